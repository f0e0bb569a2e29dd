"""Operator 6, benchmark decontamination by latent semantic retrieval.

1. Words (lower case, letters and digits) are hashed to DIMENSIONS, which are written once, two bytes a word; document
   frequencies come from all documents.
2. Texts are cut into windows of 2 * STEP words, one every STEP words. The TF-IDF windows of all
   documents and of all benchmark items make a matrix whose right singular space is found by randomised
   subspace iteration: each task multiplies its rows, blocks of the products are summed by Spark, and the driver
   only orthogonalises a DIMENSIONS x (skip + rank + 8) matrix. Items are weighted up to `share` of the energy, since they
   are what is searched for.
3. Every window of every document is projected; items whose latent cosine with it is high are candidates. The space
   has fewer directions than a large block has item windows, so cosines alone would lose items as the benchmark
   grows. A window with a word of an item's rare words is therefore a candidate for that item whatever its cosine:
   rare are so many of the least frequent words of the item that a passage without all of them cannot cover enough.
   All windows whose words reach a rare one are compared, so what is found, and its lcs and answer, does not depend on
   the space; the reported cosine does.
4. A candidate counts if the longest common subsequence of the item and the words around the window covers
   enough of the item, and of its answer where the benchmark has a column `answer`; without one there is nothing
   more to cover, and `answer` of the match is 1.

The benchmark is the stated query set. One space is fitted, on all documents and items.
Items are searched in blocks of `block`, so what goes to the tasks is bounded. One block is searched in one pass over the
documents; of more, each is a job of its own, whose matches are written before the next one starts.

Defined results: null and empty texts match nothing; so do items without words; items with fewer than `least_words` words
match where all their words stand in a row (cosine, lcs and answer 1); an item with several hits in one document gives one match, the best; rows with equal doc_id are scanned as rows of their
own; an empty table gives no rows; an input column named matches is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.scratch import Scratch, slim
from tessera.llm.worker import lean, trim

DIMENSIONS, STEP = 1 << 15, 16
MATCH = T.ArrayType(T.StructType().add("item_id", "long").add("cosine", "double").add("lcs", "double").add("answer", "double"))
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
#: Bytes of text that are projected at once.
RUN = 1 << 19
#: Words whose windows are multiplied at once.
_WORDS = 1 << 18
#: Rows that are added to each other at once; they and their sums stay in the processor's cache.
_ROWS = 512
_BLOCK = 1024
_MODULUS = 1 << 40


def _words(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    return W.words(data, offsets, W.NON_ALNUM, lower=True)


def _keys(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    return _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).key


def _dims(key: np.ndarray) -> np.ndarray:
    return (key % np.uint64(DIMENSIONS)).astype(np.int64)


def coded(texts: DataFrame) -> DataFrame:
    """Column dims: of each text the dimensions of its words, two bytes each. texts: (text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in rows:
            data, offsets = W.buffers(b.column("text"))
            dims, sizes = [np.zeros(0, "<u2")], [np.zeros(1, np.int64)]
            for lo, hi in W.runs(offsets, RUN):
                w = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                dims.append(_dims(w.key).astype("<u2"))
                sizes.append(np.diff(w.first))
            ends = 2 * np.cumsum(np.concatenate(sizes))  # no more than the bytes of the texts
            column = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(dims))])
            yield pa.RecordBatch.from_arrays([column], ["dims"])

    return texts.mapInArrow(run, "dims binary")


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimensions, words of each text) of about _WORDS words of a column made by coded()."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    dims = (np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)).view("<u2")
    first = (offsets - offsets[0]) // 2
    for lo, hi in W.runs(first, _WORDS):
        yield dims[first[lo] : first[hi]], np.diff(first[lo : hi + 1])


def _by_dimension(dims: np.ndarray) -> np.ndarray:
    return np.argsort(dims.astype(np.int16), kind="stable")  # sixteen bits: sorted by radix


def frequencies(words: DataFrame, least: int = 1) -> tuple[np.ndarray, int, int]:
    """Texts that have a word of each dimension, the number of texts, and of windows of those of `least` words and more. words: of coded()."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total, n, windows = np.zeros(DIMENSIONS, np.int64), 0, 0
        for b in rows:
            n += b.num_rows
            for dims, long in _runs(b.column("dims")):
                order = _by_dimension(dims)
                some, text = dims[order].astype(np.int64), np.repeat(np.arange(len(long)), long)[order]
                total += np.bincount(some[(np.diff(some, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)], minlength=DIMENSIONS)
                windows += int(np.maximum(1, -(-long[long >= least] // STEP) - 1).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(total[some], [n, windows]))], ["dim", "n"])

    got = words.mapInArrow(count, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()  # DIMENSIONS + 2 rows at most
    dim, n = (got.column(c).to_numpy() for c in ("dim", "n"))
    out = np.zeros(DIMENSIONS, np.int64)
    out[dim[dim >= 0]] = n[dim >= 0]
    return out, int(n[dim == -1].sum()), int(n[dim == -2].sum())


def _windows(key: np.ndarray) -> list[np.ndarray]:
    return [key[i : i + 2 * STEP] for i in range(0, max(1, len(key) - STEP), STEP)] if len(key) else []


def _projection(basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return basis * idf[:, None]


def _joined(keys: list[np.ndarray]) -> W.Words:
    """Texts of which only the hashes of their words are known."""
    none = np.zeros(0, np.int64)
    return W.Words(none, none, none, np.concatenate([np.zeros(0, np.uint64), *keys]), np.cumsum([0, *map(len, keys)]))


def _sums(values: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the next so many `rows` of values, for each of counts, all above 0.

    Of many stretches of at most STEP rows the first rows are copied together, then the second ones added to them, and so
    on, without a copy of all rows; sums of stretches are summed again. ufunc.reduceat takes many times as long.
    """
    stretches = -(-counts // STEP)
    last = np.cumsum(stretches) - 1
    n = int(stretches.sum())
    long = np.full(n, STEP)
    long[last] = counts - (stretches - 1) * STEP
    order = np.argsort((STEP - long).astype(np.int8), kind="stable")
    first = (np.cumsum(long) - long)[order]
    longer = np.cumsum(np.bincount(long, minlength=STEP + 1)[::-1])[::-1]  # stretches of so many rows and more
    out = np.empty((n, values.shape[1]), values.dtype)
    total, more = np.empty((2, min(n, _ROWS), values.shape[1]), values.dtype)
    for lo in range(0, n, _ROWS):
        at = first[lo : lo + _ROWS]
        np.take(values, rows[at], axis=0, out=total[: len(at)], mode="clip")  # other modes copy once more
        for k in range(1, STEP):
            m = min(len(at), int(longer[k + 1]) - lo)
            if m <= 0:
                break
            np.take(values, rows[at[:m] + k], axis=0, out=more[:m], mode="clip")
            total[:m] += more[:m]
        out[order[lo : lo + _ROWS]] = total[: len(at)]
    if n == len(counts):
        return out
    many = stretches > 1
    sums = out[last]
    sums[many] = _sums(out, np.flatnonzero(np.repeat(many, stretches)), stretches[many])
    return sums


def gram(w: W.Words, least: int, idf: np.ndarray, project: np.ndarray, total: np.ndarray) -> None:
    """Adds A' A basis to total, but for a factor idf of each row: A the TF-IDF windows, of unit length, of texts of `least` words and more.

    A window is two blocks of STEP words, or a whole text of one block. project: idf times basis.
    """
    _gram(_dims(w.key), np.diff(w.first), least, idf, project, total)


def _gram(dims: np.ndarray, long: np.ndarray, least: int, idf: np.ndarray, project: np.ndarray, total: np.ndarray) -> None:
    """gram() of texts of which dims are the words' dimensions and long the numbers of words."""
    if (long < least).any():
        dims = dims[np.repeat(long >= least, long)]
        long = long[long >= least]
    long = long[long > 0]
    if not len(long):
        return
    blocks = -(-long // STEP)
    last = np.cumsum(blocks) - 1
    n = int(last[-1]) + 1
    sizes = np.full(n, STEP)
    sizes[last] = long - (blocks - 1) * STEP
    at = np.cumsum(sizes) - sizes
    sums, squares = _sums(project, dims, sizes), np.add.reduceat(idf[dims] ** 2, at)
    follows = np.ones(n, bool)  # a block of the same text follows
    follows[last] = False
    before = np.flatnonzero(follows)
    both, norm = sums.copy(), squares.copy()
    both[before] += sums[before + 1]
    norm[before] += squares[before + 1]
    both /= np.maximum(1e-18, norm)[:, None]
    both[last[blocks > 1]] = 0  # the last of several blocks starts no window
    both[before + 1] += both[before]  # of a text each block gets the window that it starts and the one before
    order = _by_dimension(dims)
    some = dims[order].astype(np.int64)
    starts = np.flatnonzero(np.diff(some, prepend=-1))
    total[some[starts]] += _sums(both, np.repeat(np.arange(n), sizes)[order], np.diff(starts, append=len(dims)))


def singular_space(docs: DataFrame, windows: int, items: DataFrame | list[np.ndarray], own: int, least: int, idf: np.ndarray, rank: int, skip: int, share: float, rounds: int, seed: int) -> np.ndarray:
    """DIMENSIONS x rank: right singular vectors of the documents' and the items' windows, but for the first `skip`.

    The first ones tell languages apart and hold what all texts share; they make unlike texts look alike. Few items
    have few such directions: at most one for 25 windows is left out.
    docs: of coded(). windows, own: of the documents and of the items of `least` words and more. items: of coded(), or their words.
    """
    if not own:
        return np.zeros((DIMENSIONS, rank), np.float32)
    skip = min(skip, own // 25)
    weight = max(1.0, float(windows)) / own * share / (1 - share)
    width = skip + rank + 8
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((DIMENSIONS, width), np.float32))[0]

    few = 2 * docs.sparkSession.sparkContext.defaultParallelism  # each task sends a whole matrix, so tasks don't grow with the documents
    docs = docs.coalesce(few)

    def multiply(basis: np.ndarray, weight: float, least: int):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            project, total = _projection(basis, idf), np.zeros_like(basis)
            for b in rows:
                for dims, long in _runs(b.column("dims")):
                    _gram(dims, long, least, idf, project, total)
            total *= (idf * np.float32(weight))[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(range(0, DIMENSIONS, _BLOCK), pa.int64()), pa.array([total[i : i + _BLOCK].tobytes() for i in range(0, DIMENSIONS, _BLOCK)], pa.binary())], ["at", "part"])

        return run

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK * width)
        for x in table.column("part"):
            total += np.frombuffer(x.as_buffer(), np.float32)
        return pa.table({"at": table.column("at").slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    for k in range(rounds):
        parts = docs.mapInArrow(multiply(basis, 1.0, 1), "at long, part binary")
        product = np.zeros_like(basis)
        if isinstance(items, list):
            gram(_joined(items), least, idf, _projection(basis, idf), product)
            product *= (idf * np.float32(weight))[:, None]
        else:
            parts = parts.unionByName(items.coalesce(few).mapInArrow(multiply(basis, weight, least), "at long, part binary"))
        for r in parts.groupBy("at").applyInArrow(add, "at long, part binary").collect():  # one matrix in all
            product[r["at"] : r["at"] + _BLOCK] += np.frombuffer(r["part"], np.float32).reshape(-1, width)
        del parts
        slim(docs.sparkSession)  # or the matrices of all rounds stay on disk
        if k + 1 < rounds:
            basis = np.linalg.qr(product)[0]
    values, turn = np.linalg.eigh((basis.T @ product).astype(np.float64))
    trim()
    return (basis @ turn[:, np.argsort(-values)[skip : skip + rank]]).astype(np.float32)


@dataclass
class Index:
    """Latent windows of a block of items, and what verification needs."""

    project: np.ndarray  # DIMENSIONS x rank: idf times singular vectors
    latent: np.ndarray  # rank x windows, unit columns
    owner: np.ndarray  # item of each window
    item_ids: list[int]
    keys: list[np.ndarray]
    answers: list[np.ndarray]
    rare: np.ndarray  # sorted rare words of all items
    rare_first: np.ndarray  # where the items of each rare word start in rare_items
    rare_items: np.ndarray
    rare_dims: np.ndarray  # whether a dimension has a rare word
    short: list[tuple[int, np.ndarray]]  # items of a few words
    known: np.ndarray = field(init=False)  # sorted words of all items
    known_dims: np.ndarray = field(init=False)
    masks: list[dict[int, int]] = field(init=False)
    answer_masks: list[dict[int, int]] = field(init=False)

    def __post_init__(self) -> None:
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.keys]))
        self.known_dims = _has(self.known)
        self.masks, self.answer_masks = [masks_of(k) for k in self.keys], [masks_of(k) for k in self.answers]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "known_dims", "masks", "answer_masks")}  # small on its way to the tasks

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def _has(words: np.ndarray) -> np.ndarray:
    """Whether a dimension has one of the words."""
    out = np.zeros(DIMENSIONS, bool)
    out[_dims(words)] = True
    return out


def rare_words(keys: list[np.ndarray], frequency: np.ndarray, lcs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first, items, dimensions): of each item one word more than a passage that covers `lcs` of it may lack."""
    own = [np.unique(k[np.argsort(frequency[_dims(k)], kind="stable")[: len(k) - int(np.ceil(lcs * len(k) - 1e-9)) + 1]]) for k in keys]
    words, items = np.concatenate([np.zeros(0, np.uint64), *own]), np.repeat(np.arange(len(own)), [len(k) for k in own])
    order = np.argsort(words, kind="stable")
    rare, first = np.unique(words[order], return_index=True)
    return rare, np.append(first, len(words)), items[order], _has(rare)


def code(items: list[tuple[int, str, str | None]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(id, words, words of the answer) of the items that have words."""
    coded = [(i, _keys(t or ""), _keys(a or "")) for i, t, a in items]
    return [c for c in coded if len(c[1])]


def build(coded: list[tuple[int, np.ndarray, np.ndarray]], space: np.ndarray, idf: np.ndarray, frequency: np.ndarray, least_words: int, lcs: float) -> Index:
    short = [(i, k) for i, k, _ in coded if len(k) < least_words]
    coded = [c for c in coded if len(c[1]) >= least_words]
    windows = [(n, w) for n, (_, k, _) in enumerate(coded) for w in _windows(k)]
    project = space * idf[:, None]
    rank = space.shape[1]
    latent = _unit(np.array([project[_dims(w)].sum(axis=0) for _, w in windows], np.float32).reshape(len(windows), rank))
    return Index(project, latent.T.copy(), np.array([n for n, _ in windows], np.int64), [c[0] for c in coded], [c[1] for c in coded], [c[2] for c in coded], *rare_words([c[1] for c in coded], frequency, lcs), short)


def masks_of(pattern: np.ndarray) -> dict[int, int]:
    """Bits of the places of each word of a pattern."""
    masks: dict[int, int] = {}
    for i, k in enumerate(pattern.tolist()):
        masks[k] = masks.get(k, 0) | 1 << i
    return masks


def common(masks: dict[int, int], size: int, text: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence, bit-parallel; 0 if too few words are common for `least`."""
    hits = [masks[k] for k in text if k in masks]
    if len(hits) < least:
        return 0
    full = v = (1 << size) - 1
    for m in hits:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _places(words: np.ndarray, has: np.ndarray, w: W.Words, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, which one) of the sorted words in texts."""
    at = np.flatnonzero(has[dims])
    nth = np.minimum(np.searchsorted(words, w.key[at]), len(words) - 1)
    same = words[nth] == w.key[at]
    return at[same], nth[same]


def _rare_hits(index: Index, w: W.Words, dims: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) of the rare words of items in texts, by window, then item."""
    at, nth = _places(index.rare, index.rare_dims, w, dims)
    n = index.rare_first[nth + 1] - index.rare_first[nth]
    items = index.rare_items[np.repeat(index.rare_first[nth] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    pairs = np.unique(np.repeat(windows[at], n) * len(index.keys) + items)
    return pairs // len(index.keys), pairs % len(index.keys)


def _short_hits(index: Index, w: W.Words) -> Iterator[tuple[int, int]]:
    """(text, item id) of the short items whose words stand in a row."""
    if not index.short:
        return
    leads = np.unique(np.array([k[0] for _, k in index.short]))
    at = np.flatnonzero(np.isin(w.key, leads))
    end = w.first[1:][np.searchsorted(w.first, at, "right") - 1]
    for item, key in index.short:
        here = at[(w.key[at] == key[0]) & (at + len(key) <= end)]
        for k in range(1, len(key)):
            here = here[w.key[here + k] == key[k]]
        for d in np.unique(np.searchsorted(w.first, here, "right") - 1).tolist():
            yield d, item


def search(index: Index, w: W.Words, cosine: float, lcs: float, answer: float) -> list[list[dict]]:
    """Matches of each text."""
    n_docs = len(w.first) - 1
    out: list[list[dict]] = [[] for _ in range(n_docs)]
    for d, item in _short_hits(index, w):
        out[d].append({"item_id": item, "cosine": 1.0, "lcs": 1.0, "answer": 1.0})
    if not len(w.key) or not len(index.owner):
        return out
    per = np.diff(w.first)
    blocks = -(-per // STEP)
    first = np.concatenate([[0], np.cumsum(blocks)])
    doc = np.repeat(np.arange(n_docs), blocks)
    starts = w.first[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc]) * STEP
    sizes = np.full(len(doc), STEP)
    some = blocks > 0
    sizes[first[1:][some] - 1] = per[some] - (blocks[some] - 1) * STEP
    dims = _dims(w.key)
    sums = _sums(index.project, dims, sizes)
    follows = np.flatnonzero(np.arange(first[-1]) + 1 < first[doc + 1])
    windows = sums.copy()
    windows[follows] += sums[follows + 1]
    near = _unit(windows) @ index.latent
    best: dict[tuple[int, int], dict] = {}
    longest = max(map(len, index.keys))
    edges = np.searchsorted(index.owner, np.arange(len(index.keys) + 1))
    done: set[tuple[int, int]] = set()
    known = _places(index.known, index.known_dims, w, dims)[0]
    known_key = w.key[known]  # other words are of no item
    known_before = np.zeros(len(w.key) + 1, np.int64)
    known_before[known + 1] = 1
    known_before = known_before.cumsum()

    def items_words(lo: int, hi: int) -> set[int]:
        """The words at these places that items have."""
        return set(known_key[known_before[lo] : known_before[hi]].tolist())

    def verify(r: int, item: int, d: int, key: list[int]) -> None:
        if (r, item) in done:
            return
        done.add((r, item))
        size, own, at = len(index.keys[item]), index.masks[item], int(starts[r] - w.first[d])
        around = key[max(0, at - size) : at + 2 * STEP + size]
        covered = common(own, size, around, lcs * size) / size
        former = best.get((d, item), {"lcs": 0, "answer": 0})
        if covered >= lcs and covered >= former["lcs"]:
            answers = len(index.answers[item])
            found = common(index.answer_masks[item], answers, around) / answers if answers else 1.0
            if found >= answer and (covered, found) > (former["lcs"], former["answer"]):
                best[d, item] = {"item_id": index.item_ids[item], "cosine": float(near[r, edges[item] : edges[item + 1]].max()), "lcs": covered, "answer": found}

    def candidates(rows: np.ndarray, items: np.ndarray, reach: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(window, item, text, its words) where enough of the item's words are near; by window, then item."""
        pairs, nth = np.unique(doc[rows] * len(index.keys) + items, return_inverse=True)
        enough, last, every = np.zeros(len(pairs), bool), -1, set()
        for n, pair in enumerate(pairs.tolist()):
            d, item = divmod(pair, len(index.keys))
            if last != d:
                every, last = items_words(w.first[d], w.first[d + 1]), d
            own, size = index.masks[item].keys(), len(index.keys[item])
            enough[n] = len(own & every) + size - len(own) >= lcs * size
        some = enough[nth]
        last, window, key, near_words = -1, -1, [], set()
        for r, item in zip(rows[some].tolist(), items[some].tolist(), strict=True):
            d = int(doc[r])
            if window != r:
                at, window = int(starts[r]), r
                near_words = items_words(max(w.first[d], at - reach * longest - (reach - 1) * 2 * STEP), min(w.first[d + 1], at + reach * (2 * STEP + longest)))
            own, size = index.masks[item].keys(), len(index.keys[item])
            if len(own & near_words) + size - len(own) >= lcs * size:
                if last != d:
                    key, last = w.key[w.of(d)].tolist(), d
                yield r, item, d, key

    alike, column = np.divmod(np.flatnonzero(near >= cosine), near.shape[1])
    for r, item, d, key in candidates(alike, index.owner[column], 1):
        verify(r, item, d, key)
    # of an item's passage some rare word is in the text, so the windows around each one are all that can match, whatever the cosine
    for r, item, d, key in candidates(*_rare_hits(index, w, dims, np.repeat(np.arange(len(doc)), sizes)), 2):
        size = len(index.keys[item])
        lo, hi = max(int(first[d]), r - (2 * STEP - 1 + size) // STEP), min(int(first[d + 1]) - 1, r + (STEP - 1 + size) // STEP)
        if all((k, item) in done for k in range(lo, hi + 1)):
            continue
        stretch = key[max(0, int(starts[lo] - w.first[d]) - size) : int(starts[hi] - w.first[d]) + 2 * STEP + size]
        if common(index.masks[item], size, stretch, lcs * size) >= lcs * size:
            for k in range(lo, hi + 1):
                verify(k, item, d, key)
    for (d, _), match in best.items():
        out[d].append(match)
    return out


def scan(docs: DataFrame, index: Index, cosine: float, lcs: float, answer: float) -> DataFrame:
    """The documents with column matches; matches that it already has stay."""
    columns = [c for c in docs.columns if c != "matches"]
    schema = docs.select(columns).schema.add("__found", MATCH)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in rows:
            data, offsets = W.buffers(b.column("text"))
            found: list[list[dict]] = []
            for lo, hi in W.runs(offsets, RUN):
                found += search(index, _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), cosine, lcs, answer)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _MATCH)], [*b.schema.names, "__found"])

    return docs.select(columns).mapInArrow(run, schema).withColumnRenamed("__found", "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, rank: int = 64, skip: int = 8, cosine: float = 0.5, lcs: float = 0.7, answer: float = 0.5, least_words: int = 5, sample_documents: int | None = None, share: float = 0.8, block: int = 4096, rounds: int = 3, seed: int = 11) -> DataFrame:
    """The documents with column matches: (item_id, cosine, lcs, answer) of each item found in them.

    The space is fitted on all documents and items; on about `sample_documents` documents where that is given.
    """
    docs = docs.drop("matches")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    fitted = coded(texts) if sample_documents is not None else scratch.keep(coded(texts), "words")
    frequency, n, windows = frequencies(fitted)
    if sample_documents is not None:  # only the singular space is fitted on these; frequencies and the search cover all documents
        fitted = scratch.keep(coded(texts.filter(F.pmod(F.xxhash64("text"), F.lit(_MODULUS)) < math.ceil(_MODULUS * min(1.0, sample_documents / max(1, n))))), "words")
        windows = frequencies(fitted)[2]
    answers = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answers.alias("answer"))
    blocks = max(1, -(-items.count() // block))

    def some(k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        return code([tuple(r) for r in rows.orderBy("item_id", "text").collect()])  # about `block` items

    idf = (np.log((n + 1) / (frequency + 1)) + 0.05).astype(np.float32)
    if blocks == 1:
        first = some(0)
        given = [k for _, k, _ in first if len(k) >= least_words]
        own = sum(max(1, -(-len(k) // STEP) - 1) for k in given)
    else:
        given = coded(items.select("text"))
        own = frequencies(given, least_words)[2]
    space = singular_space(fitted, windows, given, own, least_words, idf, rank, skip, share, rounds, seed)
    scratch.forget(fitted)

    def searched(rows: DataFrame, coded: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
        return scan(rows, build(coded, space, idf, frequency, least_words, lcs), cosine, lcs, answer)

    if blocks == 1:
        return searched(docs, first)
    rows_of = docs.select(F.col("doc_id").cast("long").alias("__i"), F.xxhash64("text").alias("__h"), F.col("text").cast("string").alias("text"))
    found = None
    for k in range(blocks):
        part = scratch.keep(searched(rows_of, some(k)).filter(F.size("matches") > 0).select("__i", "__h", "matches").distinct(), "found")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("__i", "__h").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    rows = docs.withColumns({"__i": F.col("doc_id").cast("long"), "__h": F.xxhash64("text")}).alias("d")
    same = F.col("d.__i").eqNullSafe(F.col("f.__i")) & (F.col("d.__h") == F.col("f.__h"))
    return rows.join(found.alias("f"), same, "left").select(*(F.col(f"d.{c}") for c in docs.columns), F.coalesce("f.matches", F.array().cast(MATCH)).alias("matches"))
