"""Texts whose word shingles are alike, beyond the few bits by which fingerprints may differ.

1. MinHash: of each text's set of five-word shingles, BANDS keys of ROWS minima each. Two texts with Jaccard similarity
   0.8 share no key with probability (1 - 0.8 ** 4) ** 24 = 3e-6, and less above it.
2. Keys under which more than one component stands are groups; of equal groups one is kept.
3. Each group's sets are compared exactly; a crowded group in blocks of which each two meet. A text is compared with texts of other components only, and components that
   are alike become one, so a large group of near copies is not compared pair by pair.

Defined results: null and empty texts are similar to nothing; fewer words than a shingle make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.scratch import Scratch
from tessera.llm.worker import lean

BANDS, ROWS = 24, 4
#: Bytes of text whose shingles are hashed at once.
RUN = 1 << 19


def shingles(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): the shingles of each text with a word, by text."""
    n = np.diff(w.first)
    whole = W.rolling(w.key, size)
    own = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(own[size - 1 :] == own[: len(whole)]) if len(whole) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < size))
    rest = [W.rolling(w.key[w.of(i)], int(n[i])) for i in short]
    hashes, owner = np.concatenate([whole[at], *rest]), np.concatenate([own[at], short])
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def band_keys(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BANDS keys of each)."""
    texts, starts = np.unique(owner, return_index=True)
    out = np.zeros((len(texts), BANDS), np.uint64)
    if not len(texts):
        return texts, out
    factors = np.random.default_rng(17).integers(1 << 62, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    for k, factor in enumerate(factors):
        band = k // ROWS
        low = np.minimum.reduceat((hashes ^ (factor >> np.uint64(7))) * factor, starts)
        out[:, band] = W.mix((out[:, band] if k % ROWS else np.uint64(band + 1)) ^ W.mix(low))
    return texts, out


def _shingle_set(text: str | None, size: int) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.unique(shingles(W.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True), size)[0])


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is `least` or more."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both)


class Postings:
    """Which of a group's texts have each shingle; texts are added one by one."""

    def __init__(self, sets: list[np.ndarray]):
        every, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        ends = np.cumsum(self.sizes)
        self.codes = [code[a:b] for a, b in zip(ends - self.sizes, ends, strict=True)]
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.texts = owner[np.argsort(code, kind="stable")]  # by shingle, then by text
        self.start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(every)))])
        self.filled = self.start[:-1].copy()

    def add(self, i: int) -> None:
        self.filled[self.codes[i]] += 1

    def alike(self, i: int, least: float) -> np.ndarray:
        """The texts added so far whose similarity with text i is `least` or more."""
        low, n = self.start[self.codes[i]], self.filled[self.codes[i]] - self.start[self.codes[i]]
        hits = self.texts[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.bincount(hits, minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (both >= least * (self.sizes[i] + self.sizes - both)))


def merged(components: list[int], sets: list[np.ndarray], least: float, few: int = 64) -> list[tuple[int, int]]:
    """Pairs of components that connect all that have similar sets.

    A text is compared with those of other components only: one by one where these are `few`, else by counting what
    it shares with each.
    """
    clusters: dict[int, list[int]] = {}
    up: dict[int, int] = {}
    out = []

    def find(c: int) -> int:
        while up.setdefault(c, c) != c:
            c = up[c]
        return c

    def join(root: int, other: int) -> None:
        out.append((root, other))
        up[other] = root
        clusters[root] = clusters.get(root, []) + clusters.pop(other)

    postings = Postings(sets)
    for i, component in enumerate(components):
        root = find(component)
        if sum(len(v) for c, v in clusters.items() if c != root) <= few:
            for other in [c for c in clusters if c != root]:
                if any(similar(sets[i], sets[j], least) for j in clusters[other]):
                    join(root, other)
        else:
            for j in postings.alike(i, least).tolist():
                if (other := find(components[j])) != root:
                    join(root, other)
        clusters.setdefault(root, []).append(i)
        postings.add(i)
    return out


def dealt(members: DataFrame, crowded: int) -> DataFrame:
    """members (k, text_hash, ...) with block: groups of more than `crowded` are cut into blocks, and each two blocks meet."""
    many = members.groupBy("k").count().filter(F.col("count") > crowded).select("k", F.ceil(2 * F.col("count") / crowded).alias("n"))
    own = F.pmod(F.xxhash64("text_hash"), F.col("n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("n") - 1, F.lit(0).cast("long")))).alias("other")
    rows = members.join(many, "k", "left").select(*members.columns, own.alias("own"), other)
    block = F.when(F.col("own").isNotNull(), F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    return rows.select(*members.columns, block.alias("block"))


def links(docs: DataFrame, found: DataFrame, scratch: Scratch, least: float = 0.8, size: int = 5, crowded: int = 4096) -> DataFrame:
    """(a, b): pairs of components that connect all with texts of similarity `least` or more.

    found: (text_hash, component) of the texts of docs. A task compares about `crowded` texts at most.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in rows:
            data, offsets = W.buffers(b.column("text"))
            hashes = b.column("text_hash").to_numpy(zero_copy_only=False)
            for lo, hi in W.runs(offsets, RUN):
                w = W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
                texts, keys = band_keys(*shingles(w, size))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[lo:hi][texts]), lists], ["text_hash", "keys"])

    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    known = found.groupBy("text_hash").agg(F.min("component").alias("component"))
    marked = texts.mapInArrow(run, "text_hash long, keys array<long>").dropDuplicates(["text_hash"]).join(known, "text_hash")
    entries = scratch.keep(marked, "bands").select("text_hash", "component", F.explode("keys").alias("k"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("text_hash").cast("decimal(38,0)")).alias("h"), F.min("component").alias("low"), F.max("component").alias("high")]
    groups = entries.groupBy("k").agg(*sums).filter("low < high").groupBy("n", "h", "low", "high").agg(F.min("k").alias("k")).select("k")
    members = scratch.keep(entries.join(groups, "k").distinct(), "alike")
    wanted = texts.join(members.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("text_hash", "ascending")])
        pairs = merged(table.column("component").to_pylist(), [_shingle_set(t.as_py(), size) for t in table.column("text")], least)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return dealt(members, crowded).join(wanted, "text_hash").groupBy("k", "block").applyInArrow(compare, "a long, b long").distinct()
