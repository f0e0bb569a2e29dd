"""Operator 3, substring dedup by compressed full-text indexes, one per shard.

A word goes if it lies in a window of `size` words whose word sequence also starts anywhere else. Streaming all
documents through the indexes of all shards would be quadratic in the shards, so equal windows are sent to one shard:

1. Each window has an anchor, the smallest hash of its `gram`-word grams. Consecutive windows with the same anchor
   in the same place form a run of at most size - gram + 1 windows. A window's anchor depends on its words only,
   so equal windows have equal anchors.
2. Anchors that occur once drop out, and with them most of the corpus: their windows can't be repeated.
3. Runs with equal words become one row with a count and the place of one of them, whose words are fetched and sent to
   a shard by anchor. So anchors and hashes only route and count; nothing is called repeated by them.
4. Each shard is indexed (tessera.llm.fm_index) and its runs are streamed through it: backward search over the
   wavelet tree gives the matching statistics, and the windows above the threshold. Words are told apart by their bytes.
5. What was found goes back to all places of each run, where a second hash over the bytes makes sure that the place
   holds the words that were searched, and the documents are cut.

Anchors with more than `crowded` different runs (the edge of a passage that very many documents share) are split:
each window of them is a sequence of its own and goes to a shard by all of its words. Nothing is dropped or capped.

Defined results: null and empty texts have no words and an empty rest; rows with equal doc_id and text count as
copies; copies in one document count, overlapping ones too; an empty table gives no rows; input columns named like
the result's are replaced. Names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.scratch import Scratch
from tessera.llm.worker import lean

RUNS = "__k1 long, __k2 long, anchor long, content long, start int, n int"
#: Symbols of a shard, about.
SHARD = 400_000
#: Low bits of a gram's hash that make way for its place when the smallest of a window is sought.
_PLACE = np.uint64(32)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the two longs that tell texts apart."""
    return docs.withColumns({"__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__k2": F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))})


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def runs_of(w: W.Words, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first word in the text, windows, anchor, content) of all runs of several texts."""
    n = len(w.key) - size + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    grams = W.rolling(w.key, gram)
    low = (np.uint64(1) << _PLACE) - np.uint64(1)  # the same for all texts, so equal windows choose alike
    least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), size - gram + 1)
    place = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    inside = np.flatnonzero(doc[:n] == doc[size - 1 :])
    if not len(inside):
        return none, none, none, none, none
    place, doc = place[inside], doc[inside]
    new = np.ones(len(inside), np.bool_)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(inside)))
    start = inside[first]
    content, long = count.astype(np.uint64), count + size - 1
    for k in range(2 * size - gram):
        some = slice(None) if k < size else np.flatnonzero(long > k)
        content[some] = W.mix(content[some] ^ w.key[start[some] + k]) * W._P
    return doc[first], start - w.first[doc[first]], count, grams[place[first]].view(np.int64), content.view(np.int64)


def runs(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """All runs of keyed documents, see RUNS."""

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in rows:
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__k1", "__k2"))
            data, offsets = W.buffers(b.column("text"))
            for lo, hi in W.runs(offsets):
                doc, start, count, anchor, content = runs_of(W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(k1[lo:hi][doc]), pa.array(k2[lo:hi][doc]), pa.array(anchor), pa.array(content), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["__k1", "__k2", "anchor", "content", "start", "n"])

    return docs.select("__k1", "__k2", "text").mapInArrow(find, RUNS)


def _digest(piece: bytes) -> int:
    """A second hash of a run, of its bytes."""
    return xxhash.xxh3_64_intdigest(piece, 29) - (1 << 63)


def _segments(docs: DataFrame, wanted: DataFrame, size: int, shards: int) -> DataFrame:
    """(shard, anchor, content, at, copies, digest, words) of the wanted runs; words: joined by one space."""
    per = wanted.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("anchor", "content", "start", "n", "copies", "split")).alias("__wanted"))
    joined = docs.select("__k1", "__k2", "text").join(per, ["__k1", "__k2"]).select("text", "__wanted")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        names = ("anchor", "content", "at", "copies", "digest", "words", "spread")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        for b in rows:
            data, offsets = W.buffers(b.column("text"))
            lists = b.column("__wanted")
            for lo, hi in W.runs(offsets):
                w = W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                odd = W.one_spaced(w)
                out: list[tuple] = []
                for d in range(lo, hi):
                    origin = int(w.first[d - lo])
                    for r in lists[d].as_py():
                        first, end = origin + r["start"], origin + r["start"] + r["n"] + size - 1
                        piece = W.passage(w, odd, first, end)
                        head = (r["anchor"], r["content"])
                        if r["split"]:
                            spread = W.rolling(w.key[first:end], size, 1).view(np.int64).tolist()
                            out += [(*head, i, r["copies"], _digest(piece), W.passage(w, odd, first + i, first + i + size), s) for i, s in enumerate(spread)]
                        else:
                            out.append((*head, 0, r["copies"], _digest(piece), piece, r["anchor"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    cuts = joined.mapInArrow(cut, "anchor long, content long, at int, copies long, digest long, words binary, spread long")
    return cuts.withColumn("shard", F.pmod(F.xxhash64("spread"), F.lit(shards)).cast("int")).drop("spread")


def _search(segments: DataFrame, size: int) -> DataFrame:
    """(anchor, content, digest, mask): bit i of mask says that window i of the run is repeated."""

    def find(table: pa.Table) -> pa.Table:
        lean()
        from tessera.llm.fm_index import repeated

        table = table.sort_by([(k, "ascending") for k in ("anchor", "content", "at")])
        anchor, content, at, copies, digest = (table.column(k).to_numpy() for k in ("anchor", "content", "at", "copies", "digest"))
        new = np.ones(len(at), np.bool_)  # a task that ran twice or equal rows of documents give a run twice
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (at[1:] != at[:-1])
        nth = np.flatnonzero(new)
        data, offsets = W.buffers(table.column("words").take(pa.array(nth)).cast(pa.string()))
        w = W.words(data, offsets)
        found = repeated(W.codes(w), np.diff(w.first), copies[nth], size)
        masks = [(i, sum(1 << j for j in (np.flatnonzero(flags) + int(at[i])).tolist())) for i, flags in zip(nth.tolist(), found, strict=True) if flags.any()]
        rows = np.array([i for i, _ in masks], np.int64)
        return pa.table({"anchor": anchor[rows], "content": content[rows], "digest": digest[rows], "mask": pa.array([m for _, m in masks], pa.int64())})

    return segments.groupBy("shard").applyInArrow(find, "anchor long, content long, digest long, mask long")


def _cut(docs: DataFrame, size: int) -> DataFrame:
    """Documents with column __found (start, n, mask, digest of each run) to documents with their words counted and cut."""
    columns = [c for c in docs.columns if c not in ("__k1", "__k2", "__found", "n_words", "n_removed", "kept_text")]
    schema = docs.select(columns).schema.add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_text", T.StringType())

    def covered(w: W.Words, found: pa.Array) -> np.ndarray:
        """Whether each word is in a repeated window."""
        ends = np.concatenate([[0], np.cumsum(np.array([len(x) if x.is_valid else 0 for x in found], np.int64))])
        flat = found.flatten()
        start, n, mask, digest = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "mask", "digest"))
        start = start + np.repeat(w.first[:-1], np.diff(ends))
        odd = W.one_spaced(w)
        for a, b, x in zip(start.tolist(), (start + n + size - 1).tolist(), digest.tolist(), strict=True):
            if _digest(W.passage(w, odd, a, b)) != x:
                raise ValueError("two different runs of words share a hash; choose another seed in tessera.llm.words")
        edge = np.zeros(len(w.start) + 1, np.int64)
        for k in range(int(n.max(initial=0))):
            at = start[(mask >> k) & 1 == 1] + k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
        return np.cumsum(edge[:-1]) > 0

    def rest(w: W.Words, offsets: np.ndarray, stay: np.ndarray) -> pa.Array:
        """The words that stay, joined by one space."""
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))[stay]
        start, end = w.start[stay], w.end[stay]
        edge = np.zeros(len(w.data) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
        follow = end[:-1][owner[:-1] == owner[1:]]  # a separator's byte, since a word of the text comes after it
        data = w.data.copy()
        data[follow] = 0x20
        keep[follow] = True
        to = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(to.tobytes()), pa.py_buffer(data[keep].tobytes())).cast(pa.string())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in rows:
            data, offsets = W.buffers(b.column("text"))
            for lo, hi in W.runs(offsets):
                local = offsets[lo : hi + 1] - offsets[lo]
                w = W.words(data[offsets[lo] : offsets[hi]], local, hashed=False)
                stay = ~covered(w, b.column("__found").slice(lo, hi - lo))
                gone = np.concatenate([[0], np.cumsum(~stay)])[w.first]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(np.diff(w.first)), pa.array(np.diff(gone)), rest(w, local, stay)], [*columns, "n_words", "n_removed", "kept_text"])

    return docs.select(*columns, "__found").mapInArrow(run, schema)


def dedup(docs: DataFrame, scratch: Scratch, size: int = 35, gram: int = 8, crowded: int = 8192) -> DataFrame:
    """The documents with n_words, n_removed and kept_text, the words that stay joined by one space."""
    if not gram <= size or 2 * size - gram > 64:
        raise ValueError("a run must fit in 64 words")
    docs = _keyed(docs.drop("__k1", "__k2", "__found"))
    every = scratch.keep(runs(docs, size, gram), "runs")
    often = scratch.keep(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    candidates = scratch.keep(every.join(often, "anchor", "left_semi"), "candidates")
    scratch.forget(every)
    place = F.min(F.struct("__k1", "__k2", "start")).alias("p")
    rows = scratch.keep(candidates.groupBy("anchor", "content", "n").agg(F.count(F.lit(1)).alias("copies"), place).select("anchor", "content", "n", "copies", "p.*"), "contents")
    crowds = rows.groupBy("anchor").count().filter(F.col("count") > crowded).select("anchor", F.lit(True).alias("split"))
    wanted = scratch.keep(rows.join(crowds, "anchor", "left").withColumn("split", F.coalesce("split", F.lit(False))), "wanted")
    symbols = wanted.agg(F.sum(F.when(F.col("split"), F.col("n") * (size + 1)).otherwise(F.col("n") + size)).alias("s")).first()["s"] or 0
    searched = _search(_segments(docs, wanted, size, max(1, -(-symbols // SHARD))), size)
    masks = scratch.keep(searched.groupBy("anchor", "content", "digest").agg(F.bit_or("mask").alias("mask")), "masks")
    found = candidates.join(masks, ["anchor", "content"]).select("__k1", "__k2", F.struct("start", "n", "mask", "digest").alias("r"))
    per = found.groupBy("__k1", "__k2").agg(F.collect_set("r").alias("__found"))
    return _cut(docs.join(per, ["__k1", "__k2"], "left"), size)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT p) AS gone FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (x)) GROUP BY rid),
places AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT places.rid, string_agg(word, ' ' ORDER BY p) AS kept FROM places LEFT JOIN gone USING (rid) WHERE gone.gone IS NULL OR NOT list_contains(gone.gone, p) GROUP BY places.rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
