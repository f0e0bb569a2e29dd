"""Operator 5, SimHash near-duplicates by multi-index hashing.

1. Each text's fingerprint: the majority of the bits of its shingles' hashes.
2. Equal fingerprints become one row with their smallest doc_id, so copies cost nothing further.
3. The fingerprint is cut into segments. Of two fingerprints at `distance` bits at most, some segment differs
   in at most distance // segments bits. Each fingerprint is stored under its key in each segment's table and
   probes the keys of the small Hamming ball around its own; of two keys the smaller one probes the larger,
   so each pair meets once. Complete distances of what a probe finds are verified.
4. A table's key that more than `crowded` fingerprints share is not paired up. Fingerprints that store or
   probe such a key meet at midpoints instead: two lie within `distance` bits (an even number) exactly if
   some value lies within distance / 2 bits of both. Each value links its fingerprints to the
   smallest of them: no pairs, no cap, and no link between different components is lost.
5. Links become components by alternating star contraction, each round written to the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle; rows with equal doc_id each keep their row; a component of null doc_ids only has a
null component_id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import similar
from tessera.llm.scratch import Scratch
from tessera.llm.worker import lean

BITS = 64
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 14
#: Distinct fingerprints up to which a 21-bit key has few of them (64 on average).
DENSE = 1 << 27


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned. bytes.split() cuts at exactly [\\x20\\x09-\\x0D]."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in rows:
            out = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(out)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n segments."""
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(distinct: DataFrame, scratch: Scratch, distance: int = 4, segments: int = 3, crowded: int = 256) -> DataFrame:
    """(a, b), a < b: pairs of fingerprints that connect all that lie within `distance` bits."""
    if distance % 2:
        raise ValueError("distance must be even")
    fp, radius = F.col("fp"), distance // segments

    def key(nth: int, shift: int, width: int) -> Column:
        return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(nth << 40))

    def ball(nth: int, shift: int, width: int) -> Column:
        own = key(nth, shift, width)
        around = F.transform(F.array(*(F.lit(m) for m in _masks(width, radius))), lambda m: own.bitwiseXOR(m))
        return F.filter(around, lambda x: x >= own)

    cuts = _segments(segments)
    if max(w for _, w in cuts) > 40:
        raise ValueError("segments are wider than 40 bits")
    entries = distinct.select("fp", F.explode(F.array(*(key(i, *c) for i, c in enumerate(cuts)))).alias("k"))
    probes = distinct.select("fp", F.explode(F.concat(*(ball(i, *c) for i, c in enumerate(cuts)))).alias("k"))
    crowds = scratch.keep(entries.groupBy("k").count().filter(F.col("count") > crowded).select("k"), "crowds")
    stored = entries.join(crowds, "k", "left_anti").select("k", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    found = probes.join(stored, "k").filter(near & (F.col("fp") != F.col("b"))).select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b"))
    crowd = probes.join(crowds, "k", "left_semi").select("fp").distinct()
    return found.unionByName(midpoints(crowd, distance))


def midpoints(crowd: DataFrame, distance: int) -> DataFrame:
    """(a, b) of the fingerprints of a crowd: each linked to the smallest that shares a midpoint with it."""
    near = [_long(m) for m in _masks(BITS, distance // 2)]
    at = crowd.select("fp", F.explode(F.transform(F.array(*(F.lit(m) for m in near)), lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    least = at.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter(F.col("a") < F.col("top")).select("z", "a")
    return at.join(least, "z").filter(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")).distinct()


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for each node of pairs (a, b): label is the smallest node reachable."""
    edges = scratch.keep(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    while True:
        # large star: link each larger neighbour of a node to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: link each smaller neighbour, and the node, to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        after = scratch.keep(linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        same = _digest(after) == _digest(edges)
        scratch.forget(edges)
        edges = after
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 4, seed: int = 42, distance: int = 4, segments: int | None = None, crowded: int = 256) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of each row: component_id is the smallest doc_id reachable.

    component: the smallest fingerprint reachable.

    segments: 3 tables of 21 bits serve up to DENSE fingerprints, 2 of 32 bits more; any number finds all links.
    """
    marked = scratch.keep(fingerprints(docs, size, seed), "fingerprints")
    distinct = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    if segments is None:
        segments = 3 if distinct.count() <= DENSE else 2
    label = components(links(distinct.select("fp"), scratch, distance, segments, crowded), scratch)
    owner = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    least = owner.groupBy("label").agg(F.min("low").alias("component_id"))
    owner = owner.join(least, "label").select("fp", F.col("label").alias("component"), "component_id")
    return marked.join(owner, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def representatives(docs: DataFrame, scratch: Scratch, similarity: float | None = None, **how) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; nulls come last.

    Of rows with that doc_id the one with the smallest hash of its text stays, of equal rows any one.
    With `similarity`, texts whose five-word shingles are so similar are near-duplicates too, whatever their fingerprints.
    """
    found = near_duplicates(docs, scratch, **how)
    if similarity is not None:
        found = scratch.keep(found.select("doc_id", "text_hash", "component"), "components")
        label = components(similar.links(docs, found, scratch, similarity), scratch)
        found = found.join(label, F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("label", "component"))
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("o")
    chosen = found.groupBy("component").agg(order).select(F.col("o.doc_id").alias("__id"), F.col("o.text_hash").alias("__hash"))
    rows = docs.withColumns({"__i": F.col("doc_id").cast("long"), "__h": F.xxhash64("text")})
    kept = rows.join(chosen, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["__i", "__h"]).select(docs.columns)


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
