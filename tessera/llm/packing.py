"""Operator 1, best-fit packing: best fit over counts of lengths, not over documents.

1. Encode each document, append the separator id, cut what is longer than a sequence (the first piece
   takes the remainder), and number the pieces of each (partition, length).
2. Collect the histogram of lengths, at most `size` numbers whatever the input, and plan: best-fit
   decreasing, where all open sequences with the same room are one run of sequence numbers. The plan says,
   for each length, which ranks go to which run of sequences, at which offset.
3. A piece's rank within its length is its number in its (partition, length) plus the counts of the
   partitions before. These are one array of `size` numbers for each partition, broadcast up to `most_parts`
   partitions (67 MB) and beyond that joined by a shuffle on the partition.
4. Pieces join the plan on length and rank; the plan's size is bounded by `size` alone (a run is split at most once
   for each length), so the plan is broadcast.

Defined results: null or empty text is a document with the separator only; rows with equal doc_id are packed
as documents of their own; an empty table gives no rows; further columns are ignored. No rows meet by length
in one task, so any number of equal lengths is fine.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.encoding import default_tokenizer, encoder
from tessera.llm.scratch import Scratch
from tessera.llm.token_files import batches

PIECES = "part int, length long, nth long, doc_id long, piece int, start long, ids_crc32 long, ids binary"
PLAN = "length long, low long, high long, first long, each long, at long"


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, low, high, first, each, at).

    Ranks low <= r < high of a length go to sequence first + (r - low) // each, at + (r - low) % each * length.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first sequence, number)
    made, out = 0, []
    for length in sorted(counts, reverse=True):
        left, low = counts[length], 0
        room = length
        while left:
            while room < size and not rooms[room]:
                room += 1
            if room < size or rooms[size]:
                first, n = rooms[room].pop()
            else:
                room = size
                first, n = made, -(-left // (size // length))
                made += n
            each = room // length
            if left >= each:
                used = min(n, left // each)
            else:
                used, each = 1, left
            taken = used * each
            out.append((length, low, low + taken, first, each, size - room))
            if n > used:
                rooms[room].append((first + used, n - used))
            if rest := room - each * length:
                rooms[rest].append((first, used))
            low, left = low + taken, left - taken
            room = length if rest >= length else room
    return out


def tokenize(docs: DataFrame, size: int, tokenizer: str, end_id: int) -> DataFrame:
    """Pieces of all documents, see PIECES."""
    end = int(end_id).to_bytes(4, "little")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        seen: dict[int, int] = defaultdict(int)
        for batch in rows:
            keys = batch.column("doc_id").to_pylist()
            for at, texts in batches(batch.column("text")):
                out: list[tuple] = []
                for key, x in zip(keys[at : at + len(texts)], code.encode(texts), strict=True):
                    x += end
                    n = len(x) // 4
                    lo, hi, piece = 0, n % size or size, 0
                    while lo < n:
                        raw = x[4 * lo : 4 * hi]
                        out.append((part, hi - lo, seen[hi - lo], key, piece, lo, zlib.crc32(raw), raw))
                        seen[hi - lo] += 1
                        lo, hi, piece = hi, hi + size, piece + 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "length", "nth", "doc_id", "piece", "start", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def bases(counts: DataFrame, size: int) -> DataFrame:
    """(part, before): how many pieces of each length, counted from 0, the partitions before have. counts: (part, length, n)."""
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("b"))

    def dense(table: pa.Table) -> pa.Table:
        out = np.zeros(size + 1, np.int64)
        out[table.column("length").to_numpy()] = table.column("b").to_numpy()
        return pa.table({"part": table.column("part").slice(0, 1), "before": pa.array([out], pa.list_(pa.int64()))})

    return rows.groupBy("part").applyInArrow(dense, "part int, before array<long>")


def pack(docs: DataFrame, scratch: Scratch, size: int = 2048, tokenizer: str | None = None, end_id: int = 0, most_parts: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of each piece of each document."""
    spark = docs.sparkSession
    pieces = scratch.keep(tokenize(docs, size, tokenizer or default_tokenizer(), end_id), "pieces", "zstd")
    counts = scratch.keep(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = F.broadcast(spark.createDataFrame(plan(histogram, size), PLAN))
    base = scratch.keep(bases(counts, size), "bases")
    base = F.broadcast(base) if base.count() <= most_parts else base.hint("merge")
    ranked = pieces.join(base, "part").withColumn("rank", F.get("before", F.col("length").cast("int")) + F.col("nth")).drop("before")
    p, s = ranked.alias("p"), slots.alias("s")
    nth = F.col("p.rank") - F.col("s.low")
    return p.join(s, (F.col("p.length") == F.col("s.length")) & nth.between(0, F.col("s.high") - F.col("s.low") - 1)).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "p.ids",
        (F.col("s.first") + F.floor(nth / F.col("s.each"))).alias("sequence_id"),
        (F.col("s.at") + nth % F.col("s.each") * F.col("p.length")).alias("offset"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of what pack() returns: whole sequences, at most `size` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.unhex(F.concat_ws("", F.transform(parts, lambda x: x["ids"]))).alias("ids"))
