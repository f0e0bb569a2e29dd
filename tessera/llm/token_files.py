"""Operator 10, token-ID / binary output: directly addressable codes.

write() encodes documents, sorts them by doc_id and writes segments of tessera.llm.dac, one Parquet row
each (uncompressed, so a segment's bytes lie in the file as they are). The table is committed by Spark's
writer: a lost executor or a second attempt of a task leaves no half-written segment. read() gives the
documents back from the files alone, tokens_at() single ids.

Defined results: null text is an empty text (only the end id); a null doc_id sorts first; rows with equal
doc_id are kept, in order of their texts' hashes; an empty table gives an empty set of files; further
columns of the input are ignored. Whole texts of any length are held one at a time.

At scale: one range shuffle of the texts, then a pass that holds one segment. The only thing the driver
sees is the number of ids of each partition of the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.encoding import default_tokenizer, encoder

SEGMENT = "part int, segment int, start long, n_tokens long, n_documents long, body binary"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def batches(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch in runs of about `most` characters, with the place of the first."""
    at, size, run = 0, 0, []
    for i, v in enumerate(column):
        t = v.as_py()
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2, bits: int = 8, segment_tokens: int = 1 << 19) -> None:
    """Write documents (doc_id, text) to path in ascending doc_id order.

    end_id ends each document (None: nothing does). A segment is closed once it has segment_tokens ids.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        segment, base = 0, 0
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, base, keys, held, size
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])])
            body = pack_segment(held, keys, starts)
            out = [[part], [segment], [base], [size], [len(keys)], [body]]
            segment, base, keys, held, size = segment + 1, base + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "start", "n_tokens", "n_documents", "body"])

        def pack_segment(held, keys, starts):
            from tessera.llm.dac import pack

            return pack(np.frombuffer(b"".join(held), "<u4"), keys, starts, bits)

        for rows_in in rows:
            ids = rows_in.column("doc_id").to_pylist()
            for at, texts in batches(rows_in.column("text")):
                for key, x in zip(ids[at : at + len(texts)], code.encode(texts), strict=True):
                    keys.append(key)
                    held.append(x + end)
                    size += len(x) // 4 + len(end) // 4
                    if size >= segment_tokens:
                        yield close()
        if keys:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows.mapInArrow(encode, SEGMENT).write.mode("overwrite").option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


def _bases(files: DataFrame) -> tuple[dict[int, int], int]:
    """Ids before each partition of the files, and all ids."""
    base, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each partition of the files
        base[r["part"]], total = total, total + r["n"]
    return base, total


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, id) of single ids of the whole corpus, each by one look-up on each level; no segment is decoded.

    positions: counted over all documents, as `start` is; one beyond the files gives no row, a repeated one several.
    Only files of partitions that hold a position are read.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    base, total = _bases(files)
    parts, starts = list(base), np.array(list(base.values()), np.int64)
    wanted: dict[int, list[int]] = {}
    for p in positions:
        if 0 <= p < total:
            part = parts[int(np.searchsorted(starts, p, "right")) - 1]
            wanted.setdefault(part, []).append(p - base[part])

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.dac import Segment

        for batch in rows:
            for part, start, n, body in zip(*(batch.column(c) for c in ("part", "start", "n_tokens", "body")), strict=True):
                before, low = base[part.as_py()], start.as_py()
                own = [p for p in wanted[part.as_py()] if low <= p < low + n.as_py()]
                if own:
                    segment = Segment(body.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([before + p for p in own], pa.int64()), pa.array([segment[p - low] for p in own], pa.int64())], ["position", "id"])

    return files.filter(F.col("part").isin(list(wanted))).select("part", "start", "n_tokens", "body").mapInArrow(look, "position long, id long")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files.

    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    base, _ = _bases(files)

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.dac import Segment

        for batch in rows:
            for part, start, body in zip(*(batch.column(c) for c in ("part", "start", "body")), strict=True):
                segment, before = Segment(body.as_py()), base[part.as_py()] + start.as_py()
                at, n = segment.starts[:-1] + before, np.diff(segment.starts)
                raw = [segment.slice(int(a), int(b)).tobytes() for a, b in zip(segment.starts[:-1], segment.starts[1:], strict=True)]
                crc = [zlib.crc32(x) for x in raw]
                yield pa.RecordBatch.from_arrays([pa.array(segment.keys, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.select("part", "start", "body").mapInArrow(decode, TOKENS)
