"""From raw documents to packed sequences: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Each stage gets all that its predecessor kept, written as Parquet and reread. The first four return documents
with the columns they got, whatever their names; the last returns the packed pieces.

1. quality_classifier: documents whose score is below 0.3 go. Labels are learned from rows that are not held out.
2. simhash_near_dedup: one document of each group of near-duplicates stays, the one with the smallest doc_id.
   Near are fingerprints within four bits, and texts whose five-word shingles have Jaccard similarity 0.8 or more.
3. substring_dedup: words of repeated 35-word passages go; a document of which nothing is left goes.
4. benchmark_decontamination: documents in which a benchmark item is found go.
5. best_fit_packing: what is left is encoded and packed into sequences of 2048 ids.

Defined results: null and empty texts are scored like any other and have fingerprint zero, so one document stands for
them all; the third stage drops those without words. Of rows with one doc_id and text one stays. A null doc_id comes
after all others. An empty table gives an empty result. sf_dir serves the tables labels and benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, quality, simhash, substrings
from tessera.llm.scratch import Scratch

THRESHOLD = 0.3
SIMILARITY = 0.8
_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A folder for one stage. Its predecessor's goes: what that stage returned has been written by now."""
    while _open:
        last = _open.pop()
        if last.spark is spark:
            last.drop()
    _open.append(Scratch(spark, name))
    return _open[-1]


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The documents with names of further columns that clash with nothing, and the columns that give the old names back."""
    names = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(docs[f"`{c}`"].alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _scratch(spark, "quality")
    docs, back = _apart(docs)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter(F.col("score") >= THRESHOLD).select(back)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = _apart(docs)
    return simhash.representatives(docs, _scratch(spark, "simhash"), similarity=SIMILARITY).select(back)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given = docs.schema
    docs, back = _apart(docs)
    found = substrings.dedup(docs, _scratch(spark, "substrings")).filter(F.col("n_words") > F.col("n_removed"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    untouched = F.col("n_removed") == 0  # their white space stays as it is
    return found.select(*(F.when(untouched, c).otherwise(new[f.name].cast(f.dataType)).alias(f.name) if f.name in new else c for f, c in zip(given, back, strict=True)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = _apart(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark, _scratch(spark, "decontaminate"))
    return found.filter(F.size("matches") == 0).select(back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, _scratch(spark, "packing"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Models and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.forget(before)
    while _open:
        _open.pop().drop()
    return docs
