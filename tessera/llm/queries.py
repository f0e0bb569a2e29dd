"""The queries of the operators, as the entry module registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, licenses, packing, quality, rules, simhash, substrings, token_files, warc
from tessera.llm.scratch import Scratch, prepare


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, Scratch(spark, "op1")).drop("ids")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = substrings.dedup(docs, Scratch(spark, "op3"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.capture_log(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash.near_duplicates(docs, Scratch(spark, "op5"))
    return found.select("doc_id", simhash.hexadecimal(found.fp).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op6"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rules.assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    talks = scratch.keep(chat.transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "transcripts")
    model = chat.train(talks.filter(~chat.held_out(F.col("conv_id"))))
    found = chat.parse_conversations(talks, model)
    roles = F.array_join("roles", ",").alias("given_roles")
    return found.select("conv_id", "block", "style", chat.held_out(F.col("conv_id")).alias("held_out"), "n_turns", "found_roles", roles, "rendered")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = Scratch(spark, "op10").path("tokens")
    token_files.write(docs, path)
    return token_files.read(spark, path, with_ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_revisits": op4_revisits,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_license_scan": op9_license_scan,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": substrings.SQL, "op4_revisits": warc.SQL, "op7_quality_rules": rules.sql()}
