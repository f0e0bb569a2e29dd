"""Scoring of feature vectors with a forest, thresholds, votes and confusion counts."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's forests are at most this deep.
DEEPEST = 30
#: Thresholds of the single-file interface and of the scorer.
FILE_THRESHOLD, SCORER_THRESHOLD = 0.7, 0.29


def forest(trees: int = 500, depth: int = DEEPEST, seed: int = 0) -> RandomForestClassifier:
    """The untrained classifier of features and label."""
    return RandomForestClassifier(numTrees=trees, maxDepth=min(depth, DEEPEST), seed=seed, featuresCol="features", labelCol="label")


def feature_vector(lexical: Column, shares: Column, size: int) -> Column:
    """Lexical numbers, then shares (a map of index to share) spread over size places."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(shares, i.cast("long")), F.lit(0.0)))
    return array_to_vector(F.concat(lexical.cast("array<double>"), spread))


def predicted(probability: Column, threshold: float) -> Column:
    """Malicious from the threshold on."""
    return F.when(probability >= threshold, "malicious").otherwise("benign")


def score(features: DataFrame, model: RandomForestClassificationModel, threshold: float = SCORER_THRESHOLD) -> DataFrame:
    """Features with probability (of malicious) and predicted."""
    out = model.transform(features).withColumn("p", vector_to_array("probability")[1])
    return out.select(*features.columns, F.col("p").alias("probability"), predicted(F.col("p"), threshold).alias("predicted"))


def verdict(probability: Column, threshold: float = FILE_THRESHOLD) -> Column:
    """Of a single file, by the threshold of files; a file without features has none."""
    return F.when(probability.isNotNull(), predicted(probability, threshold))


def votes(scored: DataFrame, model: RandomForestClassificationModel, threshold: float = SCORER_THRESHOLD) -> DataFrame:
    """Scored with agreeing, the trees whose own thresholded verdict is the forest's, and trees."""
    out = scored.withColumn("agreeing", F.lit(0))
    for tree in model.trees:
        tree.setFeaturesCol("features").setPredictionCol("__v").setProbabilityCol("__p").setRawPredictionCol("__r")
        own = predicted(vector_to_array("__p")[1], threshold)
        out = tree.transform(out).withColumn("agreeing", F.col("agreeing") + (own == F.col("predicted")).cast("int")).drop("__v", "__p", "__r")
    return out.withColumn("trees", F.lit(model.getNumTrees))


def confusion(rows: DataFrame) -> DataFrame:
    """Tn, fp, fn, tp and accuracy of label and predicted; all null if any label is unknown ('?')."""
    pair = lambda a, b: F.count_if((F.col("label") == a) & (F.col("predicted") == b))
    known = ~F.coalesce(F.bool_or(F.col("label") == "?"), F.lit(False))
    counts = {"tn": ("benign", "benign"), "fp": ("benign", "malicious"), "fn": ("malicious", "benign"), "tp": ("malicious", "malicious")}
    right = F.count_if(F.col("label") == F.col("predicted"))
    return rows.agg(*(F.when(known, pair(*ab)).alias(k) for k, ab in counts.items()), F.when(known, F.try_divide(right, F.count(F.lit(1)))).alias("accuracy"))


def obfuscated_packages(files: DataFrame) -> DataFrame:
    """(package, obfuscated, files) from files (package, path, predicted); null: no features, not obfuscated."""
    bad = F.col("predicted") == "malicious"
    listed = F.array_sort(F.collect_set(F.when(bad & F.col("path").endswith(".js"), F.col("path"))))
    return files.groupBy("package").agg(listed.alias("files")).select("package", (F.size("files") > 0).alias("obfuscated"), "files")


def save_features(features: DataFrame, path: str) -> None:
    """Features with names and labels, as Parquet."""
    features.write.mode("overwrite").parquet(path)


def score_saved(spark: SparkSession, path: str, model: RandomForestClassificationModel, threshold: float = SCORER_THRESHOLD) -> DataFrame:
    """O13 on saved features."""
    return score(spark.read.parquet(path), model, threshold)
