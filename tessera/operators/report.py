"""Findings, their subsumption, and the report of a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses of a package.
STATUSES = ("Joern Error", "Code not Exist", "Package Json not exist", "Code has Syntactic Error", "Empty Package", "Program Error", "Benign", "Malicious", "Timeout", "Obfuscation", "GPT Error")
PHASES = ("INSTALL", "IMPORT", "RUN")


def distinct_findings(findings: DataFrame) -> DataFrame:
    """Findings (package, phase, description, ord, places) that no earlier one subsumes.

    places: (file, line) pairs. A finding goes if an earlier one of its description has the same files, and all its
    lines. Subsumption is transitive, so any earlier finding may rule one out, kept or not. Equal findings meet in one
    pre-aggregation; the others meet only where the earlier one has the later one's first place, never all by all.
    """
    key = ["package", "phase", "description"]
    places = F.array_sort(F.array_distinct("places"))
    files = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["file"])))
    rest = [c for c in findings.columns if c not in (*key, "places")]
    first = findings.select(*key, *rest, places.alias("places")).groupBy(*key, "places").agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    rows = first.select(*key, "places", "r.*", files.alias("files"))
    earlier = rows.select(*key, "files", F.col("ord").alias("o2"), F.col("places").alias("p2"), F.explode_outer("places").alias("door"))
    later = rows.select(*key, "files", "ord", "places", F.get("places", F.lit(0)).alias("door"))
    same = [later[c].eqNullSafe(earlier[c]) for c in (*key, "files", "door")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    gone = later.join(earlier, cond & (earlier["o2"] < later["ord"]) & (F.size(F.array_except(later["places"], earlier["p2"])) == 0), "left_semi").select(*key, "places")
    on = [rows[c].eqNullSafe(gone[c]) for c in (*key, "places")]
    return rows.join(gone, on[0] & on[1] & on[2] & on[3], "left_anti").drop("files")


def has_stealing(findings: DataFrame) -> DataFrame:
    """(package, stealing): is information stealing reported, in any phase?"""
    return findings.groupBy("package").agg(F.bool_or(F.col("description") == "Information Stealing").alias("stealing"))


def script_entries(scripts: DataFrame, last_phase_only: bool = False) -> DataFrame:
    """R2: (package, install_scripts): map of phase to description. scripts: (package, phase, desc, ord)."""
    if last_phase_only:
        scripts = scripts.withColumn("n", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("ord")))).filter("n = 1").drop("n")
    latest = scripts.groupBy("package", "phase").agg(F.max_by("desc", "ord").alias("desc"))
    return latest.groupBy("package").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "desc")))).alias("install_scripts"))


def report(packages: DataFrame, findings: DataFrame, scripts: DataFrame, last_phase_only: bool = False) -> DataFrame:
    """(package, malicious, report): the JSON report of each package; empty parts are left out."""
    lines = findings.select("package", "phase", "description", "ord", "pattern_desc", F.explode("places").alias("p")).groupBy("package", "phase", "description", "ord", "pattern_desc", "p.file").agg(F.array_sort(F.collect_set("p.line")).alias("lines"))
    one = lines.groupBy("package", "phase", "description", "ord", "pattern_desc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "lines")))).alias("file"))
    by_description = one.groupBy("package", "phase", "description").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("pattern_desc").alias("pattern desc"), F.to_json("file").alias("j")))).alias("f"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("f", lambda x: F.concat(F.lit('{"pattern desc":'), F.to_json(F.array(x["pattern desc"])).substr(F.lit(2), F.length(F.to_json(F.array(x["pattern desc"]))) - 2), F.lit(',"file":'), x["j"], F.lit("}"))), ","), F.lit("]"))
    phases = by_description.select("package", "phase", "description", listed.alias("j")).groupBy("package", "phase").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "description", F.lit('":'), "j"))), ","), F.lit("}")).alias("j"))
    found = phases.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(',"'), "phase", F.lit('":'), "j"))), "").alias("found"))
    rows = packages.select("package").distinct().join(found, "package", "left").join(script_entries(scripts, last_phase_only), "package", "left")
    bad = F.col("found").isNotNull() | F.col("install_scripts").isNotNull()
    hooks = F.when(F.col("install_scripts").isNotNull(), F.concat(F.lit(',"INSTALL TIME SCRIPT":'), F.to_json("install_scripts"))).otherwise("")
    return rows.select("package", bad.alias("malicious"), F.concat(F.lit('{"Malicious":'), bad.cast("string"), hooks, F.coalesce("found", F.lit("")), F.lit("}")).alias("report"))


def status(facts: DataFrame) -> DataFrame:
    """(package, status) from facts about each package, the first that holds deciding.

    facts: booleans code_exists, obfuscated, exported (graph files are there), manifest_exists, has_js, has_graph,
    malicious_script, malicious, and error: null or one of timeout, exporter, model, program.
    """
    c = F.col
    script_only = F.when(c("malicious_script"), "Malicious")
    ladder = (
        F.when(~c("code_exists"), "Code not Exist")
        .when(c("error") == "timeout", "Timeout")
        .when(c("obfuscated"), "Obfuscation")
        .when(~c("exported") | (c("error") == "exporter"), "Joern Error")
        .when(~c("manifest_exists"), "Package Json not exist")
        .when(c("error") == "model", "GPT Error")
        .when(c("error") == "program", "Program Error")
        .when(~c("has_js"), F.coalesce(script_only, F.lit("Benign")))
        .when(~c("has_graph"), F.coalesce(script_only, F.lit("Code has Syntactic Error")))
        .when(c("malicious"), "Malicious")
        .otherwise("Benign")
    )
    return facts.select("package", ladder.alias("status"))


def log_level(value: Column) -> Column:
    """The log level of a status; a program error is an error, not silence."""
    level = F.when(value.isin("Malicious", "Obfuscation"), "CRITICAL").when(value == "Code not Exist", "WARNING").when(value == "Program Error", "ERROR")
    return F.when(value.isNotNull(), F.coalesce(level, F.lit("INFO")))


def log_lines(statuses: DataFrame) -> DataFrame:
    """(package, level, message) of packages with a status."""
    return statuses.filter(F.col("status").isNotNull()).select("package", log_level(F.col("status")).alias("level"), F.concat(F.col("package").cast("string"), F.lit(": "), "status").alias("message"))


def write_log(statuses: DataFrame, path: str, overwrite: bool = True) -> None:
    """The lines as text files."""
    text = log_lines(statuses).select(F.concat_ws(" ", "level", "message").alias("value"))
    text.write.mode("overwrite" if overwrite else "append").text(path)
