"""From graphs and manifests of packages to findings, reports and statuses."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import behaviour, graph, match, report, scoring
from tessera.session import Tables

T = TypeVar("T")


def sensitive_graph(rows: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """X1-X5 on the graphs of behaviour(): nodes (package, node, class, file, line) and contracted edges.

    package is a struct (package, phase, root): each graph is contracted by itself. Node ids are node * 100 + part, the
    part counting a node's categories.
    """
    nodes, edges = behaviour.described(rows)
    key = F.struct("package", "phase", "root").alias("package")
    n = nodes.select(key, "node", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "file", "line")
    e = edges.select(key, "src", "dst", graph.edge_kind(F.col("attrs")).alias("kind"))
    parts, moved = graph.split_categories(n.select("package", "node", "categories"), e)
    number = lambda c: F.col(c)["node"] * 100 + F.col(c)["part"]
    flat = tables.keep(parts.join(n.select("package", F.col("node").alias("__n"), "file", "line"), (parts["package"] == n["package"]) & (parts["id.node"] == F.col("__n"))).select(parts["package"], number("id").alias("node"), "sensitive", behaviour.description(F.col("category")).alias("class"), "file", "line"), "nodes")
    moved = tables.keep(moved.select("package", number("src").alias("src"), number("dst").alias("dst"), "kind"), "edges")
    contracted = tables.keep(graph.contract(flat.select("package", "node", "sensitive"), moved), "contracted")
    return flat.filter("sensitive").drop("sensitive"), contracted


def findings(rows: DataFrame, patterns: list[match.Pattern], arguments: DataFrame, verdicts: DataFrame, tables: Tables) -> DataFrame:
    """(package, phase, description, ord, pattern_desc, places): what remains of all phases.

    arguments: (package, node, value) by package name and node.
    """
    nodes, contracted = sensitive_graph(rows, tables)
    pairs = tables.keep(graph.typed_closure(contracted, nodes, match.wanted(patterns)), "pairs")
    found = tables.keep(match.matches(patterns, pairs, nodes), "matches")
    kept = match.kept_patterns(found.select("package", "ord").distinct(), patterns)
    counted = found.join(kept, ["package", "ord"])
    own = nodes.select("package", "node", F.col("package.package").alias("p"), F.floor(F.col("node") / 100).cast("long").alias("n"))
    values = own.join(arguments.select(F.col("package").alias("p"), F.col("node").alias("n"), "value"), ["p", "n"]).select("package", "node", "value")
    bad = match.confirm(counted, patterns, values, verdicts)
    placed = match.localities(bad, patterns, nodes.select("package", "node", "file", "line"))
    phase = F.when(F.col("package.phase") == "RUN TIME", "RUN").otherwise(F.col("package.phase"))
    order = F.struct(F.array_position(F.array(*(F.lit(p) for p in report.PHASES)), phase), F.col("package.root"), F.col("ord"), F.hash("places"))
    flat = placed.select(F.col("package.package").alias("name"), phase.alias("phase"), F.col("maliciousness").alias("description"), order.alias("ord"), "pattern_desc", "places")
    return report.distinct_findings(flat.withColumnRenamed("name", "package"))


def within(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T | None:
    """What the action gives, or None once its time is up; its Spark jobs are cancelled then."""
    context, group, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception:
        if late.is_set():
            return None
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def package_facts(packages: DataFrame, files: DataFrame, cpg_nodes: DataFrame, methods: DataFrame, scripts: DataFrame, found: DataFrame, predicted: DataFrame, errors: DataFrame) -> DataFrame:
    """What the status of each package depends on, from the tables of the steps before.

    files: (package, path, ...); cpg_nodes, methods, found: (package, ...) of graphs, usable methods and findings;
    scripts: install_scripts(); predicted: (package, path, predicted) of scored files; errors: (package, error).
    One shuffle on the package serves all facts.
    """
    bad_script = (F.col("script.script_type") == "Shell Command") & F.col("script.malicious")
    holds = {
        "code_exists": files,
        "has_js": files.filter(F.col("path").endswith(".js")),
        "manifest_exists": files.filter(F.col("path") == "package/package.json"),
        "exported": cpg_nodes,
        "has_graph": methods,
        "obfuscated": scoring.obfuscated_packages(predicted).filter("obfuscated"),
        "malicious_script": scripts.filter(bad_script),
        "malicious": found,
    }
    flags = None
    for name, df in holds.items():
        part = df.select("package", F.lit(name).alias("fact"))
        flags = part if flags is None else flags.unionByName(part)
    told = flags.groupBy("package").agg(*(F.bool_or(F.col("fact") == n).alias(n) for n in holds))
    wrong = errors.groupBy("package").agg(F.min("error").alias("error"))
    rows = packages.select("package").distinct().join(told, "package", "left").join(wrong, "package", "left")
    return rows.select("package", *(F.coalesce(n, F.lit(False)).alias(n) for n in holds), "error").withColumn("malicious", F.col("malicious") | F.col("malicious_script"))


def verdicts(facts: DataFrame, found: DataFrame, scripts: DataFrame) -> DataFrame:
    """(package, status, level, report) of all packages. A report is of packages whose code was analysed."""
    bad = scripts.filter((F.col("script.script_type") == "Shell Command") & F.col("script.malicious"))
    entries = bad.select("package", "phase", F.col("script.shell_command_description").alias("desc"), "ord")
    told = report.report(facts.select("package"), found, entries)
    rows = report.status(facts).join(told, "package")
    return rows.select("package", "status", report.log_level(F.col("status")).alias("level"), F.when(F.col("status").isin("Benign", "Malicious"), F.col("report")).alias("report"))
