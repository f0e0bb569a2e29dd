"""Graphs in DOT, and package folders, as DataFrames.

A DOT file is one string in one row; parsing it is the one thing here that built-in functions can't do, so a batch
function turns rows of text into rows of statements. Everything after that is joins and groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import HOOKS, repair_dot_line
from tessera.session import ship

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|->|--|[\[\]{};,=]|[^\s\[\]{};,="]+|<[^>]*>', re.S)
_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|^\s*#[^\n]*', re.S | re.M)
STATEMENTS = "is_edge boolean, head string, tail string, attr map<string,string>, seq long"


def _value(token: str) -> str:
    if token.startswith('"'):
        return re.sub(r'\\(["\\])', r"\1", token[1:-1])
    return token


def statements(text: str) -> Iterator[tuple[bool, str, str | None, dict[str, str], int]]:
    """(is_edge, head, tail, attributes, place) of the nodes and edges of a DOT text, in order."""
    tokens = _TOKEN.findall(_COMMENT.sub(lambda m: m[1] or " ", text))
    i, n, seq = 0, len(tokens), 0
    while i < n and tokens[i] != "{":
        i += 1
    i += 1
    while i < n:
        if tokens[i] in "{};,":
            i += 1
            continue
        ids = [_value(tokens[i])]
        i += 1
        if i < n and tokens[i] == "=":  # an attribute of the graph
            i += 2
            continue
        while i + 1 < n and tokens[i] in ("->", "--"):
            ids.append(_value(tokens[i + 1]))
            i += 2
        attr: dict[str, str] = {}
        while i < n and tokens[i] == "[":
            i += 1
            while i < n and tokens[i] != "]":
                if tokens[i] in ",;":
                    i += 1
                elif i + 2 < n and tokens[i + 1] == "=":
                    attr[_value(tokens[i])] = _value(tokens[i + 2])
                    i += 3
                else:
                    i += 1
            i += 1
        if ids[0] in ("graph", "node", "edge") and len(ids) == 1 and attr:
            continue
        if len(ids) == 1:
            yield False, ids[0], None, attr, seq
            seq += 1
        for head, tail in zip(ids, ids[1:], strict=False):
            yield True, head, tail, attr, seq
            seq += 1


def repair_dot(text: Column) -> Column:
    """A file with all lines repaired; no file gives none."""
    return F.when(text.contains("DYNAMIC_TYPE_HINT_FULL_NAME"), F.array_join(F.transform(F.split(text, "\n"), repair_dot_line), "\n")).otherwise(text)


def parse_dot(files: DataFrame, keys: list[str]) -> DataFrame:
    """Statements of DOT files: the key columns of files (..., text), then STATEMENTS. Lines are repaired first."""
    ship(files.sparkSession)
    kept = files.select(*keys, repair_dot(F.col("text")).alias("text"))
    schema = kept.drop("text").schema
    for f in _fields(STATEMENTS):
        schema = schema.add(f)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in rows:
            for r in b.to_pylist():
                found = [dict(zip(("is_edge", "head", "tail", "attr", "seq"), (e, h, t, list(a.items()), s), strict=True)) | {k: r[k] for k in keys} for e, h, t, a, s in statements(r["text"] or "")]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return kept.mapInArrow(run, schema)


def _fields(ddl: str) -> list:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).fields


def cpg_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cpg_nodes (package, node_id, attr) and cpg_edges (package, src, dst, attrs, seq), parallel edges merged.

    A node named only in an edge has no attributes; a node stated twice keeps the later values.
    """
    nodes = parsed.filter(~F.col("is_edge")).select("package", F.expr("try_cast(head AS long)").alias("node_id"), "attr", "seq")
    ends = parsed.filter("is_edge").select("package", F.explode(F.array("head", "tail")).alias("id")).select("package", F.expr("try_cast(id AS long)").alias("node_id"), F.create_map().cast("map<string,string>").alias("attr"), F.lit(-1).cast("long").alias("seq"))
    entries = nodes.unionByName(ends).filter(F.col("node_id").isNotNull())
    every = entries.groupBy("package", "node_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.map_entries("attr").alias("e")))).alias("all"))
    flat = F.flatten(F.transform("all", lambda x: x["e"]))
    last = F.filter(flat, lambda e, i: ~F.exists(F.slice(flat, i + 2, F.size(flat)), lambda later: later["key"] == e["key"]))
    cpg_nodes = every.select("package", "node_id", F.map_from_entries(last).alias("attr"))
    labels = parsed.filter("is_edge").select("package", F.expr("try_cast(head AS long)").alias("src"), F.expr("try_cast(tail AS long)").alias("dst"), "seq", F.posexplode_outer(F.map_values("attr")).alias("at", "label"))
    rows = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("seq", "at", "label"))))
    cpg_edges = labels.groupBy("package", "src", "dst").agg(F.transform(rows, lambda r: r["label"]).alias("attrs"), F.min("seq").alias("seq"))
    return cpg_nodes, cpg_edges


def methods(parsed: DataFrame, cpg_nodes: DataFrame) -> DataFrame:
    """(package, file, method_id, name, full_name, file_name, code, kind) from the first node of each method's file.

    parsed has columns package and file; the code is looked up in the property graph.
    """
    first = parsed.filter(~F.col("is_edge")).groupBy("package", "file").agg(F.min_by(F.struct(F.col("head").cast("long").alias("method_id"), "attr"), "seq").alias("m")).select("package", "file", "m.method_id", "m.attr")
    name = F.coalesce(F.try_element_at("attr", F.lit("NAME")), F.lit(""))
    kind = F.when(name == ":program", "program").when(name.rlike(r"^<lambda>\d*"), "lambda").otherwise("function")
    code = cpg_nodes.select("package", F.col("node_id").alias("method_id"), F.try_element_at("attr", F.lit("CODE")).alias("code"))
    get = lambda k: F.coalesce(F.try_element_at("attr", F.lit(k)), F.lit(""))
    return first.select("package", "file", "method_id", name.alias("name"), get("FULL_NAME").alias("full_name"), get("FILENAME").alias("file_name"), kind.alias("kind")).join(code, ["package", "method_id"], "left")


def usable_methods(found: DataFrame) -> DataFrame:
    """S3: methods with a name, of a .js file."""
    return found.filter((F.col("name") != "") & (F.col("file_name") != "<empty>") & F.col("file_name").endswith(".js"))


def pdg_nodes(parsed: DataFrame, cpg_nodes: DataFrame, method_table: DataFrame) -> DataFrame:
    """(package, method_id, node_id, node_type, name, code, line, col); no line: the largest, no column: 0."""
    owner = method_table.select("package", "file", "method_id")
    get = lambda k: F.try_element_at("attr", F.lit(k))
    number = lambda k: F.expr(f"try_cast(try_element_at(attr, '{k}') AS long)")
    rows = parsed.filter(~F.col("is_edge")).join(owner, ["package", "file"])
    rows = rows.select("package", "method_id", F.col("head").cast("long").alias("node_id"), F.coalesce(get("NODE_TYPE"), get("label")).alias("node_type"), get("NAME").alias("name"), F.coalesce(number("LINE_NUMBER"), F.lit(2**63 - 1)).alias("line"), F.coalesce(number("COLUMN_NUMBER"), F.lit(0).cast("long")).alias("col"), "seq")
    code = cpg_nodes.select("package", "node_id", F.try_element_at("attr", F.lit("CODE")).alias("code"))
    return rows.join(code, ["package", "node_id"], "left")


# --- package folders and other tables


def package_files(spark: SparkSession, root: str, pattern: str = "*.js", recursive: bool = True) -> DataFrame:
    """(package, path, text, lines) of the files below root/<package>/; lines are stripped."""
    rows = spark.read.text(root if recursive else f"{root}/*", wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("text"))
    inside = F.regexp_replace(F.url_decode(F.replace("p", F.lit("+"), F.lit("%2B"))), rf"^.*?{re.escape(root.rstrip('/').split(':', 1)[-1].lstrip('/'))}/", "")
    rows = rows.select(F.regexp_extract(inside, "^([^/]+)/", 1).alias("package"), F.regexp_replace(inside, "^[^/]+/", "").alias("path"), "text")
    return rows.withColumn("lines", F.transform(F.split("text", "\n"), lambda x: F.trim(x)))


def manifests(files: DataFrame) -> DataFrame:
    """(package, main, scripts, dependencies) of each package's package/package.json.

    files: (package, path, text). Other places don't count; main is index.js if it isn't named; of the scripts only the
    install hooks stay; a broken manifest gives nulls but for main.
    """
    schema = "main string, scripts map<string,string>, dependencies map<string,string>"
    rows = files.filter(F.col("path") == "package/package.json").select("package", F.from_json("text", schema).alias("j"))
    hooks = F.map_filter(F.coalesce("j.scripts", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*HOOKS))
    names = F.coalesce(F.map_keys("j.dependencies"), F.array().cast("array<string>"))
    return rows.select("package", F.coalesce("j.main", F.lit("index.js")).alias("main"), hooks.alias("scripts"), names.alias("dependencies"))


def manifest_status(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Packages with manifest_exists."""
    there = files.filter(F.col("path") == "package/package.json").select("package", F.lit(True).alias("m")).distinct()
    return packages.join(there, "package", "left").select(*packages.columns, F.coalesce("m", F.lit(False)).alias("manifest_exists"))


def install_scripts(table: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(package, phase, ord, segment, script) of all install hooks.

    A hook that runs .js files by node is of type Node, its files go to static analysis. Of others, verdicts (kind,
    input, answer) tell: kind script_type gives Node or Shell_Command, kind shell gives Description, Judgement and File.
    script is a struct as it is stored: phase, static, script_type, files, downloads, shell_command,
    shell_command_description, malicious.
    """
    from tessera.functions.text import braced, script_files

    rows = table.select("package", F.explode("scripts").alias("phase", "segment")).withColumn("ord", F.array_position(F.array(*(F.lit(h) for h in HOOKS)), F.col("phase")))
    told = lambda kind, name: verdicts.filter(F.col("kind") == kind).groupBy(F.col("input").alias("segment")).agg(F.min("answer").alias(name))
    rows = rows.join(told("script_type", "t"), "segment", "left").join(told("shell", "s"), "segment", "left")
    kind = F.from_json(braced(F.col("t")), "Type string, Run array<string>")
    shell = F.from_json(braced(F.col("s")), "Description string, Judgement string, File array<string>")
    rows = rows.withColumns({"by_regex": script_files(F.col("segment")), "k": kind, "j": shell})
    node = (F.size("by_regex") > 0) | F.coalesce(F.col("k.Type") == "Node", F.lit(False))
    is_shell = ~node & F.coalesce(F.col("k.Type") == "Shell_Command", F.lit(False))
    files = F.when(F.size("by_regex") > 0, F.col("by_regex")).when(node, F.col("k.Run")).when(is_shell, F.col("j.File"))
    script = F.struct(
        F.col("phase"),
        node.alias("static"),
        F.when(node, "Node").when(is_shell, "Shell Command").alias("script_type"),
        F.coalesce(files, F.array().cast("array<string>")).alias("files"),
        F.array().cast("array<string>").alias("downloads"),
        F.when(is_shell, F.col("segment")).alias("shell_command"),
        F.when(is_shell, F.col("j.Description")).alias("shell_command_description"),
        (is_shell & F.coalesce(F.col("j.Judgement") == "malicious", F.lit(False))).alias("malicious"),
    )
    return rows.select("package", "phase", "ord", "segment", script.alias("script"))


SCRIPT = "phase string, static boolean, script_type string, files array<string>, downloads array<string>, shell_command string, shell_command_description string, malicious boolean"


def script_json(script: Column) -> Column:
    """A script as JSON."""
    return F.to_json(script)


def script_entry(script: Column) -> Column:
    """What a report says of a script: a Node script's files; a shell command, with files and downloads if any."""
    some = lambda c: F.when(F.size(c) > 0, c)
    shell = F.to_json(F.struct(script["shell_command"].alias("shell_command"), script["shell_command_description"].alias("shell_command_description"), some(script["files"]).alias("files"), some(script["downloads"]).alias("downloads")))
    return F.when(script["script_type"] == "Shell Command", shell).otherwise(F.to_json(F.struct(script["files"].alias("files"))))


def script_from_json(text: Column) -> Column:
    """The inverse of script_json."""
    return F.from_json(text, SCRIPT)


def script_only_status(scripts: DataFrame) -> DataFrame:
    """(package, malicious_script): of packages without usable code only shell verdicts count."""
    bad = (F.col("script.script_type") == "Shell Command") & F.col("script.malicious")
    return scripts.groupBy("package").agg(F.bool_or(bad).alias("malicious_script"))


def uncached(scripts: DataFrame, profile: DataFrame) -> DataFrame:
    """Packages of scripts that the profile table does not have yet."""
    return scripts.join(profile.select("package").distinct(), "package", "left_anti")
