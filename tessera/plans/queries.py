"""Registered queries over the driver tables, each with its SQL where SQL can express it.

Functions of strings are applied to a column of written-out cases, dealt over the rows of events; their SQL holds the
answers worked out by hand. So do queries over one constant package. All others derive their answers from whole tables;
more of those are in data_queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import features, text
from tessera.operators import graph, kb, match, report, resolve
from tessera.plans.registry import query, table
from tessera.session import Tables

# --- string functions on written-out cases


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}e0"
    if isinstance(value, int):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def cases(name: str, apply: Callable[[Column], Column], pairs: list[tuple[object, object]]) -> None:
    """Register a function with cases (input, answer): each event gets one of them, by its id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = F.array(*(F.lit(a) for a, _ in pairs))
        e = table(spark, sf_dir, "events").select("event_id", F.get(inputs, (F.col("event_id") % len(pairs)).cast("int")).alias("x"))
        return e.select("event_id", apply(F.col("x")).alias("answer"))

    answers = ", ".join(_sql(b) for _, b in pairs)
    query(name, f"SELECT event_id, [{answers}][CAST(event_id % {len(pairs)} AS INTEGER) + 1] AS answer FROM events")(run)


cases("t4_property_calls", text.property_calls, [
    ("process.env.HOME", "process.env().HOME"), ("process.env[k]", "process.env[k]"), ("myprocess.env", "myprocess.env"), ("process.environment", "process.environment"),
    ("document.cookie = v", "document.cookie = v"), ("f(document.cookie)", "f(document.cookie())"), ("a = process.versions;b = process.version", "a = process.versions();b = process.version()"),
    ("process.argv(1)", "process.argv(1)"), ("document.forms==x", "document.forms==x"), ("process.pid+process.pid", "process.pid()+process.pid()"), ("", ""), (None, None),
])
cases("t1_plain_requires", text.plain_requires, [
    ("const a = require('node:fs')", "const a = require('fs')"), ('require("node:path").join', 'require("path").join'), ("require('fs')", "require('fs')"), ("require(`node:fs`)", "require(`node:fs`)"),
    ("require('node:')", "require('node:')"), ("require('node:a'),require('node:b')", "require('a'),require('b')"),
])
cases("a13_call_names", text.is_call_name, [("foo", True), ("$", True), ("_a1", True), ("1a", False), ("a-b", False), ("", False), ("a\n", True), ("a\nb", False), ("a.b", False), ("é", False), (None, False)])
cases("c2_legal_modules", text.is_legal_module, [("fs", True), ("@s/p", True), (".x", False), ("_x", False), ("a b", False), ("node_modules_x", False), ("a" * 214, True), ("a" * 215, False), ("", True), (None, False)])
cases("i1_script_files", lambda x: F.array_join(text.script_files(x), "|"), [
    ("node a.js && node ./b.js", "a.js|./b.js"), ("curl x | sh", ""), ("node a.json", ""), ("node  x/y.js;", "x/y.js"), ("nodejs a.js", ""), ("NODE a.js", ""), ("node a.js.js", "a.js.js"), ("", ""), (None, None),
])
cases("i4_sensitive_extensions", text.has_sensitive_extension, [("run.sh", True), ("a.exe", True), ("README.md", True), ("cmd", True), ("a.js", False), ("sh.js", False), ("push", True), ("bash", True), ("", False), (None, False)])
cases("l1_answer_categories", lambda x: F.array_join(text.answer_categories(x, list(match.CATEGORIES)), ","), [
    ("12", "12"), ("<40>", "Others"), ("none", "Others"), ("99", "Others"), ("12\n40", "12,Others"), ("", "Others"), ("class 7: x\n23\n", "7,23"), ("140", "Others"), ("1\n\n2", "1,Others,2"), ("99\n3", "3"), (None, "Others"),
])
cases("c3_category_strings", lambda x: text.category_string(F.split(x, ",")), [("12,23", "12-23"), ("12,Others", "Others"), ("Others", "Others"), ("5", "5")])
cases("l3_braced_answers", lambda x: F.get_json_object(text.braced(x), "$.a"), [('x {"a": "1"} y', "1"), ('{"a": {"b": 2}}', '{"b":2}'), ("no", None), ("}{", None), ('{"a": "}"}', "}"), ("{broken", None), (None, None)])
cases("l7_verdicts", text.says, [("Yes", True), ("no, but yes later", True), ("NO", False), ("yEs.", True), ("", False), (None, False)])
cases("l12_url_verdicts", lambda x: text.says(x, "suspicios"), [("suspicious", False), ("Suspicios", True), ("benign", False)])
cases("s18_dot_lines", text.repair_dot_line, [
    ('1 [DYNAMIC_TYPE_HINT_FULL_NAME="a"b" NAME="x"]', '1 [DYNAMIC_TYPE_HINT_FULL_NAME="a\\"b" NAME="x"]'), ('1 [DYNAMIC_TYPE_HINT_FULL_NAME="a"b"]', '1 [DYNAMIC_TYPE_HINT_FULL_NAME="a\\"b"]'),
    ('1 [NAME="x"]', '1 [NAME="x"]'), ('1 [DYNAMIC_TYPE_HINT_FULL_NAME="ab" CODE="c"', '1 [DYNAMIC_TYPE_HINT_FULL_NAME="ab" CODE="c"'), ("", ""), (None, None),
])
cases("d2_code_from_position", lambda x: text.code_from(x, F.lit(2), F.lit(1)), [("ab\ncd\nef", "d\nef"), ("ab\ncd", "d"), ("ab\n", "")])
cases("d3_fill_placeholders", lambda x: text.fill_placeholders(F.split(x, ","), F.create_map(F.lit("#1"), F.lit("one"), F.lit("#2"), F.lit("two"))), [("a,#1", "aone"), ("#1,#2,b", "onetwob"), ("#3", "#3"), ("x", "x")])
cases("d3_first_placeholder", lambda x: text.fill_placeholders(F.split(x, ","), F.create_map(F.lit("#1"), F.lit("one"), F.lit("#2"), F.lit("two")), True), [("a,#1", "aone"), ("#1,#2,b", "one#2b")])
cases("d4_evaluation_logs", lambda x: F.to_json(text.parse_log(x)), [("#1: a\n#2:b:c", '{"#1":"a","#2":"b:c"}'), ("#1: a\n#1: z", '{"#1":"z"}'), ("", "{}"), ("none", "{}"), (None, "{}")])
cases("n8_import_paths", lambda x: text.import_path(F.lit("package/lib/a.js"), x), [("./b", "package/lib/b.js"), ("../b.js", "package/b.js"), ("b", "package/lib/b.js"), ("../../../x", "../x.js"), ("./c/./d", "package/lib/c/d.js")])
cases("n8_local_names", text.looks_local, [("./a", True), ("/a", True), ("a.js", True), ("socket.io", True), ("fs", False), ("@s/p", False), ("lodash/fp", False)])
cases("c4_object_classes", kb.object_class, [("crypto.createHash", "hash"), ("Buffer", "buf"), ("fs.lstat", "stats"), ("tls.connect", "tlsSocket"), ("fs.readFile", None), ("", None), (None, None)])
cases("n28_interest", lambda x: kb.interest(F.split(x, "-")), [("12-20", "20"), ("6", "6"), ("12", None), ("32-31", "32"), (None, None)])
cases("s22_download_names", lambda x: kb.download_name(x, F.array(F.lit("@s/p"), F.lit("q"), F.lit("@t/q"))), [("p", "@s/p"), ("q", "q"), ("r", "r")])
cases("o10b_confusing_names", features.is_confusing, [("strng", True), ("rhythm", True), ("index", False), ("x", False), ("aSTRNGb", True), ("", False)])
cases("o10e_special_numbers", features.special_numbers, [("0x1F", 1), ("0700", 1), ("100", 1), ("42", 0), ("0x1F 0x2", 2), ("\\u00e9", 2), ("", 0)])
cases("o10c_entropy", lambda x: F.round(features.entropy(x), 9), [("aab", 0.918295834), ("a", 0.0), ("", 0.0), ("abcd", 2.0)])
cases("r6_log_levels", report.log_level, [("Malicious", "CRITICAL"), ("Obfuscation", "CRITICAL"), ("Benign", "INFO"), ("Code not Exist", "WARNING"), ("Program Error", "ERROR"), ("Timeout", "INFO"), (None, None)])

# --- features


@query("o6_vector_sizes", "SELECT event_id, CASE event_id % 9 + 1 WHEN 1 THEN 31 WHEN 2 THEN 961 WHEN 3 THEN 4000 WHEN 4 THEN 15000 WHEN 5 THEN 20000 WHEN 6 THEN 40000 WHEN 7 THEN 80000 ELSE 300000 END AS size FROM events")
def o6_vector_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(*(F.lit(features.vector_size(n)) for n in range(1, 10)))
    return table(spark, sf_dir, "events").select("event_id", F.get(sizes, (F.col("event_id") % 9).cast("int")).alias("size"))


_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


def _document_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as if their words were syntax units: a word's code is its length modulo 31."""
    words = F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda w: (F.length(w) % 31).cast("int")).alias("codes"))


_CODES = f"codes AS (SELECT doc_id, list_transform({_WORDS}, lambda w: length(w) % 31) AS c FROM documents)"
_GRAMS = f"{_CODES}, g AS (SELECT doc_id, len(c) - 2 AS total, c, unnest(range(0, len(c) - 2)) AS p FROM codes WHERE len(c) >= 3), n AS (SELECT doc_id, total, p, '(' || c[p + 1] || ', ' || c[p + 2] || ', ' || c[p + 3] || ')' AS gram FROM g), counted AS (SELECT doc_id, gram, min(p) AS position, count(*) AS n, max(total) AS total FROM n GROUP BY doc_id, gram)"


@query("o3_gram_counts", f'WITH {_GRAMS} SELECT doc_id, gram, CAST(position AS INTEGER) AS position, n AS "count", CAST(total AS INTEGER) AS total FROM counted')
def o3_gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.gram_counts(_document_codes(spark, sf_dir), "doc_id", "codes", 3).select("doc_id", "gram", "position", "count", (F.col("total")).alias("total"))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of grams of which the benchmark's words make the most common."""
    words = F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda x: x != "")
    codes = table(spark, sf_dir, "benchmark").select("item_id", F.transform(words, lambda w: (F.length(w) % 31).cast("int")).alias("codes"))
    seen = features.gram_counts(codes, "item_id", "codes", 3).select("gram").distinct()
    return seen.select("gram", (F.rank().over(Window.orderBy("gram")) - 1).cast("long").alias("idx"))  # a dictionary is small


_DICT = f"bw AS (SELECT list_transform({_WORDS}, lambda w: length(w) % 31) AS c FROM benchmark), bg AS (SELECT c, unnest(range(0, len(c) - 2)) AS p FROM bw WHERE len(c) >= 3), dict AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS idx FROM (SELECT DISTINCT '(' || c[p + 1] || ', ' || c[p + 2] || ', ' || c[p + 3] || ')' AS gram FROM bg))"


@query("o4_o5_gram_vectors", f"""WITH {_GRAMS}, {_DICT}, k AS (SELECT c.*, d.idx AS known FROM counted c LEFT JOIN dict d ON c.gram = d.gram),
i AS (SELECT *, CASE WHEN known IS NULL THEN (SELECT count(*) FROM dict) + row_number() OVER (PARTITION BY doc_id, known IS NULL ORDER BY position) - 1 ELSE known END AS idx FROM k)
SELECT doc_id, gram, idx, round(n / CAST(total AS DOUBLE), 9) AS share FROM i WHERE idx < 4000""")
def o4_o5_gram_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = features.gram_counts(_document_codes(spark, sf_dir), "doc_id", "codes", 3)
    return features.gram_index(counts, "doc_id", _dictionary(spark, sf_dir), 3).select("doc_id", "gram", "idx", F.round("share", 9).alias("share"))


@query("o10f_o10g_space_and_symbols", r"""SELECT page_id, round((length(html) - length(regexp_replace(html, '\s', '', 'g'))) / CAST(length(html) - length(replace(html, chr(10), '')) + 1 AS DOUBLE), 9) AS spaces_per_line,
length(html) - length(regexp_replace(html, '[%$@^~\\]', '', 'g')) AS symbols FROM pages""")
def o10f_o10g(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("html", "\n"))
    return table(spark, sf_dir, "pages").select("page_id", F.round(features.whitespace_per_line(F.col("html"), lines), 9).alias("spaces_per_line"), features.symbols(F.col("html")).alias("symbols"))


@query("o10d_string_lengths", f"SELECT doc_id, len(list_filter({_WORDS}, lambda w: length(w) > 100)) AS long_strings, coalesce(list_max(list_transform({_WORDS}, lambda w: length(w))), 0) AS longest FROM documents")
def o10d_string_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", features.string_features(words).alias("s")).select("doc_id", "s.*")


@query("o10c_identifier_features", f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), s AS (SELECT doc_id, w,
CASE WHEN length(w) >= 2 AND regexp_matches(lower(w), '[bcdfghjklmnpqrstvwxyz]{{4,}}') THEN 1 ELSE 0 END + len(regexp_extract_all(w, '0x[0-9A-Fa-f]+')) + len(regexp_extract_all(w, '\\\\u[0-9A-Fa-f]{{4}}')) + len(regexp_extract_all(w, '0[0-7]+')) AS odd FROM w),
d AS (SELECT DISTINCT w FROM w), ch AS (SELECT w, c, count(*) / CAST(length(w) AS DOUBLE) AS p FROM (SELECT w, unnest(string_split(w, '')) AS c FROM d) GROUP BY w, c), ent AS (SELECT w, -sum(p * log2(p)) AS e FROM ch GROUP BY w)
SELECT s.doc_id, CAST(sum(odd) AS BIGINT) AS confusing, round(avg(e), 6) AS entropy FROM s JOIN ent ON s.w = ent.w GROUP BY s.doc_id""")
def o10c_identifier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda x: x != "")
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), none.alias("p")).filter(F.size("w") > 0)
    return features.identifier_table(rows, "doc_id", "w", "p").select("doc_id", "confusing", F.round("entropy", 6).alias("entropy"))


# --- graphs

_EVENTS = """e AS (SELECT user_id AS package, event_id AS node, event_type AS class, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS key, event_type IN ('signup', 'error', 'purchase') AS sensitive FROM events),
steps AS (SELECT package, node, lead(node) OVER (PARTITION BY package ORDER BY ts, node) AS cfg, lead(node) OVER (PARTITION BY package, key ORDER BY ts, node) AS ddg FROM e),
edges AS (SELECT package, node AS src, cfg AS dst, 'CFG' AS kind FROM steps WHERE cfg IS NOT NULL UNION ALL SELECT package, node, ddg, 'DDG' FROM steps WHERE ddg IS NOT NULL)"""
_CONTRACTED = f"""{_EVENTS},
d(package, src, dst) AS (SELECT x.package, x.src, x.dst FROM edges x JOIN e s ON s.package = x.package AND s.node = x.src AND s.sensitive WHERE x.kind = 'DDG'
  UNION SELECT d.package, d.src, x.dst FROM d JOIN e m ON m.package = d.package AND m.node = d.dst AND NOT m.sensitive JOIN edges x ON x.package = d.package AND x.src = d.dst AND x.kind = 'DDG'),
c(package, src, dst) AS (SELECT x.package, x.src, x.dst FROM edges x JOIN e s ON s.package = x.package AND s.node = x.src AND s.sensitive
  UNION SELECT c.package, c.src, x.dst FROM c JOIN e m ON m.package = c.package AND m.node = c.dst AND NOT m.sensitive JOIN edges x ON x.package = c.package AND x.src = c.dst),
dd AS (SELECT d.* FROM d JOIN e t ON t.package = d.package AND t.node = d.dst AND t.sensitive),
cc AS (SELECT c.* FROM c JOIN e t ON t.package = c.package AND t.node = c.dst AND t.sensitive WHERE c.src <> c.dst),
sens AS (SELECT package, src, dst, 'DDG' AS kind FROM dd UNION ALL SELECT package, src, dst, 'CFG' FROM cc WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.package = cc.package AND dd.src = cc.src AND dd.dst = cc.dst))"""
_REACH = f"""{_CONTRACTED},
rd(package, src, dst) AS (SELECT package, src, dst FROM sens WHERE kind = 'DDG' UNION SELECT r.package, r.src, s.dst FROM rd r JOIN sens s ON s.package = r.package AND s.src = r.dst AND s.kind = 'DDG'),
rc(package, src, dst) AS (SELECT package, src, dst FROM sens UNION SELECT r.package, r.src, s.dst FROM rc r JOIN sens s ON s.package = r.package AND s.src = r.dst),
reach AS (SELECT package, src, dst, 'DDG' AS kind FROM rd WHERE src <> dst UNION ALL SELECT package, src, dst, 'CFG' FROM rc WHERE src <> dst)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.event_graph(table(spark, sf_dir, "events"))


def _contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contract(*_graph(spark, sf_dir))


@query("g_event_edges", f"WITH {_EVENTS} SELECT package, src, dst, kind FROM edges")
def g_event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@query("x2_x3_contraction", f"WITH RECURSIVE {_CONTRACTED} SELECT package, src, dst, kind FROM sens")
def x2_x3_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracted(spark, sf_dir).select("package", "src", "dst", "kind")


@query("x2_x3_contraction_by_joins", f"WITH RECURSIVE {_CONTRACTED} SELECT package, src, dst, kind FROM sens")
def x2_x3_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contract_by_joins(*_graph(spark, sf_dir), Tables(spark, "contract"))


@query("x5_path_nodes", f"""WITH RECURSIVE {_EVENTS}, p(package, src, dst, inner_nodes) AS (SELECT x.package, x.src, x.dst, CAST([] AS BIGINT[]) FROM edges x JOIN e s ON s.package = x.package AND s.node = x.src AND s.sensitive WHERE x.kind = 'DDG'
UNION ALL SELECT p.package, p.src, x.dst, list_append(p.inner_nodes, p.dst) FROM p JOIN e m ON m.package = p.package AND m.node = p.dst AND NOT m.sensitive JOIN edges x ON x.package = p.package AND x.src = p.dst AND x.kind = 'DDG')
SELECT p.package, p.src, p.dst, CAST(len(inner_nodes) AS INTEGER) AS n_inner, array_to_string(list_sort(inner_nodes), ',') AS inner_nodes FROM p JOIN e t ON t.package = p.package AND t.node = p.dst AND t.sensitive""")
def x5_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _contracted(spark, sf_dir).filter("kind = 'DDG'")
    return d.select("package", "src", "dst", F.size("inner").alias("n_inner"), F.array_join(F.transform("inner", lambda x: x.cast("string")), ",").alias("inner_nodes"))


@query("x8_reachability", f"WITH RECURSIVE {_REACH} SELECT package, src, dst, kind FROM reach")
def x8_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(Tables(spark, "reach").keep(_contracted(spark, sf_dir).drop("inner"), "contracted"))


@query("x1_category_split", f"""WITH {_EVENTS}, cat AS (SELECT package, node, CASE class WHEN 'signup' THEN ['12', '23'] WHEN 'error' THEN ['37'] WHEN 'purchase' THEN ['6', '14', '20'] ELSE CAST([] AS VARCHAR[]) END AS c FROM e),
last AS (SELECT package, node, greatest(len(c) - 1, 0) AS l FROM cat), chain AS (SELECT package, node, unnest(range(1, len(c))) AS part FROM cat WHERE len(c) > 1)
SELECT x.package, x.src, CAST(l AS INTEGER) AS src_part, x.dst, 0 AS dst_part, kind FROM edges x JOIN last ON last.package = x.package AND last.node = x.src
UNION ALL SELECT package, node, CAST(part - 1 AS INTEGER), node, CAST(part AS INTEGER), 'DDG' FROM chain""")
def x1_category_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    listed = F.when(F.col("class") == "signup", F.array(F.lit("12"), F.lit("23"))).when(F.col("class") == "error", F.array(F.lit("37"))).when(F.col("class") == "purchase", F.array(F.lit("6"), F.lit("14"), F.lit("20"))).otherwise(F.array().cast("array<string>"))
    _, split = graph.split_categories(nodes.select("package", "node", listed.alias("categories")), edges)
    return split.select("package", F.col("src.node").alias("src"), F.col("src.part").alias("src_part"), F.col("dst.node").alias("dst"), F.col("dst.part").alias("dst_part"), "kind")


@query("g7_x4_edge_kinds", f"WITH {_EVENTS} SELECT package, src, dst, max(kind) AS kind FROM edges GROUP BY package, src, dst")
def g7_x4_edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)[1]
    label = F.when(F.col("kind") == "DDG", F.concat(F.lit("DDG: v"), F.col("src").cast("string"))).otherwise(F.col("kind"))
    merged = graph.merge_parallel(edges.select("package", "src", "dst", label.alias("label"), F.hash("kind").alias("seq")))
    return merged.select("package", "src", "dst", graph.edge_kind(F.col("attrs")).alias("kind"))


@query("g3_ordered_children", """SELECT o_orderkey % 10 AS package, o_orderkey AS node, (SELECT string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) WHERE l_orderkey = o_orderkey) AS children FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def g3_ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("package"), F.col("l_orderkey").alias("src"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("dst"), "l_linenumber", "l_partkey").distinct()
    edges = lines.select("package", "src", "dst", F.array(F.lit("AST")).alias("attrs"))
    nodes = lines.select("package", F.col("dst").alias("node"), F.create_map(F.lit("ORDER"), F.col("l_linenumber").cast("string")).alias("attr"))
    children = graph.ordered_children(edges, nodes, "AST", "ORDER").select("package", "node", F.posexplode("children").alias("at", "dst"))
    rows = children.join(lines.select("package", "dst", "l_partkey"), ["package", "dst"]).groupBy("package", "node").agg(F.array_sort(F.collect_list(F.struct("at", "l_partkey"))).alias("c"))
    return rows.select("package", "node", F.array_join(F.transform("c", lambda x: x["l_partkey"].cast("string")), ",").alias("children"))


@query("b9_backward_slice", f"""WITH RECURSIVE {_EVENTS}, back AS (SELECT package, src, dst FROM edges WHERE kind = 'DDG'), own AS (SELECT package, node FROM e WHERE sensitive),
seeds AS (SELECT DISTINCT x.package, x.src AS node FROM back x JOIN own o ON o.package = x.package AND o.node = x.dst WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.package = x.package AND own.node = x.src)),
seen(package, node) AS (SELECT package, node FROM seeds UNION SELECT s.package, b.src FROM seen s JOIN back b ON b.package = s.package AND b.dst = s.node)
SELECT package, node, CAST(NULL AS BIGINT) AS src FROM seen UNION ALL SELECT s.package, s.node, b.src FROM seen s JOIN back b ON b.package = s.package AND b.dst = s.node""")
def b9_backward_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    back = edges.filter("kind = 'DDG'").select("package", "src", "dst")
    own = nodes.filter("sensitive").select("package", "node")
    into = back.join(own.select("package", F.col("node").alias("dst")), ["package", "dst"], "left_semi").select("package", "src", "dst")
    return graph.backward_slice(own, into, back)


# --- matching and findings

PATTERNS = [
    match.Pattern("p0", "Theft", "signup then error then purchase", [("signup", "CFG", "error"), ("error", "DDG", "purchase")]),
    match.Pattern("p1", "Theft", "signup then error", [("signup", "CFG", "error")]),
    match.Pattern("p2", "Abuse", "error feeds purchase", [("error", "DDG", "purchase")]),
    match.Pattern("p3", "Abuse", "a purchase", [("purchase", None, None)]),
    match.Pattern("p4", "Loop", "purchase feeds signup feeds error", [("purchase", "DDG", "signup"), ("signup", "DDG", "error")]),
]


def _pairs(spark: SparkSession, sf_dir: str, patterns: list[match.Pattern]) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf_dir)
    sens = nodes.filter("sensitive").select("package", "node", "class")
    return graph.contracted_pairs(nodes, edges, match.wanted(patterns)), sens


_TYPED = f"{_REACH}, t AS (SELECT r.*, h.class AS hc, g.class AS tc FROM reach r JOIN e h ON h.package = r.package AND h.node = r.src JOIN e g ON g.package = r.package AND g.node = r.dst)"
_P0 = "SELECT a.package, a.src AS signup, a.dst AS error, b.dst AS purchase FROM t a JOIN t b ON b.package = a.package AND b.src = a.dst WHERE a.kind = 'CFG' AND a.hc = 'signup' AND a.tc = 'error' AND b.kind = 'DDG' AND b.tc = 'purchase'"


@query("m3_two_edge_pattern", f"WITH RECURSIVE {_TYPED} {_P0}")
def m3_two_edge_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, nodes = _pairs(spark, sf_dir, PATTERNS[:1])
    pairs = Tables(spark, "match").keep(pairs, "pairs")  # several edges read them
    return match.match(PATTERNS[0], pairs, nodes).toDF("package", "signup", "error", "purchase")


_MATCHED = f"""{_TYPED}, m AS (SELECT DISTINCT package, 0 AS ord FROM ({_P0}) UNION ALL SELECT DISTINCT package, 1 FROM t WHERE kind = 'CFG' AND hc = 'signup' AND tc = 'error'
UNION ALL SELECT DISTINCT package, 2 FROM t WHERE kind = 'DDG' AND hc = 'error' AND tc = 'purchase' UNION ALL SELECT DISTINCT package, 3 FROM e WHERE class = 'purchase'
UNION ALL SELECT DISTINCT a.package, 4 FROM t a JOIN t b ON b.package = a.package AND b.src = a.dst WHERE a.kind = 'DDG' AND a.hc = 'purchase' AND a.tc = 'signup' AND b.kind = 'DDG' AND b.tc = 'error')"""


@query("m5_m7_rule_loop", f"""WITH RECURSIVE {_MATCHED} SELECT package, ord FROM m WHERE ord = 0 OR ord = 4
OR (ord = 1 AND NOT EXISTS (SELECT 1 FROM m q WHERE q.package = m.package AND q.ord = 0)) OR (ord = 2 AND NOT EXISTS (SELECT 1 FROM m q WHERE q.package = m.package AND q.ord = 0))
OR (ord = 3 AND NOT EXISTS (SELECT 1 FROM m q WHERE q.package = m.package AND q.ord IN (0, 2)))""")
def m5_m7_rule_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, nodes = _pairs(spark, sf_dir, PATTERNS)
    pairs = Tables(spark, "match").keep(pairs, "pairs")
    found = match.matches(PATTERNS, pairs, nodes).select("package", "ord").distinct()
    return match.kept_patterns(found, PATTERNS)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of users: the (type, hour) pairs of an event and the next ones of the day; a day is a description."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("package"), "event_id", F.to_date("ts").cast("string").alias("description"), F.struct(F.lit("f").alias("file"), (F.col("value").cast("int") % 5).alias("line")).alias("p"))
    w = Window.partitionBy("package", "description").orderBy("event_id").rowsBetween(0, 2)
    return e.select("package", F.lit("RUN").alias("phase"), "description", F.col("event_id").alias("ord"), F.lit("x").alias("pattern_desc"), F.collect_list("p").over(w).alias("places"))


_FINDINGS = """f AS (SELECT user_id AS package, CAST(CAST(ts AS DATE) AS VARCHAR) AS description, event_id AS ord, list(CAST(trunc(value) AS INTEGER) % 5) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l FROM events),
s AS (SELECT package, description, ord, list_sort(list_distinct(l)) AS l FROM f)"""


@query("r1_distinct_findings", f"""WITH {_FINDINGS} SELECT package, description, ord, array_to_string(l, ',') AS lines FROM s
WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.package = s.package AND o.description = s.description AND o.ord < s.ord AND list_has_all(o.l, s.l))""")
def r1_distinct_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = report.distinct_findings(_findings(spark, sf_dir))
    return kept.select("package", "description", "ord", F.array_join(F.transform("places", lambda p: p["line"].cast("string")), ",").alias("lines"))


@query("r3_stealing", "SELECT user_id AS package, bool_or(event_type = 'error') AS stealing FROM events GROUP BY user_id")
def r3_stealing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return report.has_stealing(e.select(F.col("user_id").alias("package"), F.when(F.col("event_type") == "error", match.STEALING).otherwise("x").alias("description")))


_LADDER = [("code_exists", 2), ("obfuscated", 3), ("exported", 5), ("manifest_exists", 7), ("has_js", 11), ("has_graph", 13), ("malicious_script", 17), ("malicious", 19)]


@query("r4_status_ladder", """SELECT event_id AS package, CASE WHEN event_id % 23 = 0 THEN 'Code not Exist' WHEN event_id % 29 = 1 THEN 'Timeout' WHEN event_id % 3 = 0 THEN 'Obfuscation' WHEN event_id % 5 = 0 OR event_id % 29 = 2 THEN 'Joern Error'
WHEN event_id % 7 = 0 THEN 'Package Json not exist' WHEN event_id % 29 = 3 THEN 'GPT Error' WHEN event_id % 29 = 4 THEN 'Program Error' WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 17 = 0 THEN 'Malicious' ELSE 'Benign' END
WHEN event_id % 13 = 0 THEN CASE WHEN event_id % 17 = 0 THEN 'Malicious' ELSE 'Code has Syntactic Error' END WHEN event_id % 19 = 0 THEN 'Malicious' ELSE 'Benign' END AS status FROM events""")
def r4_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    error = F.when(n % 29 == 1, "timeout").when(n % 29 == 2, "exporter").when(n % 29 == 3, "model").when(n % 29 == 4, "program")
    divides = lambda k: n % k == 0
    facts = table(spark, sf_dir, "events").select(n.alias("package"), (n % 23 != 0).alias("code_exists"), divides(3).alias("obfuscated"), (n % 5 != 0).alias("exported"), (n % 7 != 0).alias("manifest_exists"), (n % 11 != 0).alias("has_js"), (n % 13 != 0).alias("has_graph"), divides(17).alias("malicious_script"), divides(19).alias("malicious"), error.alias("error"))
    return report.status(facts)


# --- knowledge base and names


def _kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base whose modules are brands of parts, and whose functions are part names; some lack a category."""
    p = F.col("p_partkey")
    category = F.when(p % 7 == 0, F.lit(None)).when(p % 5 == 0, "Others").when(p % 3 == 0, "12-23").otherwise((p % 39 + 1).cast("string"))
    rows = table(spark, sf_dir, "part").select(F.lit("npm").alias("eco"), F.when(p % 2 == 0, "builtin").otherwise("third").alias("kind"), p.alias("id"), F.col("p_brand").alias("package"), F.lit("f.js").alias("file"), F.col("p_type").alias("name"), F.concat_ws(".", "p_brand", "p_type").alias("qualifiedname"), F.lit("").alias("comment"), F.lit(0).alias("parameters_num"), category.alias("category"), F.lit(None).cast("string").alias("summary"), F.lit("").alias("code"))
    return rows


_KB = "kb AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'builtin' ELSE 'third' END AS kind, p_partkey AS id, p_brand AS package, p_type AS name, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Others' WHEN p_partkey % 3 = 0 THEN '12-23' ELSE CAST(p_partkey % 39 + 1 AS VARCHAR) END AS category FROM part)"


@query("c1_module_origin", f"""WITH {_KB}, m AS (SELECT DISTINCT p_brand AS module FROM part UNION SELECT n_name FROM nation UNION SELECT '.' || n_name FROM nation)
SELECT module, CASE WHEN module LIKE '.%' OR contains(module, ' ') THEN 'NOT_IN' WHEN EXISTS (SELECT 1 FROM kb WHERE kb.package = module AND kind = 'builtin') THEN 'BUILTIN' WHEN EXISTS (SELECT 1 FROM kb WHERE kb.package = module) THEN 'THIRD_PART' ELSE 'NOT_IN' END AS origin FROM m""")
def c1_module_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("module"))
    modules = table(spark, sf_dir, "part").select(F.col("p_brand").alias("module")).unionByName(nations).unionByName(nations.select(F.concat(F.lit("."), "module").alias("module"))).distinct()
    return kb.origin(modules, _kb(spark, sf_dir))


@query("c3_sensitive_calls", f"""WITH {_KB}, first AS (SELECT kind, package, name, arg_min(CASE WHEN category IS NULL THEN '' ELSE category END, id) AS category FROM kb GROUP BY kind, package, name),
calls AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'builtin' ELSE 'third' END AS kind, p_brand AS qualifier, p_type AS name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT c.l_orderkey, c.l_linenumber, coalesce(f.category NOT IN ('', 'Others'), false) AS sensitive, CASE WHEN f.category NOT IN ('', 'Others') THEN f.category END AS categories, coalesce(f.category <> '', false) AS known
FROM calls c LEFT JOIN first f ON f.kind = c.kind AND f.package = c.qualifier AND f.name = c.name""")
def c3_sensitive_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("qualifier"), F.col("p_type").alias("name"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "builtin").otherwise("third").alias("kind")
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind).join(parts, "l_partkey").drop("l_partkey")
    found = kb.sensitive_calls(calls, _kb(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", "sensitive", F.array_join("categories", "-").alias("categories"), "known")


@query("c7_lookup", f"WITH {_KB} SELECT id, package, name FROM kb WHERE kind = 'builtin' AND category = '12-23'")
def c7_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.lookup(_kb(spark, sf_dir), kind="builtin", category="12-23").select("id", "package", "name")


@query("c10_updates", f"""WITH {_KB}, u AS (SELECT l_partkey AS id, arg_max(CAST(l_suppkey AS VARCHAR), l_orderkey * 10 + l_linenumber) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT kb.id, CASE WHEN u.id IS NOT NULL THEN u.v ELSE kb.category END AS category FROM kb LEFT JOIN u ON u.id = kb.id""")
def c10_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _kb(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.lit("npm").alias("eco"), F.when(F.col("l_partkey") % 2 == 0, "builtin").otherwise("third").alias("kind"), F.col("l_partkey").alias("id"), F.lit("category").alias("column"), F.col("l_suppkey").cast("string").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return kb.updated(base, lines).select("id", "category")


@query("n1_asof_names", """WITH b AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS seq FROM orders),
u AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey, max(l_shipdate) AS l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey * 10 + l_linenumber, o_custkey)
SELECT u.id, arg_max(b.o_orderkey, b.seq) AS binding FROM u LEFT JOIN b ON b.o_custkey = u.o_custkey AND b.o_orderdate <= u.l_shipdate GROUP BY u.id""")
def n1_asof_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    bindings = o.select("o_custkey", F.col("o_orderkey").alias("binding"), "o_orderdate", seq.alias("seq"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").groupBy("id", "o_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    uses = lines.join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
    return resolve.asof_by_time(uses, bindings, "o_custkey", "l_shipdate", "o_orderdate", "seq", "id", "binding")


@query("n1_scoped_names", """WITH c AS (SELECT conv_id AS package, turn, role, list_sort(list_distinct([role])) AS r FROM conversations),
b AS (SELECT conv_id AS package, turn, role, CASE WHEN turn % 3 = 0 THEN 0 WHEN turn % 3 = 1 THEN 1 ELSE 2 END AS depth, (turn * 7) % 11 AS seq, turn AS line FROM conversations),
u AS (SELECT conv_id * 100 + turn AS id, conv_id AS package, role, turn % 3 AS depth, turn + 1 AS line FROM conversations)
SELECT u.id, arg_max(b.turn, b.depth * 1000 + b.seq) AS bound_turn FROM u LEFT JOIN b ON b.package = u.package AND b.role = u.role AND b.depth <= u.depth AND b.line <= u.line GROUP BY u.id""")
def n1_scoped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    path = F.slice(F.array(F.lit("f"), F.lit("g")), F.lit(1), (F.col("turn") % 3).cast("int")).alias("scope_path")
    base = [F.col("conv_id").alias("package"), F.lit("a.js").alias("file"), path, F.col("role").alias("name")]
    bindings = c.select(*base, ((F.col("turn") * 7) % 11).alias("seq"), F.col("turn").alias("line"), F.col("turn").alias("bound_turn"))
    uses = c.select(*base, (F.col("turn") + 1).alias("line"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return resolve.resolve(uses, bindings, "id").select("id", "binding.bound_turn")


@query("n15_alias_roots", """WITH RECURSIVE e AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type FROM events), a AS (SELECT id, CASE WHEN event_type IN ('click', 'view') THEN prev END AS alias_of FROM e),
r(id, root) AS (SELECT id, id FROM a WHERE alias_of IS NULL UNION ALL SELECT a.id, r.root FROM a JOIN r ON a.alias_of = r.id) SELECT id, root FROM r""")
def n15_alias_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    bindings = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view"), prev).alias("alias_of"))
    return resolve.aliases(bindings, Tables(spark, "alias")).select("id", "root")


# --- scoring


@query("o14_thresholds", "SELECT doc_id, CASE WHEN n_chars % 100 / 100.0 >= 0.7 THEN 'malicious' ELSE 'benign' END AS predicted FROM documents")
def o14_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.scoring import predicted

    return table(spark, sf_dir, "documents").select("doc_id", predicted(F.col("n_chars") % 100 / F.lit(100.0), 0.7).alias("predicted"))


@query("o18_confusion", """WITH p AS (SELECT CASE WHEN quality = 0 THEN 'malicious' ELSE 'benign' END AS label, CASE WHEN n_chars % 100 / 100.0 >= 0.29 THEN 'malicious' ELSE 'benign' END AS predicted FROM labels JOIN documents USING (doc_id))
SELECT count(*) FILTER (WHERE label = 'benign' AND predicted = 'benign') AS tn, count(*) FILTER (WHERE label = 'benign' AND predicted = 'malicious') AS fp, count(*) FILTER (WHERE label = 'malicious' AND predicted = 'benign') AS fn, count(*) FILTER (WHERE label = 'malicious' AND predicted = 'malicious') AS tp,
round(count(*) FILTER (WHERE label = predicted) / CAST(count(*) AS DOUBLE), 9) AS accuracy FROM p""")
def o18_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.scoring import confusion, predicted

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.when(F.col("quality") == 0, "malicious").otherwise("benign").alias("label"), predicted(F.col("n_chars") % 100 / F.lit(100.0), 0.29).alias("predicted"))
    return confusion(rows).select("tn", "fp", "fn", "tp", F.round("accuracy", 9).alias("accuracy"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: findings of the two-edge pattern over contracted event graphs."""
    return m3_two_edge_pattern(spark, sf_dir)


# --- syntax trees


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of each page, as a file."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<script>(.*?)</script>", 1).alias("text"))


_TYPES = "program variable_declaration variable_declarator identifier string string_fragment expression_statement call_expression identifier arguments number".split()
_SCRIPT = "s AS (SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1) AS t, regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS n FROM pages)"
_TEXTS = """[t, 'var t="</p>";', 't="</p>"', 't', '"</p>"', '</p>', 'track(' || n || ');', 'track(' || n || ')', 'track', '(' || n || ')', n]"""


@query("a1_parse_scripts", f"WITH {_SCRIPT} SELECT page_id, CAST(i AS BIGINT) AS pre, {_TYPES!r}[i + 1] AS type, {_TEXTS}[i + 1] AS text FROM (SELECT page_id, t, n, unnest(range(0, 11)) AS i FROM s)")
def a1_parse_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ast

    return ast.parse_js(_scripts(spark, sf_dir), ["page_id"]).select("page_id", "pre", "type", "text")


@query("a4_a5_calls_on_names", f"WITH {_SCRIPT} SELECT page_id, 'track' AS f_text, n AS n_text FROM s")
def a4_a5_calls_on_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ast

    tree = ast.parse_js(_scripts(spark, sf_dir), ["page_id"])
    call = ast.Shape("call_expression", [ast.Shape("identifier", field="function", capture="f"), ast.Shape("arguments", [ast.Shape("number", capture="n")])])
    return ast.first_capture(ast.query(tree, ["page_id"], call), ["page_id"], "f").select("page_id", "f_text", "n_text")


@query("a10_statement_at", "SELECT page_id, 0 AS statement_row, 13 AS statement_col FROM pages")
def a10_statement_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ast

    tree = ast.parse_js(_scripts(spark, sf_dir), ["page_id"])
    at = tree.filter("type = 'number'").select("page_id", F.col("start_row").alias("row"), F.col("start_col").alias("col"))
    return ast.statement_at(tree, ["page_id"], at).select("page_id", "statement_row", "statement_col")


@query("a11_top_statements", "SELECT page_id, CAST(6 AS BIGINT) AS node_id FROM pages")
def a11_top_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ast

    return ast.top_statements(ast.parse_js(_scripts(spark, sf_dir), ["page_id"]), ["page_id"])


@query("a14_o1_unit_codes", "SELECT page_id, '30,1,1,6,15,15,17,11,6,18,23' AS codes FROM pages")
def a14_o1_unit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ast

    types = ast.unit_types(ast.parse_js(_scripts(spark, sf_dir), ["page_id"]), ["page_id"])
    return types.select("page_id", F.array_join(F.transform(features.unit_codes(F.col("types")), lambda c: c.cast("string")), ",").alias("codes"))


@query("a15_post_order", f"SELECT page_id, {','.join(_TYPES[i] for i in (3, 5, 4, 2, 1, 8, 10, 9, 7, 6, 0))!r} AS types FROM pages")
def a15_post_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ast

    return ast.unit_types(ast.parse_js(_scripts(spark, sf_dir), ["page_id"]), ["page_id"], "post").select("page_id", F.array_join("types", ",").alias("types"))


@query("o10_lexical_vectors", f"""WITH {_SCRIPT} SELECT page_id, array_to_string([CAST(x AS VARCHAR) FOR x IN [1.0, 0.5, 1.0, 0.0, 1.161, 0.0, 0.0, 4.0, CAST(len(regexp_extract_all(n, '0[0-7]+')) AS DOUBLE), 1.0, 0.0]], ' ') AS lexical FROM s""")
def o10_lexical_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ast

    rows = ast.lexical(ast.source_parts(_scripts(spark, sf_dir), ["page_id"]), ["page_id"])
    return rows.select("page_id", F.array_join(F.transform("lexical", lambda x: F.round(x, 3).cast("string")), " ").alias("lexical"))


def source_cases(name: str, make: Callable[[DataFrame], DataFrame], pairs: list[tuple[str, object]]) -> None:
    """As cases(), for functions of whole source files: make takes (event_id, text) and gives (event_id, answer)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.array(*(F.lit(a) for a, _ in pairs))
        rows = table(spark, sf_dir, "events").select("event_id", F.get(texts, (F.col("event_id") % len(pairs)).cast("int")).alias("text"))
        return make(rows.repartition(spark.sparkContext.defaultParallelism, "event_id"))  # parsing outweighs the shuffle of short rows

    answers = ", ".join(_sql(b) for _, b in pairs)
    query(name, f"SELECT event_id, [{answers}][CAST(event_id % {len(pairs)} AS INTEGER) + 1] AS answer FROM events")(run)


def _rewritten(df: DataFrame) -> DataFrame:
    from tessera.operators import ast

    return ast.rewrite(df, ["event_id"]).withColumnRenamed("text", "answer")


def _defined(df: DataFrame) -> DataFrame:
    from tessera.operators import ast

    files = df.select(F.col("event_id").alias("package"), F.lit("a.js").alias("path"), "text")
    found = ast.functions(files).groupBy(F.col("package").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(":"), "comment"))), "|").alias("answer"))
    return df.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("answer", F.lit("")).alias("answer"))


def _argued(df: DataFrame) -> DataFrame:
    from tessera.operators import ast

    calls = df.select(F.lit(1).alias("package"), F.col("event_id").alias("node"), "text", F.lit(1).alias("line"), F.lit(0).alias("col"))
    log = df.filter("event_id % 2 = 0").select(F.lit(1).alias("package"), F.col("event_id").alias("node"), F.create_map(F.lit("#1"), F.lit("one")).alias("value"))
    return ast.argument_strings(calls, log).select(F.col("node").alias("event_id"), F.col("value").alias("answer"))


source_cases("t0_rewrite", _rewritten, [
    ("const {a, b: c} = require('node:m');", "const a = require('m').a, c = require('m').b;"), ("async function f() { await g(await h()) }", "async function f() {\n    g(h())\n}"), ("xs.forEach(f); ys.forEach(g)", "xs.forEach((xs_) => f(xs_));\nys.forEach(g)"),
    ("f(process.env)", "f(process.env())"), ("", ""), ("if(", "if("), ("var x = 1", "var x = 1"),
])
source_cases("k1_functions", _defined, [
    ("// adds\nfunction add(a) { return a }\nconst g = () => 1", "add:adds|g:"), ("exports.h = function () {}; function h() {}", "h:"), ("var x = 1", ""), ("/* one */ /* two */\nfunction* k() {}", "k:one */\n/* two */"), ("", ""),
])
source_cases("d1_argument_strings", _argued, [("f('a', 'b')", "'a''b'"), ("f()", ""), ("x", ""), ("f('a', () => 1)", "'a'"), ("require('m').f('z')", "'z'"), ("f(y)", ""), ("f(y, 'b')", "one'b'"), ("new a.B(\"c\")", '"c"')])

# --- whole packages

_CPG = """digraph "cpg" {
1 [label="METHOD" NAME=":program" FULL_NAME="package/index.js::program" FILENAME="package/index.js" CODE=":program"]
2 [label="METHOD" NAME="send" FULL_NAME="package/index.js::program:send" FILENAME="package/index.js" CODE="function send(x) { http.request(x) }"]
10 [label="CALL" NAME="<operator>.assignment" CODE="fs = require('fs')" LINE_NUMBER="1"]
11 [label="IDENTIFIER" NAME="fs" CODE="fs" ORDER="1" LINE_NUMBER="1"]
12 [label="CALL" NAME="require" CODE="require('fs')" ORDER="2" LINE_NUMBER="1"]
20 [label="CALL" NAME="<operator>.assignment" CODE="d = fs.readFileSync('/etc/passwd')" LINE_NUMBER="2"]
21 [label="IDENTIFIER" NAME="d" CODE="d" ORDER="1" LINE_NUMBER="2"]
22 [label="CALL" NAME="readFileSync" CODE="fs.readFileSync('/etc/passwd')" ORDER="2" LINE_NUMBER="2"]
30 [label="CALL" NAME="send" CODE="send(d)" LINE_NUMBER="3"]
31 [label="IDENTIFIER" CODE="d" NAME="d" ARGUMENT_INDEX="1" LINE_NUMBER="3"]
40 [label="METHOD_PARAMETER_IN" NAME="x" CODE="x" LINE_NUMBER="4"]
50 [label="CALL" NAME="request" CODE="http.request(x)" LINE_NUMBER="5"]
51 [label="IDENTIFIER" CODE="x" NAME="x" ARGUMENT_INDEX="1" LINE_NUMBER="5"]
10 -> 11 [label="AST"]
10 -> 12 [label="AST"]
20 -> 21 [label="AST"]
20 -> 22 [label="AST"]
30 -> 31 [label="ARGUMENT"]
50 -> 51 [label="ARGUMENT"]
}"""
_PDGS = {
    "1-pdg.dot": 'digraph {\n1 [label="METHOD" NODE_TYPE="METHOD" NAME=":program" FULL_NAME="package/index.js::program" FILENAME="package/index.js"]\n10 [NODE_TYPE="CALL" NAME="<operator>.assignment" LINE_NUMBER="1"]\n22 [NODE_TYPE="CALL" NAME="readFileSync" LINE_NUMBER="2"]\n20 [NODE_TYPE="CALL" NAME="<operator>.assignment" LINE_NUMBER="2"]\n30 [NODE_TYPE="CALL" NAME="send" LINE_NUMBER="3"]\n1 -> 10 [label="CFG"]\n10 -> 22 [label="CFG"]\n10 -> 22 [label="DDG: fs"]\n22 -> 20 [label="CFG"]\n20 -> 30 [label="CFG"]\n20 -> 30 [label="DDG: d"]\n}',
    "2-pdg.dot": 'digraph {\n2 [label="METHOD" NODE_TYPE="METHOD" NAME="send" FULL_NAME="package/index.js::program:send" FILENAME="package/index.js"]\n40 [NODE_TYPE="METHOD_PARAMETER_IN" NAME="x" LINE_NUMBER="4"]\n50 [NODE_TYPE="CALL" NAME="request" LINE_NUMBER="5"]\n2 -> 40 [label="DDG"]\n2 -> 50 [label="CFG"]\n40 -> 50 [label="DDG: x"]\n}',
}


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user as a package that reads a file and sends it."""
    from tessera.operators import behaviour
    from tessera.sources import dot

    packages = table(spark, sf_dir, "events").select(F.col("user_id").alias("package")).distinct()
    nodes, edges = dot.cpg_tables(dot.parse_dot(packages.select("package", F.lit(_CPG).alias("text")), ["package"]))
    pdgs = F.explode(F.create_map(*(F.lit(x) for pair in _PDGS.items() for x in pair)))
    parsed = dot.parse_dot(packages.select("package", pdgs.alias("file", "text")), ["package", "file"])
    methods = dot.usable_methods(dot.methods(parsed, nodes))
    pdg_nodes = dot.pdg_nodes(parsed, nodes, methods)
    pdg_edges = parsed.filter("is_edge").join(methods.select("package", "file", "method_id"), ["package", "file"]).select("package", "method_id", F.col("head").cast("long").alias("src"), F.col("tail").cast("long").alias("dst"), F.col("attr")["label"].alias("label"), "seq")
    base = spark.createDataFrame([("npm", "builtin", 1, "fs", "readFileSync", "12"), ("npm", "builtin", 2, "http", "request", "20"), ("npm", "builtin", 3, "os", "x", "4")], "eco string, kind string, id long, package string, name string, category string")
    files = packages.select("package", F.lit("package/index.js").alias("path"))
    manifests = packages.select("package", F.lit("index.js").alias("main"), F.array().cast("array<string>").alias("files"))
    return behaviour.behaviour(nodes, edges, methods, pdg_nodes, pdg_edges, files, manifests, base)


_USERS = "u AS (SELECT DISTINCT user_id AS package FROM events)"


@query("s1_dot_scan", f"""WITH {_USERS}, x AS (SELECT unnest([10, 10, 20, 20, 30, 50]) AS src, unnest([11, 12, 21, 22, 31, 51]) AS dst, unnest(['AST', 'AST', 'AST', 'AST', 'ARGUMENT', 'ARGUMENT']) AS labels) SELECT package, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, labels FROM u, x""")
def s1_dot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources import dot

    packages = table(spark, sf_dir, "events").select(F.col("user_id").alias("package")).distinct()
    _, edges = dot.cpg_tables(dot.parse_dot(packages.select("package", F.lit(_CPG).alias("text")), ["package"]))
    return edges.select("package", "src", "dst", F.array_join("attrs", ",").alias("labels"))


@query("b2_behaviour_graphs", f"""WITH {_USERS}, x AS (SELECT unnest([1, 10, 22, 20, 30, 2, 2, 40]) AS src, unnest([10, 22, 20, 30, 2, 50, 40, 50]) AS dst, unnest(['CFG', 'CFG,DDG: fs', 'DDG', 'CFG,DDG: d', 'DDG', 'CFG', 'DDG', 'DDG: x']) AS labels) SELECT package, 'IMPORT' AS phase, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, labels FROM u, x""")
def b2_behaviour_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import behaviour

    _, edges = behaviour.described(_behaviour(spark, sf_dir))
    return edges.select("package", "phase", "src", "dst", F.array_join("attrs", ",").alias("labels"))


@query("n21_classified_calls", f"WITH {_USERS} SELECT package, CAST(unnest([22, 50]) AS BIGINT) AS node, unnest(['12', '20']) AS categories FROM u")
def n21_classified_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import behaviour

    nodes, _ = behaviour.described(_behaviour(spark, sf_dir))
    return nodes.filter("categories IS NOT NULL").select("package", "node", F.array_join("categories", "-").alias("categories"))


@query("r5_package_findings", f"""WITH {_USERS} SELECT package, 'IMPORT' AS phase, 'Theft' AS description, 'read local file - send through HTTP request' AS pattern_desc, 'package/index.js:2,package/index.js:5' AS places FROM u WHERE package % 3 = 0""")
def r5_package_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans import analysis

    tables = Tables(spark, "findings")
    rows = tables.keep(_behaviour(spark, sf_dir), "behaviour")
    packages = table(spark, sf_dir, "events").select(F.col("user_id").alias("package")).distinct()
    arguments = packages.select("package", F.lit(22).cast("long").alias("node"), F.when(F.col("package") % 3 == 0, "/etc/passwd").when(F.col("package") % 3 == 1, "").otherwise("a.txt").alias("value"))
    verdicts = spark.createDataFrame([("read", "/etc/passwd", True), ("read", "a.txt", False)], "judge string, input string, malicious boolean")
    rule = match.Pattern("p", "Theft", "read local file - send through HTTP request", [("read data from a file", "DDG", "make HTTP request")])
    found = analysis.findings(rows, [rule], arguments, verdicts, tables)
    return found.select("package", "phase", "description", "pattern_desc", F.array_join(F.transform("places", lambda p: F.concat(p["file"], F.lit(":"), p["line"].cast("string"))), ",").alias("places"))
