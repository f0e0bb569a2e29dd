"""Registered queries whose answers SQL derives from the tables, row by row: packages, graphs, scripts and findings differ."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.functions import features
from tessera.operators import ast, graph, kb, report, resolve
from tessera.plans.queries import _EVENTS, _KB, _graph, _kb
from tessera.plans.registry import query, table
from tessera.session import Tables
from tessera.sources import dot


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nodes: (package, node, class, key), key from 0 to 9."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("package"), F.col("event_id").alias("node"), F.col("event_type").alias("class"), (F.get_json_object("props", "$.k").cast("long") % 10).alias("key"))


# --- graph primitives


@query("g1_composed_methods", f"""WITH {_EVENTS}, x AS (SELECT package, src, dst, CASE WHEN kind = 'CFG' OR src % 4 = 2 THEN 'CFG' WHEN src % 4 = 0 THEN 'DDG: ' WHEN src % 4 = 1 THEN 'DDG: this' ELSE 'DDG: v' || (src % 10) END AS label FROM edges)
SELECT package, src, dst, label FROM x WHERE label NOT IN ('DDG: ', 'DDG: this') AND NOT EXISTS (SELECT 1 FROM e WHERE e.package = x.package AND e.node = x.dst AND e.class = 'error')""")
def g1_composed_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    one = [F.col("package"), F.lit(1).alias("method"), F.col("src"), F.col("dst")]
    label = F.when(F.col("src") % 4 == 0, "DDG: ").when(F.col("src") % 4 == 1, "DDG: this").when(F.col("src") % 4 == 3, F.concat(F.lit("DDG: v"), (F.col("src") % 10).cast("string")))
    dependence = edges.filter("kind = 'DDG'").select(*one, label.alias("label"), F.col("src").alias("seq"))
    control = edges.filter("kind = 'CFG'").select(*one, F.lit(None).cast("string").alias("label"), F.col("src").alias("seq"))
    kinds = nodes.select("package", "node", F.when(F.col("class") == "error", "METHOD_RETURN").otherwise("CALL").alias("node_type"))
    return graph.compose(dependence, control, kinds).select("package", "src", "dst", "label")


@query("g2_parameter_edges", """SELECT l_orderkey % 10 AS package, l_orderkey AS method, l_orderkey AS src, l_orderkey * 10 + l_linenumber AS dst, 'DDG' AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_linenumber <= 4 AND (o_orderstatus <> 'F' OR (o_custkey % 2 = 0 AND l_returnflag || l_linestatus IN ('NO', 'AF')))""")
def g2_parameter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") <= 4, "METHOD_PARAMETER_IN").otherwise("CALL")
    nodes = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("package"), F.col("l_orderkey").alias("method"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), kind.alias("node_type"), F.concat("l_returnflag", "l_linestatus").alias("code"))
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("<lambda>"), (F.col("o_custkey") % 7).cast("string"))).otherwise("f")
    formal = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("NO"), F.lit("AF")))
    methods = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("package"), F.col("o_orderkey").alias("method"), name.alias("name"), formal.alias("formal"))
    return graph.parameter_edges(nodes, methods)


@query("g4_argument_lists", "SELECT user_id AS package, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id % 7, event_id) AS arguments FROM events WHERE event_type = 'view' GROUP BY user_id")
def g4_argument_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    edges = e.select("package", F.col("package").alias("src"), F.col("node").alias("dst"), F.array(F.when(F.col("class") == "view", "ARGUMENT").otherwise("AST")).alias("attrs"))
    nodes = e.select("package", "node", F.create_map(F.lit("ARGUMENT_INDEX"), (F.col("node") % 7).cast("string")).alias("attr"))
    found = graph.ordered_children(edges, nodes, "ARGUMENT", "ARGUMENT_INDEX")
    return found.select("package", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("arguments"))


@query("g5_callees", f"WITH {_EVENTS} SELECT package, key AS node, max(node) AS callee FROM e WHERE class IN ('click', 'view') GROUP BY package, key")
def g5_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.when(F.col("class").isin("click", "view"), F.array(F.lit("CFG"), F.lit("CALL"))).otherwise(F.array(F.lit("CFG")))
    return graph.callees(_events(spark, sf_dir).select("package", F.col("key").alias("src"), F.col("node").alias("dst"), attrs.alias("attrs"), F.col("node").alias("seq")))


@query("g9_named_dependences", f"WITH {_EVENTS} SELECT package, node, key = 3 AS on_v3 FROM e")
def g9_named_dependences(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.array(F.lit("CFG"), F.concat(F.lit("DDG: v"), F.col("key").cast("string")))
    return _events(spark, sf_dir).select("package", "node", graph.is_named_ddg(attrs, "v3").alias("on_v3"))


_BOTH = "EXISTS (SELECT 1 FROM edges y WHERE y.kind = 'DDG' AND y.package = x.package AND y.src = x.src AND y.dst = x.dst)"


@query("g10_existing_edges", f"WITH {_EVENTS} SELECT package, src, dst FROM edges x WHERE kind = 'CFG' AND {_BOTH}")
def g10_existing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)[1]
    return graph.has_edge(edges.filter("kind = 'CFG'").select("package", "src", "dst"), edges.filter("kind = 'DDG'"))


@query("g12_remaining_edges", f"WITH {_EVENTS} SELECT package, src, dst, kind FROM edges x WHERE NOT {_BOTH}")
def g12_remaining_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)[1]
    return graph.without_edges(edges, edges.filter("kind = 'DDG'")).select("package", "src", "dst", "kind")


@query("g11_g15_first_edges", f"WITH {_EVENTS} SELECT package, key AS src, length(class) AS dst, arg_min(class, node) AS label, min(node) AS seq FROM e GROUP BY package, key, length(class)")
def g11_first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("package", F.col("key").alias("src"), F.length("class").cast("long").alias("dst"), F.array("class").alias("attrs"), F.col("node").alias("seq"))
    return graph.first_edges(rows).select("package", "src", "dst", F.get("attrs", F.lit(0)).alias("label"), "seq")


@query("g13_g14_first_nodes", f"WITH {_EVENTS} SELECT package, key AS node, arg_min(class, node) AS name FROM e GROUP BY package, key")
def g13_first_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("package", F.col("key").alias("node"), F.col("class").alias("name"), F.col("node").alias("seq"))
    return graph.first_nodes(rows).select("package", "node", "name")


@query("g16_g17_neighbours", f"""WITH {_EVENTS}, x AS (SELECT package, src AS node, dst AS other, 'out' AS way FROM edges UNION ALL SELECT package, dst, src, 'in' FROM edges)
SELECT package, node, way, array_to_string(list_sort(list(DISTINCT other)), ',') AS neighbours FROM x GROUP BY package, node, way""")
def g16_g17_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)[1]
    both = graph.neighbour_sets(edges).withColumn("way", F.lit("out")).unionByName(graph.neighbour_sets(edges, incoming=True).withColumn("way", F.lit("in")))
    return both.select("package", "node", "way", F.array_join(F.transform("neighbours", lambda n: n.cast("string")), ",").alias("neighbours"))


_FRESH = f"{_EVENTS}, fresh AS (SELECT package FROM e GROUP BY package HAVING arg_max(class, node) <> 'click')"


def _joint(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks and their DDG edges, joined by views and clicks with CFG edges unless a package's last event is a click."""
    nodes, edges = _graph(spark, sf_dir)
    own = nodes.filter("class = 'click'").select("package", "node", F.lit("own").alias("name"), F.col("node").alias("seq"))
    sub = nodes.filter("class IN ('click', 'view')").select("package", "node", F.lit("sub").alias("name"), F.col("node").alias("seq"))
    last = nodes.groupBy("package").agg(F.max("node").alias("node"))
    of = lambda kind: edges.filter(F.col("kind") == kind).select("package", "src", "dst", F.array("kind").alias("attrs"), F.col("src").alias("seq"))
    return graph.joint(own, of("DDG"), sub, of("CFG"), last)


@query("g18_joined_nodes", f"WITH {_FRESH} SELECT package, node, 'own' AS name FROM e WHERE class = 'click' UNION ALL SELECT package, node, 'sub' FROM e WHERE class = 'view' AND package IN (SELECT package FROM fresh)")
def g18_joined_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joint(spark, sf_dir)[0].select("package", "node", "name")


@query("g18_joined_edges", f"WITH {_FRESH} SELECT package, src, dst, kind FROM edges WHERE kind = 'DDG' UNION ALL SELECT package, src, dst, kind FROM edges x WHERE kind = 'CFG' AND package IN (SELECT package FROM fresh) AND NOT {_BOTH}")
def g18_joined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joint(spark, sf_dir)[1].select("package", "src", "dst", F.get("attrs", F.lit(0)).alias("kind"))


@query("g19_parameter_counts", f"WITH {_EVENTS} SELECT package, key AS method, CASE WHEN bool_or(class = 'error') THEN 1000 ELSE count(*) FILTER (WHERE class = 'click') END AS parameters FROM e GROUP BY package, key")
def g19_parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("class") == "click", "PARAM,a").when(F.col("class") == "view", "PARAM,this").when(F.col("class") == "error", "PARAM,...r").otherwise("CALL")
    return graph.parameter_count(_events(spark, sf_dir).select("package", F.col("key").alias("method"), kind.alias("node_type")))


@query("x6_path_nodes_of_pairs", f"""WITH RECURSIVE {_EVENTS}, p(package, src, dst, inner_nodes) AS (SELECT x.package, x.src, x.dst, CAST([] AS BIGINT[]) FROM edges x JOIN e s ON s.package = x.package AND s.node = x.src AND s.sensitive WHERE x.kind = 'DDG'
UNION ALL SELECT p.package, p.src, x.dst, list_append(p.inner_nodes, p.dst) FROM p JOIN e m ON m.package = p.package AND m.node = p.dst AND NOT m.sensitive JOIN edges x ON x.package = p.package AND x.src = p.dst AND x.kind = 'DDG')
SELECT p.package, p.src, p.dst, array_to_string(list_sort(inner_nodes), ',') AS path_nodes FROM p JOIN e t ON t.package = p.package AND t.node = p.dst AND t.sensitive WHERE p.src % 3 = 0""")
def x6_path_nodes_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracted = graph.contract(*_graph(spark, sf_dir))
    asked = contracted.filter("kind = 'DDG' AND src % 3 = 0").select("package", "src", "dst")
    found = graph.path_nodes(contracted, asked)
    return found.select("package", "src", "dst", F.array_join(F.transform("inner", lambda n: n.cast("string")), ",").alias("path_nodes"))


@query("x9_class_lists", f"WITH {_EVENTS} SELECT package, string_agg(node || ':' || class, ',' ORDER BY node) AS classes FROM e WHERE sensitive GROUP BY package")
def x9_class_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = graph.class_lists(_graph(spark, sf_dir)[0].filter("sensitive"))
    return listed.select("package", F.array_join(F.transform("classes", lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["class"])), ",").alias("classes"))


@query("x7_nodes_between", f"""WITH {_EVENTS}, s AS (SELECT package, key, node, ts, lead(node, 2) OVER (PARTITION BY package, key ORDER BY ts, node) AS dst FROM e WHERE sensitive), d AS (SELECT s.*, t.ts AS until FROM s JOIN e t ON t.package = s.package AND t.node = s.dst)
SELECT d.package, d.node AS src, d.dst, string_agg(CAST(m.node AS VARCHAR), ',' ORDER BY m.node) AS nodes FROM d JOIN e m ON m.package = d.package AND m.key = d.key AND m.ts > d.ts AND m.ts < d.until GROUP BY d.package, d.node, d.dst""")
def x7_nodes_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between each sensitive event and the second one after it with the same key."""
    contracted = Tables(spark, "between").keep(graph.contract(*_graph(spark, sf_dir)), "contracted").filter("kind = 'DDG'")
    after = contracted.select("package", F.col("src").alias("dst"), F.col("dst").alias("end"))
    pairs = contracted.join(after, ["package", "dst"]).select("package", "src", F.col("end").alias("dst"))
    found = graph.nodes_between(contracted, pairs)
    return found.select("package", "src", "dst", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


@query("m11_category_numbers", f"WITH {_EVENTS} SELECT package, node, CASE WHEN key < 9 THEN CAST(key + 1 AS VARCHAR) END AS category FROM e")
def m11_category_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import behaviour, match

    text = F.when(F.col("key") < 9, behaviour.description((F.col("key") + 1).cast("string"))).otherwise("no class")
    return _events(spark, sf_dir).select("package", "node", match.category_of(text).alias("category"))


# --- graphs as text


def _dot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOT file for each user: a node for each event, with a type hint that holds an unescaped quote, and its steps."""
    q = F.lit('"')
    e = _events(spark, sf_dir)
    order = Window.partitionBy("package").orderBy("node")
    line = F.concat(F.col("node").cast("string"), F.lit(' [label="'), "class", F.lit('" DYNAMIC_TYPE_HINT_FULL_NAME="t'), F.col("key").cast("string"), q, F.lit('x" NAME="n'), F.col("key").cast("string"), F.lit('"]'))
    step = F.concat(F.col("node").cast("string"), F.lit(" -> "), F.lead("node").over(order).cast("string"), F.lit(' [label="'), F.when(F.col("key") < 5, "AST").otherwise("CFG"), F.lit('"]'))
    rows = e.select("package", "node", line.alias("line"), step.alias("step")).groupBy("package").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.array_sort(F.collect_list("step")).alias("steps"))
    return rows.select("package", F.concat(F.lit('digraph "g" {\n'), F.array_join(F.concat("lines", "steps"), "\n"), F.lit("\n}")).alias("text"))


@query("s1_s18_s19_graph_nodes", f"WITH {_EVENTS} SELECT package, node AS node_id, class AS label, 'n' || key AS name, 't' || key || '\"x' AS hint FROM e")
def s1_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = dot.cpg_tables(dot.parse_dot(_dot_texts(spark, sf_dir), ["package"]))
    get = lambda k: F.try_element_at("attr", F.lit(k))
    return nodes.select("package", "node_id", get("label").alias("label"), get("NAME").alias("name"), get("DYNAMIC_TYPE_HINT_FULL_NAME").alias("hint"))


@query("s1_graph_edges", """SELECT package, src, dst, labels FROM (SELECT user_id AS package, event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS dst,
CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 < 5 THEN 'AST' ELSE 'CFG' END AS labels FROM events) WHERE dst IS NOT NULL""")
def s1_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = dot.cpg_tables(dot.parse_dot(_dot_texts(spark, sf_dir), ["package"]))
    return edges.select("package", "src", "dst", F.array_join("attrs", ",").alias("labels"))


_METHOD = """SELECT user_id AS package, event_id AS method_id, CASE event_id % 4 WHEN 0 THEN ':program' WHEN 1 THEN '<lambda>' || (event_id % 10) WHEN 2 THEN '' ELSE 'f' || (event_id % 10) END AS name,
CASE event_id % 3 WHEN 0 THEN 'package/a.js' WHEN 1 THEN '<empty>' ELSE 'x.ts' END AS file_name, CASE event_id % 4 WHEN 0 THEN 'program' WHEN 1 THEN 'lambda' ELSE 'function' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'c' || event_id END AS code FROM events"""


@query("s2_s3_methods", f"SELECT * FROM ({_METHOD}) WHERE name <> '' AND file_name = 'package/a.js'")
def s2_s3_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _events(spark, sf_dir), F.col("node")
    digit = (n % 10).cast("string")
    name = F.when(n % 4 == 0, ":program").when(n % 4 == 1, F.concat(F.lit("<lambda>"), digit)).when(n % 4 == 2, "").otherwise(F.concat(F.lit("f"), digit))
    path = F.when(n % 3 == 0, "package/a.js").when(n % 3 == 1, "<empty>").otherwise("x.ts")
    text = F.concat(F.lit("digraph {\n"), n.cast("string"), F.lit(' [label="METHOD" NAME="'), name, F.lit('" FILENAME="'), path, F.lit('"]\n1 [label="CALL" NAME="later"]\n}'))
    parsed = dot.parse_dot(e.select("package", F.concat(n.cast("string"), F.lit("-pdg.dot")).alias("file"), text.alias("text")), ["package", "file"])
    cpg = e.filter("node % 2 = 0").select("package", n.alias("node_id"), F.create_map(F.lit("CODE"), F.concat(F.lit("c"), n.cast("string"))).alias("attr"))
    return dot.usable_methods(dot.methods(parsed, cpg)).select("package", "method_id", "name", "file_name", "kind", "code")


# --- package folders, manifests and install scripts


@query("s4_s5_package_files", "SELECT 'region=' || n_regionkey AS package, string_agg(n_name, '|' ORDER BY n_name) || '|' AS lines FROM nation GROUP BY n_regionkey")
def s4_s5_package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Tables(spark, "folders").root + "/files"
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("value"))
    rows.repartition(1).sortWithinPartitions("region", "value").write.partitionBy("region").text(root)
    return dot.package_files(spark, root, "*.txt").select("package", F.array_join("lines", "|").alias("lines"))


_MAIN = "CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'm' || c_custkey || '.js' ELSE 'index.js' END"


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each customer; in the place of a manifest for half of them, and broken for a quarter."""
    c = F.col("c_custkey")
    path = F.when(c % 4 == 1, "package.json").when(c % 4 == 2, "package/lib/package.json").otherwise("package/package.json")
    main = F.when(c % 8 != 0, F.concat(F.lit('"main":"m'), c.cast("string"), F.lit('.js",'))).otherwise("")
    text = F.concat(F.lit("{"), main, F.lit('"scripts":{"install":"'), _segment(), F.lit('","test":"t","postinstall":"echo '), c.cast("string"), F.lit('"},"dependencies":{"'), "c_mktsegment", F.lit('":"1","z":"2"}}'))
    return table(spark, sf_dir, "customer").select(c.alias("package"), path.alias("path"), F.when(c % 4 == 3, "{").otherwise(text).alias("text"))


def _segment() -> Column:
    c = F.col("c_custkey")
    s = c.cast("string")
    return F.when(c % 5 == 0, F.concat(F.lit("node i"), s, F.lit(".js && node ./b.js"))).when(c % 5 == 1, F.concat(F.lit("curl x"), s, F.lit(" | sh"))).when(c % 5 == 2, F.concat(F.lit("make "), s)).when(c % 5 == 3, F.concat(F.lit("node run"), s)).otherwise(F.concat(F.lit("echo "), s))


_SEGMENT = "CASE c_custkey % 5 WHEN 0 THEN 'node i' || c_custkey || '.js && node ./b.js' WHEN 1 THEN 'curl x' || c_custkey || ' | sh' WHEN 2 THEN 'make ' || c_custkey WHEN 3 THEN 'node run' || c_custkey ELSE 'echo ' || c_custkey END"


@query("s7_s8_manifests", f"""SELECT c_custkey AS package, {_MAIN} AS main, CASE WHEN c_custkey % 4 = 0 THEN {_SEGMENT} END AS install, CASE WHEN c_custkey % 4 = 0 THEN 'echo ' || c_custkey END AS postinstall,
CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS hooks, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ',z' ELSE '' END AS dependencies FROM customer WHERE c_custkey % 4 IN (0, 3)""")
def s7_s8_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dot.manifests(_folders(spark, sf_dir))
    hook = lambda k: F.try_element_at("scripts", F.lit(k))
    return m.select("package", "main", hook("install").alias("install"), hook("postinstall").alias("postinstall"), F.size("scripts").alias("hooks"), F.array_join("dependencies", ",").alias("dependencies"))


@query("s6_manifest_places", "SELECT c_custkey AS package, c_custkey % 4 IN (0, 3) AS manifest_exists FROM customer")
def s6_manifest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _folders(spark, sf_dir)
    return dot.manifest_status(files.select("package"), files)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model said of scripts: curl is a shell command that some take for malicious, run... is run by node."""
    c = F.col("c_custkey")
    s = c.cast("string")
    curl, run = c % 5 == 1, c % 5 == 3
    kind = F.when(curl, 'So: {"Type": "Shell_Command"}').when(run, F.concat(F.lit('{"Type": "Node", "Run": ["run'), s, F.lit('.js"]}')))
    shell = F.concat(F.lit('{"Description": "d'), s, F.lit('", "Judgement": "'), F.when(c % 3 == 0, "malicious").otherwise("benign"), F.lit('", "File": ["x'), s, F.lit('"]} ok'))
    rows = table(spark, sf_dir, "customer").filter(curl | run).select(_segment().alias("input"), kind.alias("t"), F.when(curl, shell).alias("s"))
    answers = F.explode(F.array(F.struct(F.lit("script_type").alias("kind"), F.col("t").alias("answer")), F.struct(F.lit("shell").alias("kind"), F.col("s").alias("answer"))))
    return rows.select("input", answers.alias("a")).select("a.kind", "input", "a.answer").filter("answer IS NOT NULL")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dot.install_scripts(dot.manifests(_folders(spark, sf_dir)), _told(spark, sf_dir))


_INSTALL = f"inst AS (SELECT *, c_custkey % 5 AS k, c_custkey % 5 = 1 AS shell, {_SEGMENT} AS segment FROM customer WHERE c_custkey % 4 = 0)"
_FILES = "CASE k WHEN 0 THEN ['i' || c_custkey || '.js', './b.js'] WHEN 1 THEN ['x' || c_custkey] WHEN 3 THEN ['run' || c_custkey || '.js'] ELSE CAST([] AS VARCHAR[]) END"


@query("i1_i2_i3_l3_l6_install_scripts", f"""WITH {_INSTALL} SELECT c_custkey AS package, 'install' AS phase, k IN (0, 3) AS static, CASE WHEN k IN (0, 3) THEN 'Node' WHEN shell THEN 'Shell Command' END AS script_type, array_to_string({_FILES}, ',') AS files,
CASE WHEN shell THEN segment END AS shell_command, CASE WHEN shell THEN 'd' || c_custkey END AS description, shell AND c_custkey % 3 = 0 AS malicious FROM inst
UNION ALL SELECT c_custkey, 'postinstall', false, NULL, '', NULL, NULL, false FROM inst""")
def i1_install_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("script")
    return _scripts(spark, sf_dir).select("package", "phase", s["static"].alias("static"), s["script_type"].alias("script_type"), F.array_join(s["files"], ",").alias("files"), s["shell_command"].alias("shell_command"), s["shell_command_description"].alias("description"), s["malicious"].alias("malicious"))


@query("i6_i8_i9_i10_script_entries", f"""WITH {_INSTALL} SELECT c_custkey AS package, true AS restored, CASE WHEN shell THEN '{{"shell_command":"' || segment || '","shell_command_description":"d' || c_custkey || '","files":["x' || c_custkey || '"]}}'
ELSE '{{"files":[' || array_to_string(list_transform({_FILES}, lambda f: '"' || f || '"'), ',') || ']}}' END AS entry FROM inst""")
def i6_script_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scripts(spark, sf_dir).filter("phase = 'install'")
    again = dot.script_from_json(dot.script_json(F.col("script")))
    return rows.select("package", (F.to_json(again) == F.to_json("script")).alias("restored"), dot.script_entry(again).alias("entry"))


@query("i5_script_only", f"WITH {_INSTALL} SELECT c_custkey AS package, shell AND c_custkey % 3 = 0 AS malicious_script FROM inst")
def i5_script_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dot.script_only_status(_scripts(spark, sf_dir))


@query("s9_uncached_scripts", f"WITH {_INSTALL} SELECT c_custkey AS package, count(*) * 2 AS scripts FROM inst WHERE c_nationkey % 2 = 1 GROUP BY c_custkey")
def s9_uncached_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = table(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("package"))
    return dot.uncached(_scripts(spark, sf_dir), profile).groupBy("package").agg(F.count(F.lit(1)).alias("scripts"))


# --- knowledge base


@query("c6_c8_function_lookups", f"WITH {_KB} SELECT id, package, name FROM kb WHERE kind = 'third' AND (package, name) IN (SELECT package, name FROM kb WHERE kind = 'third' ORDER BY id LIMIT 1)")
def c6_c8_function_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = kb.lookup(_kb(spark, sf_dir), kind="third")
    first = base.orderBy("id").select("package", "name").first()
    return kb.lookup(base, package=first["package"], name=first["name"]).select("id", "package", "name")


@query("c9_known_functions", f"WITH {_KB} SELECT p_partkey AS id FROM part WHERE (p_brand, p_type) IN (SELECT package, name FROM kb WHERE kind = 'third')")
def c9_known_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"), F.col("p_type").alias("name"))
    return kb.is_function_of(calls, _kb(spark, sf_dir)).select("id")


@query("c11_c12_c13_inserted", f"WITH {_KB} SELECT id, package, category FROM kb UNION ALL SELECT s_suppkey + 1000000, s_name, NULL FROM supplier UNION ALL SELECT n_nationkey + 2000000, n_name, '7' FROM nation")
def c11_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    npm = [F.lit("npm").alias("eco"), F.lit("third").alias("kind")]
    short = table(spark, sf_dir, "supplier").select(*npm, (F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("package"))
    coded = table(spark, sf_dir, "nation").select(*npm, (F.col("n_nationkey") + 2_000_000).cast("long").alias("id"), F.col("n_name").alias("package"), F.lit("7").alias("category"))
    return kb.inserted(kb.inserted(_kb(spark, sf_dir), short), coded).select("id", "package", "category")


@query("s21_misses", f"""WITH {_KB}, first AS (SELECT kind, package, name, arg_min(CASE WHEN category IS NULL THEN '' ELSE category END, id) AS category FROM kb GROUP BY kind, package, name),
calls AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'builtin' ELSE 'third' END AS kind, p_brand AS qualifier, p_type AS name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT c.kind, c.qualifier, c.name, count(*) AS uses FROM calls c LEFT JOIN first f ON f.kind = c.kind AND f.package = c.qualifier AND f.name = c.name WHERE coalesce(f.category, '') = '' GROUP BY c.kind, c.qualifier, c.name""")
def s21_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("qualifier"), F.col("p_type").alias("name"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "builtin").otherwise("third").alias("kind")
    calls = table(spark, sf_dir, "lineitem").select("l_partkey", kind).join(parts, "l_partkey").drop("l_partkey")
    return kb.misses(kb.sensitive_calls(calls, _kb(spark, sf_dir)))


@query("l4_l5_l8_l14_answers", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'reads ' || event_type END AS answer, event_type NOT IN ('click', 'view') AS missing FROM events")
def l4_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    told = e.filter(F.col("event_type").isin("click", "view")).select(F.lit("summary").alias("kind"), F.col("event_type").alias("input"), F.concat(F.lit("reads "), "event_type").alias("answer"))
    return kb.answered(e, told, "summary", "event_type").select("event_id", "answer", "missing")


@query("l9_l10_l11_l13_verdicts", "SELECT event_id, event_type, event_type = 'error' AND event_id % 2 = 0 AS malicious FROM events")
def l9_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import says

    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat("event_type", (n % 2).cast("string")).alias("input"))
    told = e.filter("event_type IN ('error', 'click')").select(F.lit("command").alias("kind"), "input", F.when(F.col("input") == "error0", "I think Yes.").otherwise("No").alias("answer"))
    return kb.answered(e, told, "command", "input").select("event_id", "event_type", says(F.col("answer")).alias("malicious"))


@query("n5_recursion_guard", "SELECT conv_id, turn, turn % 3 = 2 OR (turn % 3 = 1 AND role = 'f') AS inside FROM conversations")
def n5_recursion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    scope = F.array().cast("array<string>")
    one, two = resolve.push(scope, F.col("role")), resolve.push(resolve.push(scope, F.lit("f")), F.lit("g"))
    path = F.when(F.col("turn") % 3 == 0, resolve.pop(one)).when(F.col("turn") % 3 == 1, one).otherwise(resolve.pop(two))
    return c.select("conv_id", "turn", resolve.is_inside(path, F.lit("f")).alias("inside"))


# --- reports


@query("r2_script_phases", "SELECT user_id AS package, event_type AS phase, arg_max(props, event_id) AS description FROM events GROUP BY user_id, event_type")
def r2_script_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("package"), F.col("event_type").alias("phase"), F.col("props").alias("desc"), F.col("event_id").alias("ord"))
    return report.script_entries(rows).select("package", F.explode("install_scripts").alias("phase", "description"))


@query("s12_reports", """WITH u AS (SELECT user_id AS p, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY user_id)
SELECT p AS package, p % 2 = 0 OR p % 3 = 0 AS malicious, '{"Malicious":' || CASE WHEN p % 2 = 0 OR p % 3 = 0 THEN 'true' ELSE 'false' END || CASE WHEN p % 2 = 0 THEN ',"INSTALL TIME SCRIPT":{"install":"s' || p || '"}' ELSE '' END ||
CASE WHEN p % 3 = 0 THEN ',"RUN":{"Theft":[{"pattern desc":"x","file":{"f.js":[' || CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END || ']}}]}' ELSE '' END || '}' AS report FROM u""")
def s12_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("package")).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    places = F.transform(F.array("a", "b"), lambda n: F.struct(F.lit("f.js").alias("file"), n.alias("line")))
    found = u.filter("package % 3 = 0").select("package", F.lit("RUN").alias("phase"), F.lit("Theft").alias("description"), F.lit(0).alias("ord"), F.lit("x").alias("pattern_desc"), places.alias("places"))
    scripts = u.filter("package % 2 = 0").select("package", F.lit("install").alias("phase"), F.concat(F.lit("s"), F.col("package").cast("string")).alias("desc"), F.lit(0).alias("ord"))
    return report.report(u, found, scripts)


@query("s20_r6_log_lines", """SELECT event_id AS package, CASE WHEN event_type IN ('error') THEN 'CRITICAL' WHEN event_type = 'view' THEN 'WARNING' WHEN event_type = 'click' THEN 'ERROR' ELSE 'INFO' END AS level,
event_id || ': ' || CASE event_type WHEN 'error' THEN 'Malicious' WHEN 'view' THEN 'Code not Exist' WHEN 'click' THEN 'Program Error' ELSE 'Benign' END AS message FROM events""")
def s20_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "Malicious").when(F.col("event_type") == "view", "Code not Exist").when(F.col("event_type") == "click", "Program Error").otherwise("Benign")
    return report.log_lines(table(spark, sf_dir, "events").select(F.col("event_id").alias("package"), status.alias("status")))


# --- features


@query("o7_grams_by_index", """SELECT doc_id, n_chars % 12 AS idx, CASE WHEN n_chars % 12 < 10 THEN '(' || (n_chars % 12) || ', 1)' END AS gram FROM documents""")
def o7_grams_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = spark.range(10).select(F.concat(F.lit("("), F.col("id").cast("string"), F.lit(", 1)")).alias("gram"), F.col("id").alias("idx"))
    return features.grams_by_index(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 12).alias("idx")), dictionary).select("doc_id", "idx", "gram")


@query("o9_stacked_vectors", "SELECT doc_id, 'a' AS part FROM documents UNION ALL SELECT item_id, 'b' FROM benchmark")
def o9_stacked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", F.lit("a").alias("part"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("b").alias("part"))
    return features.stacked(a, None, b)


# --- scripts of several shapes


def _code() -> Column:
    k = (F.get_json_object("props", "$.k").cast("long") % 10).cast("string")
    kind = F.col("event_type")
    return (
        F.when(kind == "click", F.concat(F.lit("f"), k, F.lit("("), k, F.lit(");")))
        .when(kind == "view", F.concat(F.lit("var v"), k, F.lit(' = g("s'), k, F.lit('");')))
        .when(kind == "error", F.concat(F.lit("if (a) { h("), k, F.lit("); } else { i(0); }")))
        .when(kind == "signup", F.concat(F.lit("// makes "), k, F.lit("\nfunction s"), k, F.lit("(x) { return x[t("), k, F.lit(")]; }")))
        .otherwise(F.concat(F.lit("o.p("), k, F.lit(", q(1));")))
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _code().alias("text")).repartition(spark.sparkContext.defaultParallelism, "event_id")


_K = "k AS (SELECT event_id, user_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k FROM events)"


@query("a4_a6_called_names", f"WITH {_K} SELECT event_id, CASE t WHEN 'click' THEN 'f' || k WHEN 'view' THEN 'g' WHEN 'error' THEN 'h' WHEN 'signup' THEN 't' ELSE 'q' END AS first_name, CASE t WHEN 'click' THEN 'f' || k WHEN 'view' THEN 'g' WHEN 'error' THEN 'i' WHEN 'signup' THEN 't' ELSE 'q' END AS last_name FROM k")
def a4_a6_called_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Tables(spark, "trees").keep(ast.parse_js(_sources(spark, sf_dir), ["event_id"]), "trees")
    calls = ast.query(tree, ["event_id"], ast.Shape("call_expression", [ast.Shape("identifier", field="function", capture="f")]))
    last = ast.last_capture(calls, ["event_id"], "f").select("event_id", F.col("f_text").alias("last_name"))
    return ast.first_capture(calls, ["event_id"], "f").select("event_id", F.col("f_text").alias("first_name")).join(last, "event_id")


@query("a2_a3_children", f"WITH {_K} SELECT event_id, 1 AS numbers, CAST(k AS VARCHAR) AS first_number FROM k WHERE t <> 'view'")
def a2_a3_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers among the arguments of each script's first call with one."""
    keys = ["event_id"]
    tree = Tables(spark, "trees").keep(ast.parse_js(_sources(spark, sf_dir), keys), "trees")
    holder = tree.filter("type = 'arguments'").select(*keys, "node_id")
    some = ast.children(tree, keys, "number").join(holder, [*keys, "node_id"]).groupBy(*keys, "node_id").agg(F.count(F.lit(1)).cast("int").alias("numbers"))
    first = ast.first_child(tree, keys, "number").join(some, [*keys, "node_id"])
    text = tree.select(*keys, F.col("node_id").alias("child"), F.col("text").alias("first_number"))
    rows = first.join(text, [*keys, "child"]).groupBy(*keys).agg(F.min_by(F.struct("numbers", "first_number"), "node_id").alias("r"))
    return rows.select(*keys, "r.*")


_SHAPES = {
    "click": "program expression_statement call_expression identifier arguments number",
    "view": "program variable_declaration variable_declarator identifier call_expression identifier arguments string string_fragment",
    "error": "program if_statement parenthesized_expression identifier statement_block expression_statement call_expression identifier arguments number else_clause statement_block expression_statement call_expression identifier arguments number",
    "signup": "program comment function_declaration identifier formal_parameters identifier statement_block return_statement subscript_expression identifier call_expression identifier arguments number",
    "purchase": "program expression_statement call_expression member_expression identifier property_identifier arguments number call_expression identifier arguments number",
}


@query("a7_walks", f"WITH {_K} SELECT event_id, CASE t {' '.join(f'WHEN {t!r} THEN {s!r}' for t, s in _SHAPES.items())} END AS types FROM k")
def a7_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = ast.parse_js(_sources(spark, sf_dir), ["event_id"])
    listed = tree.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pre", "type"))).alias("w"))
    return listed.select("event_id", F.array_join(F.transform("w", lambda x: x["type"]), " ").alias("types"))


@query("a12_roots", "SELECT event_id, CAST(0 AS BIGINT) AS node_id FROM events")
def a12_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ast.top_subscripts(ast.parse_js(_sources(spark, sf_dir), ["event_id"]), ["event_id"])


@query("k1_k2_defined_functions", f"WITH {_K} SELECT user_id AS package, 's' || k AS name, 'makes ' || k AS comment, 'function s' || k || '(x) {{ return x[t(' || k || ')]; }}' AS code FROM k WHERE t = 'signup' GROUP BY user_id, k")
def k1_k2_defined_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").select(F.col("user_id").alias("package"), F.concat(F.col("event_id").cast("string"), F.lit(".js")).alias("path"), _code().alias("text"))
    other = ast.functions(files, "python")
    return ast.functions(files).unionByName(other).select("package", "name", "comment", "code")


@query("o11_gram_features", f"""WITH {_K}, codes AS (SELECT event_id, CASE t WHEN 'click' THEN [30, 17, 11, 6, 18, 23] WHEN 'view' THEN [30, 1, 1, 6, 11, 6, 18, 15, 15] WHEN 'purchase' THEN [30, 17, 11, 8, 6, 6, 18, 23, 11, 6, 18, 23] END AS c FROM k),
g AS (SELECT event_id, len(c) - 2 AS n, '(' || c[i] || ', ' || c[i + 1] || ', ' || c[i + 2] || ')' AS gram FROM (SELECT event_id, c, unnest(range(1, len(c) - 1)) AS i FROM codes WHERE c IS NOT NULL))
SELECT event_id, gram, round(count(*) / CAST(max(n) AS DOUBLE), 9) AS share FROM g GROUP BY event_id, gram""")
def o11_gram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").filter("event_type IN ('click', 'view', 'purchase')").select("event_id")
    tables = Tables(spark, "features")
    files = tables.keep(_sources(spark, sf_dir).join(kinds, "event_id", "left_semi"), "files")
    dictionary = tables.keep(ast.learn_dictionary(files, "event_id"), "dictionary")
    found = ast.feature_table(files, "event_id", dictionary).select("event_id", F.explode("shares").alias("idx", "share"))
    return found.join(dictionary, "idx").select("event_id", "gram", F.round("share", 9).alias("share"))


# --- scores


@query("o13_o19_o20_o21_obfuscated_packages", "SELECT user_id AS package, bool_or(event_type = 'error' AND value >= 50) AS obfuscated, coalesce(string_agg(event_id || '.js', ',' ORDER BY event_id || '.js') FILTER (WHERE event_type = 'error' AND value >= 50), '') AS files FROM events GROUP BY user_id")
def o20_obfuscated_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import scoring

    bad = (F.col("event_type") == "error") & (F.col("value") >= 50)
    probability = F.when(bad, 0.7).when(F.col("event_type") == "view", F.lit(None).cast("double")).otherwise(0.69)
    files = table(spark, sf_dir, "events").select(F.col("user_id").alias("package"), F.concat(F.col("event_id").cast("string"), F.lit(".js")).alias("path"), scoring.verdict(probability).alias("predicted"))
    return scoring.obfuscated_packages(files).select("package", "obfuscated", F.array_join("files", ",").alias("files"))


# --- from folders to statuses

_STATUS = f"""{_INSTALL}, f AS (SELECT c_custkey AS p, c_nationkey AS nat, c_custkey % 7 <> 6 AS own, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS js, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderkey % 17 = 0) AS odd FROM customer),
s AS (SELECT p, c_custkey IS NOT NULL AND shell AND p % 3 = 0 AS script, p % 11 = 0 AS found, CASE WHEN NOT own AND NOT ordered THEN 'Code not Exist' WHEN p % 13 = 1 THEN 'Timeout' WHEN odd THEN 'Obfuscation' WHEN p % 9 = 0 THEN 'Joern Error' WHEN NOT (own AND p % 4 IN (0, 3)) THEN 'Package Json not exist'
    WHEN p % 13 = 2 THEN 'GPT Error' WHEN NOT js THEN CASE WHEN script THEN 'Malicious' ELSE 'Benign' END WHEN nat % 2 = 1 THEN CASE WHEN script THEN 'Malicious' ELSE 'Code has Syntactic Error' END WHEN found OR script THEN 'Malicious' ELSE 'Benign' END AS status
    FROM f LEFT JOIN inst ON c_custkey = p AND own)"""


@query("r4_r6_s12_package_verdicts", f"""WITH {_STATUS} SELECT p AS package, status, CASE WHEN status IN ('Malicious', 'Obfuscation') THEN 'CRITICAL' WHEN status = 'Code not Exist' THEN 'WARNING' ELSE 'INFO' END AS level,
CASE WHEN status IN ('Benign', 'Malicious') THEN '{{"Malicious":' || CASE WHEN found OR script THEN 'true' ELSE 'false' END || CASE WHEN script THEN ',"INSTALL TIME SCRIPT":{{"install":"d' || p || '"}}' ELSE '' END ||
CASE WHEN found THEN ',"IMPORT":{{"Theft":[{{"pattern desc":"x","file":{{"package/index.js":[1]}}}}]}}' ELSE '' END || '}}' END AS report FROM s""")
def r4_package_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans import analysis

    c = table(spark, sf_dir, "customer")
    p = F.col("c_custkey").alias("package")
    some = lambda condition: c.filter(condition).select(p)
    folders = _folders(spark, sf_dir).filter("package % 7 <> 6")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.concat(F.lit("package/o"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "O", ".js").otherwise(".txt")).alias("path"), (F.col("o_orderkey") % 17 == 0).alias("odd"))
    orders = orders.join(c.select(p), "package", "left_semi")
    files = folders.select("package", "path").unionByName(orders.select("package", "path"))
    scripts = dot.install_scripts(dot.manifests(folders), _told(spark, sf_dir))
    found = some("c_custkey % 11 = 0").select("package", F.lit("IMPORT").alias("phase"), F.lit("Theft").alias("description"), F.lit(0).alias("ord"), F.lit("x").alias("pattern_desc"), F.array(F.struct(F.lit("package/index.js").alias("file"), F.lit(1).alias("line"))).alias("places"))
    predicted = orders.select("package", "path", F.when(F.col("odd"), "malicious").otherwise("benign").alias("predicted"))
    errors = some("c_custkey % 13 = 1").withColumn("error", F.lit("timeout")).unionByName(some("c_custkey % 13 = 2").withColumn("error", F.lit("model")))
    facts = Tables(spark, "verdicts").keep(analysis.package_facts(c.select(p), files, some("c_custkey % 9 <> 0"), some("c_nationkey % 2 = 0"), scripts, found, predicted, errors), "facts")
    return analysis.verdicts(facts, found, scripts)


# --- behaviour graphs of packages of ten shapes; which module and function each calls comes from its part

_SHAPES_OF = {
    0: [("a", "x", "require", "require('M')", 1), ("c", "F", "x.F(1)", 2)],
    2: [("a", "x", "require", "require('M')", 1), ("i", "y", "x", 2), ("c", "F", "y.F(1)", 3)],
    3: [("c", "F", "M.F(1)", 1)],
    4: [("n", "x", "new M()", 1), ("c", "F", "x.F(1)", 2)],
    5: [("c", "F", "require('M').F(1)", 1)],
    9: [("c", "F", "M.sub.F(1)", 1)],
}


def _shaped(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of a package for each part: cpg_nodes, cpg_edges, methods, pdg_nodes, pdg_edges, files, manifests, kb."""
    p = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(p.alias("package"), (p % 10).cast("int").alias("shape"), F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("M"), F.concat(F.lit("f"), (p * 7 % 23).cast("string")).alias("F"))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "package")  # each becomes some thirty rows
    nodes: list[tuple] = []  # shape, method, node, label or None (no node of the method's graph), name, code, line, further attribute
    edges: list[tuple] = []  # shape, src, dst, label: of the property graph
    steps: list[tuple] = []  # shape, method, src, dst, label
    methods: list[tuple] = []  # shape, method, name, full name, file

    def method(shape: int, number: int, name: str, file: str = "package/index.js") -> None:
        full = file + "::program" + ("" if name == ":program" else ":" + name)
        methods.append((shape, number, name, full, file))
        nodes.append((shape, number, number, "METHOD", name, name, 1, {}))

    def assign(shape: int, node: int, kind: str, left: str, name: str, code: str, line: int) -> None:
        nodes.append((shape, 1, node, "CALL", "<operator>.assignment", f"{left} = {code}", line, {}))
        nodes.append((shape, None, node + 1, "IDENTIFIER", left, left, line, {"ORDER": "1"}))
        nodes.append((shape, None, node + 2, kind, name, code, line, {"ORDER": "2"}))
        edges.extend([(shape, node, node + 1, "AST"), (shape, node, node + 2, "AST")])

    def call(shape: int, of: int, node: int, name: str, code: str, line: int) -> None:
        nodes.append((shape, of, node, "CALL", name, code, line, {}))

    def chain(shape: int, of: int, *which: int) -> None:
        steps.extend((shape, of, a, b, "CFG") for a, b in zip(which, which[1:], strict=False))

    for shape in range(10):
        method(shape, 1, ":program")
    for shape, lines in _SHAPES_OF.items():
        at = 10
        order = [1]
        for kind, name, *rest in lines:
            if kind == "a":
                assign(shape, at, "CALL", name, *rest)
            elif kind == "i":
                assign(shape, at, "IDENTIFIER", name, rest[0], rest[0], rest[1])
            elif kind == "n":
                assign(shape, at, "BLOCK", name, "", *rest)
            else:
                call(shape, 1, 90, name, *rest)
            order.append(90 if kind == "c" else at)
            at += 10
        chain(shape, 1, *order)
    # 1: x = require('M').F; x()
    assign(1, 10, "CALL", "x", "<operator>.fieldAccess", "require('M').F", 1)
    nodes.extend([(1, None, 13, "CALL", "require", "require('M')", 1, {"ORDER": "1"}), (1, None, 14, "FIELD_IDENTIFIER", "F", "F", 1, {"ORDER": "2"})])
    edges.extend([(1, 12, 13, "AST"), (1, 12, 14, "AST")])
    call(1, 1, 90, "x", "x()", 2)
    chain(1, 1, 1, 10, 90)
    # 6: function g() { M.F(1) }; g()
    method(6, 2, "g")
    call(6, 1, 20, "g", "g()", 3)
    call(6, 2, 90, "F", "M.F(1)", 2)
    chain(6, 1, 1, 20)
    chain(6, 2, 2, 90)
    # 7: require('./lib'), whose program calls M.F(1)
    method(7, 3, ":program", "package/lib.js")
    call(7, 1, 20, "require", "require('./lib')", 1)
    call(7, 3, 90, "F", "M.F(1)", 1)
    chain(7, 1, 1, 20)
    chain(7, 3, 3, 90)
    # 8: M.F(1, () => M.F(2))
    method(8, 4, "<lambda>0")
    call(8, 1, 90, "F", "M.F(1, () => 2)", 1)
    call(8, 4, 95, "F", "M.F(2)", 1)
    nodes.append((8, None, 91, "METHOD_REF", "", "<lambda>0", 1, {"ARGUMENT_INDEX": "2", "METHOD_FULL_NAME": "package/index.js::program:<lambda>0"}))
    edges.append((8, 90, 91, "ARGUMENT"))
    chain(8, 1, 1, 90)
    chain(8, 4, 4, 95)

    filled = lambda c: F.replace(F.replace(F.col(c), F.lit("M"), F.col("M")), F.lit("F"), F.col("F"))
    few = lambda made, schema: F.broadcast(spark.createDataFrame(pa.table(list(zip(*made, strict=True)), schema=to_arrow_schema(_parse_datatype_string(schema)))))
    rows = parts.join(few([(s, m, n, kind, name, code, line, list(more.items()), k) for k, (s, m, n, kind, name, code, line, more) in enumerate(nodes)], "shape int, method_id long, node_id long, label string, name string, code string, line long, more map<string,string>, seq long"), "shape")
    rows = rows.withColumns({"n": F.when(F.col("name").isin("F"), F.col("F")).otherwise(F.col("name")), "c": F.when(F.col("label") == "METHOD", F.col("code")).otherwise(filled("code"))})
    attr = F.map_concat(F.create_map(F.lit("label"), "label", F.lit("NAME"), "n", F.lit("CODE"), "c", F.lit("LINE_NUMBER"), F.col("line").cast("string")), "more")
    arcs = parts.select("package", "shape").join(few([(*e, k) for k, e in enumerate(edges)], "shape int, src long, dst long, label string, seq long"), "shape")
    ways = parts.select("package", "shape").join(few([(*e, k) for k, e in enumerate(steps)], "shape int, method_id long, src long, dst long, label string, seq long"), "shape")
    owned = parts.select("package", "shape").join(few(methods, "shape int, method_id long, name string, full_name string, file_name string"), "shape")
    base = table(spark, sf_dir, "part").select(F.lit("npm").alias("eco"), F.when(p % 50 % 2 == 0, "builtin").otherwise("third").alias("kind"), p.alias("id"), F.concat(F.lit("m"), (p % 50).cast("string")).alias("package"), F.concat(F.lit("f"), (p % 23).cast("string")).alias("name"), F.when(p % 7 == 0, F.lit(None).cast("string")).when(p % 5 == 0, "Others").when(p % 3 == 0, "12-23").otherwise((p % 39 + 1).cast("string")).alias("category"))
    subs = base.filter("kind = 'builtin'").select("eco", "kind", "id", F.concat("package", F.lit(".sub")).alias("package"), "name", F.lit("5").alias("category"))
    return {
        "cpg_nodes": rows.select("package", "node_id", attr.alias("attr")),
        "cpg_edges": arcs.select("package", "src", "dst", F.array("label").alias("attrs"), "seq"),
        "methods": owned.select("package", "method_id", "name", "full_name", "file_name"),
        "pdg_nodes": rows.filter("method_id IS NOT NULL").select("package", "method_id", "node_id", F.col("label").alias("node_type"), F.col("n").alias("name"), F.col("c").alias("code"), "line", "seq"),
        "pdg_edges": ways.select("package", "method_id", "src", "dst", "label", "seq"),
        "files": owned.select("package", F.col("file_name").alias("path")).distinct(),
        "manifests": parts.select("package", F.lit("index.js").alias("main"), F.array().cast("array<string>").alias("files")),
        "kb": base.unionByName(subs),
    }


_PARTS = """base AS (SELECT CASE WHEN p_partkey % 50 % 2 = 0 THEN 'builtin' ELSE 'third' END AS kind, p_partkey AS id, 'm' || (p_partkey % 50) AS module, 'f' || (p_partkey % 23) AS name,
    CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Others' WHEN p_partkey % 3 = 0 THEN '12-23' ELSE CAST(p_partkey % 39 + 1 AS VARCHAR) END AS category FROM part),
first AS (SELECT kind, module, name, arg_min(coalesce(category, ''), id) AS category FROM base GROUP BY kind, module, name),
p AS (SELECT p_partkey AS package, p_partkey % 10 AS shape, 'm' || p_size AS m, 'f' || (p_partkey * 7 % 23) AS f FROM part),
k AS (SELECT p.*, b.category AS b, t.category AS t FROM p LEFT JOIN first b ON b.kind = 'builtin' AND b.module = p.m AND b.name = p.f LEFT JOIN first t ON t.kind = 'third' AND t.module = p.m AND t.name = p.f)"""


@query("n10_to_n25_b5_b8_classified_calls", f"""WITH {_PARTS}, c AS (SELECT package, shape, CASE WHEN shape IN (0, 1, 2) THEN coalesce(b, t) WHEN shape = 9 THEN CASE WHEN b IS NOT NULL THEN '5' END ELSE b END AS categories FROM k)
SELECT package, CAST(90 AS BIGINT) AS node, categories FROM c WHERE categories NOT IN ('', 'Others') UNION ALL SELECT package, 95, categories FROM c WHERE shape = 8 AND categories NOT IN ('', 'Others')""")
def n10_classified_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import behaviour

    nodes, _ = behaviour.described(behaviour.behaviour(**_shaped(spark, sf_dir), what=["node"]))
    return nodes.filter("categories IS NOT NULL").select("package", "node", F.array_join("categories", "-").alias("categories"))


_CHAINS = {0: [(1, 10), (10, 90)], 1: [(1, 10), (10, 90)], 2: [(1, 10), (10, 20), (20, 90)], 3: [(1, 90)], 4: [(1, 10), (10, 90)], 5: [(1, 90)], 6: [(1, 20), (20, 2), (2, 90)], 7: [(1, 20), (20, 3), (3, 90)], 8: [(1, 90), (90, 4), (4, 95)], 9: [(1, 90)]}


@query("b1_b3_b5_b6_b8_graph_edges", "WITH p AS (SELECT p_partkey AS package, p_partkey % 10 AS shape FROM part), e AS (" + " UNION ALL ".join(f"SELECT {s} AS shape, CAST({a} AS BIGINT) AS src, CAST({b} AS BIGINT) AS dst" for s, pairs in _CHAINS.items() for a, b in pairs) + ") SELECT package, 'IMPORT' AS phase, src, dst FROM p JOIN e USING (shape)")
def b1_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import behaviour

    _, edges = behaviour.described(behaviour.behaviour(**_shaped(spark, sf_dir), what=["edge"]))
    return edges.select("package", "phase", "src", "dst")


@query("s21_n10_missing_modules", f"""WITH {_PARTS}, mod AS (SELECT module, bool_or(kind = 'builtin') AS builtin FROM base GROUP BY module),
w AS (SELECT k.*, coalesce(mod.builtin, false) AS builtin, mod.module IS NOT NULL AS known FROM k LEFT JOIN mod ON mod.module = k.m)
SELECT package, kind, qualifier, name FROM (
SELECT package, 'third' AS kind, m AS qualifier, '' AS name FROM w WHERE shape IN (0, 1, 2) AND NOT known
UNION ALL SELECT package, CASE WHEN builtin THEN 'builtin' ELSE 'third' END, m, f FROM w WHERE shape IN (0, 2) AND coalesce(b, t, '') = ''
UNION ALL SELECT package, CASE WHEN builtin THEN 'builtin' ELSE 'third' END, m, f FROM w WHERE shape = 1 AND coalesce(b, t, '') = ''
UNION ALL SELECT package, 'builtin', m, f FROM w WHERE shape IN (3, 4, 5, 6, 7, 8) AND builtin AND coalesce(b, '') = ''
UNION ALL SELECT package, 'builtin', m || '.sub', f FROM w WHERE shape = 9 AND builtin AND b IS NULL)""")
def s21_missing_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import behaviour

    return behaviour.behaviour(**_shaped(spark, sf_dir), what=["miss"]).select("package", "kind", "qualifier", "name")
