"""What grows with the tables stays in proportion to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import behaviour


def _package(spark, n: int) -> dict:
    """n packages that call m.f(1) and buf.g(1), the object class being in the base."""
    p = spark.range(n).select(F.col("id").alias("package"))
    node = lambda i, kind, name, code: F.struct(F.lit(i).cast("long").alias("node_id"), F.lit(kind).alias("node_type"), F.lit(name).alias("name"), F.lit(code).alias("code"), F.lit(1).cast("long").alias("line"), F.lit(i).cast("long").alias("seq"))
    nodes = p.select("package", F.lit(1).cast("long").alias("method_id"), F.explode(F.array(node(1, "METHOD", ":program", ":program"), node(2, "CALL", "f", "m.f(1)"), node(3, "CALL", "g", "buf.g(1)")))).select("package", "method_id", "col.*")
    step = lambda a, b: F.struct(F.lit(a).cast("long").alias("src"), F.lit(b).cast("long").alias("dst"), F.lit("CFG").alias("label"), F.lit(a).cast("long").alias("seq"))
    return {
        "cpg_nodes": nodes.select("package", "node_id", F.create_map(F.lit("label"), "node_type", F.lit("NAME"), "name", F.lit("CODE"), "code", F.lit("LINE_NUMBER"), F.lit("1")).alias("attr")),
        "cpg_edges": spark.createDataFrame([], "package long, src long, dst long, attrs array<string>, seq long"),
        "methods": p.select("package", F.lit(1).cast("long").alias("method_id"), F.lit(":program").alias("name"), F.lit("package/index.js::program").alias("full_name"), F.lit("package/index.js").alias("file_name")),
        "pdg_nodes": nodes,
        "pdg_edges": p.select("package", F.lit(1).cast("long").alias("method_id"), F.explode(F.array(step(1, 2), step(2, 3)))).select("package", "method_id", "col.*"),
        "files": p.select("package", F.lit("package/index.js").alias("path")),
        "manifests": p.select("package", F.lit("index.js").alias("main"), F.array().cast("array<string>").alias("files")),
    }


def test_equal_functions_of_the_base_do_not_multiply(spark, monkeypatch):
    """packages times rows of a function in the base grew with the square of the tables."""
    rows = [("npm", "builtin", i, "m", "f", str(i % 39 + 1)) for i in range(7, 507)] + [("npm", "third", 1, "m", "f", "9"), ("npm", "builtin", 3, "buf", "g", None), ("npm", "builtin", 4, "buf", "g", "5"), ("npm", "builtin", 5, "m", None, "6")]
    kb = spark.createDataFrame(rows, "eco string, kind string, id long, package string, name string, category string")
    sent = {}
    inner = behaviour.by_package
    monkeypatch.setattr(behaviour, "by_package", lambda tables, *rest: sent.update(tables) or inner(tables, *rest))
    got = behaviour.behaviour(**_package(spark, 20), kb=kb)
    assert sent["kb"].count() == 20 * 2
    found = {(r["package"], r["node"]): r["categories"] for r in got.filter("what = 'node'").collect()}
    assert found == {(p, i): c for p in range(20) for i, c in ((1, None), (2, ["8"]), (3, None))}  # the smallest id counts
    assert {tuple(r) for r in got.filter("what = 'miss'").select("package", "kind", "qualifier", "name").collect()} == {(p, "builtin", "buf", "g") for p in range(20)}


def test_equal_packages_are_walked_once(spark):
    """of 600 packages with two contents, in any order of their rows, each task walks two."""
    from tessera.operators import graph

    def walk(held):
        import uuid

        made = str(uuid.uuid4())
        yield {"made": made, "what": ",".join(sorted(r["x"] for r in held["t"]))}
        yield {"made": made, "what": None}

    p = spark.range(600).select(F.col("id").alias("package"))
    order = F.when(F.col("package") % 4 < 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    rows = p.select("package", F.explode(F.concat(order, F.when(F.col("package") % 2 == 0, F.array(F.lit("c"))).otherwise(F.array()))).alias("x"))
    got = graph.by_package({"t": rows, "none": rows.filter("x = 'z'")}, walk, "made string, what string").collect()
    assert sorted((r["package"], r["what"] or "") for r in got) == sorted((n, w) for n in range(600) for w in ("", "a,b" if n % 2 else "a,b,c"))
    assert len({r["made"] for r in got}) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_what_is_asked_for_is_written(spark):
    """the query of misses wrote all nodes and edges of the graphs first."""
    kb = spark.createDataFrame([("npm", "builtin", 1, "m", "f", "1"), ("npm", "builtin", 3, "buf", "g", None)], "eco string, kind string, id long, package string, name string, category string")
    whole = behaviour.behaviour(**_package(spark, 3), kb=kb).collect()
    assert {r["what"] for r in whole} == {"node", "edge", "miss"}
    for what in behaviour.WHAT:
        some = behaviour.behaviour(**_package(spark, 3), kb=kb, what=[what]).collect()
        assert sorted(map(str, some)) == sorted(str(r) for r in whole if r["what"] == what)


def test_small_files_share_batches(spark):
    """a batch for each file cost more than its rows."""
    from tessera.operators import ast

    files = spark.range(3000).select("id", F.concat(F.lit("f("), F.col("id") % 7, F.lit(");")).alias("text")).coalesce(1)
    sizes = ast.parse_js(files, ["id"]).mapInArrow(lambda batches: (b.slice(0, 1).select(["id"]) for b in batches), "id long")
    assert sizes.count() < 300
    parsed = ast.unit_types(ast.parse_js(files, ["id"]), ["id"]).collect()
    assert len(parsed) == 3000 and {tuple(r["types"]) for r in parsed} == {("program", "expression_statement", "call_expression", "identifier", "arguments", "number")}


def test_memo_is_bounded():
    from tessera.session import Memo

    made = []
    memo = Memo(lambda t: made.append(t) or len(t), room=10, longest=5)
    assert [memo(t) for t in ("a", "a", "bb", "long text", "long text")] == [1, 1, 2, 9, 9]
    assert made == ["a", "bb", "long text", "long text"]
    for i in range(100):
        assert memo(str(i)) == len(str(i))
    assert sum(map(len, memo.held)) <= 20
