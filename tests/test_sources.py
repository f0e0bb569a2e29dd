"""Sources, manifests, scripts, syntax trees, names, scoring and reports on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import features, js
from tessera.operators import ast, kb, report, resolve, scoring
from tessera.sources import dot


def test_dot_statements():
    text = 'digraph "g x" {\nnode [shape="box"]; rankdir=LR\n1 [label="a \\"b\\"" NAME="x" CODE="f(1, 2); // no"] // comment\n1 -> 2 -> 3 [label="CFG"]\n"4" -- 5\n}'
    got = list(dot.statements(text))
    assert got[0][:4] == (False, "1", None, {"label": 'a "b"', "NAME": "x", "CODE": "f(1, 2); // no"})
    assert [(h, t, a) for e, h, t, a, _ in got if e] == [("1", "2", {"label": "CFG"}), ("2", "3", {"label": "CFG"}), ("4", "5", {})]
    assert list(dot.statements("")) == [] and list(dot.statements("digraph {")) == []


def test_cpg_tables(spark):
    text = 'digraph {\n1 [label="A" X="1"]\n1 [X="2"]\n1 -> 2 [label="AST"]\n1 -> 2 [label="CALL"]\n}'
    parsed = dot.parse_dot(spark.createDataFrame([("p", text), ("q", None)], "package string, text string"), ["package"])
    nodes, edges = dot.cpg_tables(parsed)
    assert {(r["node_id"], tuple(sorted(r["attr"].items()))) for r in nodes.collect()} == {(1, (("X", "2"), ("label", "A"))), (2, ())}
    assert [(r["src"], r["dst"], r["attrs"]) for r in edges.collect()] == [(1, 2, ["AST", "CALL"])]


def test_package_folders(spark, tmp_path):
    root = tmp_path / "some root"
    (root / "p" / "package" / "lib").mkdir(parents=True)
    (root / "q").mkdir()
    (root / "p" / "package" / "package.json").write_text(json.dumps({"main": "m.js", "scripts": {"postinstall": "node a.js", "test": "x"}, "dependencies": {"@s/d": "1"}}))
    (root / "p" / "package" / "lib" / "a b.js").write_text(" x \n y")
    (root / "q" / "package.json").write_text("{}")
    files = dot.package_files(spark, f"file://{root}")
    assert [(r["package"], r["path"], r["lines"]) for r in files.collect()] == [("p", "package/lib/a b.js", ["x", "y"])]
    found = dot.package_files(spark, f"file://{root}", "*.json")
    row = dot.manifests(found).first()
    assert dot.manifests(found).count() == 1 and (row["main"], row["scripts"], row["dependencies"]) == ("m.js", {"postinstall": "node a.js"}, ["@s/d"])
    packages = spark.createDataFrame([("p",), ("q",)], "package string")
    assert {(r["package"], r["manifest_exists"]) for r in dot.manifest_status(packages, found).collect()} == {("p", True), ("q", False)}


def test_install_scripts(spark):
    table = spark.createDataFrame([("p", {"preinstall": "curl x | sh", "install": "node a.js && node ./b.js", "postinstall": "make"}), ("q", {"install": "run"})], "package string, scripts map<string,string>")
    verdicts = spark.createDataFrame([("script_type", "curl x | sh", 'so {"Type": "Shell_Command"}'), ("shell", "curl x | sh", '{"Description": "d", "Judgement": "malicious"}'), ("script_type", "run", '{"Type": "Node", "Run": ["c.js"]}')], "kind string, input string, answer string")
    rows = dot.install_scripts(table, verdicts)
    got = {(r["package"], r["phase"]): r["script"] for r in rows.collect()}
    assert got["p", "install"]["files"] == ["a.js", "./b.js"] and got["p", "install"]["static"] and got["q", "install"]["files"] == ["c.js"]
    assert got["p", "preinstall"]["malicious"] and got["p", "preinstall"]["shell_command"] == "curl x | sh" and got["p", "postinstall"]["script_type"] is None
    assert {(r["package"], r["malicious_script"]) for r in dot.script_only_status(rows).collect()} == {("p", True), ("q", False)}
    back = rows.select("script", dot.script_from_json(dot.script_json(F.col("script"))).alias("b"), dot.script_entry(F.col("script")).alias("e")).collect()
    assert all(r["b"]["files"] == r["script"]["files"] and r["b"]["malicious"] == r["script"]["malicious"] for r in back)
    assert {json.dumps(json.loads(r["e"]), sort_keys=True) for r in back if r["script"]["script_type"] == "Shell Command"} == {'{"shell_command": "curl x | sh", "shell_command_description": "d"}'}
    assert dot.uncached(rows, spark.createDataFrame([("p",)], "package string")).count() == 1


@pytest.mark.parametrize(
    ("code", "shape"),
    [
        ("const {a, b: c} = require('m')", "(lexical_declaration (variable_declarator (object_pattern shorthand_property_identifier_pattern (pair_pattern property_identifier identifier)) (call_expression identifier (arguments (string string_fragment)))))"),
        ("x => x + 1", "(expression_statement (arrow_function identifier (binary_expression identifier number)))"),
        ("a = b\n/c/d", "(expression_statement (assignment_expression identifier (binary_expression (binary_expression identifier identifier) identifier)))"),
        ("a = /c/d", "(expression_statement (assignment_expression identifier (regex regex_pattern regex_flags)))"),
        ("a.b(", "(ERROR (member_expression identifier property_identifier))"),
        ("new Foo.Bar(1).baz()", "(expression_statement (call_expression (member_expression (new_expression (member_expression identifier property_identifier) (arguments number)) property_identifier) arguments))"),
        ("`a${b}`", "(expression_statement (template_string string_fragment (template_substitution identifier)))"),
    ],
)
def test_parser_shapes(code, shape):
    def show(n):
        return n.type if not n.children else f"({n.type} {' '.join(map(show, n.children))})"

    assert show(js.parse(code).children[0]) == shape


@pytest.mark.parametrize("code", ["", "(", "}{", "a" * 5000, "[" * 2000, "x = " * 500, "`${`${", "'", "/*", "\\", "é = 1; 日本()", "if else for", "a?.b ?? c ||= d", "class { #x; static { } }", "\x00\x01", "async async => await async"])
def test_parser_ends_and_covers(code):
    root = js.parse(code)
    for n in root.walk():
        assert all(n.start <= c.start <= c.end <= n.end for c in n.children)
    assert js.beautify(code) is not None and len(js.rows(root)) == sum(1 for _ in root.walk())


def test_tree_operators(spark):
    files = spark.createDataFrame([("p", "f(g(1)); h(() => { k(2) });")], "path string, text string")
    tree = ast.parse_js(files, ["path"])
    call = ast.Shape("call_expression", [ast.Shape("identifier", field="function", capture="f")])
    found = ast.query(tree, ["path"], call)
    assert sorted(r["f_text"] for r in found.collect()) == ["f", "g", "h", "k"]
    assert ast.first_capture(found, ["path"], "f").first()["f_text"] == "f" and ast.last_capture(found, ["path"], "f").first()["f_text"] == "k"
    assert ast.top_statements(tree, ["path"]).count() == 2 and ast.top_subscripts(tree, ["path"]).count() == 1
    assert ast.children(tree, ["path"], "expression_statement").count() == 3 and ast.first_child(tree, ["path"], "expression_statement").count() == 2
    at = spark.createDataFrame([("p", 0, 4), ("p", 5, 5)], "path string, row int, col int")
    assert [(r["row"], r["statement_col"]) for r in ast.statement_at(tree, ["path"], at).collect()] == [(0, 0)]


def test_rewriting():
    assert ast.split_requires("const {a: b} = require('m')", fix_alias=False) == "const a = require('m').b"
    assert ast.split_requires("const {a, ...r} = require('m')") == "const {a, ...r} = require('m')"
    assert ast.drop_await("async () => { await a(); b = 'await a()' }") == "async () => { a(); b = 'a()' }"
    assert ast.fix_for_each("x.forEach(y => y)") == "x.forEach(y => y)"


def test_functions_first_definition_wins(spark):
    files = spark.createDataFrame([("p", "b.js", "function f() { return 2 }"), ("p", "a.js", "// first\nfunction f() { return 1 }"), ("p", "x.ts", "function z() {}")], "package string, path string, text string")
    got = ast.functions(files).collect()
    assert [(r["name"], r["file"], r["comment"], r["code"]) for r in got] == [("f", "a.js", "first", "function f() { return 1 }")] and ast.functions(files, "python").count() == 0


def test_formal_parameters(spark):
    rows = spark.createDataFrame([(1, 1, "(a, b = 1) => a"), (1, 2, "x => x"), (1, 3, "1")], "package int, method long, code string")
    assert {(r["method"], tuple(r["formal"])) for r in ast.formal_parameters(rows).collect()} == {(1, ("a", "b = 1")), (2, ("x",)), (3, ())}


def test_gram_vectors(spark):
    rows = spark.createDataFrame([("f", [30, 17, 11, 6, 18]), ("g", [1, 2]), ("h", [])], "key string, codes array<int>")
    counts = features.gram_counts(rows, "key", "codes", 3)
    assert {(r["gram"], r["count"], r["total"]) for r in counts.collect()} == {("(30, 17, 11)", 1, 3), ("(17, 11, 6)", 1, 3), ("(11, 6, 18)", 1, 3)}
    known = spark.createDataFrame([("(17, 11, 6)", 0)], "gram string, idx long")
    got = {r["gram"]: (r["idx"], r["share"]) for r in features.gram_index(counts, "key", known, 3).collect()}
    assert got == {"(17, 11, 6)": (0, 1 / 3), "(30, 17, 11)": (1, 1 / 3), "(11, 6, 18)": (2, 1 / 3)}
    full = known.withColumn("idx", F.lit(3999).cast("long"))
    assert len({r["idx"] for r in features.gram_index(counts, "key", full, 3).collect()}) == 3


def test_worked_scopes(spark):
    bindings = spark.createDataFrame([("p", "f", [], 0, "x", 1), ("p", "f", [], 1, "x", 5), ("p", "f", ["i"], 2, "x", 3), ("p", "f", [], 3, "y", 9), ("p", "f", [], 4, "y", 2)], "package string, file string, scope_path array<string>, seq long, name string, line int")
    uses = spark.createDataFrame([(1, "p", "f", ["i"], "x", 4), (2, "p", "f", ["i"], "x", 2), (3, "p", "f", [], "x", 6), (4, "p", "f", [], "x", 0), (5, "p", "f", [], "y", 10)], "id long, package string, file string, scope_path array<string>, name string, line int")
    got = {r["id"]: r["binding"]["line"] if r["binding"] else None for r in resolve.resolve(uses, bindings, "id").collect()}
    assert got == {1: 3, 2: 1, 3: 5, 4: None, 5: 2}
    s = uses.limit(1).select(resolve.push(F.col("scope_path"), F.lit("j")).alias("a"), resolve.pop(F.col("scope_path")).alias("b"), resolve.is_inside(F.col("scope_path"), F.lit("i")).alias("c")).first()
    assert (s["a"], s["b"], s["c"]) == (["i", "j"], [], True)


def test_seeds_and_local_imports(spark):
    methods = spark.createDataFrame([("p", "a.js", 1, ":program"), ("p", "a.js", 2, "f"), ("p", "a.js", 3, "<lambda>0")], "package string, file_name string, method_id long, name string")
    assert [r["name"] for r in resolve.seeded(methods).collect()] == ["f"]
    imports = spark.createDataFrame([("p", "package/x/a.js", e) for e in ("./b", "fs", "m", "socket.io")], "package string, file string, entity string")
    files = spark.createDataFrame([("p", "package/x/m.js")], "package string, path string")
    assert {r["entity"]: r["is_local"] for r in resolve.local_imports(imports, files).collect()} == {"./b": True, "fs": False, "m": True, "socket.io": True}


def test_knowledge_base(spark):
    base = spark.createDataFrame([("npm", "builtin", 1, "fs", "a", "12-23"), ("npm", "builtin", 2, "fs", "b", "Others"), ("npm", "third", 3, "fs", "c", None), ("npm", "third", 4, "q", "q", "")], "eco string, kind string, id long, package string, name string, category string")
    calls = spark.createDataFrame([("builtin", "fs", "a"), ("builtin", "fs", "b"), ("third", "fs", "c"), ("third", "z", "z"), ("third", "q", "q")], "kind string, qualifier string, name string")
    answers = spark.createDataFrame([("third", "fs", "c", ["7"]), ("third", "q", "q", ["3", "Others"])], "kind string, qualifier string, name string, categories array<string>")
    got = {(r["qualifier"], r["name"]): (r["sensitive"], r["categories"], r["known"]) for r in kb.sensitive_calls(calls, base, answers).collect()}
    assert got == {("fs", "a"): (True, ["12", "23"], True), ("fs", "b"): (False, None, True), ("fs", "c"): (True, ["7"], True), ("z", "z"): (False, None, False), ("q", "q"): (False, None, True)}
    assert [(r["qualifier"], r["uses"]) for r in kb.misses(kb.sensitive_calls(calls, base)).filter("qualifier = 'z'").collect()] == [("z", 1)]
    modules = spark.createDataFrame([("fs",), ("q",), ("n",), ("_fs",), (None,)], "module string")
    assert {r["module"]: r["origin"] for r in kb.origin(modules, base).collect()} == {"fs": "BUILTIN", "q": "THIRD_PART", "n": "NOT_IN", "_fs": "NOT_IN", None: "NOT_IN"}
    assert kb.is_function_of(calls.withColumnRenamed("qualifier", "package"), base).count() == 2
    more = kb.inserted(base, spark.createDataFrame([("npm", "third", 9, "r", "s")], "eco string, kind string, id long, package string, name string"))
    assert more.count() == 5 and more.columns == base.columns


def test_scoring(spark):
    rows = [(f"f{i}", [float(i % 7), 0.0], {0: (i % 5) / 5}, float(i % 7 > 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, lexical array<double>, shares map<long,double>, label double")
    table = df.select("name", "label", scoring.feature_vector(F.col("lexical"), F.col("shares"), 4).alias("features"))
    assert len(table.first()["features"]) == 6
    model = scoring.forest(trees=5).fit(table)
    scored = scoring.votes(scoring.score(table, model, 0.5), model, 0.5)
    r = scored.collect()
    assert sum((x["predicted"] == "malicious") == (x["label"] == 1) for x in r) >= 55 and all(0 <= x["agreeing"] <= x["trees"] == 5 for x in r)
    p = spark.createDataFrame([(0.69,), (0.70,), (0.71,)], "p double").select(scoring.predicted(F.col("p"), 0.7).alias("v"))
    assert [x["v"] for x in p.collect()] == ["benign", "malicious", "malicious"]
    unknown = spark.createDataFrame([("?", "benign"), ("benign", "benign")], "label string, predicted string")
    assert scoring.confusion(unknown).first()["tn"] is None
    files = spark.createDataFrame([("p", "a.js", "malicious"), ("p", "b.js", None), ("q", "c.js", "benign")], "package string, path string, predicted string")
    assert {x["package"]: (x["obfuscated"], x["files"]) for x in scoring.obfuscated_packages(files).collect()} == {"p": (True, ["a.js"]), "q": (False, [])}


def test_learned_features(spark):
    files = spark.createDataFrame([("a", "var x = f(1)"), ("b", ""), ("c", "x")], "path string, text string")
    known = ast.learn_dictionary(files, "path")
    assert [r["idx"] for r in known.orderBy("idx").collect()] == list(range(known.count()))
    got = {r["path"]: r for r in ast.feature_table(files, "path", known).collect()}
    assert set(got) == {"a", "c"} and abs(sum(got["a"]["shares"].values()) - 1) < 1e-9


def test_reports(spark):
    packages = spark.createDataFrame([("p",), ("q",)], "package string")
    found = spark.createDataFrame([("p", "RUN", "Theft", 0, 'x "y"', [("a.js", 2), ("a.js", 1)])], "package string, phase string, description string, ord int, pattern_desc string, places array<struct<file string, line int>>")
    scripts = spark.createDataFrame([("p", "install", "i", 1), ("p", "postinstall", "j", 2)], "package string, phase string, desc string, ord int")
    got = {r["package"]: (r["malicious"], json.loads(r["report"])) for r in report.report(packages, found, scripts).collect()}
    assert got["q"] == (False, {"Malicious": False})
    assert got["p"] == (True, {"Malicious": True, "INSTALL TIME SCRIPT": {"install": "i", "postinstall": "j"}, "RUN": {"Theft": [{"pattern desc": 'x "y"', "file": {"a.js": [1, 2]}}]}})
    last = report.report(packages, found, scripts, last_phase_only=True).filter("package = 'p'").first()
    assert json.loads(last["report"])["INSTALL TIME SCRIPT"] == {"postinstall": "j"}


def test_small_sinks_and_sources(spark, tmp_path):
    base = spark.createDataFrame([("npm", "third", 1, "m", "f", "7")], "eco string, kind string, id long, package string, name string, category string")
    base.write.parquet(f"file://{tmp_path}/kb")
    read = kb.read_kb(spark, f"file://{tmp_path}/kb")
    assert read.columns == [x.split()[0] for x in kb.SCHEMA.split(", ")] and read.first()["category"] == "7" and read.first()["code"] is None
    statuses = spark.createDataFrame([("p", "Malicious"), ("q", None), ("r", "Benign")], "package string, status string")
    report.write_log(statuses, f"file://{tmp_path}/log")
    report.write_log(statuses.limit(1), f"file://{tmp_path}/log", overwrite=False)
    lines = sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/log").collect())
    assert lines == ["CRITICAL p: Malicious", "CRITICAL p: Malicious", "INFO r: Benign"]
    counts = spark.createDataFrame([("a", "(1, 2)", 3), ("a", "(2, 3)", 1), ("b", "(1, 2)", 5)], "k string, gram string, count long")
    shares = {r["k"]: r["shares"] for r in features.hashed_shares(counts, "k", 1000).collect()}
    assert sorted(shares["a"].values()) == [0.25, 0.75] and list(shares["b"].values()) == [1.0] and set(shares["b"]) < set(shares["a"])
    assert features.stacked(None, None) is None


def test_saved_features_are_scored_alike(spark, tmp_path):
    rows = [(f"f{i}", [float(i % 2)] * 11, {0: i / 40}, i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "name string, lexical array<double>, shares map<long,double>, label int")
    table = table.select("name", "label", scoring.feature_vector(F.col("lexical"), F.col("shares"), 3).alias("features"))
    scoring.save_features(table, f"file://{tmp_path}/features")
    model = scoring.forest(trees=5, depth=4).fit(table)
    got = {r["name"]: (r["probability"], r["predicted"]) for r in scoring.score_saved(spark, f"file://{tmp_path}/features", model).collect()}
    assert got == {r["name"]: (r["probability"], r["predicted"]) for r in scoring.score(table, model).collect()}
    assert all((got[f"f{i}"][1] == "malicious") == (i % 2 == 1) for i in range(40))


def test_lines_are_repaired_as_files_are_read(spark):
    text = 'digraph {\n1 [DYNAMIC_TYPE_HINT_FULL_NAME="a"b" NAME="x"]\n2 [NAME="y"]\n1 -> 2 [label="CFG"]\n}'
    got = dot.parse_dot(spark.createDataFrame([("p", text), ("q", None)], "package string, text string"), ["package"]).collect()
    assert [r["attr"].get("DYNAMIC_TYPE_HINT_FULL_NAME") for r in got if not r["is_edge"]] == ['a"b', None] and len(got) == 3
