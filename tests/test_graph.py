"""Graph operators: worked-out graphs, and brute force on random ones."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, match, report, resolve
from tessera.session import Tables

EDGES = "package int, src long, dst long, kind string"
NODES = "package int, node long, class string, sensitive boolean"
# Nodes 1, 3, 5 and 6 are sensitive.
WORKED = [(1, 2, "DDG"), (2, 3, "DDG"), (1, 4, "CFG"), (4, 5, "CFG"), (3, 5, "CFG"), (3, 1, "DDG"), (6, 7, "DDG"), (7, 6, "DDG")]
CLASSES = {1: "read data from a file", 3: "send data over the network", 5: "execute a command", 6: "make HTTP request"}


def tables(spark, graphs):
    """graphs: package -> (edges, classes of sensitive nodes, number of nodes)."""
    edges = [(p, *e) for p, (es, _, _) in graphs.items() for e in es]
    nodes = [(p, n, cs.get(n), n in cs) for p, (_, cs, top) in graphs.items() for n in range(1, top + 1)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def contracted(edges, classes):
    """All simple paths through plain nodes, by brute force."""
    ddg, cfg = {}, set()

    def walk(start, at, trail, only):
        for s, d, k in edges:
            if s != at or (only and k != only):
                continue
            if d in classes:
                if only:
                    ddg.setdefault((start, d), set()).update(trail)
                elif d != start:
                    cfg.add((start, d))
            elif d not in trail:
                walk(start, d, [*trail, d], only)

    for s in classes:
        walk(s, s, [], "DDG")
        walk(s, s, [], None)
    return {(s, d, "DDG", tuple(sorted(i))) for (s, d), i in ddg.items()} | {(s, d, "CFG", None) for s, d in cfg if (s, d) not in ddg}


def reachable(edges, kind):
    out = {(s, d) for s, d, k in edges if kind == "CFG" or k == "DDG"}
    while True:
        more = out | {(a, d) for a, b in out for c, d in out if b == c}
        if more == out:
            return {(a, b) for a, b in out if a != b}
        out = more


def random_graphs(n, seed):
    rng = random.Random(seed)
    out = {}
    for p in range(n):
        top = rng.randrange(2, 9)
        pairs = {(rng.randrange(1, top + 1), rng.randrange(1, top + 1)) for _ in range(rng.randrange(1, 16))}
        classes = {i: rng.choice("abc") for i in range(1, top + 1) if rng.random() < 0.5}
        out[p] = ([(s, d, rng.choice(["DDG", "CFG"])) for s, d in sorted(pairs)], classes, top)
    return out


def test_worked_contraction(spark):
    nodes, edges = tables(spark, {1: (WORKED, CLASSES, 7)})
    got = {(r["src"], r["dst"], r["kind"], tuple(r["inner"]) if r["inner"] is not None else None) for r in graph.contract(nodes, edges).collect()}
    assert got == {(1, 3, "DDG", (2,)), (3, 1, "DDG", ()), (6, 6, "DDG", (7,)), (1, 5, "CFG", None), (3, 5, "CFG", None)}
    reach = {(r["src"], r["dst"], r["kind"]) for r in graph.closure(graph.contract(nodes, edges)).collect()}
    assert (1, 5, "CFG") in reach and (1, 5, "DDG") not in reach and (1, 3, "DDG") in reach and (3, 5, "CFG") in reach
    assert not any(a == b for a, b, _ in reach)


def test_random_graphs_equal_brute_force(spark):
    graphs = random_graphs(60, 1)
    nodes, edges = tables(spark, graphs)
    got, joined, reach = {}, {}, {}
    for r in graph.contract(nodes, edges).collect():
        got.setdefault(r["package"], set()).add((r["src"], r["dst"], r["kind"], tuple(r["inner"]) if r["inner"] is not None else None))
    for r in graph.contract_by_joins(nodes, edges, Tables(spark, "test")).collect():
        joined.setdefault(r["package"], set()).add((r["src"], r["dst"], r["kind"]))
    for r in graph.closure_by_joins(edges, Tables(spark, "test")).collect():
        reach.setdefault(r["package"], set()).add((r["src"], r["dst"], r["kind"]))
    shared = {(r["package"], r["src"], r["dst"], r["kind"], tuple(r["inner"] or ())) for r in graph.contract(nodes, edges, large=3).collect()}
    assert shared == {(p, s, d, k, i or ()) for p, rows in got.items() for s, d, k, i in rows}
    assert {tuple(r) for r in graph.closure(edges, large=3).collect()} == {(p, *r) for p, rows in reach.items() for r in rows}
    for p, (es, classes, _) in graphs.items():
        want = contracted(es, classes)
        assert got.get(p, set()) == want
        assert joined.get(p, set()) == {w[:3] for w in want}
        assert reach.get(p, set()) == {(a, b, k) for k in ("CFG", "DDG") for a, b in reachable(es, k)}


def test_dense_cycles_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        top = rng.randrange(2, 10)
        pairs = {(rng.randrange(1, top + 1), rng.randrange(1, top + 1)) for _ in range(rng.randrange(1, 26))}
        classes = {i: "a" for i in range(1, top + 1) if rng.random() < 0.3}
        edges = [(s, d, rng.choice(["DDG", "DDG", "DDG", "CFG"])) for s, d in sorted(pairs)]
        assert walk_of(edges, classes, top) == contracted(edges, classes)


def walk_of(edges, classes, top):
    held = {"nodes": {"node": list(range(1, top + 1)), "sensitive": [i in classes for i in range(1, top + 1)]}, "edges": {k: [e[i] for e in edges] for i, k in enumerate(("src", "dst", "kind"))}}
    out = graph.contract_walk(held)
    return {(*r, None if inner is None else tuple(inner)) for *r, inner in zip(out["src"], out["dst"], out["kind"], out["inner"], strict=True)}


def test_many_paths_take_no_time():
    n = 400  # 2 ** 400 paths
    edges = [e for i in range(n) for a in [3 * i + 1] for e in ((a, a + 1, "DDG"), (a, a + 2, "DDG"), (a + 1, a + 3, "DDG"), (a + 2, a + 3, "DDG"))]
    began = time.time()
    assert walk_of(edges, {1: "a", 3 * n + 1: "a"}, 3 * n + 1) == {(1, 3 * n + 1, "DDG", tuple(range(2, 3 * n + 1)))}
    assert time.time() - began < 5


def test_typed_closure_is_part_of_the_closure(spark):
    nodes, edges = tables(spark, random_graphs(40, 9))
    sens = nodes.filter("sensitive").select("package", "node", "class")
    wanted = {("CFG", "a", "b"), ("DDG", "b", "c"), ("DDG", "a", "a")}
    every = match.typed_pairs(graph.closure(graph.contract(nodes, edges)), sens).select("package", "src", "dst", "kind", "src_class", "dst_class")
    want = {tuple(r) for r in every.collect() if (r["kind"], r["src_class"], r["dst_class"]) in wanted}
    assert {tuple(r) for r in graph.typed_closure(graph.contract(nodes, edges), sens, wanted, large=3).collect()} == want
    assert {tuple(r) for r in graph.contracted_pairs(nodes, edges, wanted).collect()} == want


def test_aliases_that_go_round_in_circles(spark):
    rng = random.Random(4)
    for n in (1, 7, 60):
        after = {i: rng.choice([None, *range(n)]) for i in range(n)}
        after |= {i: n + (i + 1 - n) % 5 for i in range(n, n + 5)} | {n + 5: n + 2, n + 6: 10_000}
        rows = resolve.aliases(spark.createDataFrame(list(after.items()), "id long, alias_of long"), Tables(spark, "alias")).collect()
        for r in rows:
            seen, at = [], r["id"]
            while at not in seen and after.get(at) is not None:
                seen.append(at)
                at = after[at]
            assert r["root"] == (min(seen[seen.index(at) :]) if at in seen else at)
        assert len(rows) == len(after)


def test_unrelated_packages_and_names_do_not_matter(spark):
    graphs = random_graphs(20, 2)
    nodes, edges = tables(spark, graphs)
    alone = {tuple(r) for r in graph.closure(edges.filter("package = 3")).collect()}
    assert alone == {tuple(r) for r in graph.closure(edges).collect() if r["package"] == 3}
    moved = graph.closure(edges.selectExpr("package", "src + 100 AS src", "dst + 100 AS dst", "kind"))
    assert {(r["package"], r["src"] - 100, r["dst"] - 100, r["kind"]) for r in moved.collect()} == {tuple(r) for r in graph.closure(edges).collect()}


def pattern(name, *edges):
    return match.Pattern(name, "bad", name, list(edges))


def test_worked_matching(spark):
    c = CLASSES
    p1, p2, p3, p4 = pattern("p1", (c[1], "DDG", c[3])), pattern("p2", (c[1], "CFG", c[5])), pattern("p3", (c[1], "DDG", c[5])), pattern("p4", (c[1], None, None))
    nodes, edges = tables(spark, {1: (WORKED, CLASSES, 7)})
    sens = nodes.filter("sensitive").select("package", "node", "class")
    pairs = match.typed_pairs(graph.closure(graph.contract(nodes, edges)), sens)
    found = match.matches([p1, p2, p3, p4], pairs, sens)
    assert sorted((r["ord"], tuple(sorted(r["assigned"].values()))) for r in found.collect()) == [(0, (1, 3)), (1, (1, 5)), (3, (1,))]
    for rule, want in (([p1, p4], {0}), ([p4, p1], {0, 1})):
        hits = match.matches(rule, pairs, sens).select("package", "ord")
        assert {r["ord"] for r in match.kept_patterns(hits, rule).collect()} == want
    assert not match.is_sub_pattern(p1, p2) and not match.is_sub_pattern(p2, p1) and match.is_sub_pattern(p4, p1)


def test_random_matches_equal_brute_force(spark):
    graphs = random_graphs(40, 3)
    nodes, edges = tables(spark, graphs)
    sens = nodes.filter("sensitive").select("package", "node", "class")
    rules = [pattern("x", ("a", "CFG", "b")), pattern("y", ("a", "CFG", "b"), ("b", "DDG", "c")), pattern("z", ("a", "DDG", "b"), ("a", "CFG", "c")), pattern("t", ("a", "CFG", "b"), ("b", "CFG", "c"), ("a", "DDG", "c")), pattern("s", ("c", None, None))]
    got = {}
    for r in match.matches(rules, match.typed_pairs(graph.closure(graph.contract(nodes, edges)), sens), sens).collect():
        got.setdefault((r["package"], r["ord"]), set()).add(tuple(r["assigned"][c] for c in rules[r["ord"]].classes))
    for p, (es, classes, _) in graphs.items():
        inner = [(s, d, k) for s, d, k, _ in contracted(es, classes)]
        reach = {k: reachable(inner, k) for k in ("CFG", "DDG")}
        for n, rule in enumerate(rules):
            choices = [()]
            for c in rule.classes:
                choices = [(*x, i) for x in choices for i, k in classes.items() if k == c]
            at = rule.classes.index
            want = {x for x in choices if all((x[at(h)], x[at(t)]) in reach[k] for h, k, t in rule.required())}
            assert got.get((p, n), set()) == want


def test_faithful_and_full_subsumption():
    p = pattern("p", ("a", "CFG", "c"))
    q = pattern("q", ("a", "CFG", "b"), ("a", "CFG", "c"))
    assert not match.is_sub_pattern(p, q) and match.is_sub_pattern(p, q, first_edge_only=False)
    assert pattern("r", ("a", "CFG", "a")).required() == []


@pytest.mark.parametrize(
    ("places", "kept"),
    [
        ([[("a", 1), ("a", 2)], [("a", 1)], [("a", 3)], [("a", 1), ("b", 1)], [("a", 1), ("a", 2)]], [0, 2, 3]),
        ([[("a", 1)], [("a", 1), ("a", 2)]], [0, 1]),
    ],
)
def test_worked_findings(spark, places, kept):
    rows = [("p", "RUN", "d", n, "x", p) for n, p in enumerate(places)]
    df = spark.createDataFrame(rows, "package string, phase string, description string, ord int, pattern_desc string, places array<struct<file string, line int>>")
    assert sorted(r["ord"] for r in report.distinct_findings(df).collect()) == kept


def test_worked_split(spark):
    nodes = spark.createDataFrame([(1, 1, ["12", "23"]), (1, 2, [])], "package int, node long, categories array<string>")
    parts, edges = graph.split_categories(nodes, spark.createDataFrame([(1, 1, 2, "DDG"), (1, 2, 1, "CFG")], EDGES))
    got = {(tuple(r["src"]), tuple(r["dst"]), r["kind"]) for r in edges.collect()}
    assert got == {((1, 0), (1, 1), "DDG"), ((1, 1), (2, 0), "DDG"), ((2, 0), (1, 0), "CFG")}
    assert {(tuple(r["id"]), r["category"]) for r in parts.collect()} == {((1, 0), "12"), ((1, 1), "23"), ((2, 0), None)}


def test_worked_slice(spark):
    pairs = "package int, src long, dst long"
    own = spark.createDataFrame([(1, 10)], "package int, node long")
    got = graph.backward_slice(own, spark.createDataFrame([(1, 3, 10)], pairs), spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 9, 8)], pairs))
    assert {(r["node"], r["src"]) for r in got.collect()} == {(3, None), (2, None), (1, None), (3, 2), (2, 1)}


def test_sets_of_nodes_and_edges(spark):
    edges = spark.createDataFrame([(1, 1, 2, ["CFG"], 0), (1, 1, 2, ["DDG: x"], 1), (1, 2, 3, ["DDG: this"], 2)], "package int, src long, dst long, attrs array<string>, seq long")
    first = graph.first_edges(edges)
    assert {(r["src"], r["dst"], r["attrs"][0]) for r in first.collect()} == {(1, 2, "CFG"), (2, 3, "DDG: this")}
    assert graph.without_edges(edges, edges.filter("src = 2")).count() == 2 and graph.has_edge(edges.filter("src = 1"), first).count() == 2
    assert {(r["node"], tuple(r["neighbours"])) for r in graph.neighbour_sets(edges, incoming=True).collect()} == {(2, (1,)), (3, (2,))}
    nodes = spark.createDataFrame([(1, 1, "a", 0), (1, 1, "b", 1), (1, 2, "c", 2)], "package int, node long, name string, seq long")
    assert {(r["node"], r["name"]) for r in graph.first_nodes(nodes).collect()} == {(1, "a"), (2, "c")}
    entrance = spark.createDataFrame([(1, 9)], "package int, node long")
    sub = spark.createDataFrame([(1, 9, "z", 0), (1, 1, "other", 1)], "package int, node long, name string, seq long")
    n, e = graph.joint(nodes, edges, sub, edges.limit(0), entrance)
    assert {(r["node"], r["name"]) for r in n.collect()} == {(1, "a"), (2, "c"), (9, "z")} and e.count() == 2
    assert graph.joint(nodes, edges, sub, edges, entrance.selectExpr("package", "1L AS node"))[0].count() == 2
    typed = spark.createDataFrame([(1, 1, "PARAM,this"), (1, 1, "PARAM,a"), (1, 2, "PARAM,...r"), (1, 3, "CALL")], "package int, method long, node_type string")
    assert {(r["method"], r["parameters"]) for r in graph.parameter_count(typed).collect()} == {(1, 1), (2, 1000), (3, 0)}


def test_composed_method_graphs(spark):
    single = "package int, method long, src long, dst long, label string, seq long"
    pdg = spark.createDataFrame([(1, 1, 1, 2, "DDG: ", 0), (1, 1, 1, 2, "DDG: x", 1), (1, 1, 2, 3, "CDG: ", 2), (1, 1, 2, 3, "DDG: this", 3), (1, 1, 1, 9, "DDG: y", 4)], single)
    cfg = spark.createDataFrame([(1, 1, 1, 2, None, 0)], single)
    nodes = spark.createDataFrame([(1, 9, "METHOD_RETURN"), (1, 2, "CALL")], "package int, node long, node_type string")
    assert sorted((r["src"], r["dst"], r["label"]) for r in graph.compose(pdg, cfg, nodes).collect()) == [(1, 2, "CFG"), (1, 2, "DDG: x")]
    params = spark.createDataFrame([(1, 1, 11, "METHOD_PARAMETER_IN", "a"), (1, 2, 21, "METHOD_PARAMETER_IN", "b"), (1, 2, 22, "METHOD_PARAMETER_IN", "this")], "package int, method long, node long, node_type string, code string")
    methods = spark.createDataFrame([(1, 1, "f", None), (1, 2, "<lambda>0", ["b"])], "package int, method long, name string, formal array<string>")
    assert {(r["src"], r["dst"]) for r in graph.parameter_edges(params, methods).collect()} == {(1, 11), (2, 21)}


def test_nodes_between_equal_brute_force(spark):
    rng, rows, want = random.Random(14), [], {}
    for p in range(40):
        edges = {(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 14))}
        inner = {e: [100 * e[0] + 10 * e[1] + k for k in range(rng.randrange(3))] for e in sorted(edges)}
        rows += [(p, s, d, "DDG", i) for (s, d), i in inner.items()]

        def paths(at, end, trail, inner=inner):
            for s, d in inner:
                if s == at and d == end:
                    yield [*trail, d]
                elif s == at and d not in trail:
                    yield from paths(d, end, [*trail, d])

        for a in range(6):
            for b in range(6):
                found = [t for t in paths(a, b, [a])]
                if found and a != b:
                    want[p, a, b] = sorted({n for t in found for n in t[1:-1]} | {n for t in found for e in zip(t, t[1:], strict=False) for n in inner[e]})
    contracted = spark.createDataFrame(rows, EDGES + ", inner array<long>")
    pairs = spark.createDataFrame([(p, a, b) for p in range(40) for a in range(6) for b in range(6) if a != b], "package int, src long, dst long")
    assert {(r["package"], r["src"], r["dst"]): r["nodes"] for r in graph.nodes_between(contracted, pairs).collect()} == want


def test_deadlines(spark):
    from tessera.plans import analysis

    assert analysis.within(spark, 60, lambda: spark.range(10).count()) == 10
    slow = spark.range(4).select(F.udf(lambda x: time.sleep(30) or x, "long")("id"))
    began = time.time()
    assert analysis.within(spark, 1, slow.collect) is None and time.time() - began < 25
    with pytest.raises(ZeroDivisionError):
        analysis.within(spark, 60, lambda: 1 / 0)
    assert spark.range(3).count() == 3


def test_names_in_slices_equal_brute_force(spark):
    rng = random.Random(16)
    base = lambda: (1, rng.choice(["a.js", None]), rng.choice([[], ["f"], ["f", "g"]]), rng.choice("xy"))
    bindings = [(*base(), n, rng.choice([None, *range(30)]), n) for n in range(150)]
    uses = [(*base(), rng.choice([None, *range(30)]), n) for n in range(200)]
    b = spark.createDataFrame(bindings, "package int, file string, scope_path array<string>, name string, seq long, line int, id long")
    u = spark.createDataFrame(uses, "package int, file string, scope_path array<string>, name string, line int, use long")
    want = {}
    for p, f, scope, name, line, use in uses:
        for depth in range(len(scope), -1, -1):
            found = [x for x in bindings if x[:4] == (p, f, scope[:depth], name) and line is not None and x[5] is not None and x[5] <= line]
            if found:
                want[use] = max(found, key=lambda x: x[4])[6]
                break
    known = {k: v for k, v in want.items() if uses[k][1] is not None}
    for slices in (1, 2, 7, 16):
        rows = resolve.resolve(u.filter("line IS NOT NULL"), b.filter("line IS NOT NULL"), "use", slices).collect()
        assert {r["use"]: r["binding"]["id"] for r in rows if r["binding"] is not None and r["file"] is not None} == known
