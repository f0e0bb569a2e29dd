"""Graphs as tables, keyed by package: normalisation, set operations, closures and contraction onto sensitive nodes.

edges: (package, src, dst, kind) with kind DDG or CFG, or (package, src, dst, attrs) with all labels of a pair.
Sorting, joining and grouping are Catalyst's; only walks of unbounded depth are not. Those run package by package, over
typed Arrow columns. A package with more than `large` edges is walked by several tasks, each with all of its edges and a
share of the nodes that walks start from, so results do not depend on its size. Where a package's edges don't fit in a
task, contract_by_joins() and closure_by_joins() walk by joins, with a table written after each round.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Tables, ship

#: Edges of a package for each task that walks it.
LARGE = 200_000
#: Rows of small packages that leave a task together.
_ROWS = 1000
#: Result rows that a task keeps for packages with equal rows; packages of a hundredth of it and less are compared.
HELD = 20_000
# Labels of dependence edges that say nothing.
EMPTY_LABELS = ("DDG: ", "CDG: ", "DDG: this")

# --- kinds, and sets of nodes and edges


def edge_kind(attrs: Column) -> Column:
    """DDG if any label mentions it, else CFG."""
    return F.when(F.exists(attrs, lambda a: a.contains("DDG")), "DDG").otherwise("CFG")


def is_named_ddg(attrs: Column, name: str) -> Column:
    """Is one of the labels a dependence on this variable?"""
    return F.array_contains(attrs, f"DDG: {name}")


def first_edges(edges: DataFrame) -> DataFrame:
    """Of edges (package, src, dst, attrs, seq) with one pair the first stays."""
    return edges.groupBy("package", "src", "dst").agg(F.min_by("attrs", "seq").alias("attrs"), F.min("seq").alias("seq"))


def has_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (package, src, dst) between which there is any edge."""
    return pairs.join(edges.select("package", "src", "dst").distinct(), ["package", "src", "dst"], "left_semi")


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges but for the pairs in gone."""
    return edges.join(gone.select("package", "src", "dst").distinct(), ["package", "src", "dst"], "left_anti")


def first_nodes(nodes: DataFrame) -> DataFrame:
    """Of nodes (package, node, ..., seq) with one id the first stays."""
    rest = [c for c in nodes.columns if c not in ("package", "node")]
    row = F.min_by(F.struct(*rest), "seq").alias("r")
    return nodes.groupBy("package", "node").agg(row).select("package", "node", "r.*")


def neighbour_sets(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """(package, node, neighbours) as sorted sets."""
    node, other = ("dst", "src") if incoming else ("src", "dst")
    return edges.groupBy("package", F.col(node).alias("node")).agg(F.array_sort(F.collect_set(other)).alias("neighbours"))


def joint(nodes: DataFrame, edges: DataFrame, sub_nodes: DataFrame, sub_edges: DataFrame, entrances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of two graphs for each package, unless the second's entrance is a node of the first already.

    entrances: (package, node), the second graph's. Nodes and edges have seq; what the first graph has stays.
    """
    fresh = entrances.join(nodes.select("package", "node"), ["package", "node"], "left_anti").select("package").distinct()
    more_nodes, more_edges = (x.join(fresh, "package", "left_semi") for x in (sub_nodes, sub_edges))
    after = 1 << 40
    return first_nodes(nodes.unionByName(more_nodes.withColumn("seq", F.col("seq") + after))), first_edges(edges.unionByName(more_edges.withColumn("seq", F.col("seq") + after)))


def parameter_count(nodes: DataFrame) -> DataFrame:
    """(package, method, parameters) from nodes (package, method, node_type); varargs count 1000."""
    kind = F.col("node_type")
    varied = F.max(kind.contains("PARAM,..."))
    plain = F.count_if(kind.contains("PARAM") & (kind != "PARAM,this"))
    return nodes.groupBy("package", "method").agg(F.when(varied, F.lit(1000).cast("long")).otherwise(plain).alias("parameters"))


# --- code property graphs


def merge_parallel(edges: DataFrame) -> DataFrame:
    """(package, src, dst, attrs) from single edges (package, src, dst, label, seq), labels in order."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "label")))
    return edges.groupBy("package", "src", "dst").agg(F.transform(rows, lambda r: r["label"]).alias("attrs"), F.min("seq").alias("seq"))


def compose(dependence: DataFrame, control: DataFrame, nodes: DataFrame) -> DataFrame:
    """G1: edges (package, method, src, dst, label, seq) of a method, from its dependence and control graphs.

    Labels that say nothing go, control edges join, unlabelled ones become CFG, and METHOD_RETURN gets no in-edges.
    nodes: (package, node, node_type).
    """
    kept = dependence.filter(F.col("label").isNull() | ~F.col("label").isin(*EMPTY_LABELS))
    every = kept.unionByName(control.withColumn("seq", F.col("seq") + (1 << 40))).withColumn("label", F.coalesce("label", F.lit("CFG")))
    ends = nodes.filter(F.col("node_type") == "METHOD_RETURN").select("package", F.col("node").alias("dst"))
    return every.join(ends, ["package", "dst"], "left_anti").select("package", "method", "src", "dst", "label", "seq")


def parameter_edges(nodes: DataFrame, methods: DataFrame) -> DataFrame:
    """(package, method, src, dst, label): each method to its parameters.

    methods: (package, method, name, formal). A lambda reaches only the parameters whose code is in formal, the list
    of its formal parameters as they are written (null: none).
    """
    params = nodes.filter(F.col("node_type") == "METHOD_PARAMETER_IN").select("package", "method", F.col("node").alias("dst"), "code")
    named = methods.select("package", "method", F.col("name").rlike(r"<lambda>\d*").alias("is_lambda"), "formal")
    linked = params.join(named, ["package", "method"]).filter(~F.col("is_lambda") | F.coalesce(F.array_contains("formal", F.col("code")), F.lit(False)))
    return linked.select("package", "method", F.col("method").alias("src"), "dst", F.lit("DDG").alias("label"))


def ordered_children(edges: DataFrame, nodes: DataFrame, label: str, order: str) -> DataFrame:
    """(package, node, children), by integer attribute: AST by ORDER, ARGUMENT by ARGUMENT_INDEX.

    edges: merged; nodes: (package, node, attr map).
    """
    found = edges.filter(F.array_contains("attrs", label)).select("package", F.col("src").alias("node"), F.col("dst").alias("child"))
    place = nodes.select("package", F.col("node").alias("child"), F.expr(f"try_cast(attr['{order}'] AS long)").alias("at"))
    rows = found.join(place, ["package", "child"]).groupBy("package", "node").agg(F.array_sort(F.collect_list(F.struct("at", "child"))).alias("c"))
    return rows.select("package", "node", F.transform("c", lambda r: r["child"]).alias("children"))


def callees(edges: DataFrame) -> DataFrame:
    """(package, node, callee): the last CALL target."""
    return edges.filter(F.array_contains("attrs", "CALL")).groupBy("package", F.col("src").alias("node")).agg(F.max_by("dst", "seq").alias("callee"))


# --- walks


def by_package(tables: dict[str, DataFrame], walk: Callable[[dict[str, list[dict]]], Iterable[dict]], schema: str) -> DataFrame:
    """walk(rows of each table) for each package; its dicts, with the package added, make the result.

    All tables of a package meet in one task: one shuffle on package serves them all. Of packages of a task with equal
    rows one is walked, as long as the results fit in HELD rows; a row's place in its table means nothing. Columns that a
    dict lacks are null.
    """
    from pyspark.sql.types import _parse_datatype_string

    first = next(iter(tables.values()))
    spark = first.sparkSession
    ship(spark)
    parts = []
    for name, df in tables.items():
        rest = [c for c in df.columns if c != "package"]
        parts.append(df.select("package", F.lit(name).alias("t"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("r")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kind = rows.schema["package"].dataType
    out_schema = _parse_datatype_string(schema)
    full = type(out_schema)([*out_schema.fields]).add("package", kind)
    names, arrow = list(tables), _arrow(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import json

        results: dict[bytes, list[dict]] = {}
        kept = 0

        def packages() -> Iterator[tuple[object, list[tuple[str, str]]]]:
            key, held = None, None
            for b in batches:
                for package, t, r in zip(*(b.column(c).to_pylist() for c in ("package", "t", "r")), strict=True):
                    if held is None or package != key:
                        if held is not None:
                            yield key, held
                        key, held = package, []
                    held.append((t, r))
            if held is not None:
                yield key, held

        def result(held: list[tuple[str, str]]) -> Iterable[dict]:
            nonlocal results, kept
            same = None
            if len(held) <= HELD // 100:
                held.sort()
                same = hashlib.blake2b("\n".join(x for pair in held for x in pair).encode("utf-8", "surrogatepass"), digest_size=20).digest()  # JSON has no line breaks
                if same in results:
                    return results[same]
            of: dict[str, list[dict]] = {n: [] for n in names}
            for t, r in held:
                of[t].append(json.loads(r))
            if same is None:
                return walk(of)
            made = list(walk(of))
            if kept > HELD:
                results, kept = {}, 0
            if len(made) <= HELD // 100:
                results[same] = made
                kept += len(made) + 1
            return made

        def batch(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.get(f.name) for x in out], f.type) for f in arrow], schema=arrow)

        out: list[dict] = []
        for package, held in packages():
            for x in result(held):
                out.append(x | {"package": package})
                if len(out) == _ROWS:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    # packages are many and small: they share batches, a batch for each would cost more than the walk. A walk costs more
    # than the bytes of its rows tell, so tasks are not to be fewer where these are few
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "package").sortWithinPartitions("package").mapInArrow(run, full).select("package", *[f.name for f in out_schema.fields])


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: Columns of the tables of a package, by name of the table and of the column.
Held = dict[str, dict[str, list]]


def walked(tables: dict[str, DataFrame], walk: Callable[[Held, int, int], dict[str, list]], schema: str, large: int | None = LARGE) -> DataFrame:
    """walk(columns of each table, share, shares) for each package and share; its columns, with the package, make the result.

    A package with more than `large` rows of the table edges is dealt to several tasks as shares 0 to shares - 1, all
    with all of its rows; they are counted first, so edges that are costly to make should be a written table. One
    shuffle serves all tables.
    """
    from pyspark.sql.types import _parse_datatype_string

    first = next(iter(tables.values()))
    ship(first.sparkSession)
    kinds = {name: df.drop("package").schema for name, df in tables.items()}
    parts = [df.select("package", F.lit(i).alias("t"), *(F.struct(*kinds[n].names).alias(n) if n == name else F.lit(None).cast(kinds[n]).alias(n) for n in tables)) for i, (name, df) in enumerate(tables.items())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keys = ["package"]
    if large is not None:
        heavy = tables["edges"].groupBy("package").count().filter(F.col("count") > large).select("package", F.ceil(F.col("count") / large).cast("int").alias("shares"))
        rows = rows.join(heavy, "package", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
        keys = ["package", "share"]
    out_schema = _parse_datatype_string(schema)
    full = type(out_schema)([*out_schema.fields]).add("package", rows.schema["package"].dataType)
    names, arrow = list(tables), _arrow(full)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held: Held = {}
        which = table.column("t")
        for i, name in enumerate(names):
            own = table.column(name).filter(pa.compute.equal(which, i)).combine_chunks()
            held[name] = {f.name: own.field(k).to_pylist() for k, f in enumerate(own.type)}
        share, shares = (key[1].as_py(), table.column("shares")[0].as_py() or 1) if len(key) > 1 else (0, 1)
        out = walk(held, share, shares)
        n = len(next(iter(out.values())))
        return pa.Table.from_arrays([*(pa.array(out[f.name], f.type) for f in arrow if f.name != "package"), pa.array([key[0].as_py()] * n, arrow.field("package").type)], schema=arrow)

    return rows.groupBy(*keys).applyInArrow(run, full).select("package", *[f.name for f in out_schema.fields])


def _after(src: list[int], dst: list[int], keep: Iterable[bool] | None = None) -> dict[int, list[int]]:
    out: dict[int, list[int]] = defaultdict(list)
    for a, b, k in zip(src, dst, keep if keep is not None else [True] * len(src), strict=True):
        if k:
            out[a].append(b)
    return out


def _reached(starts: Iterable[int], after: dict[int, list[int]], within: set[int] | None = None, barred: Iterable[int] = ()) -> set[int]:
    """What the starts reach, themselves included, through nodes `within` that aren't barred."""
    barred = set(barred)
    seen = {n for n in starts if n not in barred and (within is None or n in within)}
    queue = list(seen)
    while queue:
        for n in after.get(queue.pop(), ()):
            if n not in seen and n not in barred and (within is None or n in within):
                seen.add(n)
                queue.append(n)
    return seen


def cycles(nodes: Iterable[int], after: dict[int, list[int]]) -> dict[int, int]:
    """Node to component, of the nodes in strongly connected components of several nodes."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on_stack: set[int] = set()
    out: dict[int, int] = {}
    for start in nodes:
        if start in number:
            continue
        work = [(start, iter(after.get(start, ())))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on_stack.add(start)
        while work:
            node, rest = work[-1]
            n = next(rest, None)
            if n is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        on_stack.discard(members[-1])
                        if members[-1] == node:
                            break
                    if len(members) > 1:
                        out.update(dict.fromkeys(members, node))
            elif n not in number:
                number[n] = low[n] = len(number)
                stack.append(n)
                on_stack.add(n)
                work.append((n, iter(after.get(n, ()))))
            elif n in on_stack:
                low[node] = min(low[node], number[n])
    return out


def _path_through(a: int, v: int, b: int, after: dict[int, list[int]], members: set[int]) -> set[int] | None:
    """Nodes of a simple path from a over v to b within members, or None."""
    trail, on_trail = [a], {a}
    stack = [iter([v] if a == v else after.get(a, ()))]
    if a == v:
        trail, on_trail = [], set()
    while stack:
        n = next(stack[-1], None)
        if n is None:
            stack.pop()
            if trail:
                on_trail.discard(trail.pop())
        elif n in members and n not in on_trail and n != (b if v != b else None):
            if n == v:
                way = _way(v, b, after, members, on_trail)
                if way is not None:
                    return on_trail | way
            elif v in _reached([n], after, members, on_trail):
                trail.append(n)
                on_trail.add(n)
                stack.append(iter(after.get(n, ())))
    return None


def _way(a: int, b: int, after: dict[int, list[int]], members: set[int], barred: set[int]) -> set[int] | None:
    """Nodes of a shortest path from a to b within members, or None."""
    came, queue = {a: a}, [a]
    for node in queue:
        if node == b:
            out = {b}
            while node != a:
                node = came[node]
                out.add(node)
            return out
        for n in after.get(node, ()):
            if n in members and n not in came and n not in barred:
                came[n] = node
                queue.append(n)
    return None


def _between(a: int, b: int, after: dict[int, list[int]], before: dict[int, list[int]], members: set[int]) -> set[int]:
    """Nodes on simple paths from a to b within one strongly connected component."""
    if a == b:
        return {a}
    open_ = (_reached([a], after, members, [b]) & _reached([b], before, members, [a])) | {a, b}
    open_ |= {n for n in _reached([a], after, members, [b]) if b in after.get(n, ()) and n != a}
    found: set[int] = set()
    for v in sorted(open_):
        if v not in found:
            found |= _path_through(a, v, b, after, members) or set()
    return found


def contract_walk(held: Held, share: int = 0, shares: int = 1) -> dict[str, list]:
    """X2, X3, X5 of one package: contracted edges of its sensitive nodes, with the inner nodes of DDG paths.

    Which nodes a node reaches is a plain search. An inner node is one that is reached and from which the end is
    reached. That settles nodes on no cycle. Within a cycle there must also be a simple path from where walks enter its
    component, over the node, to where they leave it.
    """
    edges, out = held["edges"], {"src": [], "dst": [], "kind": [], "inner": []}
    sensitive = {n for n, s in zip(held["nodes"]["node"], held["nodes"]["sensitive"], strict=True) if s}
    every, ddg = _after(edges["src"], edges["dst"]), _after(edges["src"], edges["dst"], (k == "DDG" for k in edges["kind"]))
    after = {n: [m for m in to if m not in sensitive] for n, to in ddg.items() if n not in sensitive}
    before = _after([n for to in after.values() for n in to], [m for m, to in after.items() for _ in to])
    component = cycles(list(after), after)
    members: dict[int, set[int]] = defaultdict(set)
    for n, c in component.items():
        members[c].add(n)
    known: dict[tuple[int, int], set[int]] = {}

    def inner(start: int, end: int, reached: set[int], last: set[int]) -> list[int]:
        """last: reached nodes with an edge to the end."""
        back = _reached(last, before, reached)
        found = {n for n in back if n not in component}
        for c in {component[n] for n in back if n in component}:
            own = members[c]
            into = [n for n in own & reached if n in ddg[start] or any(m in reached and component.get(m) != c for m in before.get(n, ()))]
            outof = [n for n in own & back if n in last or any(m in back and component.get(m) != c for m in after.get(n, ()))]
            for a in into:
                for b in outof:
                    if (a, b) not in known:
                        known[a, b] = _between(a, b, after, before, own)
                    found |= known[a, b]
        return sorted(found)

    for s in sorted(sensitive):
        if hash(s) % shares != share:
            continue
        reached = _reached((n for n in ddg.get(s, ()) if n not in sensitive), after)
        ends: dict[int, set[int]] = {n: set() for n in ddg.get(s, ()) if n in sensitive}
        for n in reached:
            for m in ddg.get(n, ()):
                if m in sensitive:
                    ends.setdefault(m, set()).add(n)
        rows = [(t, "DDG", inner(s, t, reached, last)) for t, last in sorted(ends.items())]
        seen, queue = {s}, list(every.get(s, ()))
        while queue:
            node = queue.pop()
            if node in seen:
                continue
            seen.add(node)
            if node not in sensitive:
                queue += every.get(node, ())
            elif node not in ends:
                rows.append((node, "CFG", None))
        out["src"] += [s] * len(rows)
        for c, values in zip(("dst", "kind", "inner"), zip(*rows, strict=True), strict=False):
            out[c] += values
    return out


def contract(nodes: DataFrame, edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(package, src, dst, kind, inner) between sensitive nodes.

    A DDG edge stands for a path of DDG edges whose inner nodes are all plain; inner has those of all such simple
    paths, and a node may reach itself. Else a CFG edge stands for a path of any edges through plain nodes.
    nodes: (package, node, sensitive). inner is null for CFG edges.
    """
    tables = {"nodes": nodes.select("package", "node", "sensitive"), "edges": edges.select("package", "src", "dst", "kind")}
    return walked(tables, contract_walk, "src long, dst long, kind string, inner array<long>", large)


def contract_by_joins(nodes: DataFrame, edges: DataFrame, tables: Tables) -> DataFrame:
    """X2-X4 without a task that holds a package: (package, src, dst, kind), without inner nodes."""
    n, e = nodes.select("package", "node", "sensitive"), edges.select("package", "src", "dst", "kind")
    marked = n.filter("sensitive").select("package", "node")
    ddg = reach_by_joins(marked, e.filter("kind = 'DDG'"), marked, tables).select("package", "src", "dst")
    cfg = reach_by_joins(marked, e, marked, tables).filter("src <> dst").select("package", "src", "dst").join(ddg, ["package", "src", "dst"], "left_anti")
    return ddg.withColumn("kind", F.lit("DDG")).unionByName(cfg.withColumn("kind", F.lit("CFG")))


def reach_by_joins(sources: DataFrame, edges: DataFrame, stops: DataFrame | None, tables: Tables) -> DataFrame:
    """(package, src, dst): what each source (package, node) reaches, by a semi-naive loop of joins.

    With stops (package, node), walks end at those and only they are returned.
    """
    step = edges.select("package", F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    front = tables.keep(sources.select("package", F.col("node").alias("src"), F.col("node").alias("at")), "front")
    found = None
    while front.limit(1).count():
        moved = front.join(step, ["package", "at"]).select("package", "src", F.col("next").alias("at")).distinct()
        fresh = tables.keep(moved if found is None else moved.join(found, ["package", "src", "at"], "left_anti"), "front")
        found = fresh if found is None else tables.keep(found.unionByName(fresh), "found")
        front = fresh if stops is None else fresh.join(stops.select("package", F.col("node").alias("at")), ["package", "at"], "left_anti")
    out = front.select("package", "src", "at") if found is None else found
    if stops is not None:
        out = out.join(stops.select("package", F.col("node").alias("at")), ["package", "at"], "left_semi")
    return out.select("package", "src", F.col("at").alias("dst"))


def closure_walk(held: Held, share: int = 0, shares: int = 1) -> dict[str, list]:
    """X8 of one package: pairs of different nodes, by kind."""
    edges, out = held["edges"], {"src": [], "dst": [], "kind": []}
    for kind, after in (("CFG", _after(edges["src"], edges["dst"])), ("DDG", _after(edges["src"], edges["dst"], (k == "DDG" for k in edges["kind"])))):
        for s in sorted(after):
            if hash(s) % shares == share:
                ends = sorted(_reached([s], after) - {s})
                out["src"] += [s] * len(ends)
                out["dst"] += ends
                out["kind"] += [kind] * len(ends)
    return out


def closure(edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(package, src, dst, kind): DDG where a path of DDG edges leads, CFG where any path does; src differs.

    All pairs: patterns that name classes ask typed_closure() for theirs alone.
    """
    return walked({"edges": edges.select("package", "src", "dst", "kind")}, closure_walk, "src long, dst long, kind string", large)


Wanted = set[tuple[str, str, str]]
_TYPED = "src long, dst long, kind string, src_class string, dst_class string"


def _typed_walk(held: Held, wanted: Wanted, share: int, shares: int) -> dict[str, list]:
    edges, out = held["edges"], {"src": [], "dst": [], "kind": [], "src_class": [], "dst_class": []}
    own = dict(zip(held["nodes"]["node"], held["nodes"]["class"], strict=True))
    for kind in ("CFG", "DDG"):
        tails: dict[str, set[str]] = defaultdict(set)
        for k, head, tail in wanted:
            if k == kind:
                tails[head].add(tail)
        after = _after(edges["src"], edges["dst"], None if kind == "CFG" else (k == "DDG" for k in edges["kind"])) if tails else {}
        for s in sorted(after):
            if own.get(s) in tails and hash(s) % shares == share:
                ends = sorted(n for n in _reached([s], after) - {s} if own.get(n) in tails[own[s]])
                for c, values in (("src", [s] * len(ends)), ("dst", ends), ("kind", [kind] * len(ends)), ("src_class", [own[s]] * len(ends)), ("dst_class", [own[n] for n in ends])):
                    out[c] += values
    return out


def typed_closure(edges: DataFrame, nodes: DataFrame, wanted: Wanted, large: int = LARGE) -> DataFrame:
    """X8 for patterns: (package, src, dst, kind, src_class, dst_class) of the wanted (kind, head class, tail class) alone.

    nodes: (package, node, class).
    """
    tables = {"nodes": nodes.select("package", "node", "class"), "edges": edges.select("package", "src", "dst", "kind")}
    return walked(tables, lambda held, share, shares: _typed_walk(held, wanted, share, shares), _TYPED, large)


def contracted_pairs(nodes: DataFrame, edges: DataFrame, wanted: Wanted) -> DataFrame:
    """typed_closure() of contract(), in one walk and one shuffle. nodes: (package, node, class, sensitive)."""

    def both(held: Held, share: int, shares: int) -> dict[str, list]:
        return _typed_walk({"nodes": held["nodes"], "edges": contract_walk(held)}, wanted, share, shares)

    tables = {"nodes": nodes.select("package", "node", "class", "sensitive"), "edges": edges.select("package", "src", "dst", "kind")}
    return walked(tables, both, _TYPED)


def closure_by_joins(edges: DataFrame, tables: Tables) -> DataFrame:
    """X8 without a task that holds a package."""
    e, out = edges.select("package", "src", "dst", "kind"), None
    for kind, part in (("CFG", e), ("DDG", e.filter("kind = 'DDG'"))):
        pairs = reach_by_joins(part.select("package", F.col("src").alias("node")).distinct(), part, None, tables)
        pairs = pairs.filter("src <> dst").withColumn("kind", F.lit(kind))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def path_nodes(contracted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (package, src, dst) with inner, the nodes on the paths that their contracted DDG edge stands for."""
    known = contracted.filter("kind = 'DDG'").select("package", "src", "dst", "inner")
    return pairs.join(known, ["package", "src", "dst"])


def _nodes_between_walk(held: Held, share: int, shares: int) -> dict[str, list]:
    """X7 of one package. Every edge is cut in two by a node of its own, so that the edges on simple paths are found too."""
    own, out = held["edges"], {"src": [], "dst": [], "nodes": []}
    nodes = sorted({*own["src"], *own["dst"]})
    number = {n: i for i, n in enumerate(nodes)}
    m = len(own["src"])
    src = [number[a] for a in own["src"]] + [len(nodes) + i for i in range(m)]
    dst = [len(nodes) + i for i in range(m)] + [number[b] for b in own["dst"]]
    every = list(range(len(nodes) + m))
    for a, b in sorted(set(zip(held["pairs"]["src"], held["pairs"]["dst"], strict=True))):
        if a not in number or b not in number or hash(a) % shares != share:
            continue
        ends = {number[a], number[b]}
        walk = contract_walk({"nodes": {"node": every, "sensitive": [n in ends for n in every]}, "edges": {"src": src, "dst": dst, "kind": ["DDG"] * (2 * m)}})
        for s, t, kind, inner in zip(walk["src"], walk["dst"], walk["kind"], walk["inner"], strict=True):
            if (s, t, kind) == (number[a], number[b], "DDG"):
                passed = {nodes[n] for n in inner if n < len(nodes)} | {x for n in inner if n >= len(nodes) for x in own["inner"][n - len(nodes)] or ()}
                for c, value in (("src", a), ("dst", b), ("nodes", sorted(passed))):
                    out[c].append(value)
    return out


def nodes_between(contracted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (package, src, dst) that contracted DDG edges connect, with nodes: all that their simple paths pass, plain and sensitive."""
    edges = contracted.filter("kind = 'DDG'").select("package", "src", "dst", "inner")
    return walked({"edges": edges, "pairs": pairs.select("package", "src", "dst")}, _nodes_between_walk, "src long, dst long, nodes array<long>")


def class_lists(nodes: DataFrame) -> DataFrame:
    """(package, classes): (node, class) of a package's nodes (package, node, class), in order."""
    return nodes.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("node", "class"))).alias("classes"))


def split_categories(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node with several categories becomes a DDG chain (node, 0), (node, 1), ...

    In-edges stay at the first part, out-edges move to the last. nodes: (package, node, categories); no category:
    one plain part. edges: (package, src, dst, kind). Ids of the result are structs (node, part).
    """
    parts = nodes.select("package", "node", F.posexplode_outer("categories").alias("part", "category")).withColumn("part", F.coalesce("part", F.lit(0)))
    last = nodes.select("package", F.col("node").alias("src"), F.greatest(F.size("categories") - 1, F.lit(0)).alias("last"))
    ident = lambda node, part: F.struct(F.col(node).alias("node"), part.alias("part"))
    moved = edges.join(last, ["package", "src"], "left").select("package", ident("src", F.coalesce("last", F.lit(0))).alias("src"), ident("dst", F.lit(0)).alias("dst"), "kind")
    chain = parts.filter("part > 0").select("package", ident("node", F.col("part") - 1).alias("src"), ident("node", F.col("part")).alias("dst"), F.lit("DDG").alias("kind"))
    out = parts.select("package", ident("node", F.col("part")).alias("id"), "category", F.col("category").isNotNull().alias("sensitive"))
    return out, moved.unionByName(chain)


def strongest(edges: DataFrame) -> DataFrame:
    """One edge for each pair; DDG outdoes CFG."""
    return edges.groupBy("package", "src", "dst").agg(F.max("kind").alias("kind"))


def backward_walk(held: Held, share: int = 0, shares: int = 1) -> dict[str, list]:
    """B9 of one package."""
    background, edges, out = held["background"], held["edges"], {"node": [], "src": []}
    before = _after(background["dst"], background["src"])
    known, own = {*background["src"], *background["dst"]}, set(held["nodes"]["node"])
    for node in sorted(_reached((n for n in edges["src"] if n not in own and n in known), before)):
        sources = [None, *sorted(set(before.get(node, ())))]
        out["node"] += [node] * len(sources)
        out["src"] += sources
    return out


def backward_slice(nodes: DataFrame, edges: DataFrame, background: DataFrame) -> DataFrame:
    """(package, node, src) of what a function's graph gains from its file's graph.

    From each in-edge of the function whose source is no node of it but one of the background, all ancestors in the
    background come along. Rows with src are edges src - node, rows without are nodes.
    """
    tables = {"nodes": nodes.select("package", "node"), "edges": edges.select("package", "src", "dst"), "background": background.select("package", "src", "dst")}
    return walked(tables, backward_walk, "node long, src long", None)


# --- graph views over event tables


def event_graph(events: DataFrame, sensitive: tuple[str, ...] = ("signup", "error", "purchase")) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of event-like data: a user is a package, an event a node.

    CFG: to the user's next event. DDG: to the user's next event with the same remainder of props.k by 10.
    """
    e = events.select(F.col("user_id").alias("package"), F.col("event_id").alias("node"), F.col("event_type").alias("class"), "ts", (F.get_json_object("props", "$.k").cast("long") % 10).alias("key"))
    nodes = e.select("package", "node", "class", F.col("class").isin(*sensitive).alias("sensitive"))
    order = Window.partitionBy("package").orderBy("ts", "node")
    same = Window.partitionBy("package", "key").orderBy("ts", "node")
    after = e.select("package", "node", F.lead("node").over(order).alias("CFG"), F.lead("node").over(same).alias("DDG"))
    pairs = after.select("package", F.col("node").alias("src"), F.explode(F.create_map(F.lit("CFG"), F.col("CFG"), F.lit("DDG"), F.col("DDG"))).alias("kind", "dst")).filter(F.col("dst").isNotNull())
    return nodes, pairs.select("package", "src", "dst", "kind")
