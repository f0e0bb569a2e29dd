"""Typed pattern matching: patterns are tables, matches are joins of reachable pairs, subsumption is a fold.

A pattern is a list of edges (head class, kind, tail class); the first is the key edge, and a pattern of one class has a
single edge without kind and tail. A match gives each class one node so that every edge is satisfied by reachability.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Behaviour classes by number.
CATEGORIES = {
    "1": "manipulate the path", "2": "read input data from hardware devices", "3": "get the path or directory information", "4": "get system information", "5": "get user information",
    "6": "search for a file", "7": "copy or move a file or directory", "8": "delete a file or directory", "9": "modify the permissions or ownership", "10": "create a file or directory",
    "11": "read data from a byte array, or stream", "12": "read data from a file", "13": "write data to a byte array, or stream", "14": "write data to a file", "15": "compress data",
    "16": "decompress data", "17": "create a writable stream", "18": "create a readable stream", "19": "open a file", "20": "make HTTP request",
    "21": "resolve the DNS", "22": "create a network server or communication", "23": "send data over the network", "24": "receive data over the network", "25": "configure the network",
    "26": "get network information", "27": "start listening", "28": "create a data representation", "29": "encode the data", "30": "decode the data",
    "31": "create a cipher object", "32": "create a decipher object", "33": "cipher the data", "34": "decipher the data", "35": "spawn a new process",
    "36": "run an executable file", "37": "execute a command", "38": "pipe the data", "39": "execute a dynamically created program", "Others": "Others",
}
# Patterns whose match is confirmed by a verdict, the class whose argument is judged, and the judge.
CONFIRMED = {
    "execute a command": ("execute a command", "command"),
    "run an executable file": ("run an executable file", "file"),
    "read from file - execute dynamically created program": ("read data from a file", "read"),
    "manipulate path - read local file - send through network communication": ("read data from a file", "read"),
    "read local file - send through network communication": ("read data from a file", "read"),
    "read local file - send through HTTP request": ("read data from a file", "read"),
    "search file - send through network": ("search for a file", "read"),
    "spawn a new process": ("spawn a new process", "command"),
    "execute a dynamically created program": ("execute a dynamically created program", "code"),
    "make HTTP request - write data to local sensitive path": ("write data to a file", "write"),
    "change file mode - write data to file": ("write data to a file", "write"),
    "read file - write data to file": ("write data to a file", "write"),
    "encode data - data rep - send through network communication": ("create a network server or communication", "url"),
    "encode data - send through network communication": ("create a network server or communication", "url"),
}
#: These count as benign once stealing is reported already.
UNLESS_STEALING = {k for k, v in CONFIRMED.items() if v[1] == "url"}
STEALING = "Information Stealing"


@dataclass
class Pattern:
    """M1, M2, M12. edges: (head, kind, tail), the key edge first; kind and tail None for a single class."""

    pattern_id: str
    maliciousness: str
    description: str
    edges: list[tuple[str, str | None, str | None]]
    after: dict[str, list[tuple[str, str]]] = field(init=False)
    classes: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.after, self.classes = {}, []
        for n, (head, kind, tail) in enumerate(self.edges):
            for c in (head, tail):
                if c is not None and c not in self.classes:
                    self.classes.append(c)
            self.after.setdefault(head, [])
            if tail is not None:
                loose = n == 0 and tail in self.after  # a key edge from a class to itself is lost
                self.after.setdefault(tail, [])
                if not loose:
                    self.after[head].append((kind, tail))

    @property
    def head(self) -> str:
        return self.edges[0][0]

    def required(self) -> list[tuple[str, str, str]]:
        """Edges that a match must satisfy; none for a single class."""
        return [(h, k, t) for h, out in self.after.items() for k, t in out] if len(self.classes) > 1 else []


def category_of(description: Column) -> Column:
    """The category whose description this is, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for number, text in CATEGORIES.items() for x in (text, number))), description)


def read_patterns(patterns: DataFrame, pattern_edges: DataFrame) -> list[Pattern]:
    """Patterns (pattern_id, ord, maliciousness, pattern_desc), edges (pattern_id, ord, is_key, head_class, kind,
    tail_class). A rule set is small by nature; it is what the driver compiles."""
    edges: dict[str, list] = {}
    for r in pattern_edges.orderBy("pattern_id", F.desc("is_key"), "ord").collect():
        edges.setdefault(r["pattern_id"], []).append((r["head_class"], r["kind"], r["tail_class"]))
    return [Pattern(r["pattern_id"], r["maliciousness"], r["pattern_desc"], edges[r["pattern_id"]]) for r in patterns.orderBy("ord").collect()]


def pattern_reaches(p: Pattern, head: str, tail: str, kind: str, first_edge_only: bool = True) -> bool:
    """Does p lead from head to tail? CFG may use both kinds, DDG only DDG.

    first_edge_only walks on from the first usable edge of each class alone; otherwise all paths count.
    """
    allowed = ("CFG", "DDG") if kind == "CFG" else ("DDG",)
    seen: set[str] = set()
    queue = [head]
    while queue:
        at = queue.pop()
        if at in seen:
            continue
        seen.add(at)
        usable = [t for k, t in p.after.get(at, []) if k in allowed]
        if first_edge_only:
            usable = usable[:1]
        if tail in usable:
            return True
        queue += usable
    return False


def is_sub_pattern(p: Pattern, q: Pattern, first_edge_only: bool = True) -> bool:
    """All classes of p are in q, and q implies each edge of p."""
    if any(c not in q.classes for c in p.classes):
        return False
    return all(h in q.after and pattern_reaches(q, h, t, k, first_edge_only) for h, out in p.after.items() for k, t in out)


def wanted(patterns: list[Pattern]) -> set[tuple[str, str, str]]:
    """(kind, head class, tail class) of all edges that matches must satisfy: what a closure has to find."""
    return {(k, h, t) for p in patterns for h, k, t in p.required()}


def typed_pairs(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reachable pairs (package, src, dst, kind) with the classes of their ends. nodes: (package, node, class)."""
    ends = nodes.select("package", "node", "class")
    head = ends.select("package", F.col("node").alias("src"), F.col("class").alias("src_class"))
    tail = ends.select("package", F.col("node").alias("dst"), F.col("class").alias("dst_class"))
    return reach.join(head, ["package", "src"]).join(tail, ["package", "dst"])


def match(pattern: Pattern, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """M3, M4: (package, n0, n1, ...): a node for each class of the pattern, in the order of pattern.classes.

    pairs: as typed_pairs() or graph.typed_closure() give them. Each edge is one filter of the pairs; edges join on the package and on the
    classes that they share, so a pattern of one edge needs no join at all.
    """
    column = {c: f"n{i}" for i, c in enumerate(pattern.classes)}
    parts = [pairs.filter((F.col("kind") == k) & (F.col("src_class") == h) & (F.col("dst_class") == t)).select("package", F.col("src").alias(column[h]), F.col("dst").alias(column[t])) for h, k, t in pattern.required() if h != t]
    if any(h == t for h, _, t in pattern.required()):
        parts.append(nodes.filter(F.lit(False)).select("package", F.col("node").alias(column[pattern.head])))  # no node reaches itself
    free = [c for c in pattern.classes if not any(column[c] in p.columns for p in parts)]
    parts += [nodes.filter(F.col("class") == c).select("package", F.col("node").alias(column[c])) for c in free]
    joined: DataFrame = parts.pop(0)
    while parts:
        nxt = next((p for p in parts if set(p.columns) & set(joined.columns) - {"package"}), parts[0])
        parts.remove(nxt)
        joined = joined.join(nxt, [c for c in nxt.columns if c in joined.columns])
    return joined.select("package", *column.values())


def matches(patterns: list[Pattern], pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(package, ord, pattern_id, assigned) of all patterns; assigned: map of class to node."""

    def one(n: int, p: Pattern) -> DataFrame:
        named = F.create_map(*(x for i, c in enumerate(p.classes) for x in (F.lit(c), F.col(f"n{i}"))))
        return match(p, pairs, nodes).select("package", F.lit(n).alias("ord"), F.lit(p.pattern_id).alias("pattern_id"), named.alias("assigned"))

    return reduce(DataFrame.unionByName, [one(n, p) for n, p in enumerate(patterns)])


def kept_patterns(found: DataFrame, patterns: list[Pattern], first_edge_only: bool = True) -> DataFrame:
    """M5, M7: (package, ord) of the patterns that count, from (package, ord) of those that match.

    In order of the list, a pattern is skipped if it is a sub-pattern of one that counted before.
    """
    below = [f"{i}<{j}" for i, p in enumerate(patterns) for j, q in enumerate(patterns) if is_sub_pattern(p, q, first_edge_only)]
    table = F.array(*(F.lit(x) for x in below)) if below else F.array().cast("array<string>")

    def step(done: Column, o: Column) -> Column:
        blocked = F.exists(done, lambda q: F.array_contains(table, F.concat(o.cast("string"), F.lit("<"), q.cast("string"))))
        return F.when(blocked, done).otherwise(F.concat(done, F.array(o)))

    ords = F.array_sort(F.collect_set("ord"))  # at most one for each pattern
    kept = F.aggregate("ords", F.array().cast("array<int>"), step)
    return found.groupBy("package").agg(ords.alias("ords")).select("package", F.explode(kept).alias("ord"))


def pattern_table(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    rows = [(n, p.pattern_id, p.maliciousness, p.description, CONFIRMED.get(p.description, (None, None))[0], CONFIRMED.get(p.description, (None, None))[1]) for n, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "ord int, pattern_id string, maliciousness string, pattern_desc string, judged_class string, judge string")


def confirm(found: DataFrame, patterns: list[Pattern], arguments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """M8: the matches (package, ord, pattern_id, assigned) that count as malicious, with what was judged.

    arguments: (package, node, value); no row or null: unknown, which is malicious; empty: benign.
    verdicts: (judge, input, malicious); no row: benign. Patterns without a judge pass.
    """
    table = F.broadcast(pattern_table(found.sparkSession, patterns))
    rows = found.join(table, ["ord", "pattern_id"])
    node = F.try_element_at("assigned", F.col("judged_class"))
    rows = rows.withColumn("node", node).join(arguments.select("package", "node", "value"), ["package", "node"], "left")
    told = verdicts.select("judge", F.col("input").alias("value"), "malicious").dropDuplicates(["judge", "value"])
    rows = rows.join(told, ["judge", "value"], "left")
    ok = F.when(F.col("judge").isNull() | F.col("value").isNull(), True).when(F.col("value") == "", False).otherwise(F.coalesce("malicious", F.lit(False)))
    return rows.filter(ok).select("package", "ord", "pattern_id", "maliciousness", "pattern_desc", "assigned")


def localities(found: DataFrame, patterns: list[Pattern], places: DataFrame) -> DataFrame:
    """M9: found with column places, the (file, line) of matched nodes: of both ends of each edge, or of the single node.

    places: (package, node, file, line).
    """
    ends = {n: (p.classes if len(p.classes) == 1 else [c for h, _, t in p.required() for c in (h, t)]) for n, p in enumerate(patterns)}
    table = F.create_map(*(x for n, cs in ends.items() for x in (F.lit(n), F.array(*(F.lit(c) for c in cs)) if cs else F.array().cast("array<string>"))))
    keys = [c for c in found.columns if c != "assigned"]
    rows = found.withColumn("match_id", F.monotonically_increasing_id()).select(*keys, "assigned", "match_id", F.posexplode(table[F.col("ord")]).alias("at", "class"))
    rows = rows.select(*keys, "match_id", "at", F.col("assigned")[F.col("class")].alias("node")).join(places.select("package", "node", "file", "line"), ["package", "node"])
    return rows.groupBy(*keys, "match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file", "line"))), lambda r: F.struct(r["file"].alias("file"), r["line"].alias("line"))).alias("places")).drop("match_id")
