"""Scoped names: which binding does a use of a name mean?

bindings: (package, file, scope_path, seq, name, line, ...); uses: (package, file, scope_path, name, line, ...).
A use sees the bindings of its own scope and of those around it. The innermost scope with a binding of that name on an
earlier or the same line decides, and in it the one bound last, by seq and not by line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import import_path, looks_local


def push(scope: Column, name: Column) -> Column:
    """The scope of a function called name, inside scope."""
    return F.concat(scope, F.array(name))


def pop(scope: Column) -> Column:
    """The scope around."""
    return F.slice(scope, 1, F.greatest(F.size(scope) - 1, F.lit(0)))


def is_inside(scope: Column, name: Column) -> Column:
    """Is the function on the scope chain?"""
    return F.array_contains(scope, name)


def enclosing(scope: Column) -> Column:
    """The scope and all around it, innermost first."""
    return F.transform(F.sequence(F.size(scope), F.lit(0), F.lit(-1)), lambda n: F.slice(scope, 1, n))


def resolve(uses: DataFrame, bindings: DataFrame, use_id: str, slices: int = 1) -> DataFrame:
    """Uses with binding, the struct of the binding's other columns, or null.

    An as-of join without a range join: uses are exploded to the scopes that they see, which are as many as the
    nesting is deep, and stand beside the bindings of each (package, file, name, scope) in order of lines, where a
    running max_by hands each use its binding. So nothing is paired up. use_id identifies a use. slices: tasks over which
    a name with very many rows in one scope is spread.
    """
    key = ["package", "file", "name"]
    others = [c for c in bindings.columns if c not in (*key, "scope_path")]
    seen = uses.select(use_id, *key, "line", F.explode(enclosing(F.col("scope_path"))).alias("scope_path"))
    bound = bindings.select(*key, "scope_path", "line", "seq", F.struct(*others).alias("binding"))
    rows = _running(seen, bound, [*key, "scope_path"], "line", "seq", "binding", slices)
    best = rows.filter(F.col("binding").isNotNull()).groupBy(use_id).agg(F.max_by("binding", F.size("scope_path")).alias("binding"))
    return uses.join(best, use_id, "left")


def _running(uses: DataFrame, bound: DataFrame, key: list[str], at: str, seq: str, value: str, slices: int = 1) -> DataFrame:
    """uses with value: of the rows of bound with an equal key and an at that is not later, the one with the largest seq.

    With several slices the axis of at is cut at quantiles, so that the rows of one key, however many, spread over as many
    tasks. What earlier slices hand on is one row for each (key, slice), found by a pre-aggregation.
    """
    cuts = sorted(set(bound.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 1000).alias("c")).first()["c"] or [])) if slices > 1 else []
    nth = F.size(F.filter(F.array(*(F.lit(c).cast(bound.schema[at].dataType) for c in cuts)), lambda c: c <= F.col(at))) if cuts else F.lit(0)
    uses, bound, group = uses.withColumn("__slice", nth), bound.withColumn("__slice", nth), [*key, "__slice"]
    both = uses.withColumns({seq: F.lit(None).cast(bound.schema[seq].dataType), value: F.lit(None).cast(bound.schema[value].dataType), "__use": F.lit(True)})
    rows = both.unionByName(bound.withColumn("__use", F.lit(False)), allowMissingColumns=True)
    order = F.when(~F.col("__use"), F.col(seq))
    upto = Window.partitionBy(*group).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({"__own": F.max_by(value, order).over(upto), "__seq": F.max(order).over(upto)}).filter("__use").drop("__use", seq, value)
    if not cuts:
        return own.withColumnRenamed("__own", value).drop("__seq", "__slice")
    last = rows.groupBy(*group).agg(F.max_by(value, order).alias("v"), F.max(order).alias("s"), F.max("__use").alias("asks"))
    before = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(*(F.col(c).alias(f"{c}__h") for c in group), F.max_by("v", "s").over(before).alias("__v"), F.max("s").over(before).alias("__s"), "asks").filter("asks AND __s IS NOT NULL")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}__h")) for c in group))
    pick = F.when(F.col("__seq").isNull() | (F.col("__s") > F.col("__seq")), F.col("__v")).otherwise(F.col("__own"))
    out = own.join(handed, same, "left").withColumn(value, pick)
    return out.drop("__own", "__seq", "__v", "__s", "__slice", "asks", *(f"{c}__h" for c in group))


def asof_by_time(uses: DataFrame, bindings: DataFrame, key: str, at: str, since: str, seq: str, use_id: str, value: str, slices: int = 1) -> DataFrame:
    """N1 with one scope: (use_id, value) of the last binding, by seq, whose since is not after the use's at."""
    found = _running(uses.select(use_id, key, F.col(at).alias("__at")), bindings.select(key, F.col(since).alias("__at"), seq, value), [key], "__at", seq, value, slices)
    return found.select(use_id, value)


def seeded(methods: DataFrame) -> DataFrame:
    """Bindings of all declared functions: line 1 of their file's outermost scope, in order of method id.

    methods: (package, file_name, method_id, name); lambdas and whole files declare nothing.
    """
    named = methods.filter(~F.col("name").rlike(r"<lambda>\d*") & (F.col("name") != ":program"))
    return named.select("package", F.col("file_name").alias("file"), F.array().cast("array<string>").alias("scope_path"), F.col("method_id").alias("seq"), "name", F.lit(1).alias("line"), F.lit("FUNCTION_DECLARE").alias("type"), F.col("method_id").alias("node_id"))


def local_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (..., package, file, entity) with is_local. files: (package, path)."""
    known = files.select("package", F.col("path").alias("__path")).distinct()
    rows = imports.withColumn("__path", import_path(F.col("file"), F.col("entity"))).join(known.withColumn("__found", F.lit(True)), ["package", "__path"], "left")
    return rows.select(*imports.columns, (looks_local(F.col("entity")) | F.coalesce("__found", F.lit(False))).alias("is_local"))


def aliases(bindings: DataFrame, tables) -> DataFrame:  # noqa: ANN001
    """Bindings (id, alias_of, ...) with root, the binding at the end of each chain of x = y assignments.

    Pointers are doubled, so a chain of n takes log n joins; each round is written to tables. On a cycle there is no
    end: all bindings that lead into one have its smallest id as root. As many rounds as the number of bindings has
    bits settle both.
    """
    step = bindings.select("id", F.coalesce("alias_of", "id").alias("to"), F.coalesce("alias_of", "id").alias("low"))
    step = tables.keep(step.withColumn("low", F.least("id", "low")), "alias")  # low: the least id from here to the pointer's end
    rounds = step.count().bit_length()
    for _ in range(rounds):
        a, b = step.alias("a"), step.alias("b")
        step = tables.keep(a.join(b, F.col("a.to") == F.col("b.id"), "left").select(F.col("a.id").alias("id"), F.coalesce("b.to", "a.to").alias("to"), F.least("a.low", "b.low").alias("low")), "alias")
        if not step.join(step.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").filter("to <> then").limit(1).count():
            break
    # pointers have reached the end of their chain or gone all round their cycle, so the least id from there on is the root
    ends = step.select(F.col("id").alias("end"), F.col("low").alias("least"))
    done = step.join(ends, F.col("to") == F.col("end"), "left").select("id", F.coalesce("least", "to").alias("root"))
    return bindings.join(done, "id")
