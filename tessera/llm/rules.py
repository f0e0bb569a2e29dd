"""Operator 7, quality rules: a threshold table compiled into one projection.

RULES names a measure, the least and the greatest value that a kept document may have. compile_rules() turns
such a table into one boolean column, and assess() adds it with the measures to the documents: one pass, built-in
functions only, no shuffle and no user function. Values that several measures need are bound once by let().

Repeated three-word windows are found by sorting: a window's key is its hash with its position in the low bits,
so after a sort of plain longs equal windows stand side by side. Neighbours whose hashes agree are compared word
by word. Where two different windows share a hash, which long texts make likely since places take bits from it, the
text's windows whose hashes repeat are sorted once more, by their words.

Defined results: null and empty texts have no words, fail the base rules and are not kept; ratios over nothing
are 0; rows with equal doc_id keep a row each; an empty table gives no rows; columns of the input whose names
clash with a measure are left out of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common function words of four languages, lower case.
STOP_WORDS = {
    "en": "the of and to in is a that for it on with as was be by are this from at an or not",
    "de": "der die und das den von zu mit ist des im dem nicht ein eine als auch es an auf für sich in",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus avec ce",
    "es": "de la que el en y a los del se las por un para con no una su al es lo como",
}
#: Separators of words, a word character, and symbols.
SEPARATORS, WORD, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
WINDOW = 3

#: (measure, least, greatest); None: no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("mean_word_chars", 2, 15),
    ("symbols_per_word", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
    ("repeat_word_ratio", None, 0.5),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n)


def repeat_words(words: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Number of words in windows that occur twice or more in the array, the first included. hashed: for tests."""

    def of(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n.cast("long"))).cast("int")
        low = _left(F.lit(1).cast("long"), bits) - 1

        def same(a: Column, b: Column) -> Column:
            return _right(a, bits) == _right(b, bits)

        def place(x: Column) -> Column:
            return x.bitwiseAND(low).cast("int")

        def equal(p: Column, q: Column) -> Column:
            out = F.get(w, p) == F.get(w, q)
            for k in range(1, WINDOW):
                out = out & (F.get(w, p + k) == F.get(w, q + k))
            return out

        keys = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: _left(hashed(*(F.get(w, i + k) for k in range(WINDOW))), bits).bitwiseOR(i.cast("long")))

        def covered(at: Column) -> Column:
            """at: sorted first words of windows."""
            steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        def by_words(some: Column) -> Column:
            """Places of the windows among these whose words stand elsewhere among them."""
            spelt = F.sort_array(F.transform(some, lambda x: F.struct(*(F.get(w, place(x) + k).alias(f"w{k}") for k in range(WINDOW)), place(x).alias("at"))))

            def of_spelt(s: Column) -> Column:
                def alike(x: Column, y: Column) -> Column:
                    out = x["w0"] == y["w0"]
                    for k in range(1, WINDOW):
                        out = out & (x[f"w{k}"] == y[f"w{k}"])
                    return F.coalesce(out, F.lit(False))

                again = F.filter(s, lambda x, j: alike(x, F.get(s, j + 1)) | alike(x, F.get(s, F.when(j > 0, j - 1))))
                return F.transform(again, lambda x: x["at"])

            return let(spelt, of_spelt)

        def from_sorted(s: Column) -> Column:
            twins = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, F.when(j > 0, j - 1))), F.lit(False)))

            def of_twins(d: Column) -> Column:
                clashes = F.filter(d, lambda x, j: F.coalesce(same(x, F.get(d, j + 1)) & ~equal(place(x), place(F.get(d, j + 1))), F.lit(False)))
                at = F.sort_array(F.when(F.size(clashes) > 0, by_words(d)).otherwise(F.transform(d, place)))
                return F.when(F.size(d) == 0, F.lit(0).cast("long")).otherwise(let(at, covered))

            return let(twins, of_twins)

        return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(let(F.sort_array(keys), from_sorted))

    return let(words, of)


def measures(text: Column) -> Column:
    """A struct of all counts and ratios of one text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    stops = sorted({w for words in STOP_WORDS.values() for w in words.split()})

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, SEPARATORS), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))

        def of_words(w: Column) -> Column:
            def of_lines(x: Column) -> Column:
                n, n_lines = F.size(w).cast("long"), F.size(x).cast("long")
                counts = F.struct(
                    n.alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                    (n_lines - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                    repeat_words(w).alias("n_repeat_words"),
                    F.size(F.filter(w, lambda y: F.lower(y).isin(stops))).cast("long").alias("n_stop_words"),
                    n_lines.alias("n_lines"),
                    F.size(F.filter(x, lambda y: y.rlike(r"^\s*[-*•‣]"))).cast("long").alias("n_bullet_lines"),
                    F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
                )

                def of_counts(c: Column) -> Column:
                    return F.struct(
                        *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")),
                        ratio(c["word_chars"], c["n_words"]).alias("mean_word_chars"),
                        ratio(c["n_symbols"], c["n_words"]).alias("symbols_per_word"),
                        ratio(c["n_stop_words"], c["n_words"]).alias("stop_word_ratio"),
                        ratio(c["n_dup_lines"], c["n_lines"]).alias("dup_line_ratio"),
                        ratio(c["n_bullet_lines"], c["n_lines"]).alias("bullet_line_ratio"),
                        ratio(c["n_ellipsis_lines"], c["n_lines"]).alias("ellipsis_line_ratio"),
                        ratio(c["n_repeat_words"], c["n_words"]).alias("repeat_word_ratio"),
                    )

                return let(counts, of_counts)

            return let(lines, of_lines)

        return let(words, of_words)

    return let(text, of)


def compile_rules(m: Column, rules: list[tuple[str, float | None, float | None]]) -> Column:
    """True if every measure of the struct m is within its bounds."""
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out = out & (m[name] >= least)
        if most is not None:
            out = out & (m[name] <= most)
    return out


def assess(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] | None = None) -> DataFrame:
    """Documents with their measures, base_failed and kept."""

    def judged(m: Column) -> Column:
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(m.alias("m"), base.alias("base_failed"), (~base & compile_rules(m, rules or RULES)).alias("kept"))

    out = docs.select(*docs.columns, let(measures(F.col("text")), judged).alias("__judged"))
    names = out.schema["__judged"].dataType["m"].dataType.names
    return out.select(*(c for c in docs.columns if c not in {*names, "base_failed", "kept"}), *(F.col(f"__judged.m.{n}").alias(n) for n in names), "__judged.base_failed", "__judged.kept")


def sql(rules: list[tuple[str, float | None, float | None]] = RULES) -> str:
    """The counts, base_failed and kept of each row of a table documents, as SQL."""
    stops = ", ".join("'" + w + "'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    bounds = [f"{name} >= {least}" for name, least, _ in rules if least is not None] + [f"{name} <= {most}" for name, _, most in rules if most is not None]
    ratios = {"mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "stop_word_ratio": ("n_stop_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "bullet_line_ratio": ("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"), "repeat_word_ratio": ("n_repeat_words", "n_words")}
    made = ", ".join(f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END AS {name}" for name, (a, b) in ratios.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
windows AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT rid, x FROM windows GROUP BY rid, x HAVING count(*) > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM windows SEMI JOIN twice USING (rid, x)) GROUP BY rid),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t\n\x0b\f\r]*[-*•‣]'))) AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\n\x0b\f\r]*$'))) AS n_ellipsis_lines
    FROM d LEFT JOIN again USING (rid)),
judged AS (SELECT *, {made}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM judged
"""
