"""Syntax trees as tables, structural queries on them, and what is read off or rewritten in source files.

Parsing is a batch function over rows of text; one file is one row, so files spread over tasks. Queries on trees are
joins on (file, parent) that Catalyst plans; what depends on a node's ancestors is a column that the parser writes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import features, js
from tessera.functions.text import plain_requires, property_calls
from tessera.session import Memo, ship

TREE = "node_id long, parent_id long, pre long, post long, statement_id long, type string, field string, start_row int, start_col int, end_row int, end_col int, text string"

#: Rows, and characters of text, after which the rows of small files leave a task together.
_ROWS, _CHARACTERS = 1000, 1 << 20


def _per_file(files: DataFrame, keys: list[str], schema: str, make: Callable[[str], list[dict]]) -> DataFrame:
    """make(text) for each file: rows of schema with the key columns in front."""
    from pyspark.sql.types import _parse_datatype_string

    ship(files.sparkSession)
    rows = files.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    full = rows.drop("text").schema
    for f in _parse_datatype_string(schema).fields:
        full = full.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, made, out, size = to_arrow_schema(full), Memo(make), [], 0
        for b in batches:
            for r in b.to_pylist():
                out += [m | {k: r[k] for k in keys} for m in made(r["text"])]
                size += len(r["text"])
                if len(out) >= _ROWS or size >= _CHARACTERS:  # small files share a batch
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, full)


def parse_js(files: DataFrame, keys: list[str]) -> DataFrame:
    """A1: the tree of each file (keys..., text), see TREE."""
    return _per_file(files, keys, TREE, lambda text: js.rows(js.parse(text)))


def children(tree: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """A2: (keys, node_id, child): children of a type."""
    return tree.filter((F.col("type") == kind) & F.col("parent_id").isNotNull()).select(*keys, F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))


def first_child(tree: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """A3: (keys, node_id, child): the first child of a type."""
    return children(tree, keys, kind).groupBy(*keys, "node_id").agg(F.min("child").alias("child"))


@dataclass
class Shape:
    """A node of a query: its type, the field it fills in its parent, what it is captured as, the text it must have."""

    type: str
    parts: list[Shape] = field(default_factory=list)
    field: str | None = None
    capture: str | None = None
    text: str | None = None


def query(tree: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """A4: (keys, <capture>, <capture>_text, ...) of every match: one join on (file, parent) for each part."""
    names: list[str] = []

    def of(s: Shape) -> DataFrame:
        rows = tree.filter(F.col("type") == s.type)
        if s.field is not None:
            rows = rows.filter(F.col("field") == s.field)
        if s.text is not None:
            rows = rows.filter(F.col("text") == s.text)
        own = [F.col("node_id").alias("__id"), F.col("parent_id").alias("__up")]
        if s.capture:
            names.append(s.capture)
            own += [F.col("node_id").alias(s.capture), F.col("text").alias(f"{s.capture}_text")]
        out = rows.select(*keys, *own)
        for p in s.parts:
            sub = of(p).drop("__id").withColumnRenamed("__up", "__id")
            out = out.join(sub, [*keys, "__id"])
        return out

    return of(shape).drop("__id", "__up")


def first_capture(found: DataFrame, keys: list[str], capture: str) -> DataFrame:
    """A5: the match whose capture comes first in each file."""
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.min_by(F.struct(*rest), capture).alias("m")).select(*keys, "m.*")


def last_capture(found: DataFrame, keys: list[str], capture: str) -> DataFrame:
    """The match whose capture comes last in each file."""
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), capture).alias("m")).select(*keys, "m.*")


def node_at(tree: DataFrame, keys: list[str], positions: DataFrame) -> DataFrame:
    """Positions (keys, row, col) with node_id, the first node in pre-order that starts there (null: none)."""
    at = tree.groupBy(*keys, F.col("start_row").alias("row"), F.col("start_col").alias("col")).agg(F.min("pre").alias("node_id"))
    return positions.join(at, [*keys, "row", "col"], "left")


def enclosing_statement(tree: DataFrame, keys: list[str], nodes: DataFrame) -> DataFrame:
    """Nodes (keys, node_id) with statement: the node itself or its nearest ancestor that is an expression_statement."""
    own = F.when(F.col("type") == "expression_statement", F.col("node_id")).otherwise(F.col("statement_id"))
    return nodes.join(tree.select(*keys, "node_id", own.alias("statement")), [*keys, "node_id"])


def statement_at(tree: DataFrame, keys: list[str], positions: DataFrame) -> DataFrame:
    """A10: A8, then A9, as the statement's row and column."""
    found = node_at(tree, keys, positions).filter(F.col("node_id").isNotNull())
    inside = enclosing_statement(tree, keys, found.select(*keys, "node_id").distinct())
    place = tree.select(*keys, F.col("node_id").alias("statement"), F.col("start_row").alias("statement_row"), F.col("start_col").alias("statement_col"))
    return found.join(inside, [*keys, "node_id"]).join(place, [*keys, "statement"])


def top_statements(tree: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id) of the expression_statement nodes without an ancestor of that type."""
    return tree.filter((F.col("type") == "expression_statement") & F.col("statement_id").isNull()).select(*keys, "node_id")


def top_subscripts(tree: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id) of the nodes without an expression_statement or program around them: just a file's root."""
    return tree.filter(F.col("statement_id").isNull() & F.col("parent_id").isNull()).select(*keys, "node_id")


def unit_types(tree: DataFrame, keys: list[str], order: str = "pre") -> DataFrame:
    """(keys, types): node types in pre- or post-order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "type")))
    return tree.groupBy(*keys).agg(F.transform(rows, lambda r: r["type"]).alias("types"))


# --- rewriting


def split_requires(code: str, fix_alias: bool = True) -> str:
    """Const {a, k: v} = require('m') becomes const a = require('m').a, v = require('m').k.

    Without fix_alias a renamed part binds the key, and takes the local name from the module.
    """
    spans = []
    for n in js.parse(code).walk():
        value, name = n.fields.get("value"), n.fields.get("name")
        if n.type != "variable_declarator" or name is None or name.type != "object_pattern" or value is None or value.type != "call_expression":
            continue
        if value.fields["function"].type != "identifier" or value.fields["function"].text != "require":
            continue
        parts = []
        for c in name.children:
            if c.type == "shorthand_property_identifier_pattern":
                parts.append(f"{c.text} = {value.text}.{c.text}")
            elif c.type == "pair_pattern" and c.fields["key"].type == "property_identifier" and c.fields["value"].type == "identifier":
                key, local = c.fields["key"].text, c.fields["value"].text
                parts.append(f"{local} = {value.text}.{key}" if fix_alias else f"{key} = {value.text}.{local}")
        if parts and len(parts) == len([c for c in name.children if c.type != "comment"]):
            spans.append((n.start, n.end, ", ".join(parts)))
    for start, end, text in sorted(spans, reverse=True):
        code = code[:start] + text + code[end:]
    return code


def drop_await(code: str) -> str:
    """T5: 'await ' goes from each await expression, everywhere that expression's text stands."""
    for n in js.parse(code).walk():
        if n.type == "await_expression":
            code = code.replace(n.text, n.text.replace("await ", ""))
    return code


def fix_for_each(code: str) -> str:
    """The first statement x.forEach(f) becomes x.forEach((x_) => f(x_));"""
    for n in js.parse(code).walk():
        call = n.children[0] if n.type == "expression_statement" and n.children else None
        if call is None or call.type != "call_expression":
            continue
        f, args = call.fields["function"], call.fields["arguments"]
        if f.type != "member_expression" or f.fields["object"].type != "identifier" or f.fields["property"].text != "forEach":
            continue
        names = args.of_type("identifier")
        if names:
            x = f.fields["object"].text
            return f"{code[: n.start]}{x}.forEach(({x}_) => {names[0].text}({x}_));{code[n.end :]}"
    return code


def rewrite(files: DataFrame, keys: list[str], fix_alias: bool = True) -> DataFrame:
    """Files with text rewritten: T1, T2, T3, T4, T5, T6 and T7, in that order."""
    plain = files.withColumn("text", plain_requires(F.col("text")))
    split = _per_file(plain, keys, "text string", lambda t: [{"text": split_requires(t, fix_alias)}])
    called = split.withColumn("text", property_calls(F.col("text")))
    return _per_file(called, keys, "text string", lambda t: [{"text": fix_for_each(js.beautify(drop_await(t)))}])


# --- what files hold

_FUNCTIONS = ("function_expression", "function_declaration", "generator_function", "generator_function_declaration")


def _defined(n: js.Node) -> js.Node | None:
    """The name node of a function that n defines, or None."""
    if n.type in _FUNCTIONS:
        return n.fields.get("name")
    if n.type == "variable_declarator" and n.fields.get("value") is not None and n.fields["value"].type == "arrow_function":
        return n.fields["name"] if n.fields["name"].type == "identifier" else None
    if n.type == "expression_statement" and n.children and n.children[0].type == "assignment_expression":
        left, right = n.children[0].fields["left"], n.children[0].fields["right"]
        if left.type == "member_expression" and right.type == "function_expression" and left.fields["property"].type == "property_identifier":
            return left.fields["property"]
    return None


def _functions(text: str) -> list[dict]:
    out = []
    for i, n in enumerate(js.parse(text).walk()):
        name = _defined(n)
        if name is None:
            continue
        doc = ""
        if n.parent is not None:
            before = [c for c in n.parent.children if c.end <= n.start]
            run: list[str] = []
            while before and before[-1].type == "comment":
                run.insert(0, before.pop().text)
            doc = re.sub(r"^[\s*/]+|^[\s*/]$", "", "\n".join(run))
        out.append({"pre": i, "name": name.text, "comment": doc, "code": n.text})
    return out


def functions(files: DataFrame, language: str = "javascript") -> DataFrame:
    """K1, K2: (package, file, name, qualifiedname, comment, parameters_num, code): the first definition of each name in
    a package, in order of files; the comments right before a definition are its own. Other languages give nothing.

    files: (package, path, text).
    """
    found = _per_file(files.filter(F.lit(language == "javascript") & F.col("path").endswith(".js")), ["package", "path"], "pre long, name string, comment string, code string", _functions)
    first = found.groupBy("package", "name").agg(F.min_by(F.struct("path", "comment", "code"), F.struct("path", "pre")).alias("f"))
    return first.select("package", F.col("f.path").alias("file"), "name", F.col("name").alias("qualifiedname"), F.col("f.comment").alias("comment"), F.lit(0).alias("parameters_num"), F.col("f.code").alias("code"))


def _parts(text: str) -> list[dict]:
    root = js.parse(text)
    nodes = list(root.walk())
    of = lambda *kinds: [n.text for n in nodes if n.type in kinds]
    return [{"types": [n.type for n in nodes], "empty": not root.children, "identifiers": of("identifier"), "properties": of("property_identifier"), "strings": of("string_fragment"), "numbers": of("number"), "formatted": js.beautify(text)}]


def source_parts(files: DataFrame, keys: list[str]) -> DataFrame:
    """What features are made of: (keys, text, types, empty, identifiers, properties, strings, numbers, formatted).

    Files without a key have no row; the text of a null one is empty.
    """
    keyed = files.dropna(subset=keys)
    return _per_file(keyed, keys, "text string, types array<string>, empty boolean, identifiers array<string>, properties array<string>, strings array<string>, numbers array<string>, formatted string", lambda t: [p | {"text": t} for p in _parts(t)])


def _codes(files: DataFrame, key: str) -> DataFrame:
    """O1: (key, codes): the codes of each file's units."""
    types = _per_file(files.dropna(subset=[key]), [key], "types array<string>", lambda t: [{"types": [n.type for n in js.parse(t).walk()]}])
    return types.select(key, features.unit_codes(F.col("types")).alias("codes"))


def lexical(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lexical): eleven numbers, all zero for a file without statements."""
    code = F.coalesce("text", F.lit(""))
    lines = F.size(F.split(code, "\n"))
    ratio, ids, strings = features.compression(code, F.col("formatted")), features.identifier_features(F.col("identifiers"), F.col("properties")), features.string_features(F.col("strings"))
    rows = parts.select(*keys, "empty", lines.alias("n"), ratio.alias("r"), ids.alias("i"), strings.alias("s"), features.number_features(F.col("numbers")).alias("numbers"), features.whitespace_per_line(code, lines).alias("w"), features.symbols(code).alias("y"))
    every = [F.col(c).cast("double") for c in ("n", "r.lines", "r.spaces", "i.confusing", "i.entropy", "i.prototypes", "s.long_strings", "s.longest", "numbers", "w", "y")]
    return rows.select(*keys, F.when(F.col("empty"), F.array_repeat(F.lit(0.0), 11)).otherwise(F.array(*every)).alias("lexical"))


def feature_table(files: DataFrame, key: str, dictionary: DataFrame, n: int = 3) -> DataFrame:
    """(key, lexical, shares): shares is a map of gram index to share. Files of fewer than n nodes have no row."""
    counts = features.gram_counts(_codes(files, key), key, "codes", n)
    shares = features.gram_index(counts, key, dictionary, n).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "share"))).alias("shares"))
    return lexical(source_parts(files, [key]), [key]).join(shares, key)


def learn_dictionary(files: DataFrame, key: str, n: int = 3) -> DataFrame:
    """(gram, idx): grams of all files, by first appearance: file by file in order of key, then by place.

    A dictionary holds as many grams as a vector has places; ranks are given to these alone.
    """
    places = _codes(files, key).select(key, F.posexplode(features.grams(F.col("codes"), n)).alias("position", "one"))
    first = places.groupBy(features.gram_name(F.col("one")).alias("gram")).agg(F.min(F.struct(key, "position")).alias("at")).orderBy("at").limit(features.vector_size(n))
    return first.select("gram", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("idx"))


def literal_arguments(code: str) -> list[tuple[bool, str]] | None:
    """Arguments of the first call in a piece of code: (is literal, text); None: there is no call.

    A constructor's arguments go before those of require('m').f(), and those before any other call's. Functions are
    left out.
    """
    nodes = list(js.parse(code).walk())
    made = next((n.fields["arguments"] for n in nodes if n.type == "new_expression" and n.fields["constructor"].type == "member_expression" and "arguments" in n.fields), None)
    calls = [n for n in nodes if n.type == "call_expression" and n.fields["arguments"].type == "arguments"]

    def of_require(n: js.Node) -> bool:
        f = n.fields["function"]
        left = f.fields["object"] if f.type == "member_expression" else None
        return left is not None and left.type == "call_expression" and left.fields["function"].text == "require"

    found = made or next((n.fields["arguments"] for n in calls if of_require(n)), None) or (calls[0].fields["arguments"] if calls else None)
    if found is None:
        return None
    return [(c.type == "string", c.text) for c in found.children if c.type not in ("arrow_function", "function_expression", "comment")]


def argument_strings(calls: DataFrame, values: DataFrame) -> DataFrame:
    """(package, node, value) of calls (package, node, text, line, col), line from 1 and col from 0.

    Literals are strung together as they are written; other arguments are placeholders that values (package, node,
    value map) fill, the log of an outside run. Without such a row the value is empty.
    """
    from tessera.functions.text import code_from, fill_placeholders

    at = calls.select("package", "node", code_from(F.col("text"), F.col("line"), F.col("col")).alias("text"))

    def make(code: str) -> list[dict]:
        args, n, parts = literal_arguments(code), 0, []
        for literal, text in args or []:
            if not literal:
                n += 1
            parts.append(text if literal else f"#{n}")
        return [{"parts": parts, "open": n}]

    rows = _per_file(at, ["package", "node"], "parts array<string>, open int", make).join(values.select("package", "node", F.col("value").alias("log")), ["package", "node"], "left")
    filled = fill_placeholders(F.col("parts"), F.col("log"))
    return rows.select("package", "node", F.when(F.col("open") == 0, F.array_join("parts", "")).when(F.col("log").isNotNull(), filled).otherwise("").alias("value"))


def formal_parameters(methods: DataFrame) -> DataFrame:
    """Methods (..., code) with formal: the formal parameters of the first function in their code, as written."""

    def make(code: str) -> list[dict]:
        nodes = list(js.parse(code).walk())
        listed = next((n for n in nodes if n.type == "formal_parameters"), None)
        alone = next((n.fields["parameter"] for n in nodes if n.type == "arrow_function" and "parameter" in n.fields), None)
        formal = [c.text for c in listed.children if c.type != "comment"] if listed else []
        return [{"formal": formal + ([alone.text] if alone else [])}]

    keys = ["package", "method"]
    found = _per_file(methods.select(*keys, F.col("code").alias("text")), keys, "formal array<string>", make)
    return methods.join(found, keys)

