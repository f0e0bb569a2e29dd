"""String functions: source rewriting, name tests, install scripts, answers and logs. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Properties that are read like calls.
PROCESS_PROPERTIES = ("arch", "platform", "version", "env", "config", "pid", "release", "versions", "argv")
DOCUMENT_PROPERTIES = ("cookie", "forms")
# Patterns of such reads, with the properties put in, and of files that an install script runs.
PROCESS_READ = r"(?<![a-zA-Z0-9])(process\.(?:%s))(?![a-zA-Z0-9(\[])"
DOCUMENT_READ = r"(?<![a-zA-Z0-9])(document\.(?:%s))(?![a-zA-Z0-9(])(?! *=)"
SCRIPT_FILE = r"node\s+([^\s]+\.js\b)"
#: Install hooks of a manifest.
HOOKS = ("preinstall", "install", "postinstall")
#: Longest module name.
NAME_LIMIT = 214


def property_calls(code: Column) -> Column:
    """T4: reads of process and document properties become calls."""
    process, document = (pattern % "|".join(names) for pattern, names in ((PROCESS_READ, PROCESS_PROPERTIES), (DOCUMENT_READ, DOCUMENT_PROPERTIES)))
    return F.regexp_replace(F.regexp_replace(code, process, "$1()"), document, "$1()")


def plain_requires(code: Column) -> Column:
    """T1, the textual part: require('node:x') becomes require('x')."""
    return F.regexp_replace(code, r"""(require\(['"])node:([^'"]+['"]\))""", "$1$2")


def is_call_name(name: Column) -> Column:
    """May the name be called in JavaScript? One trailing line break is let through."""
    return F.coalesce(name.rlike(r"\A[a-zA-Z$_][a-zA-Z0-9$_]*\n?\z"), F.lit(False))


def is_legal_module(name: Column) -> Column:
    """May a module have this name?"""
    bad = name.startswith(".") | name.startswith("_") | name.contains(" ") | name.startswith("node_modules")
    return F.coalesce((F.length(name) <= NAME_LIMIT) & ~bad, F.lit(False))


def script_files(script: Column) -> Column:
    """JavaScript files that an install script runs with node."""
    return F.regexp_extract_all(script, F.lit(SCRIPT_FILE), F.lit(1))


def has_sensitive_extension(name: Column) -> Column:
    """I4: does the name end like a document, shell script or program? The dot is not asked for."""
    return F.coalesce(name.rlike(r"(md|sh|exe)\z"), F.lit(False))


def normal_path(path: Column) -> Column:
    """A relative path without '.', '..' and doubled slashes; '..' at the front stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    rooted = F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(rooted == "", F.lit(".")).otherwise(rooted)


def parent_path(path: Column) -> Column:
    """The part before the last slash, or nothing."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def import_path(file: Column, entity: Column) -> Column:
    """The .js path that an import in file resolves to."""
    bare, folder = F.regexp_replace(entity, r"\.js\z", ""), parent_path(file)
    return F.concat(normal_path(F.when(folder == "", bare).otherwise(F.concat(folder, F.lit("/"), bare))), F.lit(".js"))


def looks_local(entity: Column) -> Column:
    """N8 without the file table: relative or absolute, a .js file, or any dotted name."""
    return entity.startswith(".") | entity.startswith("/") | entity.endswith(".js") | entity.rlike(r"\b\w+\.(\w+)\b$")


def answer_categories(answer: Column, known: list[str]) -> Column:
    """L1, L2: the categories an answer names, one for each line; 40, no number or no line at all: Others.

    A line whose first number is unknown names none.
    """
    lines = F.split(F.coalesce(answer, F.lit("")), r"\r\n|\r|\n")
    # a final line break ends the last line and begins none
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)

    def of(line: Column) -> Column:
        number = F.regexp_extract(line, r"(\d+)", 1)
        return F.when(line.contains("40"), "Others").when(number == "", "Others").when(number.isin(known), number)

    named = F.filter(F.transform(lines, of), lambda x: x.isNotNull())
    return F.when(F.size(lines) == 0, F.array(F.lit("Others"))).when(F.size(named) == 0, F.array(F.lit("Others"))).otherwise(named)


def category_string(categories: Column) -> Column:
    """Categories as stored; Others anywhere makes the whole Others."""
    return F.when(F.array_contains(categories, "Others"), "Others").otherwise(F.array_join(categories, "-"))


def braced(answer: Column) -> Column:
    """The text from the first brace to the last, or null."""
    first, last = F.instr(answer, "{"), F.length(answer) - F.instr(F.reverse(answer), "}") + 1
    return F.when((first > 0) & answer.contains("}") & (last >= first), F.trim(F.substring(answer, first, last - first + 1)))


def says(answer: Column, word: str = "yes") -> Column:
    """Does an answer contain the word, in any case?"""
    return F.coalesce(F.lower(answer).contains(word.lower()), F.lit(False))


def repair_dot_line(line: Column) -> Column:
    """Quotes inside the type-hint attribute are escaped, up to the NAME attribute or the closing bracket.

    The line has no line break at its end.
    """
    key, name, close = 'DYNAMIC_TYPE_HINT_FULL_NAME="', '" NAME="', '"]'
    start = F.instr(line, key) + len(key)
    by_name, by_close = F.instr(line, name), F.instr(line, close)
    stop = F.when(by_name > 0, by_name).when((by_close > 0) & (by_close == F.length(line) - 1), by_close)
    inner = F.replace(F.substring(line, start, stop - start), F.lit('"'), F.lit('\\"'))
    fixed = F.concat(F.substring(line, F.lit(1), start - 1), inner, F.substring(line, stop, F.length(line)))
    return F.when((F.instr(line, key) == 0) | stop.isNull() | (stop < start), line).otherwise(fixed)


def code_from(text: Column, line: Column, column: Column) -> Column:
    """The text from a line (from 1) and column (from 0) to its end."""
    lines = F.split(text, "\n")
    first = F.substring(F.get(lines, line - 1), column + 1, F.length(text))
    return F.array_join(F.concat(F.array(first), F.slice(lines, line + 1, F.greatest(F.size(lines) - line, F.lit(0)))), "\n")


def fill_placeholders(parts: Column, values: Column, only_first: bool = False) -> Column:
    """D3: argument parts strung together, '#n' replaced by its value. only_first: just '#1'."""
    known = F.map_filter(values, lambda k, _: k == "#1") if only_first else values
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def parse_log(log: Column) -> Column:
    """A map of the log's 'key: value' lines; the last of a key counts, a line without a colon doesn't."""
    lines = F.filter(F.split(F.coalesce(log, F.lit("")), "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(last)
