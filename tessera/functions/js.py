"""A JavaScript parser, formatter and tree, in plain Python.

The tree has the node types and fields that concrete-syntax tools for JavaScript commonly use: program,
expression_statement, call_expression, member_expression and so on; punctuation is not kept. What can't be parsed
becomes an ERROR node that holds the complete parts found in it, and parsing goes on behind it. Names are matched by
Unicode classes, regular expressions and divisions are told apart by what the grammar expects next, and statements end
at line breaks where the language says so. Nesting is followed to a depth of 10,000.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

_NAME = re.compile(r"#?(?:[^\W\d]|[$_]|\\u[0-9A-Fa-f]{4})(?:\w|[$\u200c\u200d]|\\u[0-9A-Fa-f]{4})*")
_NUMBER = re.compile(r"0[xX][0-9A-Fa-f_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_PUNCTUATION = sorted("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @".split(), key=len, reverse=True)
_MARK = re.compile("|".join(map(re.escape, _PUNCTUATION)))
_BLANK = re.compile(r"[ \t\v\f\r\n\u00a0\u2028\u2029\ufeff]+")
_COMMENT = re.compile(r"//[^\n\r]*|/\*.*?(?:\*/|\Z)|<!--[^\n\r]*", re.S)
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with".split())
#: Statements and expressions inside each other; what is nested deeper becomes an ERROR node.
_DEEPEST = 10_000
#: Frames of Python for each level.
_FRAMES = 30


@dataclass(eq=False)
class Node:
    type: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    fields: dict[str, Node] = field(default_factory=dict)
    parent: Node | None = None
    source: str = ""

    @property
    def text(self) -> str:
        return self.source[self.start : self.end]

    def walk(self) -> Iterator[Node]:
        """This node and all below it, parents first."""
        queue = [self]
        while queue:
            n = queue.pop()
            yield n
            queue.extend(reversed(n.children))

    def post(self) -> Iterator[Node]:
        """All below this node and itself, children first."""
        stack = [(self, iter(self.children))]
        while stack:
            n, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                yield n
            else:
                stack.append((child, iter(child.children)))

    def of_type(self, name: str) -> list[Node]:
        """A2: children of a type."""
        return [c for c in self.children if c.type == name]

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class _Bad(Exception):
    pass


@dataclass
class _Token:
    kind: str  # name, number, string, template, mark, private, end
    text: str
    start: int
    end: int
    newline: bool  # a line break stands before it


class Parser:
    def __init__(self, source: str):
        self.s, self.at, self.token, self.last = source, 0, None, 0
        self.comments: list[Node] = []
        self.depth = 0
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _FRAMES * _DEEPEST))  # frames are on the heap
        self.done: list[Node] = []  # complete nodes of the statement under way, for ERROR

    # --- tokens

    def _skip(self) -> bool:
        newline = False
        while True:
            if m := _BLANK.match(self.s, self.at):
                newline |= any(c in "\n\r\u2028\u2029" for c in m[0])
                self.at = m.end()
            elif (m := _COMMENT.match(self.s, self.at)) or (self.at == 0 and (m := re.compile(r"#![^\n]*").match(self.s))):
                kind = "hash_bang_line" if m[0].startswith("#!") else "comment"
                if not self.comments or self.comments[-1].start < m.start():
                    self.comments.append(Node(kind, m.start(), m.end()))
                newline |= "\n" in m[0]
                self.at = m.end()
            else:
                return newline

    def peek(self) -> _Token:
        if self.token is None:
            newline, start, s = self._skip(), self.at, self.s
            if start >= len(s):
                self.token = _Token("end", "", start, start, newline)
            elif s[start] in "\"'":
                i = start + 1
                while i < len(s) and s[i] != s[start]:
                    if s[i] == "\n":
                        break
                    i += 2 if s[i] == "\\" else 1
                if i >= len(s) or s[i] != s[start]:
                    self.token = _Token("bad", s[start], start, start + 1, newline)
                else:
                    self.token = _Token("string", s[start : i + 1], start, i + 1, newline)
            elif s[start] == "`":
                self.token = _Token("template", "`", start, start + 1, newline)
            elif m := _NAME.match(s, start):
                self.token = _Token("private" if m[0][0] == "#" else "name", m[0], start, m.end(), newline)
            elif (s[start].isdigit() or (s[start] == "." and s[start + 1 : start + 2].isdigit())) and (m := _NUMBER.match(s, start)):
                self.token = _Token("number", m[0], start, m.end(), newline)
            elif m := _MARK.match(s, start):
                word = m[0]
                if word == "?." and s[m.end() : m.end() + 1].isdigit():
                    word = "?"
                self.token = _Token("mark", word, start, start + len(word), newline)
            else:
                self.token = _Token("bad", s[start], start, start + 1, newline)
        return self.token

    def next(self) -> _Token:
        t = self.peek()
        self.at, self.last, self.token = t.end, t.end, None
        return t

    def sees(self, *words: str) -> bool:
        t = self.peek()
        return t.kind in ("mark", "name") and t.text in words

    def take(self, word: str) -> bool:
        if self.sees(word):
            self.next()
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise _Bad(word)

    def after(self) -> _Token:
        """The token behind the next one."""
        keep, at, comments = self.peek(), self.at, len(self.comments)
        self.at, self.token = keep.end, None
        out = self.peek()
        self.at, self.token = at, keep
        del self.comments[comments:]
        return out

    # --- nodes

    def node(self, kind: str, start: int, *children: Node | None, **fields: Node | None) -> Node:
        kids = [c for c in (*children, *fields.values()) if c is not None]
        kids.sort(key=lambda c: (c.start, c.end))
        n = Node(kind, start, max(self.last, start), kids, {k: v for k, v in fields.items() if v is not None})
        self.done = [d for d in self.done if not (n.start <= d.start and d.end <= n.end)]
        self.done.append(n)
        return n

    def leaf(self, kind: str) -> Node:
        t = self.next()
        return self.node(kind, t.start)

    def end_statement(self) -> None:
        if self.take(";"):
            return
        t = self.peek()
        if not (t.kind == "end" or t.newline or self.sees("}")):
            raise _Bad(";")

    def parse(self) -> Node:
        root = Node("program", 0, len(self.s))
        while self.peek().kind != "end":
            root.children.append(self.guarded())
        root.children = self._with_comments(root)
        stack = [root]
        while stack:
            n = stack.pop()
            n.source = self.s
            for c in n.children:
                c.parent = n
                stack.append(c)
        return root

    def guarded(self) -> Node:
        """A statement, or an ERROR node for what can't be one."""
        start, at, depth = self.peek().start, self.at, self.depth
        self.done = []
        try:
            return self.statement()
        except (_Bad, RecursionError):
            self.depth = depth
            reached = max(self.last, start)
            if self.peek().start >= reached and self.peek().kind != "end":
                reached = self.next().end
            while self.peek().kind != "end" and not self.peek().newline and self.last < len(self.s) and self.s[self.last - 1] not in ";}":
                reached = self.next().end
            if reached <= at:
                reached = self.next().end
            error = Node("ERROR", start, max(reached, start + 1), sorted((d for d in self.done if d.end <= reached), key=lambda d: d.start))
            self.done = []
            return error

    def _with_comments(self, root: Node) -> list[Node]:
        """Comments go to the innermost node around them."""
        for c in self.comments:
            at, inner = root, root
            while inner is not None:
                at = inner
                inner = next((k for k in at.children if k.start < c.start and c.end < k.end and k.type not in ("string", "template_string", "regex")), None)
            at.children.append(c)
            at.children.sort(key=lambda k: k.start)
        return root.children

    # --- statements

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > _DEEPEST:
            raise _Bad("too deep")
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def block(self) -> Node:
        start = self.peek().start
        self.need("{")
        body = []
        while not self.sees("}"):
            if self.peek().kind == "end":
                raise _Bad("}")
            body.append(self.statement())
        self.need("}")
        return self.node("statement_block", start, *body)

    def _statement(self) -> Node:
        t = self.peek()
        start = t.start
        word = t.text if t.kind in ("name", "mark") else ""
        if word == "{":
            return self.block()
        if word == ";":
            return self.leaf("empty_statement")
        if word in ("var", "const") or (word == "let" and (self.after().kind == "name" or self.after().text in ("[", "{"))):
            out = self.declaration()
            self.end_statement()
            out.end = max(out.end, self.last)
            return out
        if word == "function" or (word == "async" and self.after().text == "function" and not self.after().newline):
            return self.function(True)
        if word == "class":
            return self.class_(True)
        if word == "if":
            self.next()
            test, then = self.parenthesized(), self.statement()
            other = None
            if self.sees("else"):
                at = self.next().start
                other = self.node("else_clause", at, self.statement())
            return self.node("if_statement", start, condition=test, consequence=then, alternative=other)
        if word == "for":
            return self.for_()
        if word in ("while", "with"):
            self.next()
            test = self.parenthesized()
            return self.node(f"{word}_statement", start, test, body=self.statement())
        if word == "do":
            self.next()
            body = self.statement()
            self.need("while")
            test = self.parenthesized()
            self.take(";")
            return self.node("do_statement", start, body=body, condition=test)
        if word == "switch":
            self.next()
            return self.node("switch_statement", start, value=self.parenthesized(), body=self.switch_body())
        if word == "try":
            self.next()
            body, handler, final = self.block(), None, None
            if self.sees("catch"):
                at = self.next().start
                name = None
                if self.take("("):
                    name = self.binding()
                    self.need(")")
                handler = self.node("catch_clause", at, parameter=name, body=self.block())
            if self.sees("finally"):
                at = self.next().start
                final = self.node("finally_clause", at, body=self.block())
            if handler is None and final is None:
                raise _Bad("catch")
            return self.node("try_statement", start, body=body, handler=handler, finalizer=final)
        if word in ("return", "throw"):
            self.next()
            value = None
            n = self.peek()
            if not (n.newline or n.kind == "end" or self.sees(";", "}")):
                value = self.expression()
            self.end_statement()
            return self.node(f"{word}_statement", start, value)
        if word in ("break", "continue"):
            self.next()
            label = self.leaf("statement_identifier") if self.peek().kind == "name" and not self.peek().newline else None
            self.end_statement()
            return self.node(f"{word}_statement", start, label)
        if word == "debugger":
            self.next()
            self.end_statement()
            return self.node("debugger_statement", start)
        if word == "import" and self.after().text not in ("(", "."):
            return self.import_()
        if word == "export":
            return self.export()
        if t.kind == "name" and word not in _RESERVED and self.after().text == ":":
            label = self.leaf("statement_identifier")
            self.need(":")
            return self.node("labeled_statement", start, label=label, body=self.statement())
        value = self.expression()
        self.end_statement()
        return self.node("expression_statement", start, value)

    def declaration(self, in_ok: bool = True) -> Node:
        word = self.next()
        parts = []
        while True:
            at = self.peek().start
            name, value = self.binding(), None
            if self.take("="):
                value = self.assignment(in_ok)
            parts.append(self.node("variable_declarator", at, name=name, value=value))
            if not self.take(","):
                break
        return self.node("variable_declaration" if word.text == "var" else "lexical_declaration", word.start, *parts)

    def for_(self) -> Node:
        start = self.next().start
        self.take("await")
        self.need("(")
        first = None
        if not self.sees(";"):
            if self.sees("var", "let", "const"):
                at = self.at
                word, kept = self.peek(), len(self.comments)
                self.next()
                name = self.binding()
                if self.sees("in", "of"):
                    self.next()
                    right = self.expression()
                    self.need(")")
                    return self.node("for_in_statement", start, left=name, right=right, body=self.statement())
                self.at, self.token = at, word
                del self.comments[kept:]
                first = self.declaration(False)
            else:
                first = self.expression(False)
                if self.sees("in", "of"):
                    self.next()
                    right = self.expression()
                    self.need(")")
                    return self.node("for_in_statement", start, left=self.pattern(first), right=right, body=self.statement())
        self.need(";")
        test = None if self.sees(";") else self.expression()
        self.need(";")
        step = None if self.sees(")") else self.expression()
        self.need(")")
        return self.node("for_statement", start, initializer=first, condition=test, increment=step, body=self.statement())

    def switch_body(self) -> Node:
        start = self.peek().start
        self.need("{")
        cases = []
        while not self.take("}"):
            at = self.peek().start
            if self.take("case"):
                value = self.expression()
                kind = "switch_case"
            else:
                self.need("default")
                value, kind = None, "switch_default"
            self.need(":")
            body = []
            while not self.sees("case", "default", "}"):
                if self.peek().kind == "end":
                    raise _Bad("}")
                body.append(self.statement())
            cases.append(self.node(kind, at, value, *body))
        return self.node("switch_body", start, *cases)

    def import_(self) -> Node:
        start, parts = self.next().start, []
        if self.peek().kind != "string":
            at, clause = self.peek().start, []
            while not self.sees("from"):
                if self.take(","):
                    continue
                if self.sees("*"):
                    begin = self.next().start
                    self.need("as")
                    clause.append(self.node("namespace_import", begin, self.leaf("identifier")))
                elif self.sees("{"):
                    clause.append(self.specifiers("named_imports", "import_specifier"))
                elif self.peek().kind == "name":
                    clause.append(self.leaf("identifier"))
                else:
                    raise _Bad("import")
            parts.append(self.node("import_clause", at, *clause))
            self.need("from")
        parts.append(self.string())
        self.end_statement()
        return self.node("import_statement", start, *parts, source=None)

    def specifiers(self, kind: str, each: str) -> Node:
        start, parts = self.next().start, []
        while not self.take("}"):
            at = self.peek().start
            name = self.string() if self.peek().kind == "string" else self.leaf("identifier")
            alias = None
            if self.take("as"):
                alias = self.string() if self.peek().kind == "string" else self.leaf("identifier")
            parts.append(self.node(each, at, name=name, alias=alias))
            if not self.sees("}"):
                self.need(",")
        return self.node(kind, start, *parts)

    def export(self) -> Node:
        start = self.next().start
        if self.take("default"):
            if self.sees("function", "class", "async"):
                value = self.statement()
                return self.node("export_statement", start, value=value)
            value = self.assignment()
            self.end_statement()
            return self.node("export_statement", start, value=value)
        if self.sees("*", "{"):
            if self.sees("*"):
                at, name = self.next().start, None
                if self.take("as"):
                    name = self.node("namespace_export", at, self.leaf("identifier"))
            else:
                name = self.specifiers("export_clause", "export_specifier")
            source = self.string() if self.take("from") else None
            self.end_statement()
            return self.node("export_statement", start, name, source=source)
        return self.node("export_statement", start, declaration=self.statement())

    # --- functions and classes

    def function(self, declared: bool) -> Node:
        start = self.peek().start
        self.take("async")
        self.need("function")
        star = self.take("*")
        name = self.leaf("identifier") if self.peek().kind == "name" and not self.sees("(") else None
        params, body = self.parameters(), self.block()
        named = declared and name is not None
        kind = ("generator_function_declaration" if named else "generator_function") if star else ("function_declaration" if named else "function_expression")
        out = self.node(kind, start, name=name, parameters=params, body=body)
        if declared and not named:
            return self.node("expression_statement", start, out)
        return out

    def parameters(self) -> Node:
        start, parts = self.peek().start, []
        self.need("(")
        while not self.take(")"):
            parts.append(self.binding_element())
            if not self.sees(")"):
                self.need(",")
        return self.node("formal_parameters", start, *parts)

    def binding_element(self) -> Node:
        start = self.peek().start
        if self.take("..."):
            return self.node("rest_pattern", start, self.binding())
        left = self.binding()
        if self.take("="):
            return self.node("assignment_pattern", start, left=left, right=self.assignment())
        return left

    def binding(self) -> Node:
        t = self.peek()
        if self.sees("{", "["):
            return self.pattern(self.primary())
        if t.kind == "name" and t.text not in _RESERVED:
            return self.leaf("identifier")
        raise _Bad("name")

    def class_(self, declared: bool) -> Node:
        start = self.next().start
        name = self.leaf("identifier") if self.peek().kind == "name" and not self.sees("extends") else None
        heritage = None
        if self.sees("extends"):
            at = self.next().start
            heritage = self.node("class_heritage", at, self.postfix())
        at, members = self.peek().start, []
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            members.append(self.member())
        body = self.node("class_body", at, *members)
        return self.node("class_declaration" if declared and name is not None else "class", start, heritage, name=name, body=body)

    def member(self) -> Node:
        start = self.peek().start
        if self.sees("static") and self.after().text == "{":
            self.next()
            return self.node("class_static_block", start, body=self.block())
        while self.sees("static", "async", "get", "set", "*") and self.after().text not in ("(", "=", ";", "}") and (self.sees("*") or not self.after().newline or not self.sees("async")):
            self.next()
        self.take("*")
        name = self.key()
        if self.sees("("):
            return self.node("method_definition", start, name=name, parameters=self.parameters(), body=self.block())
        value = self.assignment() if self.take("=") else None
        self.end_statement()
        return self.node("field_definition", start, property=name, value=value)

    def key(self) -> Node:
        t = self.peek()
        if t.kind == "name":
            return self.leaf("property_identifier")
        if t.kind == "private":
            return self.leaf("private_property_identifier")
        if t.kind == "string":
            return self.string()
        if t.kind == "number":
            return self.leaf("number")
        if self.take("["):
            inner = self.assignment()
            self.need("]")
            return self.node("computed_property_name", t.start, inner)
        raise _Bad("key")

    # --- expressions

    def parenthesized(self) -> Node:
        start = self.peek().start
        self.need("(")
        inner = self.expression()
        self.need(")")
        return self.node("parenthesized_expression", start, inner)

    def expression(self, in_ok: bool = True) -> Node:
        start, parts = self.peek().start, [self.assignment(in_ok)]
        while self.take(","):
            parts.append(self.assignment(in_ok))
        return parts[0] if len(parts) == 1 else self.node("sequence_expression", start, *parts)

    def assignment(self, in_ok: bool = True) -> Node:
        self.depth += 1
        if self.depth > _DEEPEST:
            raise _Bad("too deep")
        try:
            return self._assignment(in_ok)
        finally:
            self.depth -= 1

    def _arrow(self) -> Node | None:
        """An arrow function, if one starts here; otherwise nothing is taken."""
        t = self.peek()
        mark = (self.at, self.token, self.last, len(self.comments), list(self.done), self.depth)
        start = t.start
        try:
            if self.sees("async") and not self.after().newline and (self.after().kind == "name" or self.after().text == "(") and self.after().text != "function":
                self.next()
            if self.peek().kind == "name" and self.peek().text not in _RESERVED and self.after().text == "=>":
                param = self.leaf("identifier")
                self.need("=>")
                return self.node("arrow_function", start, parameter=param, body=self.arrow_body())
            if self.sees("("):
                params = self.parameters()
                if self.sees("=>") and not self.peek().newline:
                    self.next()
                    return self.node("arrow_function", start, parameters=params, body=self.arrow_body())
        except _Bad:
            if self.last > 0 and "=>" in self.s[start : self.last]:
                raise
        self.at, self.token, self.last, n, self.done, self.depth = mark
        del self.comments[n:]
        return None

    def arrow_body(self) -> Node:
        return self.block() if self.sees("{") else self.assignment()

    def _assignment(self, in_ok: bool) -> Node:
        t = self.peek()
        start = t.start
        if (t.kind == "name" and (t.text == "async" or self.after().text == "=>")) or t.text == "(":
            if (arrow := self._arrow()) is not None:
                return arrow
        if self.sees("yield"):
            self.next()
            n = self.peek()
            value = None
            if not (n.newline or n.kind == "end" or self.sees(")", "]", "}", ",", ";", ":")):
                self.take("*")
                value = self.assignment(in_ok)
            return self.node("yield_expression", start, value)
        left = self.conditional(in_ok)
        if self.sees("="):
            self.next()
            return self.node("assignment_expression", start, left=self.pattern(left), right=self.assignment(in_ok))
        if self.peek().kind == "mark" and self.peek().text in _ASSIGN:
            self.next()
            return self.node("augmented_assignment_expression", start, left=left, right=self.assignment(in_ok))
        return left

    def conditional(self, in_ok: bool) -> Node:
        start, test = self.peek().start, self.binary(1, in_ok)
        if not self.take("?"):
            return test
        yes = self.assignment()
        self.need(":")
        return self.node("ternary_expression", start, condition=test, consequence=yes, alternative=self.assignment(in_ok))

    def binary(self, level: int, in_ok: bool) -> Node:
        start, left = self.peek().start, self.unary()
        while True:
            t = self.peek()
            rank = _BINARY.get(t.text, 0) if t.kind in ("mark", "name") else 0
            if rank < level or (t.text == "in" and not in_ok):
                return left
            self.next()
            right = self.binary(rank if t.text == "**" else rank + 1, in_ok)
            left = self.node("binary_expression", start, left=left, right=right)

    def unary(self) -> Node:
        t = self.peek()
        if self.sees("!", "~", "+", "-", "typeof", "void", "delete"):
            self.next()
            return self.node("unary_expression", t.start, argument=self.unary())
        if self.sees("++", "--"):
            self.next()
            return self.node("update_expression", t.start, argument=self.unary())
        if self.sees("await") and (self.after().kind in ("name", "string", "number", "template") or self.after().text in ("(", "[", "{", "!")) and not self.after().newline and self.after().text not in _BINARY:
            self.next()
            return self.node("await_expression", t.start, self.unary())
        out = self.postfix()
        if self.sees("++", "--") and not self.peek().newline:
            self.next()
            return self.node("update_expression", t.start, argument=out)
        return out

    def postfix(self) -> Node:
        start = self.peek().start
        out = self.new() if self.sees("new") else self.primary()
        while True:
            t = self.peek()
            if self.take("."):
                out = self.member_of(out, start, None)
            elif self.sees("?."):
                chain = self.leaf("optional_chain")
                if self.sees("("):
                    out = self.node("call_expression", start, chain, function=out, arguments=self.arguments())
                elif self.take("["):
                    index = self.expression()
                    self.need("]")
                    out = self.node("subscript_expression", start, chain, object=out, index=index)
                else:
                    out = self.member_of(out, start, chain)
            elif self.take("["):
                index = self.expression()
                self.need("]")
                out = self.node("subscript_expression", start, object=out, index=index)
            elif self.sees("("):
                out = self.node("call_expression", start, function=out, arguments=self.arguments())
            elif t.kind == "template":
                out = self.node("call_expression", start, function=out, arguments=self.template())
            else:
                return out

    def member_of(self, left: Node, start: int, chain: Node | None) -> Node:
        t = self.peek()
        if t.kind not in ("name", "private"):
            raise _Bad("property")
        name = self.leaf("property_identifier" if t.kind == "name" else "private_property_identifier")
        return self.node("member_expression", start, chain, object=left, property=name)

    def new(self) -> Node:
        start = self.next().start
        if self.take("."):
            self.next()
            return self.node("meta_property", start)
        at = self.peek().start
        made = self.new() if self.sees("new") else self.primary()
        while True:
            if self.take("."):
                made = self.member_of(made, at, None)
            elif self.take("["):
                index = self.expression()
                self.need("]")
                made = self.node("subscript_expression", at, object=made, index=index)
            else:
                break
        args = self.arguments() if self.sees("(") else None
        return self.node("new_expression", start, constructor=made, arguments=args)

    def arguments(self) -> Node:
        start, parts = self.peek().start, []
        self.need("(")
        while not self.take(")"):
            parts.append(self.spread())
            if not self.sees(")"):
                self.need(",")
        return self.node("arguments", start, *parts)

    def spread(self) -> Node:
        start = self.peek().start
        if self.take("..."):
            return self.node("spread_element", start, self.assignment())
        return self.assignment()

    def string(self) -> Node:
        t = self.peek()
        if t.kind != "string":
            raise _Bad("string")
        self.next()
        return self.node("string", t.start, *self.fragments(t.start + 1, t.end - 1))

    def fragments(self, start: int, end: int) -> list[Node]:
        """string_fragment and escape_sequence nodes of a stretch of text."""
        out, at = [], start
        escape = re.compile(r"\\(?:u\{[^}]*\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|\r\n|.)", re.S)
        for m in escape.finditer(self.s, start, end):
            if m.start() > at:
                out.append(Node("string_fragment", at, m.start()))
            out.append(Node("escape_sequence", m.start(), m.end()))
            at = m.end()
        if end > at:
            out.append(Node("string_fragment", at, end))
        return out

    def template(self) -> Node:
        start = self.next().start
        parts, i, at, s = [], self.at, self.at, self.s
        while True:
            if i >= len(s):
                raise _Bad("`")
            if s[i] == "\\":
                i += 2
            elif s[i] == "`":
                parts += self.fragments(at, i)
                self.at, self.last, self.token = i + 1, i + 1, None
                return self.node("template_string", start, *parts)
            elif s.startswith("${", i):
                parts += self.fragments(at, i)
                self.at, self.token = i + 2, None
                inner = self.expression()
                if not self.sees("}"):
                    raise _Bad("}")
                close = self.peek().end
                self.at, self.last, self.token = close, close, None
                parts.append(self.node("template_substitution", i, inner))
                i = at = close
            else:
                i += 1

    def regex(self) -> Node:
        start = self.peek().start
        i, inside, s = start + 1, False, self.s
        while i < len(s) and (s[i] != "/" or inside):
            if s[i] in "\n\r":
                raise _Bad("/")
            if s[i] == "\\":
                i += 1
            elif s[i] in "[]":
                inside = s[i] == "["
            i += 1
        if i >= len(s):
            raise _Bad("/")
        flags = re.compile(r"[A-Za-z]*").match(s, i + 1)
        self.at, self.last, self.token = flags.end(), flags.end(), None
        parts = [Node("regex_pattern", start + 1, i)] + ([Node("regex_flags", i + 1, flags.end())] if flags[0] else [])
        return self.node("regex", start, *parts)

    def primary(self) -> Node:
        t = self.peek()
        if t.kind == "string":
            return self.string()
        if t.kind == "number":
            return self.leaf("number")
        if t.kind == "template":
            return self.template()
        if t.kind == "private":
            return self.leaf("private_property_identifier")
        if t.kind == "name":
            if t.text in ("this", "super", "true", "false", "null", "undefined"):
                return self.leaf(t.text)
            if t.text == "function" or (t.text == "async" and self.after().text == "function" and not self.after().newline):
                return self.function(False)
            if t.text == "class":
                return self.class_(False)
            if t.text == "new":
                return self.new()
            if t.text == "import":
                out = self.leaf("import")
                if self.sees("."):
                    self.next()
                    self.next()
                    return self.node("meta_property", t.start)
                return out
            if t.text in _RESERVED:
                raise _Bad(t.text)
            return self.leaf("identifier")
        if t.text == "(":
            return self.parenthesized()
        if t.text == "[":
            self.next()
            parts = []
            while not self.take("]"):
                if self.take(","):
                    continue
                parts.append(self.spread())
                if not self.sees("]"):
                    self.need(",")
            return self.node("array", t.start, *parts)
        if t.text == "{":
            return self.object()
        if t.text in ("/", "/="):
            return self.regex()
        raise _Bad(t.text)

    def object(self) -> Node:
        start, parts = self.next().start, []
        while not self.take("}"):
            at = self.peek().start
            if self.sees("..."):
                parts.append(self.spread())
            else:
                plain = True
                while self.sees("async", "get", "set", "*") and self.after().text not in ("(", ":", ",", "}", "="):
                    plain = False
                    self.next()
                shorthand = self.peek().kind == "name"
                name = self.key()
                if self.sees("("):
                    parts.append(self.node("method_definition", at, name=name, parameters=self.parameters(), body=self.block()))
                elif self.take(":"):
                    parts.append(self.node("pair", at, key=name, value=self.assignment()))
                elif shorthand and plain:
                    name.type = "shorthand_property_identifier"
                    if self.take("="):
                        parts.append(self.node("object_assignment_pattern", at, left=name, right=self.assignment()))
                    else:
                        parts.append(name)
                else:
                    raise _Bad("property")
            if not self.sees("}"):
                self.need(",")
        return self.node("object", start, *parts)

    def pattern(self, n: Node) -> Node:
        """An expression that stands where names are bound."""
        if n.type == "object":
            n.type = "object_pattern"
            for c in n.children:
                if c.type == "shorthand_property_identifier":
                    c.type = "shorthand_property_identifier_pattern"
                elif c.type == "object_assignment_pattern":
                    c.children[0].type = "shorthand_property_identifier_pattern"
                elif c.type == "pair":
                    c.type = "pair_pattern"
                    self.pattern(c.fields["value"])
                elif c.type == "spread_element":
                    c.type = "rest_pattern"
                    self.pattern(c.children[0])
        elif n.type == "array":
            n.type = "array_pattern"
            for c in n.children:
                if c.type == "spread_element":
                    c.type = "rest_pattern"
                self.pattern(c)
        elif n.type == "assignment_expression":
            n.type = "assignment_pattern"
            self.pattern(n.fields["left"])
        return n


def parse(source: str | None) -> Node:
    """A1: the tree of a source text."""
    return Parser(source or "").parse()


def rows(root: Node) -> list[dict]:
    """The tree as rows: node_id and pre in pre-order, post in post-order, rows and columns from 0.

    statement_id: the nearest expression_statement above.
    """
    breaks = [i for i, c in enumerate(root.source) if c == "\n"]
    from bisect import bisect_left

    def point(at: int) -> tuple[int, int]:
        row = bisect_left(breaks, at)
        return row, at - (breaks[row - 1] + 1 if row else 0)

    pre = {id(n): i for i, n in enumerate(root.walk())}
    post = {id(n): i for i, n in enumerate(root.post())}
    out: list[dict] = []
    around: dict[int, int | None] = {}  # nearest expression_statement above
    for n in root.walk():
        up = n.parent
        around[id(n)] = None if up is None else pre[id(up)] if up.type == "expression_statement" else around[id(up)]
        (r, c), (er, ec) = point(n.start), point(n.end)
        name = next((k for k, v in n.parent.fields.items() if v is n), None) if n.parent else None
        out.append({"node_id": pre[id(n)], "parent_id": pre[id(n.parent)] if n.parent else None, "pre": pre[id(n)], "post": post[id(n)], "statement_id": around[id(n)], "type": n.type, "field": name, "start_row": r, "start_col": c, "end_row": er, "end_col": ec, "text": n.text})
    return out


def beautify(source: str) -> str:
    """Statements on lines of their own, four spaces for each open bracket, one space where there were several.

    A text that is not wholly understood stays as it is.
    """
    p = Parser(source)
    root = p.parse()
    if any(n.type == "ERROR" for n in root.walk()):
        return source
    kept = [(n.start, n.end) for n in root.walk() if n.type in ("string", "template_string", "regex", "comment", "hash_bang_line")]
    breaks_after = {n.end for n in root.walk() if n.type.endswith(("_statement", "_declaration")) and n.parent is not None and n.parent.type in ("program", "statement_block", "class_body", "switch_case", "switch_default")}
    breaks_after |= {n.end for n in root.walk() if n.type in ("method_definition", "field_definition") and n.parent.type == "class_body"}
    opens = {n.start for n in root.walk() if n.type in ("statement_block", "class_body", "switch_body") and n.children}
    closes = {n.end - 1 for n in root.walk() if n.type in ("statement_block", "class_body", "switch_body") and n.children}
    out: list[str] = []
    depth, at, k = 0, 0, 0
    kept.sort()

    def line() -> None:
        while out and out[-1].isspace():
            out.pop()
        if out:
            out.append("\n" + "    " * depth)

    while at < len(source):
        while k < len(kept) and kept[k][1] <= at:
            k += 1
        if k < len(kept) and kept[k][0] == at:
            text = source[at : kept[k][1]]
            out.append(text)
            at = kept[k][1]
            if text.startswith("//"):
                line()
            if at in breaks_after:
                line()
            continue
        c = source[at]
        if c.isspace():
            run = at
            while run < len(source) and source[run].isspace():
                run += 1
            text = source[at:run]
            if "\n" in text:
                line()
                if text.count("\n") > 1 and out:
                    out[-1] = "\n" + out[-1]
            elif out and not out[-1].isspace():
                out.append(" ")
            at = run
            continue
        if at in closes:
            depth -= 1
            line()
        out.append(c)
        at += 1
        if at - 1 in opens:
            depth += 1
            line()
        elif at in breaks_after and at < len(source):
            line()
    return "".join(out).rstrip() + ("\n" if source.endswith("\n") else "")
