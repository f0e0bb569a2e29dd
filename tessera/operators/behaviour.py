"""Behaviour graphs: a walk over a package's dependence graphs that resolves names, classifies calls and joins callees.

The order of the walk is its meaning: bindings come into being on the way, the first edge between two nodes wins, and
a call means what its name is bound to just then. So a package is walked in one piece, in one task; packages are
independent and spread over tasks, and everything before and after is joins. The knowledge base is not carried along:
a package gets the rows whose module it mentions. What the base doesn't know comes out as misses.
"""

from __future__ import annotations

import json
import posixpath
import re
import sys
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import js
from tessera.operators.graph import by_package
from tessera.operators.kb import CLASS_OF, INTEREST
from tessera.operators.match import CATEGORIES
from tessera.session import Memo

GRAPHS = "phase string, root long, what string, node long, src long, dst long, attrs array<string>, categories array<string>, file string, line long, name string, code string, kind string, qualifier string"
WHAT = ("node", "edge", "miss")
_LAMBDA = re.compile(r"<lambda>\d*")
_CALL = re.compile(r"^[a-zA-Z$_][a-zA-Z0-9$_]*$")
_DOTTED = re.compile(r"\b\w+\.(\w+)\b$")


@dataclass
class Binding:
    """A name, and what is known of its value."""

    name: str
    line: int
    type: str
    node: int | None
    method: int | None = None
    entity: str | None = None
    function: str | None = None
    full_name: str | None = None
    original: str | None = None
    right: str | None = None
    local: bool = False
    builtin: bool = False
    third: bool = False
    categories: list[str] | None = None


class Scopes:
    """The scopes of one file; the innermost is the last."""

    def __init__(self) -> None:
        self.chain: list[tuple[str, list[Binding]]] = [("", [])]

    def bind(self, b: Binding) -> None:
        self.chain[-1][1].append(b)

    def find(self, name: str, line: int) -> Binding | None:
        for _, bound in reversed(self.chain):
            for b in reversed(bound):
                if b.name == name and b.line <= line:
                    return b
        return None

    def inside(self, name: str) -> bool:
        return any(n == name for n, _ in self.chain[1:])


@dataclass
class Graph:
    entrance: int
    nodes: dict[int, None] = field(default_factory=dict)
    edges: dict[tuple[int, int], list[str]] = field(default_factory=dict)
    into: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    returns: list[int] = field(default_factory=list)

    def edge(self, src: int | None, dst: int, attrs: list[str]) -> None:
        if src is not None and (src, dst) not in self.edges:
            self.edges[src, dst] = list(attrs)
            self.into[dst].append(src)

    def join(self, other: Graph) -> None:
        if other.entrance not in self.nodes:
            self.nodes.update(other.nodes)
            for (s, d), attrs in other.edges.items():
                self.edge(s, d, attrs)


@dataclass
class State:
    """What is known of a node of a dependence graph."""

    call: str | None = None
    graph: Graph | None = None
    categories: list[str] | None = None
    full_name: str | None = None
    origin: str | None = None


def _is_ddg(attrs: list[str]) -> bool:
    return any("DDG" in a for a in attrs)


def _first(root: js.Node, *path: str) -> js.Node | None:
    """The first node, in document order, at the end of a chain of child types."""
    for n in root.walk():
        if n.type == path[0]:
            found = [n]
            for kind in path[1:]:
                found = [c for f in found for c in f.children if c.type == kind]
            if found:
                return found[0]
    return None


def _calls(root: js.Node) -> list[tuple[js.Node, js.Node]]:
    """(statement, call) of the expression statements that are calls."""
    return [(n, c) for n in root.walk() if n.type == "expression_statement" for c in n.children if c.type == "call_expression"]


def _is_top(statement: js.Node) -> bool:
    return not any(a.type == "expression_statement" for a in statement.ancestors())


@lru_cache(64)
def _functions(text: str) -> dict[tuple[str, str], str]:
    """Categories of a module's functions by (kind, name)."""
    return {(f.get("kind"), f.get("name")): f["category"] for f in json.loads(text)}


#: Packages of a task share the trees of equal pieces of code; nothing changes a tree.
_TREES = Memo(js.parse)


class Walk:
    def __init__(self, held: dict[str, list[dict]]):
        self.attr = {n["node_id"]: n["attr"] or {} for n in held["cpg_nodes"]}
        self.out: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
        for e in sorted(held["cpg_edges"], key=lambda e: e["seq"]):
            self.out[e["src"]].append((e["dst"], e["attrs"]))
        self.methods = {m["method_id"]: m for m in sorted(held["methods"], key=lambda m: m["method_id"])}
        self.nodes: dict[int, dict[int, dict]] = defaultdict(dict)
        for n in sorted(held["pdg_nodes"], key=lambda n: n["seq"]):
            self.nodes[n["method_id"]][n["node_id"]] = n
        self.edges: dict[int, dict[tuple[int, int], list[str]]] = defaultdict(dict)
        for e in sorted(held["pdg_edges"], key=lambda e: e["seq"]):
            self.edges[e["method_id"]].setdefault((e["src"], e["dst"]), []).append(e["label"])
        self.files = {f["path"] for f in held["files"]}
        self.origins = {r["module"]: "BUILTIN" if r["builtin"] else "THIRD_PART" for r in held["kb"]}
        self.known = {r["module"]: r["functions"] for r in held["kb"]}
        self.manifest = held["manifests"][0] if held["manifests"] else {"main": "index.js", "files": []}
        self.scopes: dict[str, Scopes] = {}
        self.state: dict[int, State] = defaultdict(State)
        self.analysed: set[int] = set()
        self.function_calls: set[int] = set()
        self.local_calls: set[int] = set()
        self.missing: dict[tuple[str, str, str], None] = {}
        self.trees: dict[str, js.Node] = {}

    # --- look-ups

    def tree(self, code: str | None) -> js.Node:
        if code not in self.trees:
            self.trees[code] = _TREES(code or "")
        return self.trees[code]

    def origin(self, module: str) -> str:
        legal = len(module) <= 214 and not module.startswith((".", "_", "node_modules")) and " " not in module
        return self.origins.get(module, "NOT_IN") if legal else "NOT_IN"

    def classify(self, node: int, qualifier: str, name: str, kind: str) -> list[str] | None:
        """The categories of a call, which its node gets; None: not sensitive, or not known."""
        stored = _functions(self.known[qualifier]).get((kind, name), "") if qualifier in self.known else ""
        if not stored:
            self.missing[kind, qualifier, name] = None
            return None
        if stored == "Others":
            return None
        self.state[node].categories = stored.split("-")
        return self.state[node].categories

    def listed(self, node: int, label: str, order: str) -> list[int]:
        found = [d for d, attrs in self.out[node] for a in attrs if a == label]
        return sorted(found, key=lambda d: int(self.attr[d].get(order, 0)))

    def children(self, node: int) -> list[int]:
        return self.listed(node, "AST", "ORDER")

    def line(self, node: int) -> int:
        return int(self.attr[node].get("LINE_NUMBER", 0))

    def is_local(self, file: str, entity: str) -> bool:
        if entity.startswith((".", "/")) or entity.endswith(".js") or _DOTTED.search(entity):
            return True
        return posixpath.normpath(posixpath.join(posixpath.dirname(file), entity)) + ".js" in self.files

    def method_of(self, name: str, file: str) -> int | None:
        return next((i for i, m in self.methods.items() if m["name"] == name and m["file_name"] == file), None)

    def start_scopes(self) -> None:
        """Every file's scope anew, with the functions that it declares."""
        self.scopes = defaultdict(Scopes)
        for i, m in self.methods.items():
            if not _LAMBDA.search(m["name"]) and m["name"] != ":program" and m["file_name"] in self.files:
                self.scopes[m["file_name"]].bind(Binding(m["name"], 1, "FUNCTION_DECLARE", None, i))

    # --- the walk

    def generate(self, file: str, method: int) -> Graph:
        """B1: the graph of a method, from its first node."""
        graph = Graph(method)
        self.visit(method, method, method, file, set(), graph)
        return graph

    def visit(self, node: int, former: int, method: int, file: str, seen: set[int], graph: Graph) -> None:
        """B2."""
        pdg, edges = self.nodes[method], self.edges[method]
        labels = None if former == node else edges[former, node]
        if node in seen:
            if labels is not None:
                self.revisit(node, former, labels, graph)
            return
        graph.nodes[node] = None
        seen.add(node)
        kind = pdg[node]["node_type"]
        if node != method and labels is not None:
            if kind == "RETURN":
                graph.returns.append(node)
                graph.edge(former, node, labels)
            elif kind == "METHOD_PARAMETER_IN":
                graph.edge(former, node, labels)
                name = pdg[node]["name"]
                if name != "this":
                    self.scopes[file].bind(Binding(name, pdg[node]["line"], "IDENTIFIER", node, method))
            elif kind == "CALL":
                self.call(node, former, method, file, graph, labels)
            else:
                graph.edge(former, node, labels)
        after = [(d, _is_ddg(a)) for (s, d), a in edges.items() if s == node and d in pdg]
        control = [d for d, ddg in reversed(after) if not ddg]
        data = sorted((d for d, ddg in after if ddg), key=lambda d: pdg[d]["line"])
        for d in control + data:
            self.visit(d, node, method, file, seen, graph)

    def revisit(self, node: int, former: int, labels: list[str], graph: Graph) -> None:
        called = self.state[former].call in ("FUNCTION_CALL", "LOCAL_MODULE_CALL")
        own = self.state[node]
        if not _is_ddg(labels):
            graph.edge(former, node, labels)
        elif own.call == "ASSIGNMENT" and called:
            self.redirect(former, node, labels, graph)
        elif own.call in ("FUNCTION_CALL", "LOCAL_MODULE_CALL"):
            if own.graph is not None:
                if called:
                    self.redirect(former, node, labels, graph)
                graph.edge(former, node, labels)
        else:
            graph.edge(former, node, labels)

    def redirect(self, former: int, node: int, labels: list[str], graph: Graph) -> None:
        """From the callee's return nodes, if it has any, instead of from the call."""
        callee = self.state[former].graph
        if callee is None or not callee.returns:
            graph.edge(former, node, labels)
            return
        for r in callee.returns:
            graph.edge(r, node, labels if _is_ddg(labels) else ["DDG"])

    def link(self, binding: Binding, node: int, method: int, graph: Graph, name: str | None = None) -> None:
        """An edge from where a name was bound; the labels of an edge that is there already stay."""
        if binding.node is not None:
            graph.edge(binding.node, node, self.edges[method].get((binding.node, node)) or [f"DDG: {name or binding.name}"])

    def call(self, node: int, former: int, method: int, file: str, graph: Graph, labels: list[str]) -> None:
        """B3."""
        n = self.nodes[method][node]
        name = n["name"]
        if name == "<operator>.assignment":
            self.assign(node, former, method, file, graph, labels)
        if name == "<operator>.assignmentPlus":
            self.state[node].call = "ASSIGNMENT"
            parts = self.children(node)
            left = self.attr[parts[0]].get("CODE") if parts else None
            found = self.scopes[file].find(left, n["line"]) if left else None
            if found is not None and found.node is not None:
                graph.edge(node, found.node, [f"DDG: {left}"])
            graph.edge(former, node, labels)
        elif name == "<operator>.formatString":
            if self.state[former].call in ("FUNCTION_CALL", "LOCAL_MODULE_CALL"):
                self.redirect(former, node, labels, graph)
            else:
                graph.edge(former, node, labels)
        elif name == "<operator>.new":
            graph.edge(former, node, labels)
            made = _first(self.tree(n["code"]), "new_expression", "identifier")
            if made is not None and made.text == "Function":
                self.state[node].categories = ["39"]
        elif name == "require":
            graph.edge(former, node, labels)
            self.require(node, n["code"], file, graph)
        elif name is not None and _CALL.match(name) and "<operator>" not in name and not _LAMBDA.search(name):
            graph.edge(former, node, ["DDG"] if name == "then" else labels)
            self.named_call(node, name, method, file, graph)
        else:
            graph.edge(former, node, labels)
        inner = self.lambda_of(node)
        if inner is not None:  # B8
            self.analysed.add(inner)
            scopes = self.scopes[file]
            if scopes.inside(self.methods[inner]["full_name"]):
                return
            scopes.chain.append((self.methods[inner]["full_name"], []))
            graph.edge(node, inner, ["DDG"])
            sub = self.generate(file, inner)
            scopes.chain.pop()
            graph.join(sub)

    def lambda_of(self, node: int) -> int | None:
        """The method of the last argument, if that is a lambda."""
        args = self.listed(node, "ARGUMENT", "ARGUMENT_INDEX")
        if not args:
            return None
        last = self.attr[args[-1]]
        full = last.get("METHOD_FULL_NAME")
        if full is None or not re.match(r"<lambda>\d+", last.get("CODE", "")):
            return None
        return next((i for i, m in self.methods.items() if m["full_name"] == full), None)

    def required(self, code: str | None) -> str | None:
        found = _first(self.tree(code), "call_expression", "arguments", "string", "string_fragment")
        return found.text if found is not None else None

    def require(self, node: int, code: str, file: str, graph: Graph) -> None:
        """The graph of a required local file joins by a control edge."""
        entity = self.required(code)
        if entity is None or self.origin(entity) == "BUILTIN" or not self.is_local(file, entity):
            return
        path = posixpath.normpath(posixpath.join(posixpath.dirname(file), entity.removesuffix(".js"))) + ".js"
        target = self.method_of(":program", path) if path in self.files else None
        if target is not None and not self.scopes[path].inside(path):
            self.analysed.add(target)
            self.scopes[path].chain.append((path, self.scopes[path].chain[-1][1]))  # the file's own scope, marked as entered
            sub = self.generate(path, target)
            self.scopes[path].chain.pop()
            graph.edge(node, sub.entrance, ["CFG"])
            graph.join(sub)

    def assign(self, node: int, former: int, method: int, file: str, graph: Graph, labels: list[str]) -> None:
        """N9. Every assignment also gets the direct edge from its predecessor, at the end."""
        self.state[node].call = "ASSIGNMENT"
        parts = self.children(node)
        if len(parts) >= 2 and self.attr[parts[1]].get("label") != "METHOD_REF":
            left, right = self.attr[parts[0]], self.attr[parts[1]]
            b = Binding(left.get("CODE", ""), self.nodes[method][node]["line"], "IDENTIFIER", node, method)
            self.scopes[file].bind(b)
            kind = right.get("label")
            if kind == "CALL":
                self.assign_call(b, node, former, parts[1], method, file, graph, labels)
            elif kind == "IDENTIFIER":
                graph.edge(former, node, labels)
                self.assign_name(b, node, right.get("CODE", ""), method, file, graph)
            elif kind == "BLOCK":
                graph.edge(former, node, labels)
                self.assign_new(b, node, right.get("CODE", ""), method, file, graph)
        graph.edge(former, node, labels)

    def assign_call(self, b: Binding, node: int, former: int, right: int, method: int, file: str, graph: Graph, labels: list[str]) -> None:
        """N10-N14, and calls that return objects."""
        a = self.attr[right]
        name = a.get("NAME")
        state = self.state[right]
        if name == "require":
            entity = self.required(a.get("CODE"))
            if entity is not None:
                self.imported(b, entity, file)
                b.type = "REQUIRE"
        elif name == "<operator>.addition":
            if _is_ddg(labels) and self.state[former].call in ("FUNCTION_CALL", "LOCAL_MODULE_CALL"):
                self.redirect(former, node, labels, graph)
        elif name in ("<operator>.fieldAccess", "<operator>.indexAccess"):
            self.assign_field(b, node, right, method, file, graph)
        elif right in self.local_calls or right in self.function_calls:
            b.type = "LOCAL_MODULE_FUNCTION_RETURN_VALUE" if right in self.local_calls else "FUNCTION_RETURN_VALUE"
            if state.graph is None:
                graph.edge(former, node, ["CFG"])
            elif state.graph.returns:
                for r in state.graph.returns:
                    graph.edge(r, node, ["DDG"])
            else:
                graph.edge(former, node, ["DDG"])
        else:
            if right in self.nodes[method] and state.call == "CALL":
                b.type, b.right = "RETURN_OBJECT", state.origin
                b.full_name = state.full_name or b.full_name
                b.categories = state.categories
            graph.edge(former, node, ["DDG"])

    def imported(self, b: Binding, entity: str, file: str) -> str | None:
        """What importing an entity says of a binding; its origin if it isn't local."""
        b.entity, b.local = entity, self.is_local(file, entity)
        if b.local:
            return None
        where = self.origin(entity)
        b.builtin, b.third = where == "BUILTIN", where != "BUILTIN"
        if where == "NOT_IN":
            self.missing["third", entity, ""] = None
        return where

    def assign_field(self, b: Binding, node: int, right: int, method: int, file: str, graph: Graph) -> None:
        """x = m.f, or x = require('m').f."""
        parts = self.children(right)
        if len(parts) < 2:
            return
        left, name = self.attr[parts[0]], self.attr[parts[1]].get("CODE", "")
        found = self.scopes[file].find(left.get("CODE", ""), self.line(parts[0]))
        if found is not None:
            self.link(found, node, method, graph)
            if found.type == "REQUIRE":
                b.type, b.entity, b.function, b.builtin, b.full_name = "FUNCTION_FROM_REQUIRE", found.entity, name, found.builtin, f"{found.entity}.{name}"
        elif left.get("NAME") == "require":
            entity = self.required(left.get("CODE"))
            if entity is not None:
                b.type = "REQUIRE" if name == "default" else "FUNCTION_FROM_REQUIRE"
                b.function = None if name == "default" else name
                if self.imported(b, entity, file) in ("BUILTIN", "THIRD_PART"):
                    b.full_name = f"{entity}.{name}"

    def assign_name(self, b: Binding, node: int, name: str, method: int, file: str, graph: Graph) -> None:
        """An alias, but for the categories of the call that made the value."""
        found = self.scopes[file].find(name, b.line)
        if found is b:  # x = x
            found = None
        if found is not None:
            b.original, b.type, b.local, b.builtin, b.third = name, found.type, found.local, found.builtin, found.third
            b.entity, b.full_name, b.function, b.right, b.method = found.entity, found.full_name, found.function, found.right, found.method
            self.link(found, node, method, graph, name)

    def assign_new(self, b: Binding, node: int, code: str, method: int, file: str, graph: Graph) -> None:
        """x = new A, or x = new a.B."""
        root, scopes = self.tree(code), self.scopes[file]
        made = _first(root, "new_expression", "identifier")
        if made is not None:
            found = scopes.find(made.text, b.line)
            if found is None:
                if self.origin(made.text) == "BUILTIN":
                    b.builtin, b.type, b.entity = True, "REQUIRE", made.text
                return
            if found.type == "REQUIRE" and (found.builtin or found.third):
                b.entity, b.type, b.builtin, b.third = found.entity, "REQUIRE", found.builtin, found.third and not found.builtin
            elif found.type == "FUNCTION_FROM_REQUIRE" and found.builtin:
                b.full_name, b.type, b.right = f"{found.entity}.{found.function}", "RETURN_OBJECT", "builtin"
            if found.type != "FUNCTION_DECLARE":
                self.link(found, node, method, graph)
            return
        member = _first(root, "new_expression", "member_expression")
        if member is None or member.fields["object"].type != "identifier" or member.fields["property"].type != "property_identifier":
            return
        left, name = member.fields["object"].text, member.fields["property"].text
        found = scopes.find(left, b.line)
        if found is not None:
            self.link(found, node, method, graph)
        entity = left if found is None else found.entity if found.type == "REQUIRE" else None
        if entity is not None and self.origin(entity) == "BUILTIN":
            b.full_name, b.type, b.right = f"{entity}.{name}", "RETURN_OBJECT", "builtin"
            b.categories = self.classify(node, entity, name, "builtin")

    # --- calls by name

    def named_call(self, node: int, name: str, method: int, file: str, graph: Graph) -> None:
        """The shapes of a call, the first that fits deciding."""
        self.state[node].call = "CALL"
        n = self.nodes[method][node]
        root, line, scopes = self.tree(n["code"]), n["line"], self.scopes[file]
        calls = _calls(root)
        plain = next((s for s, c in calls if c.fields["function"].type == "identifier"), None)
        if plain is not None and _is_top(plain):
            self.arguments(node, method, file, graph)
            self.single(node, name, file, graph)
            return
        errors = [m for e in root.walk() if e.type == "ERROR" for m in e.children if m.type == "member_expression"]
        if any(m.fields["object"].type == "call_expression" for m in errors):
            return
        broken = next((m for m in errors if m.fields["object"].type == "identifier" and m.fields["property"].type == "property_identifier"), None)
        if broken is not None:
            if broken.fields["property"].text == name:
                self.by_qualifier(node, broken.fields["object"].text, name, method, file, graph)
            return
        members = [(s, c.fields["function"]) for s, c in calls if c.fields["function"].type == "member_expression" and c.fields["function"].fields["property"].type == "property_identifier"]

        def shaped(test) -> tuple[js.Node, js.Node] | None:  # noqa: ANN001
            return next(((s, f) for s, f in members if test(f.fields["object"])), None)

        def of_require(o: js.Node) -> bool:
            return o.type == "call_expression" and o.fields["function"].type == "identifier" and any(c.type == "string" for c in o.fields["arguments"].children)

        def of_method(o: js.Node) -> bool:
            f = o.fields["function"] if o.type == "call_expression" else None
            return f is not None and f.type == "member_expression" and f.fields["object"].type == "identifier" and f.fields["property"].type == "property_identifier"

        def of_field(o: js.Node) -> bool:
            return o.type == "member_expression" and o.fields["object"].type == "identifier" and o.fields["property"].type == "property_identifier"

        if (hit := shaped(of_require)) is not None:
            s, f = hit
            o = f.fields["object"]
            if _is_top(s) and o.fields["function"].text == "require" and f.fields["property"].text == name:
                entity = next(c for c in o.fields["arguments"].children if c.type == "string").text[1:-1]
                if self.origin(entity) == "BUILTIN":
                    self.state[node].full_name, self.state[node].origin = f"{entity}.{name}", "builtin"
                    self.classify(node, entity, name, "builtin")
        elif (hit := shaped(lambda o: o.type == "identifier")) is not None:
            s, f = hit
            q = f.fields["object"].text
            if _is_top(s) and f.fields["property"].text == name and q != "this":
                self.by_qualifier(node, q, name, method, file, graph)
        elif (hit := shaped(of_method)) is not None:
            s, f = hit
            inner = f.fields["object"].fields["function"]
            q, made = inner.fields["object"].text, inner.fields["property"].text
            if not _is_top(s) or f.fields["property"].text != name or q == "this":
                return
            self.arguments(node, method, file, graph)
            found = scopes.find(q, line)
            if found is not None:
                self.link(found, node, method, graph)
                if found.original != "this" and found.builtin:
                    full = f"{found.entity}.{made}"
                    self.state[node].full_name = f"{full}.{name}"
                    self.classify(node, CLASS_OF.get(full, full), name, "builtin")
        elif (hit := shaped(of_field)) is not None:
            s, f = hit
            left, mid = f.fields["object"].fields["object"].text, f.fields["object"].fields["property"].text
            if not _is_top(s) or f.fields["property"].text != name or (left, mid) == ("module", "exports"):
                return
            found = scopes.find(f"{left}.{mid}", line)
            if found is not None:
                self.link(found, node, method, graph)
                self.on_binding(node, name, found, file, graph)
                return
            if left == "this":
                return
            self.arguments(node, method, file, graph)
            found = scopes.find(left, line)
            if found is None:
                if self.origin(left) == "BUILTIN":  # N24
                    self.classify(node, f"{left}.{mid}", name, "builtin")
                return
            self.link(found, node, method, graph)
            if found.original != "this":
                self.on_field(node, mid, name, found)

    def by_qualifier(self, node: int, q: str, name: str, method: int, file: str, graph: Graph) -> None:
        """q.name(): N21 if q is bound, else N22."""
        if q == "this":
            return
        self.arguments(node, method, file, graph)
        found = self.scopes[file].find(q, self.nodes[method][node]["line"])
        if found is not None:
            self.link(found, node, method, graph)
            if found.original != "this":
                self.on_binding(node, name, found, file, graph)
        elif self.origin(q) == "BUILTIN":
            self.state[node].full_name, self.state[node].origin = f"{q}.{name}", "builtin"
            self.classify(node, q, name, "builtin")

    def single(self, node: int, name: str, file: str, graph: Graph) -> None:
        """name()."""
        scopes, state = self.scopes[file], self.state[node]
        found = scopes.find(name, self.line(node))
        if found is None:
            if self.origin(name) == "BUILTIN":
                state.origin = "builtin"
                self.classify(node, name, name, "builtin")
        elif found.type == "FUNCTION_DECLARE" and found.method is not None:
            state.call = "FUNCTION_CALL"
            self.function_calls.add(node)
            target = next((d for d, attrs in reversed(self.out[node]) if "CALL" in attrs), None)
            if target is not None and target != found.method:
                return
            self.inline(node, found.method, scopes, file, graph)
        elif found.type == "FUNCTION_FROM_REQUIRE":
            if found.local:
                self.local_call(node, found.entity, found.function, graph)
                return
            where = self.origin(found.entity)
            if where == "NOT_IN":
                self.missing["third", found.entity, found.function or ""] = None
                return
            kind = "builtin" if where == "BUILTIN" else "third"
            state.full_name, state.origin = found.full_name, kind
            self.classify(node, found.entity, found.function, kind)
        elif found.type == "REQUIRE" and found.entity is not None:
            where = self.origin(found.entity)
            if where != "NOT_IN":
                kind = "builtin" if where == "BUILTIN" else "third"
                state.full_name, state.origin = found.entity, kind
                self.classify(node, found.entity, name if kind == "builtin" else found.entity, kind)

    def inline(self, node: int, target: int, scopes: Scopes, file: str, graph: Graph) -> None:
        """The callee's graph joins; a function that is being walked is not entered again."""
        name = self.methods[target]["name"]
        if scopes.inside(name):
            return
        self.analysed.add(target)
        scopes.chain.append((name, []))
        graph.edge(node, target, ["DDG"])
        sub = self.generate(file, target)
        scopes.chain.pop()
        graph.join(sub)
        self.state[node].graph = sub

    def local_call(self, node: int, entity: str | None, name: str | None, graph: Graph) -> None:
        path = posixpath.normpath(posixpath.join("package", entity or ""))
        path = path if path.endswith(".js") else path + ".js"
        target = self.method_of(name, path) if name else None
        if target is None:
            return
        self.inline(node, target, self.scopes[path], path, graph)
        if self.state[node].graph is not None:
            self.state[node].call = "LOCAL_MODULE_CALL"
            self.local_calls.add(node)

    def on_binding(self, node: int, name: str, found: Binding, file: str, graph: Graph) -> None:
        """A method of a module, or of an object that a call returned."""
        state = self.state[node]
        if found.type == "REQUIRE":
            if found.local:
                self.local_call(node, found.entity, name, graph)
            elif found.builtin or found.third:
                state.origin, state.full_name = "builtin" if found.builtin else "third", f"{found.entity}.{name}"
                self.classify(node, found.entity, name, state.origin)
        elif found.type == "RETURN_OBJECT" and found.full_name is not None:
            if found.right == "third":
                if self.interest(found):
                    self.classify(node, found.full_name, name, "third")
            elif found.right == "builtin":
                self.classify(node, CLASS_OF.get(found.full_name, found.full_name), name, "builtin")

    def on_field(self, node: int, mid: str, name: str, found: Binding) -> None:
        """Q.mid.name() with q bound."""
        state = self.state[node]
        if found.type == "REQUIRE" and not found.local and found.builtin:
            state.origin = "builtin"
            self.classify(node, f"{found.entity}.{mid}", name, "builtin")
        elif found.type == "RETURN_OBJECT" and found.full_name:
            if found.right == "builtin":
                self.classify(node, CLASS_OF.get(found.full_name, found.full_name), f"{mid}.{name}", "builtin")
            elif found.right == "third" and self.interest(found) and self.classify(node, f"{found.full_name}.{mid}", name, "third"):
                state.full_name = f"{found.full_name}.{mid}.{name}"

    @staticmethod
    def interest(found: Binding) -> str | None:
        return next((c for c in found.categories or [] if c in INTEREST), None)

    def arguments(self, node: int, method: int, file: str, graph: Graph) -> None:
        """Edges from where the arguments' names were bound."""
        quiet = ("FUNCTION_DECLARE", "FUNCTION_FROM_REQUIRE")
        for a in self.listed(node, "ARGUMENT", "ARGUMENT_INDEX"):
            attr = self.attr[a]
            names: list[tuple[str, int]] = []
            if attr.get("label") == "CALL" and attr.get("NAME") in ("<operator>.fieldAccess", "<operator>.indexAccess"):
                parts = self.children(a)
                if parts:
                    names = [(self.attr[parts[0]].get("CODE", ""), self.line(parts[0]))]
            elif attr.get("label") == "IDENTIFIER":
                names = [(n.text, self.line(a)) for n in self.tree(attr.get("CODE")).walk() if n.type == "identifier"]
            for name, line in names:
                found = self.scopes[file].find(name, line) if name != "this" else None
                if found is not None and found.type not in quiet:
                    self.link(found, node, method, graph)

    # --- phases

    def phases(self) -> Iterable[tuple[str, int, Graph]]:
        """(phase, method, graph) of install scripts, of the main file, and of what neither reached."""
        programs: set[str] = set()
        for phase, names in (("INSTALL", self.manifest["files"] or []), ("IMPORT", [self.manifest["main"] or "index.js"])):
            self.start_scopes()
            for name in names:
                path = posixpath.normpath(posixpath.join("package", name))
                method = self.method_of(":program", path) if path.endswith(".js") else None
                if method is not None and path not in programs:
                    programs.add(path)
                    self.analysed.add(method)
                    yield phase, method, self.generate(path, method)
        for method, m in self.methods.items():
            if method in self.analysed:
                continue
            self.analysed.add(method)
            file = m["file_name"]
            program = self.method_of(":program", file)
            if program is None:
                continue
            self.start_scopes()
            background, own = self.generate(file, program), self.generate(file, method)
            queue = [h for heads in list(own.into.values()) for h in heads if h not in own.nodes and h in background.nodes]
            own.nodes.update(dict.fromkeys(queue))
            seen: set[int] = set()
            while queue:  # B9
                at = queue.pop()
                if at not in seen:
                    seen.add(at)
                    for h in background.into.get(at, ()):
                        own.nodes[h] = None
                        own.edge(h, at, background.edges[h, at])
                        queue.append(h)
            yield "RUN TIME", method, own


def walk_package(held: dict[str, list[dict]], what: Iterable[str] = WHAT) -> Iterable[dict]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
    w = Walk(held)
    where = {n: (m, x) for m, nodes in w.nodes.items() for n, x in nodes.items()} if "node" in what else {}
    for phase, root, graph in w.phases():
        for n in graph.nodes if "node" in what else ():
            m, x = where[n]
            own = w.state[n].categories
            yield {"phase": phase, "root": root, "what": "node", "node": n, "categories": own, "file": w.methods[m]["file_name"], "line": x["line"], "name": x["name"], "code": x["code"]}
        for (s, d), attrs in graph.edges.items() if "edge" in what else ():
            yield {"phase": phase, "root": root, "what": "edge", "src": s, "dst": d, "attrs": attrs}
    for kind, qualifier, name in w.missing if "miss" in what else ():
        yield {"what": "miss", "kind": kind, "qualifier": qualifier, "name": name}


def behaviour(cpg_nodes: DataFrame, cpg_edges: DataFrame, methods: DataFrame, pdg_nodes: DataFrame, pdg_edges: DataFrame, files: DataFrame, manifests: DataFrame, kb: DataFrame, what: Iterable[str] = WHAT) -> DataFrame:
    """Rows of behaviour graphs, see GRAPHS; what is node, edge or miss, of which only those asked for are written.

    manifests: (package, main, files), files being the .js files that install hooks run. kb: see tessera.operators.kb.
    """
    def head(name: Column) -> Column:
        """A name up to its first dot; a module and a word that names it or something in it have the same."""
        return F.when(name.startswith("."), name).otherwise(F.substring_index(name, ".", 1))

    words = cpg_nodes.select("package", F.explode(F.split(F.concat_ws(" ", F.try_element_at("attr", F.lit("CODE")), F.try_element_at("attr", F.lit("NAME"))), r"[^\w$@/.\-]+")).alias("word"))
    mentioned = words.filter("word != ''").select("package", head(F.col("word")).alias("head")).distinct()
    # of the rows of a function the walk asks for the first one only, and a module's functions are written out once
    first = kb.groupBy("kind", F.col("package").alias("module"), "name").agg(F.min(F.struct("id", "category")).alias("r"))
    base = first.groupBy("module").agg(F.bool_or(F.col("kind") == "builtin").alias("builtin"), F.to_json(F.array_sort(F.collect_list(F.struct("kind", "name", F.coalesce("r.category", F.lit("")).alias("category"))))).alias("functions"))
    modules = base.select("module")
    named = mentioned.join(modules.select("module", head(F.col("module")).alias("head")), "head")
    objects = cpg_nodes.select("package").distinct().crossJoin(F.broadcast(modules.filter(F.col("module").isin(*sorted(set(CLASS_OF.values()))))))  # a handful of modules
    mine = named.select("package", "module").unionByName(objects).distinct().join(base, "module")
    tables = {
        "cpg_nodes": cpg_nodes.select("package", "node_id", "attr"),
        "cpg_edges": cpg_edges.select("package", "src", "dst", "attrs", "seq"),
        "methods": methods.select("package", "method_id", "name", "full_name", "file_name"),
        "pdg_nodes": pdg_nodes.select("package", "method_id", "node_id", "node_type", "name", "code", "line", "seq"),
        "pdg_edges": pdg_edges.select("package", "method_id", "src", "dst", "label", "seq"),
        "files": files.select("package", "path"),
        "manifests": manifests.select("package", "main", "files"),
        "kb": mine.select("package", "module", "builtin", "functions"),
    }
    return by_package(tables, partial(walk_package, what=tuple(what)), GRAPHS)


def described(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (package, phase, root, node, categories, file, line) and edges (.., src, dst, attrs) of behaviour()."""
    nodes = rows.filter("what = 'node'").select("package", "phase", "root", "node", "categories", "file", "line", "name", "code")
    edges = rows.filter("what = 'edge'").select("package", "phase", "root", "src", "dst", "attrs")
    return nodes, edges


def description(category: Column) -> Column:
    """The behaviour class of a category id."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair)), category)
