"""Operator 8, chat formatting: roles of a transcript's lines by a hidden Markov model.

A transcript is plain text: turns of some speakers, with or without markers such as "User:" or "### Assistant".
Each line gives three observations: the kind of its speaker marker, whether a blank line stands before it, and its
shape (length, question mark). States are (role, first or later line of a turn). Viterbi finds the likeliest states;
turns are read off and rendered in one canonical form.

Start, transition and observation probabilities are smoothed counts over labelled transcripts, counted by Spark;
the driver sees the counts only, a few hundred numbers.

Long conversations come in blocks, so no task holds a whole one, and are parsed as wholes all the same: each block gives
the best score between each state before it and each state at its end; a conversation's blocks, a small matrix each,
are chained in order; then each block is parsed between the states that the likeliest path has at its edges. The
rendered blocks, one after another, are the rendered conversation.

Defined results: null and empty texts have no turns; lines before any turn belong to the first; memory is linear in
a text's lines; rows with equal id are parsed each (conv_id and block must be unique where blocks are chained); roles
other than the known ones, and null ones, are `other`; of equally likely paths any one is taken; an empty table gives no rows; without training data a built-in
table of markers decides; input columns named like the result's are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool", "other")
# Speaker markers by role, lower case.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "q", "question", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent"),
    "tool": ("tool", "function", "observation", "result"),
}
_KIND = {m: role for role, names in MARKERS.items() for m in names}
_MARKER = re.compile(r"\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?([A-Za-z]{1,12})(?:\|?>|\]|\*\*)?\s*([:>\-]|$)\s*")
STATES = [(role, first) for role in ROLES for first in (True, False)]
KINDS = ("marker", "gap", "shape")


def read_line(line: str, after_blank: bool) -> tuple[str, str, str, str]:
    """Marker kind, blank line before, shape; and the line without the marker of a known speaker."""
    m = _MARKER.match(line)
    kind = _KIND.get(m[1].lower(), "other" if m[2] else "none") if m else "none"  # a bare word marks a known speaker only
    rest = line[m.end() :] if m and kind in MARKERS else line
    size = len(rest)
    shape = ("short" if size < 40 else "medium" if size < 200 else "long") + ("?" if rest.rstrip().endswith("?") else "")
    return kind, "blank" if after_blank else "tight", shape, rest


def lines_of(text: str | None, goes_on: bool = False) -> list[tuple[str, str, str, str]]:
    """Observations of the lines that hold something. goes_on: the text begins where a line before it ends."""
    out, blank = [], False
    for line in (text or "").split("\n")[1 if goes_on else 0 :]:
        if line.strip():
            out.append(read_line(line, blank))
            blank = False
        else:
            blank = True
    return out


@dataclass
class Model:
    """Logarithms of probabilities, by number of the state."""

    start: np.ndarray
    step: np.ndarray
    see: dict[str, np.ndarray]
    _seen: dict[tuple[str, str, str], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of_counts(counts: dict[tuple[str, str, str], int]) -> Model:
        """From counts of ('start', state, ''), ('step', state, state) and ('see', state, observation)."""
        n = len(STATES)
        seen = sorted({b for what, _, b in counts if what == "see"} | {f"marker:{k}" for k in (*ROLES, "none")})
        out = Model(np.zeros(n), np.zeros((n, n)), {o: np.zeros(n) for o in seen})
        by_kind = {k: [o for o in seen if o.split(":")[0] == k] for k in {o.split(":")[0] for o in seen}}
        total = sum(counts.get(("start", str(i), ""), 0) for i in range(n))
        for i, (role, first) in enumerate(STATES):
            rare = 0.01 if role in ("tool", "other") else 1.0  # what no count speaks for
            out.start[i] = math.log((counts.get(("start", str(i), ""), 0) + (rare if first else 1e-6)) / (total + n))
            row = sum(counts.get(("step", str(i), str(j)), 0) for j in range(n))
            for j, (other, begins) in enumerate(STATES):
                allowed = begins or other == role
                prior = 0.5 * (0.01 if other in ("tool", "other") and other != role else 1.0) if allowed else 1e-9
                out.step[i, j] = math.log((counts.get(("step", str(i), str(j)), 0) + prior) / (row + n))
            for kind, names in by_kind.items():
                hits = sum(counts.get(("see", str(i), o), 0) for o in names)
                for o in names:
                    prior = 0.1
                    if kind == "marker":  # what the markers say, as a few pseudo-counts
                        own = f"marker:{role}" if first else "marker:none"
                        prior = 4.0 if o == own else 1e-6 if o.split(":")[1] in MARKERS else 0.5
                    out.see[o][i] = math.log((counts.get(("see", str(i), o), 0) + prior) / (hits + 1 + len(names)))
        return out

    def seen(self, line: tuple[str, str, str, str]) -> np.ndarray:
        x = line[:3]
        if x not in self._seen:
            unknown = np.full(len(STATES), -8.0)
            self._seen[x] = sum(self.see.get(f"{k}:{v}", unknown) for k, v in zip(KINDS, x, strict=True))
        return self._seen[x]

    def states(self, lines: list[tuple[str, str, str, str]], before: int | None = None, last: int | None = None) -> list[int]:
        """Viterbi: the likeliest state of each line, between the state before the first line and that of the last, if known."""
        if not lines:
            return []
        score, back, every = (self.start if before is None else self.step[before]) + self.seen(lines[0]), [], np.arange(len(STATES))
        for x in lines[1:]:
            paths = score[:, None] + self.step
            came = paths.argmax(axis=0)
            score = paths[came, every] + self.seen(x)
            back.append(came.astype(np.uint8))
        at = int(score.argmax()) if last is None else last
        out = [at]
        for came in reversed(back):
            at = int(came[at])
            out.append(at)
        return out[::-1]

    def passage(self, lines: list[tuple[str, str, str, str]]) -> np.ndarray:
        """Best score from each state before the lines (the last row: from the start) to each state of the last line."""
        score = np.vstack([self.step, self.start]) + self.seen(lines[0])
        for x in lines[1:]:
            score = (score[:, :, None] + self.step[None]).max(axis=1) + self.seen(x)
        return score

    def segments(self, text: str | None, goes_on: bool = False, before: int | None = None, last: int | None = None) -> list[tuple[str, str, bool]]:
        """(role, text, whether it begins a turn) of what a text holds of each turn."""
        lines = lines_of(text, goes_on)
        out: list[tuple[str, list[str], bool]] = []
        for (_, _, _, rest), s in zip(lines, self.states(lines, before, last), strict=True):
            role, first = STATES[s]
            if first or not out:
                out.append((role, [rest] if rest else [], first or before is None))
            elif rest:
                out[-1][1].append(rest)
        return [(role, "\n".join(body), begins) for role, body, begins in out]

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        return [(role, body) for role, body, _ in self.segments(text)]


def render(segments: list[tuple[str, str, bool]], is_open: bool = False, closes: bool = True) -> str:
    """The canonical form. is_open: a turn goes on from before; closes: nothing comes after."""
    out = []
    for role, body, begins in segments:
        if begins:
            out.append(("<|end|>\n" if is_open else "") + f"<|{role}|>\n")
        if body:
            out.append(f"{body}\n")
        is_open = True
    return "".join(out) + ("<|end|>\n" if is_open and closes else "")


def transcripts(conversations: DataFrame, block: int = 512) -> DataFrame:
    """(conv_id, block, style, roles, lengths, text): plain transcripts of labelled turns, in six styles of markers.

    Styles 0 to 2 mark every turn, 3 three turns in four, 4 none, 5 in changing ways and without blank lines between turns.
    Long conversations are cut every `block` turns; a later block begins with what parts it from the one before, so
    the blocks' texts, one after another, are the whole. lengths: lines of each turn.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    names = F.create_map(*(F.lit(x) for role, name in (("user", "User"), ("assistant", "Assistant"), ("system", "System"), ("tool", "Tool"), ("other", "Guest")) for x in (role, name)))
    short = F.create_map(*(F.lit(x) for role, name in (("user", "Q"), ("assistant", "A"), ("system", "Context"), ("tool", "Result"), ("other", "Guest")) for x in (role, name)))
    body = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\n\s*\n+", "\n")
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("other")
    dice = F.pmod(F.xxhash64("turn"), F.lit(4))
    ways = [F.concat(names[role], F.lit(": "), body), F.concat(F.lit("### "), names[role], F.lit("\n"), body), F.concat(short[role], F.lit(": "), body), F.concat(F.lit("["), names[role], F.lit("]: "), body)]
    marked = F.when(style < 3, F.get(F.array(*ways), style.cast("int"))).when(style == 3, F.when(dice == 0, body).otherwise(ways[3])).when(style == 4, body).otherwise(F.get(F.array(*ways), dice.cast("int")))
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), role.alias("role"), F.regexp_replace(marked, r"\n+$", "").alias("text"))
    part = F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(0)) / block).alias("block")
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), part, style.alias("style"), turn.alias("t")).groupBy("conv_id", "block", "style").agg(F.array_sort(F.collect_list("t")).alias("t"))
    joint = F.when(F.col("style") == 5, F.lit("\n")).otherwise(F.lit("\n\n"))
    lengths = F.transform("t", lambda x: F.size(F.filter(F.split(x["text"], "\n"), lambda y: y.rlike(r"\S"))))
    texts = F.when(F.col("style") == 5, F.array_join(F.col("t.text"), "\n")).otherwise(F.array_join(F.col("t.text"), "\n\n"))
    return grouped.select("conv_id", "block", "style", F.col("t.role").alias("roles"), lengths.alias("lengths"), F.concat(F.when(F.col("block") > 0, joint).otherwise(""), texts).alias("text"))


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string")) % 5 == 0, F.lit(False))


def train(labelled: DataFrame) -> Model:
    """labelled: as transcripts() returns them; every row counts. Steps from block to block aren't counted."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: i for i, s in enumerate(STATES)}
        total: dict[tuple[str, str, str], int] = {}

        def add(*key: str) -> None:
            total[key] = total.get(key, 0) + 1

        for b in rows:
            for block, text, roles, lengths in zip(*(b.column(c).to_pylist() for c in ("block", "text", "roles", "lengths")), strict=True):
                states = [index[r, k == 0] for r, n in zip(roles, lengths, strict=True) for k in range(n)]
                lines = lines_of(text, block > 0)
                if len(states) != len(lines) or not states:
                    continue  # a transcript whose lines don't add up teaches nothing
                if block == 0:
                    add("start", str(states[0]), "")
                for i, j in zip(states, states[1:], strict=False):
                    add("step", str(i), str(j))
                for i, x in zip(states, lines, strict=True):
                    for k, v in zip(KINDS, x, strict=False):
                        add("see", str(i), f"{k}:{v}")
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([total[k] for k in keys], pa.int64())], ["what", "a", "b", "n"])

    got = labelled.select("block", "text", "roles", "lengths").mapInArrow(count, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()  # a few hundred rows
    return Model.of_counts({(r["what"], r["a"], r["b"]): r["n"] for r in got})


_EDGES = "before int, last int, goes_on boolean, closes boolean"
_OUT = ("found_roles", "n_turns", "rendered")


def _parse(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a struct column __edges of _EDGES, parsed between them."""
    columns = [c for c in docs.columns if c not in (*_OUT, "__edges")]
    schema = docs.select(columns).schema.add("found_roles", "string").add("n_turns", "long").add("rendered", "string")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found, n, rendered = [], [], []
            for text, edges in zip(b.column("text"), b.column("__edges").to_pylist(), strict=True):
                e = edges or {"before": None, "last": None, "goes_on": False, "closes": True}
                parts = model.segments(text.as_py(), e["goes_on"], e["before"], e["last"])
                roles = [role for role, _, begins in parts if begins]
                found.append(",".join(roles))
                n.append(len(roles))
                rendered.append(render(parts, e["before"] is not None, e["closes"]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(found, pa.string()), pa.array(n, pa.int64()), pa.array(rendered, pa.string())], [*columns, *_OUT])

    return docs.select(*columns, "__edges").mapInArrow(run, schema)


def parse(docs: DataFrame, model: Model) -> DataFrame:
    """The transcripts (column text), each a whole, with found_roles, n_turns and rendered."""
    return _parse(docs.withColumn("__edges", F.lit(None).cast("struct<before:int,last:int,goes_on:boolean,closes:boolean>")), model)


def chained(docs: DataFrame, model: Model) -> DataFrame:
    """(conv_id, block, before, last, goes_on, closes) of the blocks of conversations that have several."""
    n = len(STATES)
    several = docs.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("__c"))
    blocks = docs.join(several, F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi").select("conv_id", "block", "text")

    def matrices(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            lines = [lines_of(t.as_py(), k.as_py() > 0) for t, k in zip(b.column("text"), b.column("block"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array([model.passage(x).tobytes() if x else None for x in lines], pa.binary())], ["conv_id", "block", "m"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        own = [None if m is None else np.frombuffer(m).reshape(n + 1, n) for m in table.column("m").to_pylist()]
        score, came = None, []  # of each block with lines: the state before it, for each state at its end
        for m in own:
            if m is None:
                came.append(None)
            elif score is None:
                score = m[n]
                came.append(np.full(n, -1))
            else:
                paths = score[:, None] + m[:n]
                came.append(paths.argmax(axis=0))
                score = paths.max(axis=0)
        at = -1 if score is None else int(score.argmax())
        before, last = [0] * len(own), [0] * len(own)
        for k in reversed(range(len(own))):
            last[k] = at
            at = at if came[k] is None else int(came[k][at])
            before[k] = at
        none = [[None if x < 0 else x for x in v] for v in (before, last)]
        closes = [k == len(own) - 1 for k in range(len(own))]
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "before": pa.array(none[0], pa.int32()), "last": pa.array(none[1], pa.int32()), "goes_on": pa.array([k > 0 for k in table.column("block").to_pylist()]), "closes": pa.array(closes)})

    return blocks.mapInArrow(matrices, "conv_id long, block long, m binary").groupBy("conv_id").applyInArrow(chain, f"conv_id long, block long, {_EDGES}")


def parse_conversations(docs: DataFrame, model: Model) -> DataFrame:
    """Blocks of conversations (conv_id, block, text) with found_roles, n_turns and rendered; each conversation is parsed as a whole.

    A block's found_roles and n_turns are of the turns that begin in it.
    """
    edges = chained(docs, model).select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), F.struct("before", "last", "goes_on", "closes").alias("__edges"))
    rows = docs.join(edges, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b")), "left").drop("__c", "__b")
    alone = F.struct(F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("last"), (F.col("block") > 0).alias("goes_on"), F.lit(True).alias("closes"))
    return _parse(rows.withColumn("__edges", F.coalesce("__edges", alone)), model)
