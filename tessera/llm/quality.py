"""Operator 2, quality classifier: gated attention over the passages of a document.

Each text is cut into passages of PASSAGE words. A passage is encoded by hashed word counts and by shares of
its characters and words (capitals, digits, symbols, line breaks, repeats). A learned layer makes a vector of
it; gated attention, tanh(V h) * sigmoid(U h), weighs the passages of a document; the weighted vector is scored.
Only documents have labels: the passages' weights are learned from them (multiple-instance learning).

Training is in one task, with a bounded sample: at most `most` labelled documents, picked by a hash of their doc_id;
of a text with more than `spread` passages so many teach, spread evenly over it. Scoring is one pass over whole texts
of all documents. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts are one passage without words and get a score like any other; where a
doc_id has several labels the largest counts, null labels don't; where it has several texts the smallest teaches;
without labels every score is 0.5; rows with equal doc_id keep a row each; an empty table gives no rows; input columns
named score are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.worker import lean, trim

PASSAGE, BUCKETS = 64, 256
#: Passages that are encoded at once.
AT_ONCE = 4096
_CLASSES = [range(0x41, 0x5B), range(0x30, 0x3A), b"#*$%&<>", b"|", b"!", b".,;:?", b"\n", range(0x80, 0x100)]
_TABLE = np.zeros((len(_CLASSES), 256), np.uint8)
for _row, _members in zip(_TABLE, _CLASSES, strict=True):
    _row[list(_members)] = 1
STYLE = len(_CLASSES) + 4


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def passages(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First passage of each text, and first and one past the last word of each passage; no words make one passage."""
    per = np.diff(w.first)
    many = np.maximum(1, -(-per // PASSAGE))
    first = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(per)), many)
    low = w.first[text] + (np.arange(first[-1]) - first[text]) * PASSAGE
    return first, low, np.minimum(low + PASSAGE, w.first[text + 1])


def encode(w: W.Words, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word counts (passages x BUCKETS, bytes) and shares (passages x STYLE) of passages of words low to high."""
    total, n = len(low), high - low
    of = np.repeat(np.arange(total), n)
    at = np.arange(len(of)) + np.repeat(low - np.cumsum(n) + n, n)
    key = w.key[at]
    counts = np.bincount(of * BUCKETS + (key % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS).astype(np.uint8)
    start, end, some = np.zeros(total, np.int64), np.zeros(total, np.int64), n > 0
    start[some], end[some] = w.start[low[some]], w.end[high[some] - 1]
    origin = int(start[some].min()) if some.any() else 0
    data = w.data[origin : int(end.max(initial=0))]
    start[some], end[some] = start[some] - origin, end[some] - origin
    style, size, many = np.zeros((total, STYLE), np.float32), np.maximum(1, end - start), np.maximum(1, n)
    for k, row in enumerate(_TABLE):
        sums = np.concatenate([[0], np.cumsum(row[data], dtype=np.int64)])
        style[:, k] = (sums[end] - sums[start]) / size
    again = np.zeros(len(key), np.bool_)
    again[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    style[:, -4] = np.bincount(of, weights=again, minlength=total) / many
    style[:, -3] = (counts > 0).sum(axis=1) / many
    style[:, -2] = (end - start) / many / 10
    style[:, -1] = n / PASSAGE
    return counts, style


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights by name, and the shares' means and deviations."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    deviation: np.ndarray

    def inputs(self, counts: np.ndarray, style: np.ndarray) -> np.ndarray:
        bag = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, dtype=np.float32))[:, None], dtype=np.float32)
        return np.concatenate([bag, np.clip((style - self.mean) / self.deviation, -6, 6)], axis=1).astype(np.float32)

    def hidden(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Passages' vectors, the two factors of their gated attention, and its logits."""
        w = self.weights
        h = np.tanh(x @ w["encode"] + w["shift"])
        tanh, gate = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        return {"h": h, "tanh": tanh, "gate": gate, "logit": (tanh * gate) @ w["a"]}

    def pooled(self, h: np.ndarray, logit: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Attention of the passages, vectors and scores (p) of the documents."""
        starts, docs = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(logit - np.maximum.reduceat(logit, starts)[docs])
        attention = e / np.add.reduceat(e, starts)[docs]
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return {"docs": docs, "attention": attention, "z": z, "p": _sigmoid(z @ self.weights["out"] + self.weights["bias"][0])}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Everything that the backward pass needs."""
        own = self.hidden(x)
        return own | self.pooled(own["h"], own["logit"], first)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, first)
        docs, h, attention = f["docs"], f["h"], f["attention"]
        error = (f["p"] - y) / len(y)
        dz = error[:, None] * w["out"]
        into = (dz[docs] * h).sum(axis=1)
        de = attention * (into - np.add.reduceat(attention * into, first[:-1])[docs])
        dgated = de[:, None] * w["a"]
        dtanh, dgate = dgated * f["gate"] * (1 - f["tanh"] ** 2), dgated * f["tanh"] * f["gate"] * (1 - f["gate"])
        dh = attention[:, None] * dz[docs] + dtanh @ w["v"].T + dgate @ w["u"].T
        dh *= 1 - h**2
        return {"encode": x.T @ dh, "shift": dh.sum(axis=0), "v": h.T @ dtanh, "u": h.T @ dgate, "a": (f["tanh"] * f["gate"]).T @ de, "out": f["z"].T @ error, "bias": np.array([error.sum()])}

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of texts; passages are encoded some at a time, so a long text takes little more than its words do."""
        w = W.words(data, offsets, lower=True)
        first, low, high = passages(w)
        parts = [self.hidden(self.inputs(*encode(w, low[k : k + AT_ONCE], high[k : k + AT_ONCE]))) for k in range(0, len(low), AT_ONCE)]
        return self.pooled(np.concatenate([x["h"] for x in parts]), np.concatenate([x["logit"] for x in parts]), first)["p"]

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, __mean=self.mean, __deviation=self.deviation, **self.weights)
        return out.getvalue()

    @staticmethod
    def unpack(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as z:
            weights = {k: z[k] for k in z.files}
        return Model(weights, weights.pop("__mean"), weights.pop("__deviation"))


def _untrained(hidden: int, attention: int, seed: int) -> Model:
    rng, inputs = np.random.default_rng(seed), BUCKETS + STYLE
    shape = {"encode": (inputs, hidden), "v": (hidden, attention), "u": (hidden, attention), "a": (attention,)}
    weights = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shape.items()}
    weights |= {"shift": np.zeros(hidden, np.float32), "out": np.zeros(hidden, np.float32), "bias": np.zeros(1, np.float32)}
    return Model(weights, np.zeros(STYLE, np.float32), np.ones(STYLE, np.float32))


def fit(counts: np.ndarray, style: np.ndarray, first: np.ndarray, labels: np.ndarray, hidden: int = 24, attention: int = 12, rounds: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of the documents' labels."""
    model = _untrained(hidden, attention, seed)
    if not len(labels):
        return model
    model.mean, model.deviation = style.mean(axis=0), style.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            lengths = first[chosen + 1] - first[chosen]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            rows = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths) + np.repeat(first[chosen], lengths)
            step += 1
            for k, g in model.gradients(model.inputs(counts[rows], style[rows]), ends, labels[chosen]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                model.weights[k] -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * model.weights[k])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6000, spread: int = 256, **how) -> Model:
    """A model from at most `most` labelled documents that are not held out.

    It is fitted in one task of an executor, which holds at most `most` * `spread` passages.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most `most` rows are broadcast
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            data, offsets = W.buffers(b.column("text"))
            for lo, hi in W.runs(offsets):
                w = W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
                first, low, high = passages(w)
                raw = []
                for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    ranges = [(x, y)] if y - x <= spread else [(int(i), int(i) + 1) for i in np.linspace(x, y - 1, spread)]
                    parts = [encode(w, low[i:j], high[i:j]) for i, j in ranges]
                    raw.append(tuple(b"".join(p[k].tobytes() for p in parts) for k in range(2)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo), *(pa.array(v, pa.binary()) for v in zip(*raw, strict=True))], ["doc_id", "y", "counts", "style"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")]).reshape(-1, BUCKETS)
        style = np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in table.column("style")]).reshape(-1, STYLE)
        first = np.concatenate([[0], np.cumsum([len(x.as_py()) // BUCKETS for x in table.column("counts")])]).astype(np.int64)
        model = fit(counts, style, first, table.column("y").to_numpy().astype(np.float32), **how)
        out = pa.table({"model": pa.array([model.pack()], pa.binary())})
        trim()
        return out

    encoded = rows.mapInArrow(run, "doc_id long, y int, counts binary, style binary")
    got = encoded.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "model binary").collect()  # one row of some 30 KB
    return Model.unpack(bytes(got[0]["model"])) if got else fit(np.zeros((0, BUCKETS), np.uint8), np.zeros((0, STYLE), np.float32), np.zeros(1, np.int64), np.zeros(0, np.float32), **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with their score, 0 to 1, the higher the likelier the label 1."""
    columns = [c for c in docs.columns if c != "score"]
    schema = docs.select(columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            data, offsets = W.buffers(b.column("text"))
            out = [model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in W.runs(offsets)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out).astype(np.float64) if out else np.zeros(0))], [*b.schema.names, "score"])

    return docs.select(columns).mapInArrow(run, schema.add("score", "double"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, text, held_out, score, predicted) of each document."""
    model = train(docs, labels)
    out = score(docs.select("doc_id", F.col("text").cast("string")), model)
    return out.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
