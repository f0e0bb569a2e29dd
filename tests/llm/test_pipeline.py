from __future__ import annotations

import itertools
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from tests_support import compare
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import encoding, licenses, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, scratch):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF), name)
        left[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    kept = {r["doc_id"] for r in left["quality_classifier"].collect()}
    assert not any(q == 0 for d, q in labels.items() if d in kept)
    texts = [r["text"] for r in left["simhash_near_dedup"].collect()]
    assert len(texts) == len(set(texts))
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert not any(i in r["text"] for r in left["benchmark_decontamination"].collect() for i in items)
    packed = left["best_fit_packing"].collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left["benchmark_decontamination"].collect()}
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


CLASHES = "doc_id long, text string, score double, start long, matches string, k1 long, k2 string, n_words string, n_removed long, kept_text string, found int, component string, __found int, __i int, __h string, __wanted long, n_chars int"


def table_of(spark, rows):
    """Documents with columns whose names every stage uses for something of its own."""
    return spark.createDataFrame([(i, t, 0.5, 7, "m", 3, "k", "w", 4, "kept", 1, "c", 2, 5, "h", 6, len(t or "")) for i, t in rows], CLASHES).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alike(a, b):
    """Within four bits, or five-word shingles of similarity 0.8 or more; both by definition."""
    if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4:
        return True
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words((t or "").lower()) for t in (a, b))]
    return bool(sets[0] and sets[1]) and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def one_of_each(rows):
    """Smallest doc_id of each group (null last, then any), by comparing all pairs."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(rows[i][1], rows[j][1]):
            up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        best[root(i)] = min(best.get(root(i), key), key)
    return Counter(None if none else d for none, d in best.values())


def cut(rows, size=35):
    lists = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + size]) for w in lists for i in range(len(w) - size + 1))
    out = []
    for (d, t), w in zip(rows, lists, strict=True):
        gone = {k for j in range(len(w) - size + 1) if count[tuple(w[j : j + size])] > 1 for k in range(j, j + size)}
        if len(gone) < len(w):
            out.append((d, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return sorted(out, key=repr)


@pytest.fixture()
def planted(awkward):
    """Clean documents, exact and near copies, a shared passage, items of the benchmark, and awkward rows."""
    rng = random.Random(21)
    fresh = lambda n: [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(n)]
    clean = [(100 + i, " ".join(fresh(rng.randrange(60, 150)))) for i in range(25)]
    rows = [*awkward, *clean]
    rows += [(200 + i, clean[i][1]) for i in range(5)] + [(199, clean[7][1])]
    for i in range(5, 10):
        w = clean[i][1].split()
        w[10] = "changed"
        rows.append((200 + i, " ".join(w)))
    passage = fresh(55)
    rows += [(300 + i, " ".join(fresh(40) + passage + fresh(40))) for i in range(6)]
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    rows += [(400 + i, " ".join(fresh(50)) + "\n" + items[i] + "\n" + " ".join(fresh(50))) for i in range(6)]
    return rows


def test_stages_equal_brute_force(spark, scratch, planted):
    docs = table_of(spark, planted)
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        kept = scratch.keep(stage(spark, docs, SF), name)
        assert kept.schema == docs.schema or kept.dtypes == docs.dtypes
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
        rest = kept.drop("doc_id", "text", "n_chars").distinct().collect()
        assert len(rest) <= 1 and all(tuple(r) == (0.5, 7, "m", 3, "k", "w", 4, "kept", 1, "c", 2, 5, "h", 6) for r in rest)
        if name == "quality_classifier":
            model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            score = lambda t: model.score(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
            assert got == sorted((r for r in rows if score(r[1]) >= corpus_pipeline.THRESHOLD), key=repr)
            kept = docs  # the stages after this one get everything
        elif name == "simhash_near_dedup":
            assert Counter(d for d, _ in got) == one_of_each(rows)
        elif name == "substring_dedup":
            assert got == cut(rows)
            assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
        else:
            assert Counter(d for d, _ in got) == Counter(d for d, _ in rows if not 400 <= (d or 0) < 410)
        docs = kept
    ids = Tokenizer.from_file(encoding.default_tokenizer())
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    whole = {}
    for r in sorted(packed, key=lambda r: r["piece"]):
        whole.setdefault(r["doc_id"], []).extend(array("I", bytes(r["ids"])))
    assert whole == {r["doc_id"]: [*ids.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}


def test_stages_of_nothing(spark):
    docs = table_of(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert name == "best_fit_packing" or out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        compare(rows, queries.ORACLE_SQL[name], SF)
        return
    got = rows.collect()
    every = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    if name == "op6_decontamination":
        items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
        assert {(d["doc_id"], i) for d in every for i, t in items.items() if t in (d["text"] or "")} <= {(r["doc_id"], r["item_id"]) for r in got}
    elif name == "op8_chat_formatting":
        assert {r["conv_id"] for r in got} == {r["conv_id"] for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()}
    else:
        assert Counter(r["doc_id"] for r in got if r.asDict().get("piece", 0) == 0) == Counter(d["doc_id"] for d in every)
    texts = {d["doc_id"]: d["text"] or "" for d in every}
    ids = Tokenizer.from_file(encoding.default_tokenizer())
    if name == "op5_simhash":
        assert all(r["fingerprint"] == f"{simhash.fingerprint(texts[r['doc_id']]):016x}" for r in got)
    elif name == "op9_license_scan":
        for r in got:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]]))
            at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
            assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({b for _, b in at})))
            assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
    elif name == "op10_token_files":
        start = 0
        for r in sorted(got, key=lambda r: r["doc_id"]):
            own = array("I", [*ids.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2])
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
            start += len(own)
    elif name == "op2_quality_classifier":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
