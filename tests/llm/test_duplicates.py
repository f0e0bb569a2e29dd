from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import similar, simhash, substrings
from tessera.llm import words as W
from tessera.llm.fm_index import Index, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, near):
    up = list(range(len(values)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components(spark, docs_of, awkward, scratch):
    rows = [*awkward, (20, "Alpha beta gamma delta epsilon"), (21, "alpha beta gamma delta epsilon"), (22, "one two three")]
    got = simhash.near_duplicates(docs_of(rows), scratch).collect()
    assert len(got) == len(rows)
    want = {i: fingerprint(t) for i, t in rows}
    assert all(r["fp"] % 2**64 == want[r["doc_id"]] for r in got)
    ids = [i for i, _ in rows]
    root = groups([want[i] for i in ids], lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, g in zip(ids, root, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, least.get(g)) for i, g in zip(ids, root, strict=True)}
    assert simhash.near_duplicates(docs_of([]), scratch).count() == 0


@pytest.mark.parametrize(("segments", "crowded"), [(3, 256), (2, 256), (4, 256), (3, 2)])
def test_links_lose_nothing(spark, scratch, segments, crowded):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in base for _ in range(20)})
    signed = [v - 2**64 if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.components(simhash.links(nodes, scratch, segments=segments, crowded=crowded), scratch)
    label = {r["node"]: r["label"] for r in found.collect()}
    root = groups(values, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for v, g in zip(signed, root, strict=True):
        least[g] = min(least.get(g, v), v)
    assert [label.get(v, v) for v in signed] == [least[g] for g in root]


def test_long_chains_become_one_component(spark, scratch):
    n = 400
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(pairs, scratch).collect()}
    assert all(got.get(i, i) == 0 for i in range(n + 1)) and got[1001] == 1000


def test_one_of_each_group_stays(spark, docs_of, awkward, scratch):
    kept = simhash.representatives(docs_of(awkward), scratch)
    assert kept.columns == docs_of(awkward).columns
    want, seen = [], set()
    root = groups([fingerprint(t) for _, t in awkward], lambda a, b: (a ^ b).bit_count() <= 4)
    for g in root:
        if g not in seen:
            seen.add(g)
            want.append(min((i for (i, _), h in zip(awkward, root, strict=True) if h == g and i is not None), default=None))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)


def cut(rows, size):
    lists = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + size]) for w in lists for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, lists, strict=True):
        gone = {k for j in range(len(w) - size + 1) if count[tuple(w[j : j + size])] > 1 for k in range(j, j + size)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowded", [8192, 1])
def test_substrings(spark, docs_of, awkward, scratch, crowded):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = list(awkward) + [(100 + n, " ".join([f"{n}a{k}" for k in range(rng.randrange(50))] + passage[rng.randrange(10) : rng.randrange(40, 60)] + [f"{n}b{k}" for k in range(rng.randrange(50))])) for n in range(30)]
    rows += [(200, "la " * 90), (201, " ".join(passage[:35])), (202, " ".join(passage[:34])), (203, " ".join(passage + passage))]
    got = substrings.dedup(docs_of(rows), scratch, crowded=crowded).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=repr) == cut(rows, 35)
    assert substrings.dedup(docs_of([]), scratch).count() == 0


def test_windows_by_index_equal_brute_force():
    rng = random.Random(11)
    for _ in range(30):
        size = rng.choice([5, 9])
        texts = [[rng.randrange(3) for _ in range(rng.randrange(size, size + 9))] for _ in range(rng.randrange(1, 12))]
        distinct = sorted({tuple(t) for t in texts})
        weight = np.array([rng.choice([1, 1, 1, 2]) for _ in distinct])
        count = Counter()
        for t, n in zip(distinct, weight, strict=True):
            for i in range(len(t) - size + 1):
                count[t[i : i + size]] += int(n)
        coded = np.unique([x for t in distinct for x in t], return_inverse=True)[1]
        got = repeated(coded, np.array([len(t) for t in distinct]), weight, size)
        for t, flags in zip(distinct, got, strict=True):
            assert flags.tolist() == [count[t[i : i + size]] > 1 for i in range(len(t) - size + 1)]


def test_occurrences_of_the_tree():
    rng = np.random.default_rng(2)
    for sigma in (1, 2, 3, 9, 300):
        symbols = np.concatenate([np.arange(sigma), np.minimum(sigma - 1, rng.geometric(0.2, 500))])
        index = Index(symbols, sigma, np.ones(len(symbols), np.int64))
        rank = [tuple(symbols[i:].tolist()) for i in range(len(symbols))]
        last = [symbols[i - 1] for i in sorted(range(len(symbols)), key=lambda i: rank[i])]
        at = rng.integers(0, len(symbols) + 1, 200)
        which = rng.integers(0, sigma, 200)
        got = index.occurrences(which, at[None, :])[0]
        assert got.tolist() == [sum(x == c for x in last[:k]) for c, k in zip(which, at, strict=True)]


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [16, 1024, 2048, 4096])
def test_words_that_defeat_polynomial_hashes(docs_of, scratch, n):
    shared = [f"s{i}" for i in range(34)]
    rows = [(1, " ".join([thue_morse(n, "a", "b"), *shared])), (2, " ".join([thue_morse(n, "b", "a"), *shared])), (3, " ".join(shared))]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(docs_of(rows), scratch).collect()}
    assert got == {1: 0, 2: 0, 3: 0}


def test_different_words_with_one_hash_are_told_apart():
    raw = b"some words some more words"
    w = W.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(set(W.codes(w).tolist())) == 3
    w.key[:] = 5
    assert W.codes(w).tolist() == [0, 1, 0, 2, 1]


def test_runs_that_share_a_hash_are_not_passed_over(docs_of, scratch, monkeypatch):
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"a{i}" for i in range(40)))]
    assert [r["n_removed"] for r in substrings.dedup(docs_of(rows), scratch).collect()] == [40, 40]
    spaced = W.words(np.frombuffer(b"a  b c\td e", np.uint8), np.array([0, 10]))
    odd = W.one_spaced(spaced)
    assert [W.passage(spaced, odd, i, j) for i, j in ((0, 2), (1, 3), (2, 4), (3, 5), (0, 5))] == [b"a b", b"b c", b"c d", b"d e", b"a b c d e"]


def test_words_are_those_of_the_pattern():
    texts = ["", " a\tb\x0bc ", "é日 x", "no-space", "a" * 3_000_000 + " b", "\n\n"]
    raw = [t.encode() for t in texts]
    w = W.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        at = w.of(i)
        assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start[at], w.end[at], strict=True)] == WORD.findall(t)
    flat = [x for t in texts for x in WORD.findall(t)]
    same = {}
    for x, k in zip(flat, w.key.tolist(), strict=True):
        assert same.setdefault(x, k) == k
    assert len(set(same.values())) == len(same)
    assert hashlib  # the query's digest is Spark's own


def test_near_duplicates_by_similarity(spark, scratch):
    rng = random.Random(4)
    rows = []
    for n in range(80):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([20, 60, 200, 400]))]
        rows.append(words)
        for _ in range(rng.randrange(3)):  # near copies of all similarities
            copy = list(words)
            for _ in range(rng.choice([1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append(copy)
    rows += [["Few", "words"], ["few", "words"], ["few", "other", "words"]]
    texts = [" ".join(r) for r in rows]
    sets = [{tuple(x.lower().split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))} for x in texts]
    prints = [simhash.fingerprint(t) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 4
    want = {min(g) for g in components_of(len(texts), near)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = simhash.representatives(docs, scratch, similarity=0.8)
    assert {r["doc_id"] for r in got.collect()} == want
    assert simhash.representatives(docs.limit(0), scratch, similarity=0.8).count() == 0


def components_of(n, near):
    found = []
    for i in range(n):
        joined = [g for g in found if any(near(i, j) for j in g)]
        found = [g for g in found if g not in joined] + [{i}.union(*joined)]
    return found


def test_pipeline_drops_similar_documents(spark):
    import corpus_pipeline

    text = [f"w{i}" for i in range(200)]
    copy = [*text[:50], "one", *text[51:120], "two", *text[121:]]  # similarity 186 of 206
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(copy)), (3, " ".join(text[100:] + copy[:50]))], "doc_id long, text string")
    assert (simhash.fingerprint(" ".join(text)) ^ simhash.fingerprint(" ".join(copy))).bit_count() > 4
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == {1, 3}


def test_crowded_groups_lose_no_link(spark, scratch):
    rng = random.Random(23)
    base = [[f"{n}w{i}" for i in range(60)] for n in range(3)]
    texts = []
    for n in range(60):
        w = list(base[n % 3])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = docs.select(F.xxhash64("text").alias("text_hash"), F.col("doc_id").alias("component"))
    label = {}
    for crowded in (4096, 7, 2):
        pairs = similar.links(docs, found, scratch, crowded=crowded)
        label[crowded] = {r["node"]: r["label"] for r in simhash.components(pairs, scratch).collect()}
    assert label[4096] and label[4096] == label[7] == label[2]


@pytest.mark.parametrize("few", [0, 3, 64])
def test_components_of_similar_sets(few):
    rng = random.Random(17)
    for _ in range(60):
        n = rng.randrange(1, 30)
        base = [rng.sample(range(400), 40) for _ in range(3)]
        sets = [np.unique(np.array([x if rng.random() > 0.1 else rng.randrange(400) for x in rng.choice(base)], np.uint64)) for _ in range(n)]
        components = [rng.randrange(12) for _ in range(n)]

        def joined(pairs, components=components):
            up = {c: c for c in components}
            for a, b in pairs:
                low, high = sorted((up[a], up[b]))
                up = {c: low if r == high else r for c, r in up.items()}
            return up

        want = [(components[i], components[j]) for i in range(n) for j in range(i) if similar.similar(sets[i], sets[j], 0.8)]
        assert joined(similar.merged(components, sets, 0.8, few)) == joined(want)
