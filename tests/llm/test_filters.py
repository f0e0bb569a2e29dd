from __future__ import annotations

import itertools
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, licenses, quality, rules, warc
from tessera.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).drop("text").collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(got[d]["predicted"], q) for d, q in known.items() if got[d]["held_out"]]
    assert len(got) == docs.count() and sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_quality_of_awkward_rows(spark, docs_of, awkward):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (4, 0)], "doc_id long, quality int")
    got = quality.quality(docs_of(awkward), labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in awkward) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.quality(docs_of(awkward), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality(docs_of([]), labels).count() == 0
    model = quality.train(docs_of(awkward), labels)
    assert quality.score(docs_of(awkward), model).columns.count("score") == 1


def base_rules(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_rules(spark, docs_of, awkward):
    rng = random.Random(2)
    rows = [*awkward, *((100 + n, " ".join(rng.choice("abc#") + rng.choice(["", "\n", "|"]) for _ in range(rng.randrange(90)))) for n in range(40))]
    got = rules.assess(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = {i: base_rules(t) for i, t in rows}
    for r in got:
        n, _, _, _, again = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n) and not (r["base_failed"] and r["kept"])
    assert rules.assess(docs_of([])).count() == 0


def test_rules_survive_hash_clashes(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randrange(12))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, w array<string>")
    few = lambda *c: F.pmod(F.xxhash64(*c), F.lit(2))
    got = {r["i"]: r["n"] for r in df.select("i", rules.repeat_words(F.col("w"), few).alias("n")).collect()}
    assert got == {i: base_rules(" ".join(w))[4] for i, w in rows}


def test_licenses(spark, docs_of, awkward):
    rows = [*awkward, (50, "Released under the MIT License. mit-license"), (51, "Licensed under the Apache License, Version 2.0."), (52, "the general public licence"), (53, "Licensed under CC BY-NC 4.0."), (54, "smit license x mit licenses"), (55, "This work is licensed under the GNU General Public License, version 3.")]
    rows.append((56, "redistribution and use in source or binary forms with modification are permitted"))
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(rows)).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows:
        w = pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places, own = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            own |= {label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)))
        assert own <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[51]["labels"] == "apache,apache-2.0" and got[53]["labels"] == "cc-by-nc-4.0" and got[55]["labels"] == "gpl,gpl-3.0" and got[52]["labels"] == "" and got[56]["labels"] == ""
    assert licenses.scan(docs_of([])).count() == 0


def test_decontamination_recall(spark, scratch):
    docs, items = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    want = {(d["doc_id"], b["item_id"]) for b in items for d in docs if b["text"] in d["text"]}
    rng = random.Random(1)
    planted = []  # paraphrases: one word in eight changed
    for n, b in enumerate(items):
        w = [x if rng.random() > 0.125 else f"changed{k}" for k, x in enumerate(b["text"].split())]
        planted.append((10_000 + n, "Something else stands here first. " + " ".join(w) + " And after it more text follows."))
        want.add((10_000 + n, b["item_id"]))
    rows = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs] + planted, "doc_id long, text string")
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{SF}/benchmark.parquet"), scratch)
    got = {(r["doc_id"], m["item_id"]) for r in found.collect() for m in r["matches"]}
    assert len(want & got) / len(want) >= 0.9 and len(got - want) <= 0.02 * len(docs)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_recall_of_paraphrases_alone(spark, scratch):
    items = pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist()
    around = [t.split() for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    rng, rows, own = random.Random(6), [], {}
    for n, b in enumerate(items):
        for way, share in enumerate((0.125, 0.2, 0.25)):
            w = []
            for x in b["text"].split():
                dice = rng.random()
                w += [x] if dice > share else [] if dice < share / 4 else ["other", x] if dice < share / 3 else [f"changed{rng.randrange(10**6)}"]
            i, frame = 10 * n + way, around[(n + way) % len(around)]
            at = rng.randrange(len(frame) + 1)
            rows.append((i, " ".join([*frame[:at], *w, *frame[at:]])))
            own[i] = (b["item_id"], plain(b["text"]), plain(" ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["matches"] for r in decontaminate.decontaminate(docs, spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet"), scratch).collect()}
    due = [i for i, (_, item, text) in own.items() if lcs(item, text) >= 0.7 * len(item)]
    assert len(due) > 400
    assert sum(own[i][0] in {m["item_id"] for m in found[i]} for i in due) >= 0.97 * len(due)
    words = {b["item_id"]: plain(b["text"]) for b in items}
    texts = {i: plain(t) for i, t in rows}
    for i in rng.sample(sorted(texts), 60):
        assert all(lcs(words[m["item_id"]], texts[i]) >= 0.7 * len(words[m["item_id"]]) for m in found[i])


def test_decontamination_of_many_items(spark, scratch):
    rng = random.Random(3)
    texts = [t.split() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    words = [w for t in texts for w in t]
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.choice([15, 18, 25])))) for n in range(4000)]
    rows = []
    for n, t in items[:900]:
        around = texts[n % len(texts)]
        at = rng.randrange(len(around))
        rows.append((n, " ".join([*around[:at], t, *around[at:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), scratch).collect()
    lost = [r["doc_id"] for r in found if r["doc_id"] not in {m["item_id"] for m in r["matches"] if m["lcs"] == 1}]
    assert lost == []  # whatever their cosine


@pytest.mark.parametrize("cosine", [0.5, 2.0])
def test_found_items_do_not_depend_on_the_space(spark, scratch, cosine):
    """equal to comparing every window with every item, also where no cosine is high enough."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(300)]
    items = [(n, " ".join(rng.choice(common) if rng.random() < 0.6 else f"r{n}x{k}" for k in range(rng.choice([12, 20, 33])))) for n in range(30)]
    rows = []
    for n, t in items:
        for way in range(12):  # words of the item with others between them, over up to thrice its length
            spread = [x for word in t.split() for x in [*rng.choices(common, k=rng.randrange(way % 4 + 1) if rng.random() < 0.9 else 9), word] if x != word or rng.random() < 0.85]
            rows.append((100 * n + way, " ".join([*rng.choices(common, k=rng.randrange(120)), *spread, *rng.choices(common, k=rng.randrange(120))])))
    want = {}
    for i, text in rows:
        key = text.split()
        for n, t in items:
            item = t.split()
            if len(set(item) & set(key)) < 0.4 * len(set(item)):
                continue
            best = max(lcs(item, key[max(0, at - len(item)) : at + 32 + len(item)]) for at in range(0, len(key), 16)) / len(item)
            if best >= 0.7:
                want[i, n] = round(best, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), scratch, cosine=cosine, sample_documents=1).collect()
    assert len(want) > 100
    assert {(r["doc_id"], m["item_id"]): round(m["lcs"], 9) for r in found for m in r["matches"]} == want


def test_the_space_is_fitted_on_all_documents_and_items(spark, scratch, monkeypatch):
    """it was fitted on about 2000 documents, and on one block of the items."""
    inner, given = decontaminate.singular_space, []
    monkeypatch.setattr(decontaminate, "singular_space", lambda docs, windows, items, own, *rest: given.append((docs.count(), windows, items.count(), own)) or inner(docs, windows, items, own, *rest))
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("some "), F.col("id"), F.lit(" words")).alias("text"))
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(40))) for n in range(10)] + [(10, "too short")], "item_id long, text string")
    decontaminate.decontaminate(docs, items, scratch, block=4).count()
    assert given == [(2500, 2500, 11, 20)]  # windows of 32 words, every 16


def test_products_of_windows_equal_the_plain_ones():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 500) for n in (0, 1, 3, 15, 16, 17, 31, 32, 33, 48, 700, 2000, 4)]
    raw = [t.encode() for t in texts]
    w = decontaminate._words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    idf = rng.random(decontaminate.DIMENSIONS).astype(np.float32) + 0.05
    basis = rng.standard_normal((decontaminate.DIMENSIONS, 6)).astype(np.float32)
    total, want = np.zeros_like(basis), np.zeros(basis.shape)
    decontaminate.gram(w, 4, idf, decontaminate._projection(basis, idf), total)
    for i in range(len(texts)):
        for window in decontaminate._windows(w.key[w.of(i)]) if len(w.key[w.of(i)]) >= 4 else []:
            dims = decontaminate._dims(window)
            values = idf[dims] / np.sqrt((idf[dims].astype(float) ** 2).sum())
            np.add.at(want, dims, values[:, None] * (basis[dims] * values[:, None]).sum(axis=0))
    assert np.abs(total * idf[:, None] - want).max() < 1e-4 * np.abs(want).max()


def test_the_fit_finds_no_words_again(spark, docs_of, awkward, scratch, monkeypatch):
    """each pass of the fit read the texts and found their words again."""
    inner, given = decontaminate.singular_space, []
    monkeypatch.setattr(decontaminate, "singular_space", lambda docs, *rest: given.append((docs.columns, docs.inputFiles())) or inner(docs, *rest))
    docs = docs_of([*awkward, (90, "one two three four five six seven"), (91, "word " * 300_000)])
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    found = decontaminate.decontaminate(docs, items, scratch).collect()
    assert [r["doc_id"] for r in found if r["matches"]] == [90]
    (columns, files), texts = given[0], [r["text"] or "" for r in docs.collect()]
    assert columns == ["dims"] and files and all(scratch.root.removeprefix("file:").lstrip("/") in f for f in files)
    words = decontaminate.coded(docs)
    want = [decontaminate._dims(decontaminate._keys(t)) for t in texts]
    assert sorted(np.frombuffer(r["dims"], "<u2").tolist() for r in words.collect()) == sorted(w.tolist() for w in want)
    frequency, n, windows = decontaminate.frequencies(words, 4)
    assert n == len(texts) and windows == sum(len(decontaminate._windows(w)) for w in want if len(w) >= 4)
    assert frequency.tolist() == sum(np.bincount(np.unique(w), minlength=decontaminate.DIMENSIONS) for w in want).tolist()


def test_rounds_of_the_fit_are_cleared_away(spark, docs_of, scratch, monkeypatch):
    """on check_h the matrices of three rounds stayed on disk."""
    inner, cleared = decontaminate.slim, []
    monkeypatch.setattr(decontaminate, "slim", lambda session: cleared.append(inner(session)))
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    found = decontaminate.decontaminate(docs_of([(1, "so one two three four five six seven"), (2, "no")]), items, scratch, rounds=4)
    assert len(cleared) == 4 and [r["doc_id"] for r in found.collect() if r["matches"]] == [1]


def test_sums_copy_few_rows_at_once():
    """a row of the basis was copied for each word."""
    rng = np.random.default_rng(3)
    counts = np.concatenate([rng.integers(1, 40, 3000), [1, 16, 17, 256, 257, 70_000, 1]])
    values, rows = rng.standard_normal((5000, 80), np.float32), rng.integers(0, 5000, counts.sum())
    tracemalloc.start()
    got = decontaminate._sums(values, rows, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.add.reduceat(values[rows].astype(float), np.cumsum(counts) - counts)
    assert np.abs(got - want).max() < 1e-4 * np.abs(want).max() and peak < len(rows) * 80 * 4 / 2


def test_decontamination_without_the_last_sentence(spark, docs_of, scratch):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa."
    items = spark.createDataFrame([(1, f"{text} Lambda.", None), (2, f"{text} Lambda.", "Lambda")], "item_id long, text string, answer string")
    got = decontaminate.decontaminate(docs_of([(1, f"so {text}"), (2, f"so {text} Lambda")]), items, scratch).collect()
    assert {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in got} == {1: {1}, 2: {1, 2}}


@pytest.mark.parametrize("block", [4096, 2])
def test_decontamination_of_awkward_rows(spark, docs_of, awkward, scratch, block):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta. iota kappa", None), (2, None, None), (3, "short", None), (1, "alpha beta gamma delta epsilon zeta eta theta. iota kappa", None), (4, "one two three four five six seven eight", "nine ten")], "item_id long, text string, answer string")
    rows = [*awkward, (60, "so Alpha beta, gamma delta epsilon zeta eta theta. Iota kappa!"), (61, "one two three four five six seven eight"), (62, "one two three four five six seven eight nine ten")]
    got = {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in decontaminate.decontaminate(docs_of(rows), items, scratch, block=block).collect()}
    assert got[60] == {1} and got[61] == set() and got[62] == {4} and not any(v for k, v in got.items() if k not in (60, 61, 62))
    assert decontaminate.decontaminate(docs_of([]), items, scratch).count() == 0
    assert all(r["matches"] == [] for r in decontaminate.decontaminate(docs_of(rows), items.limit(0), scratch).collect())


def test_common_subsequences():
    import numpy as np

    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common(decontaminate.masks_of(np.array(a, np.uint64)), len(a), b) == best[-1][-1]


REC = "record_id long, url string, time long, kind string, headers map<string,string>, payload_digest string"


def test_revisits(spark):
    rng = random.Random(6)
    urls = ["http://A.example/x/", "https://www.a.example/x?utm_a=1#z", "http://b.example/?b=2&a=1", "http://b.example?a=1&b=2", None]
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit"])
        headers = rng.choice([{"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "content-length": str(i)}, {"last-modified": rng.choice("ab")}, {}])
        rows.append((i, rng.choice(urls), rng.choice([None, *range(40)]), kind, headers, rng.choice([None, "d", "e"])))
    df = spark.createDataFrame(rows, REC)
    canon = {r["url"]: r["c"] for r in df.select("url", warc.canonical_url(F.col("url")).alias("c")).distinct().collect()}
    assert canon[urls[0]] == canon[urls[1]] == "a.example/x" and canon[urls[2]] == canon[urls[3]] == "b.example?a=1&b=2"
    for slices in (64, 1, 4):
        got = {r["record_id"]: r for r in warc.resolve(df, slices).collect()}
        assert len(got) == sum(r[3] == "revisit" for r in rows)
        for i, url, t, kind, headers, digest in rows:
            if kind != "revisit":
                continue
            before = [(s[2], s[0], s) for s in rows if s[3] == "response" and url and s[1] and canon[s[1]] == canon[url] and t is not None and s[2] is not None and s[2] < t]
            base = max(before, key=lambda s: s[:2])[2] if before else None
            assert got[i]["response_id"] == (base[0] if base else None)
            if base is None:
                want = "no_response"
            elif "etag" in headers:
                want = "resolved" if headers["etag"].removeprefix("W/") == (base[4].get("etag") or "").removeprefix("W/") else "mismatch"
            elif "last-modified" in headers:
                want = "resolved" if headers["last-modified"] == base[4].get("last-modified") else "mismatch"
            elif digest is None:
                want = "no_validator"
            else:
                want = "resolved" if digest == base[5] else "mismatch"
            assert got[i]["outcome"] == want
            if want == "resolved":
                assert got[i]["headers"] == base[4] | {k: v for k, v in headers.items() if k != "content-length"} and got[i]["payload_digest"] == base[5]
    assert warc.resolve(df.limit(0)).count() == 0


def whole(spark, rows, block):
    """Texts and results of conversations given in blocks, put together again."""
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.transcripts(talks, block).withColumn("rendered", F.lit("clash")).withColumn("found_roles", F.lit(1))
    got = sorted(chat.parse_conversations(made, UNEVEN).collect(), key=lambda r: (r["conv_id"] or -1, r["block"]))
    out = {}
    for r in got:
        text, rendered, roles, n = out.get(r["conv_id"], ("", "", [], 0))
        out[r["conv_id"]] = text + r["text"], rendered + r["rendered"], roles + [x for x in r["found_roles"].split(",") if x], n + r["n_turns"]
    return out


MODEL, UNEVEN = chat.Model.of_counts({}), chat.Model.of_counts({})
UNEVEN.step += np.random.default_rng(1).random(UNEVEN.step.shape) / 100  # no two paths are equally likely
UNEVEN.start += np.random.default_rng(2).random(UNEVEN.start.shape) / 100


def test_blocks_are_parsed_as_wholes(spark):
    rng = random.Random(8)
    bodies = ["yes", "well?", "x " * 30, "a line\nand another", "", None, "long " * 60]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "critic", None]), rng.choice(bodies)) for c in range(40) for t in range(rng.randrange(1, 12))]
    rows += [(None, 0, "user", "z"), (None, 1, "assistant", "y")] + [(99, t, "user" if t % 2 else "assistant", "so") for t in range(1300)]
    once = whole(spark, rows, 10_000)
    for block in (1, 3, 512):
        assert whole(spark, rows, block) == once
    assert once[99][3] == 1300


def test_the_likeliest_states():
    rng = random.Random(9)
    for _ in range(20):
        lines = [(rng.choice([*chat.ROLES, "none"]), rng.choice(["blank", "tight"]), "short", "") for _ in range(rng.randrange(1, 5))]

        def score(path, lines=lines):
            return MODEL.start[path[0]] + sum(MODEL.step[i, j] for i, j in zip(path, path[1:], strict=False)) + sum(MODEL.seen(x)[i] for i, x in zip(path, lines, strict=True))

        best = max(score(p) for p in itertools.product(range(len(chat.STATES)), repeat=len(lines)))
        assert abs(score(MODEL.states(lines)) - best) < 1e-9
        assert abs(MODEL.passage(lines)[-1].max() - best) < 1e-9


def test_chat(spark):
    talks = spark.createDataFrame([(1, 0, "user", "Hi there\nhow are you?"), (1, 1, "assistant", "Fine."), (1, 1, "assistant", "Fine."), (2, 0, None, None), (3, 0, "system", "Be short."), (3, 1, "user", "x"), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    made = chat.transcripts(talks)
    assert made.count() == 4 and {tuple(r["roles"]) for r in made.collect()} == {("user", "assistant", "assistant"), ("other",), ("system", "user"), ("user",)}
    real = chat.transcripts(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    model = chat.train(real.filter(~chat.held_out(F.col("conv_id"))))
    held = chat.parse_conversations(real.filter(chat.held_out(F.col("conv_id"))), model).collect()
    right = {k: [r["found_roles"] == ",".join(r["roles"]) for r in held if r["style"] == k] for k in range(6)}
    assert all(sum(v) / len(v) >= 0.95 for k, v in right.items() if k in (0, 1, 2, 5))
    assert all(sum(v) / len(v) >= 0.8 for v in right.values())
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "User: hi\n\nBot: yes\nmore"), (4, "### Assistant\nhello"), (5, "Q: a?\nA: b\n" * 5000), (6, "Tool: 3\nAnswer: ok")], "id int, text string").withColumn("n_turns", F.lit("clash"))
    got = {r["id"]: r for r in chat.parse(texts, model).collect()}
    assert got[1]["n_turns"] == got[2]["n_turns"] == 0 and got[3]["rendered"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\nmore\n<|end|>\n"
    assert got[4]["found_roles"] == "assistant" and got[5]["n_turns"] == 10_000 and got[6]["found_roles"] == "tool,assistant"
    assert chat.parse(texts.limit(0), model).count() == 0 and MODEL.turns("User: a\nAssistant: b") == [("user", "a"), ("assistant", "b")]
    assert chat.parse_conversations(made.limit(0), model).count() == 0


def plain_scores(model, text):
    """The forward pass, passage by passage with plain numbers."""
    words = (text or "").encode().lower().split()
    pieces = [words[i : i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)] or [[]]
    data, offsets = np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())])
    w = W.words(data, offsets, lower=True)
    first, low, high = quality.passages(w)
    assert [b - a for a, b in zip(low, high, strict=True)] == [len(p) for p in pieces] and first.tolist() == [0, len(pieces)]
    x = model.inputs(*quality.encode(w, low, high)).astype(np.float64)
    v = {k: a.astype(np.float64) for k, a in model.weights.items()}
    h = [np.tanh(r @ v["encode"] + v["shift"]) for r in x]
    e = np.array([sum(np.tanh(a @ v["v"]) / (1 + np.exp(-(a @ v["u"]))) * v["a"]) for a in h])
    share = np.exp(e) / np.exp(e).sum()
    z = sum(s * a for s, a in zip(share, h, strict=True))
    return 1 / (1 + np.exp(-(z @ v["out"] + v["bias"][0])))


def test_attention_equals_its_formula(monkeypatch):
    rng = np.random.default_rng(4)
    model = quality._untrained(24, 12, 3)
    model.weights["out"] = rng.normal(size=24).astype(np.float32)
    texts = ["", "one", "Some words, 12 of them!\n" * 40, " ".join(f"w{i}" for i in range(700))]
    raw = [t.encode() for t in texts]
    for at_once in (4096, 3):
        monkeypatch.setattr(quality, "AT_ONCE", at_once)
        got = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert np.allclose(got, [plain_scores(model, t) for t in texts], atol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    model = quality._untrained(6, 4, 3)
    model.weights = {k: rng.normal(size=v.shape) * 0.5 for k, v in model.weights.items()}
    x, first, y = rng.normal(size=(9, quality.BUCKETS + quality.STYLE)) * 0.1, np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(x, first, y)
    for name, w in model.weights.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w.shape)
            kept, step = w[at], 1e-5
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * step) - found[name][at]) < 1e-6


def test_long_labelled_texts_teach(spark):
    good, bad = "calm even words follow here ", "ZZ 99 ## $$ "
    rows = [(i, (good if i % 2 else bad) * 9_000) for i in range(40)]  # 108,000 characters and more
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).select("doc_id", "score").collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in got)


def test_windows_whose_hashes_clash(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    for hashed in (F.xxhash64, lambda *w: F.crc32(F.concat(*w)) % 3, lambda *w: F.lit(0).cast("long")):
        for r in df.select("text", rules.repeat_words(F.col("w"), hashed).alias("n")).collect():
            w = r["text"].split()
            count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            assert r["n"] == len({k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})


def test_rules_on_millions_of_words(spark):
    began = time.time()
    many = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3_000_000)), lambda i: i.cast("string")), " ").alias("text"))
    got = rules.assess(many).select("n_words", "n_repeat_words").first()
    assert tuple(got) == (3_000_000, 0) and time.time() - began < 120


def test_short_items_and_blocks(spark, docs_of, scratch):
    items = spark.createDataFrame([(1, "Blue Whale"), (2, "yes"), (3, ""), (4, None), (5, "one two three four five six seven eight nine ten")], "item_id long, text string")
    texts = {1: "a blue whale, yes!", 2: "blue and whale", 3: None, 4: "whale", 5: "say one two three four five six seven eight nine ten. blue\nWHALE", 6: "so blue", 7: "yesterday"}
    want = {1: {1, 2}, 2: set(), 3: set(), 4: set(), 5: {1, 5}, 6: set(), 7: set()}
    for block in (4096, 2):
        found = decontaminate.decontaminate(docs_of(list(texts.items())), items, scratch, block=block)
        assert found.columns.count("matches") == 1
        assert {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in found.collect()} == want


def test_every_template_is_found(spark, docs_of):
    rng = random.Random(31)
    noise = lambda n: [f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.randrange(999)}" for _ in range(n)]
    rows, want = [], {}
    for n, (label, text, phrases) in enumerate(licenses.TEMPLATES):
        for changed in (False, True):
            w, i = text.split(), len(rows)
            if changed:  # a word in fifteen that no key phrase has is another
                free = [k for k in range(len(w)) if not any(w[k] in p.split() for p in phrases)]
                for k in free[: len(w) // 15]:
                    w[k] = "other"
            rows.append((i, " ".join([*noise(30), *w, *noise(30)]).upper() if n % 2 else "\n".join([*noise(30), *w, *noise(30)])))
            want[i] = label
    rows += [(1000 + i, " ".join(noise(200))) for i in range(20)]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(rows)).collect()}
    for i, label in want.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= 0.6
    assert all(got[1000 + i]["labels"] == "" and got[1000 + i]["score"] == 0 for i in range(20))
    table = spark.createDataFrame([("own", "our very special terms of quibbling", ["special terms"]), ("none", None, None)], "label string, text string, phrases array<string>")
    listed = licenses.read_templates(table)
    assert len(listed) == 1 and licenses.scan(docs_of([(1, "so Our very special terms of quibbling")]), listed).first()["labels"] == "own"
    with pytest.raises(ValueError):
        licenses.read_templates(table, 1)


def test_revisits_with_awkward_rows(spark):
    long = "http://a.example/" + "x" * 100_000
    head = {"etag": '"1"', "content-type": "t"}
    rows = [(1, long, 5, "response", head, "d"), (1, long, 4, "response", {"etag": '"0"'}, "c"), (1, long, 4, "response", {"etag": '"0"'}, "c")]
    rows += [(7, long, 9, "revisit", {"etag": '"0"'}, None), (7, "http://b.example/", 9, "revisit", {"etag": '"0"'}, None), (7, long, 9, "revisit", {"etag": '"0"'}, None), (8, None, 9, "revisit", {}, None), (9, long, None, "revisit", {}, None), (10, long, 6, "revisit", {}, None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], REC + ", u string, slice int, response_id string")
    got = Counter((r["record_id"], r["response_id"], r["outcome"]) for r in warc.resolve(df).collect())
    assert got == {(7, 1, "resolved"): 2, (7, None, "no_response"): 1, (8, None, "no_response"): 1, (9, None, "no_response"): 1, (10, 1, "no_validator"): 1}
    hot = spark.createDataFrame([(i, "http://h.example", 5 if i % 2 else 7, "response" if i % 2 else "revisit", {"etag": '"1"'}, None) for i in range(3000)], REC)
    assert {(r["response_id"], r["outcome"]) for r in warc.resolve(hot).collect()} == {(2999, "resolved")}
