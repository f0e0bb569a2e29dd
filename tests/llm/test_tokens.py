from __future__ import annotations

import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import encoding, packing, token_files
from tessera.llm.dac import Segment, pack


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(encoding.default_tokenizer())  # the plain call is the oracle


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(encoding.default_tokenizer())
SPECIAL = "<|endoftext|>"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.text(alphabet=" \n\t\x1c\x85\xa0ab1é²́.'st$|_’<>日", max_size=30) | st.sampled_from([SPECIAL, f" {SPECIAL}", f"{SPECIAL} ", "<|endoftext", "<|"]), max_size=5).map("".join), max_size=4))
def test_encoder_equals_the_library(texts):
    coder = encoding.encoder(encoding.default_tokenizer())
    for t, x in zip(texts, coder.encode(texts), strict=True):
        assert array("I", x).tolist() == ids_of(LIBRARY, t)


def test_added_tokens_get_their_ids():
    coder = encoding.encoder(encoding.default_tokenizer())
    assert array("I", coder.encode([f"a {SPECIAL} b"])[0]).tolist() == [64, 220, 50256, 275]
    coder = encoding.Encoder(encoding.default_tokenizer())
    coder.plain = False  # as for added tokens that take spaces with them
    assert array("I", coder.encode([f"a {SPECIAL} b"])[0]).tolist() == [64, 220, 50256, 275]


def test_encoder_forgets_without_harm(monkeypatch, tokenizer):
    monkeypatch.setattr(encoding, "CACHE", 3)
    coder = encoding.Encoder(encoding.default_tokenizer())
    texts = ["one two three four five", "two three six <|endoftext|>", "seven " * 9, "x" * 100]
    for _ in range(3):
        for t in texts:
            assert array("I", coder.encode([t])[0]).tolist() == ids_of(tokenizer, t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.integers(1, 16), st.data())
def test_codes_give_every_id(ids, bits, data):
    array_ids = np.array(ids, "<u4")
    s = Segment(pack(array_ids, [None, 4], np.array([0, len(ids) // 2, len(ids)]), bits))
    assert s.slice(0, len(ids)).tolist() == ids and s.keys == [None, 4] and s.n == len(ids)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert s.slice(a, b).tolist() == ids[a:b]
    for i in sorted({a, b, len(ids) // 2} & set(range(len(ids)))):
        assert s[i] == ids[i]


def test_token_files(spark, docs_of, awkward, scratch, tokenizer):
    awkward = [*awkward, (70, f"two{SPECIAL}texts {SPECIAL} here"), (71, SPECIAL)]
    path = scratch.path("tokens")
    token_files.write(docs_of(awkward), path, segment_tokens=1000)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in awkward], key=lambda i: (i is not None, i or 0))
    texts, at = {}, 0
    for i, t in awkward:
        texts.setdefault(i, t)
    for r in got:
        ids = [*ids_of(tokenizer, texts[r["doc_id"]]), 2]
        raw = array("I", ids).tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)
    every = [x for r in got for x in array("I", bytes(r["ids"]))]
    places = random.Random(3).sample(range(at), 200) + [0, at - 1, 0]
    found = token_files.tokens_at(spark, path, [*places, at, -1]).collect()
    assert Counter((r["position"], r["id"]) for r in found) == Counter((i, every[i]) for i in places)
    assert token_files.tokens_at(spark, path, []).count() == 0
    empty = scratch.path("none")
    token_files.write(docs_of([]), empty)
    assert token_files.read(spark, empty).count() == 0


def check_packed(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by)


@pytest.mark.parametrize("most_parts", [4096, 1])
def test_packing(spark, docs_of, awkward, scratch, tokenizer, most_parts):
    awkward, size = [*awkward, (70, f"two{SPECIAL}texts {SPECIAL} here")], 64
    rows = packing.pack(docs_of(awkward), scratch, size, most_parts=most_parts).collect()
    check_packed(rows, size)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    texts = dict(reversed(awkward))
    for i, t in texts.items():
        ids = [*ids_of(tokenizer, t), 0]
        copies = sum(1 for j, _ in awkward if j == i)
        lengths = [len(ids) % size or size] + [size] * ((len(ids) - 1) // size)
        got = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["length"] for r in got][::copies] == lengths
        for r in got:
            raw = array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes()
            assert bytes(r["ids"]) == raw and r["ids_crc32"] == zlib.crc32(raw)
            assert r["start"] == (0 if r["piece"] == 0 else lengths[0] + (r["piece"] - 1) * size)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pack(docs_of(awkward), scratch, size)).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in rows)
    assert packing.pack(docs_of([]), scratch, size).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    size = 40
    slots = packing.plan(counts, size)
    rows = [{"sequence_id": first + (r - low) // each, "offset": at + (r - low) % each * length, "length": length} for length, low, high, first, each, at in slots for r in range(low, high)]
    assert {n: sum(r["length"] == n for r in rows) for n in counts} == counts
    made = check_packed(rows, size)
    rooms = []  # best fit on the documents themselves
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    assert made == len(rooms)
