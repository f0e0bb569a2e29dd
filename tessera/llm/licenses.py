"""Operator 9, licence scans by a positional rare-token index.

Templates are licence texts and the notices that stand for them. Their words get inverse document frequencies over the templates, and each
template's rarest words become its postings: word -> (template, position). A file's words are looked up in the
postings; a hit at word p for a posting at position q votes for a start at p - q, and votes that agree on template
and start (within `slack` words) are one candidate. A candidate counts if its votes reach the least share of
the template's rare words and all mandatory key phrases of the template stand in the file near it. So matching
is by relative position, tolerates changed words, and never compares a file with a whole template.

Files are scanned as UTF-8 bytes, batch by batch: words and their hashes are found with numpy, so a file
without any rare word costs one table look-up for each word and no Python object.

Base phrases are found by the same postings with slack 0 and every word mandatory: their exact places, compared by
their bytes.

Defined results: null and empty texts have no words, null positions, no labels and score 0; rows with equal
doc_id keep a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, wording, mandatory key phrases.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ("general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0 1 0", ("cc0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("permission is hereby granted free of charge", "sublicense"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("with or without fee is hereby granted", "disclaims all warranties"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license", "unless required by applicable law"),
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("general public license", "version 3 of the license"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software", "public domain"),
    ),
]
#: Templates that a table may have: all of them go to every task.
MOST_TEMPLATES = 20_000


def read_templates(table: DataFrame, most: int = MOST_TEMPLATES) -> list[tuple[str, str, tuple[str, ...]]]:
    """Templates from a table (label, text, phrases array<string>), beside or instead of the built-in ones."""
    rows = table.select("label", "text", "phrases").orderBy("label", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of templates may have {most} rows")
    return [(r["label"], r["text"] or "", tuple(r["phrases"] or ())) for r in rows if (r["text"] or "").strip()]


def keys(phrase: str) -> np.ndarray:
    """Hashes of a phrase's words, as scanned files have them."""
    raw = phrase.encode()
    return W.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), W.NON_ALNUM, lower=True).key


@dataclass
class Template:
    label: str
    words: np.ndarray
    rare: list[int]  # positions of the postings
    phrases: list[np.ndarray]
    text: str


@dataclass
class Index:
    """Postings of the rarest words of templates."""

    templates: list[Template]
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @staticmethod
    def build(templates: list[tuple[str, str, tuple[str, ...]]], rarest: int = 6) -> Index:
        cut = [(label, keys(text), [keys(p) for p in phrases], text) for label, text, phrases in templates]
        df: dict[int, int] = defaultdict(int)
        for _, w, _, _ in cut:
            for x in set(w.tolist()):
                df[x] += 1
        idf = {x: math.log(len(cut) / n) for x, n in df.items()}
        out = Index([])
        for label, w, phrases, text in cut:
            must = {x for p in phrases for x in p.tolist()}
            order = sorted(range(len(w)), key=lambda i: (-(idf[int(w[i])] + (int(w[i]) in must)), i))
            rare = sorted(order[: min(rarest, len(order))])
            for i in rare:
                out.postings[int(w[i])].append((len(out.templates), i))
            out.templates.append(Template(label, w, rare, phrases, text))
        out.vocabulary = np.array(sorted(out.postings), np.uint64)
        return out

    def hits(self, key: np.ndarray) -> np.ndarray:
        """Places of words that have postings."""
        at = np.searchsorted(self.vocabulary, key)
        at[at == len(self.vocabulary)] = 0
        return np.flatnonzero(self.vocabulary[at] == key)

    def candidates(self, key: np.ndarray, places: np.ndarray, slack: int) -> Iterator[tuple[int, int, float]]:
        """(template, first word, share of its rare words) of all starts that get votes in one file."""
        votes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for p in places.tolist():
            for t, q in self.postings[int(key[p])]:
                votes[t][p - q].add(q)
        for t, starts in votes.items():
            order, n = sorted(starts), len(self.templates[t].rare)
            i = 0
            while i < len(order):
                seen, j = set(), i
                while j < len(order) and order[j] - order[i] <= slack:
                    seen |= starts[order[j]]
                    j += 1
                yield t, max(0, order[i]), len(seen) / n
                i = j


def _stands(key: np.ndarray, phrase: np.ndarray, low: int, high: int) -> int:
    """First place of a phrase that starts in low..high, or -1."""
    low, high = max(0, low), min(high, len(key) - len(phrase))
    if high < low:
        return -1
    ok = key[low : high + 1] == phrase[0]
    for k in range(1, len(phrase)):
        ok &= key[low + k : high + 1 + k] == phrase[k]
    at = np.flatnonzero(ok)
    return low + int(at[0]) if len(at) else -1


def scan_file(key: np.ndarray, places: np.ndarray, base: Index, index: Index, slack: int, least: float, word: Callable[[int], bytes]) -> tuple[list[int], set[str], set[str], float]:
    """Places of base phrases, their labels, the templates' labels, and the best share of a template. word: a word's bytes."""
    found, own = [], set()
    for t, start, share in base.candidates(key, places, 0):
        template = base.templates[t]
        if share == 1 and _stands(key, template.words, start, start) == start and all(word(start + i) == x for i, x in enumerate(template.text.encode().split())):
            found.append(start)
            own.add(template.label)
    labels, best = set(), 0.0
    for t, start, share in index.candidates(key, places, slack):
        template = index.templates[t]
        reach = len(template.words) + slack
        if share >= least and all(_stands(key, p, start - slack, start + reach) >= 0 for p in template.phrases):
            labels.add(template.label)
            best = max(best, share)
    return found, own, labels, best


def scan(docs: DataFrame, templates: list[tuple[str, str, tuple[str, ...]]] | None = None, rarest: int = 6, slack: int = 2, least: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document.

    score: 1 where a base phrase stands, else the best share of a template's rare words.
    """
    templates = TEMPLATES if templates is None else templates
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.build(templates, rarest)
        base = Index.build([(label, phrase, (phrase,)) for phrase, label in BASE.items()], 99)
        both = np.unique(np.concatenate([index.vocabulary, base.vocabulary]))
        known = Index([], defaultdict(list), both)
        for i in (index, base):
            i.postings = defaultdict(list, i.postings)
        for batch in rows:
            ids = batch.column("doc_id")
            data, offsets = W.buffers(batch.column("text"))
            for lo, hi in W.runs(offsets):
                w = W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], W.NON_ALNUM, lower=True)
                hits = known.hits(w.key)
                cut = np.searchsorted(hits, w.first)
                n = hi - lo
                out = {"n_words": np.diff(w.first), "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n}
                for d in np.flatnonzero(np.diff(cut)).tolist():
                    places = hits[cut[d] : cut[d + 1]] - w.first[d]
                    found, own, more, best = scan_file(w.key[w.of(d)], places, base, index, slack, least, lambda i, o=int(w.first[d]): w.data[w.start[o + i] : w.end[o + i]].tobytes())
                    if found:
                        out["n_base"][d], out["first_word"][d], out["last_word"][d] = len(found), min(found), max(found)
                    out["base_labels"][d], out["labels"][d] = ",".join(sorted(own)), ",".join(sorted(own | more))
                    out["score"][d] = 1.0 if found else best
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), *(pa.array(v, kinds[k]) for k, v in out.items())], list(kinds))

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
