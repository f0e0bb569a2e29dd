from __future__ import annotations

import pytest

#: doc_id long, text string, and columns whose names clash with results.
SCHEMA = "doc_id long, text string, score double, start long, matches string, k1 long, n_words string, found int, sequence_id int"


@pytest.fixture()
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs, with clashing further columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, 0.5, 7, "m", 3, "w", 1, 9) for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture()
def scratch(spark):
    from tessera.llm.scratch import Scratch

    s = Scratch(spark, "test")
    yield s
    s.drop()


#: Nulls, empty and blank texts, ties, repeated rows, a null id, one long text, one word without a space.
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "same text here now " * 12), (6, "same text here now " * 12), (5, "same text here now " * 12), (None, "nobody's text"), (7, "x" * 200_000), (8, " ".join(f"w{i}" for i in range(30_000))), (9, "ünï  cödé\n\n«日本語» ok")]


@pytest.fixture()
def awkward():
    return AWKWARD
