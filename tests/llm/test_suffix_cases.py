"""Passages found beside the removed strings, and odd tables."""

import random
from collections import Counter

import pytest

from trellis.llm.suffixes import PASSAGE, PASSAGE_WORDS, RESULTS, dedup_documents, united, without_repeats

from .test_passages import texts as passages
from .test_suffixes import brute, texts


def count_passages(some):
    data = [(t or "").encode() for t in some]
    seen = Counter(d[i : i + PASSAGE] for d in data for i in range(len(d) - PASSAGE + 1))
    runs = [united([(i, i + PASSAGE) for i in range(len(d) - PASSAGE + 1) if seen[d[i : i + PASSAGE]] > 1]) for d in data]
    return [sum(b - a >= 400 or len(d[a:b].split()) >= PASSAGE_WORDS for a, b in own) for d, own in zip(data, runs)]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_passages_of_fifty_words_are_counted_and_the_rest_is_as_before(spark, hot):
    some = texts() + passages()
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: r for r in without_repeats(docs, hot, passage=PASSAGE).collect()}
    assert [got[i].n_passages for i in range(len(some))] == count_passages(some)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans) for i in range(len(some))] == [x[:3] for x in brute(some)]
    assert any(got[i].n_passages and not got[i].n_removed for i in got)  # passages under 400 bytes


CLASHING = ["ranges", "n_bytes", "n_removed", "n_spans", "n_passages", "_key", "_k", "_t", "_kept", "_row", "id", "length", "from", "hash"]


def test_clashing_columns_come_back(spark):
    r = random.Random(4)
    long_ = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(120))
    rows = [(i, t, *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate([long_, "x " + long_, None, "", "short"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    out = dedup_documents(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x ", *rows[1][2:]), *rows[2:]], key=str)
    found = without_repeats(docs)
    assert found.columns == ["doc_id", *[c for c in CLASHING if c not in RESULTS], *RESULTS]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.ranges) for r in found.collect()) == [(0, 839, 839, "ranges0"), (1, 841, 839, "ranges1"), (2, 0, 0, "ranges2"), (3, 0, 0, "ranges3"), (4, 5, 0, "ranges4")]


def test_a_table_of_nulls(spark):
    docs = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, dedup_documents(docs).collect()), key=str) == [(None, None, None)] * 3
    assert [r.n_removed for r in without_repeats(docs).collect()] == [0, 0, 0]
