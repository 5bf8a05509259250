"""The pipeline's passage stage against every window of its floor, with passages of over 50 words under 400 bytes."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from trellis.llm import suffixes
from trellis.llm.suffixes import dedup_documents, united


def texts():
    r = random.Random(19)
    word = lambda: "".join(r.choice("etaoinsß") for _ in range(r.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, few, long_words, slight = prose(54), prose(38), " ".join("x" * 30 + word() for _ in range(13)), prose(20)
    assert 300 <= len(passage.encode()) < 400 and 200 <= len(few.encode()) < 400 and len(long_words.encode()) > 400 and len(slight.encode()) < 200
    out = [f"{prose(40)} {part} {prose(30)}" for part in (passage, few, long_words, slight) for _ in range(3)]
    return out + [passage[:250] + prose(60), None, "", prose(300)]


def brute(data, length, words):
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        kept, at = b"", 0
        for a, b in united([(i, i + length) for i in range(len(x) - length + 1) if seen[x[i : i + length]] > 1]):
            if b - a >= 400 or len(x[a:b].split()) >= words:
                kept, at = kept + x[at:a], b
        out.append((kept + x[at:]).decode("utf-8", "ignore"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")


def test_stage_cuts_passages_of_fifty_words(spark, docs):
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    want = brute([(t or "").encode() for t in texts()], 200, 50)
    assert [got[i] or "" for i in range(len(want))] == want
    assert all(len(want[i].split()) <= 72 for i in range(3)) and all(got[i] == texts()[i] for i in (3, 4, 5, 9, 10, 11))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_any_length_by_brute_force(docs, hot):
    got = {r.doc_id: r.text for r in dedup_documents(docs, hot, length=150, gram=32).collect()}
    want = brute([(t or "").encode() for t in texts()], 150, 0)
    assert [got[i] or "" for i in range(len(want))] == want


def test_op7_keeps_its_contract():
    assert (suffixes.LENGTH, suffixes.GRAM) == (400, 64)
