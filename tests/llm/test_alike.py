"""Near-dedup of the pipeline against every pair of texts."""

import random

import pytest

import corpus_pipeline
from trellis.llm import alike, simhash


def texts():
    r = random.Random(23)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    line, out = prose(14), [None, "", " \n", "one two", "ONE  two", "one two three four five", "one two three four six"]
    for n in (12, 40, 90, 200, 400):
        base = prose(n)
        out.append(" ".join(base))
        for _ in range(9):  # changed words: similarities on both sides of four fifths
            words = list(base)
            for _ in range(r.randint(1, max(1, n // 40))):
                words[r.randrange(n)] = word()
            out.append(" ".join(words).upper() if r.random() < 0.3 else " ".join(words))
        out.append(" ".join(base + prose(n // 4)))
    base = prose(60)
    for _ in range(40):  # a crowd
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            words[r.randrange(60)] = word()
        out.append(" ".join(words))
    return out + [" ".join(line + prose(r.choice([2, 3, 30]))) for _ in range(40)]


def components(some):
    sets = []
    for t in some:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(len(some)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(some)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(some))]


@pytest.mark.parametrize("crowd", [64, 3])
def test_stage_by_every_pair(spark, monkeypatch, crowd):
    monkeypatch.setattr(alike, "CROWD", crowd)
    monkeypatch.setattr(alike, "COMMON", crowd)
    some = texts()
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = components(some)
    assert got == sorted(set(want)) and len(set(want)) < 0.8 * len(some)
    far = [(i, w) for i, w in enumerate(want) if i != w and (simhash.fingerprint((some[i] or "").encode()) ^ simhash.fingerprint((some[w] or "").encode())).bit_count() > simhash.RADIUS]
    assert len(far) > 20  # fingerprints within two bits would leave these
