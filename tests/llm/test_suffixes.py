"""Suffix dedup against every window of every text."""

import hashlib
import random
from collections import Counter

import pytest

from trellis.llm import suffixes
from trellis.llm.suffixes import LENGTH, Run, dedup_documents, front_coded, merged, shared_prefix, united, without_repeats


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        runs = united([(i, i + LENGTH) for i in range(len(d) - LENGTH + 1) if seen[d[i : i + LENGTH]] > 1])
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + d[at:a], b
        kept += d[at:]
        out.append((len(d), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(7)
    word = lambda: "".join(r.choice("etaoinéß") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(400) for _ in range(12)]
    passage, exact, short = prose(150), prose(200).encode()[:LENGTH].decode("utf-8", "ignore"), "x" + prose(70)[:398]
    out = [None, "", "a", "tiny text", *base]
    out += [base[0], base[1][:900], base[1][300:], prose(60) + passage + prose(60), passage[:700] + prose(10) + passage[650:], prose(30) + passage]
    out += [prose(5) + exact + prose(5) for _ in range(3)] + [prose(5) + short + prose(9) for _ in range(3)]
    for _ in range(12):  # near copies: windows of different lengths on either side of a change
        words = base[2].split(" ")
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += ["ab" * 700, "ab" * 450 + "c" + "ab" * 260, "=" * 399, "=" * 400, "-" * 401, "-" * 1500]
    for n in (399, 400, 401, 402, 430):  # repeats of about the length, cut at every kind of place
        piece = base[3].encode()[100 : 100 + n].decode("utf-8", "ignore")
        out.append("@" + piece + "@")
    return out


@pytest.fixture(scope="module", params=[20_000, 2])
def result(request, spark):
    rows = [(i if i else None, t, "en", "s", 0, i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_bytes_x int")
    got = {r.n_bytes_x: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r["_kept"])).hexdigest()) for r in without_repeats(docs, request.param).collect()}
    return [got[i] for i in range(len(rows))]


def test_every_byte_as_by_brute_force(result):
    assert result == brute(texts())


def test_repeated_rows_repeat_each_other(spark):
    docs = spark.createDataFrame([(1, "word " * 100), (1, "word " * 100), (2, "other text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in without_repeats(docs).collect()) == [(1, 500), (1, 500), (2, 0)]


def test_empty_table_and_columns_kept(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long, ranges2 int")
    out = dedup_documents(docs)
    assert out.columns == docs.columns and out.count() == 0


def test_pieces_of_long_texts_agree(monkeypatch, spark):
    some = [t or "" for t in texts()]
    monkeypatch.setattr(suffixes, "PIECE", 500)
    ends, joined, found = [], b"", set()
    for t in some:
        joined += t.encode()
        ends.append(len(joined))
    whole = suffixes.anchors(joined, ends)
    covered = sorted((int(f), int(la)) for f, la in zip(whole[2], whole[3]))
    want = [i for t, e in zip(some, ends) for i in range(e - len(t.encode()), e - LENGTH + 1)]
    assert [i for a, b in covered for i in range(a, b + 1)] == want
    assert all(f <= p and la <= p <= f + LENGTH - suffixes.GRAM for _, p, f, la in zip(*whole)) and found == set()


def test_merge_orders_and_never_misses_a_prefix():
    r = random.Random(3)
    runs = [sorted({(bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))), r.choice([0, 1])) for _ in range(40)}) for _ in range(7)]
    out = list(merged([Run(front_coded([(t, a, 1) for t, a in run])) for run in runs]))
    assert [(t, a) for t, a, _, _ in out] == sorted({x for run in runs for x in run})
    counts = Counter(x for run in runs for x in run)
    assert all(counts[t, a] == n for t, a, n, _ in out)
    assert all(out[i][3] == shared_prefix(out[i - 1][0], out[i][0], 0) for i in range(1, len(out)))
