"""Language identification against a plain parser, on invented languages, and its defined cases."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from trellis.llm import langid

DOCS = "doc_id long, text string, lang string, source string, lang_pred string, score int"


def invented(seed, letters, n=60):
    r = random.Random(seed)
    stock = ["".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(80)]
    return [" ".join(r.choice(stock) for _ in range(r.choice([3, 30, 300]))) + "." for _ in range(n)]


def corpus():
    rows, i = [], 0
    for lang, letters in (("aa", "abcdefgho"), ("bb", "abcdefghé"), ("cc", "абвгдежзи")):
        for text in invented(lang, letters):
            rows.append((i, text, lang, "s", "clash", 1))
            i += 1
    more = [None, "", "123 !", "X", "日本語", "ab " * 40_000, "́"]
    rows += [(i + k, t, None, None, None, None) for k, t in enumerate(more)]
    return rows + [(None, "a null id", "aa", None, None, None), rows[3], rows[3], (i + 50, None, "dd", None, None, None)]


def phrases(sample, text):
    count = 0
    for lane in (text[i : i + langid.LANE] for i in range(0, len(text), langid.LANE)):
        count, match = count + 1, b""
        for k in range(len(lane)):
            c = lane[k : k + 1]
            if match + c in sample:
                match += c
            else:
                count, match = count + 1, c if c in sample else b""
    return count


def test_the_automaton_walks_exactly_the_substrings():
    r = random.Random(1)
    for n in (0, 1, 2, 40, 200):
        text = bytes(r.choice(b"abc") for _ in range(n))
        arcs = {(int(s), int(b)): int(t) for s, b, t in langid.automaton(text)}
        inside = {text[i:j] for i in range(n) for j in range(i, n + 1)} | {b""}
        for probe in [*list(inside)[:400], *(bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 9))) for _ in range(300))]:
            at = 0
            for b in probe:
                at = arcs.get((at, b))
                if at is None:
                    break
            assert (at is not None) == (probe in inside)


def test_phrases_are_those_of_a_plain_parser():
    r = random.Random(2)
    sample = "\n".join(invented(5, "abcdé", 12)).encode()
    texts = [t.encode() for t in invented(6, "abcdeé", 12)] + [b"", b"zzz", bytes(r.choice(b"abcdz ") for _ in range(5000))]
    p = langid.Parser("x", len(sample), langid.automaton(sample).tobytes())
    ends = np.cumsum([len(t) for t in texts])
    got = langid.parse([p], np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
    assert got[0].tolist() == [phrases(sample, t) for t in texts]


def test_every_text_gets_the_language_of_fewest_bits(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    out = langid.identify(docs).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add((r.held_out, r.lang_pred, r.score))
    assert all(len(v) == 1 for v in got.values())
    # the same samples by hand: all texts, as there are fewer than DOCUMENTS
    samples = {}
    for lang in ("aa", "bb", "cc"):
        texts = sorted({r[1] for r in rows if r[2] == lang and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 4 != 2})
        table = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.abs(F.xxhash64("text") % (1 << 62)).alias("d")).collect()
        samples[lang] = langid.excerpt([re.sub(r"[\W\d_]+", " ", x.text.lower()).encode() for x in table], [x.d for x in table], langid.SAMPLE)
    right = tried = 0
    for doc_id, text, lang, *_ in rows:
        held, pred, score = next(iter(got[doc_id]))
        assert held == (zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4 == 2) and 0 <= score <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert (pred, score) == ("und", 0)
            continue
        plain = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        if len(plain) < 5000:
            bits = {x: phrases(s, plain) * np.log2(len(s) + 1) for x, s in samples.items()}
            assert pred == min(sorted(bits), key=bits.get)
        if lang and held:
            tried, right = tried + 1, right + (pred == lang)
    assert tried > 20 and right == tried


def test_defined_cases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert langid.identify(empty).collect() == []
    none = spark.createDataFrame([(1, "some words", None, None, None, None), (2, None, "aa", None, None, None)], DOCS)
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(none).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    one = spark.createDataFrame([(0, "some words", "aa", None, None, None), (1, "other words", None, None, None, None)], DOCS)
    assert {(r.lang_pred, r.score) for r in langid.identify(one).collect()} == {("aa", 1.0)}


def test_a_sample_takes_a_share_of_every_text():
    texts = [b"a" * 10, b"b" * 1000, b"c" * 1000]
    got = langid.excerpt(texts, [1, 2, 3], 610)
    assert [len(x) for x in got.split(b"\n")] == [10, 300, 300]
