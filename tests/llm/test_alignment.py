"""Alignment by segments against whole texts encoded at once, and where texts may be cut."""

import collections
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trellis.llm import alignment
from trellis.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_a int, groups string, block string, segment string"
ODD = [
    None, "", " ", "  ", "\n", "\t \n", "a", "a ", "a  ", " a", "  a", "\n\na\n", "tail\n ", "x\x1cy !\x1c z", "no break   space", "a\r\nb\rc;\r\nd", "▁a ▁b", "nul\x00 in it",
    "<s> </s> <unk> <0x0A> <|endoftext|> <|startoftext|>", "don't we'll I'M 'tis", "日本語 テキスト。 中文　全角", "é é ﬁ Ａ ½", "😀👍🏽 👨‍👩‍👧 ok", "1234 56,7 8.9", "word\x0bword\x0cword \x85 next line", "z" * 20_000, "tabs\t\tand\tmore\t", "!!! ??? ...  ;;",
]


def corpus():
    r = random.Random(4)
    words = ["the", "Ingre", "thtion,", "éeuxau", "über.", "naïve", "x1", "日本", "don't", "(a|b)", "antidisestablishment", "1999", "—", "😀"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", " "]
    texts = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.choice([3, 60, 600]))) for _ in range(40)]
    texts += ["".join(chr(r.choice([32, 32, 10, 9, 13, 11, 12, 28, 133, 160, 8195, 97, 98, 46, 49, 39, 115, 233])) for _ in range(40)) for _ in range(300)]
    texts += ODD + texts[:6]
    rows = [(i, t, 7, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, "a null id", None, None, None, None)]


def whole(texts):
    """Per text n_a, n_b, groups, n_best, count_sum, or zeros: both libraries get whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: x for x, c in byte_letters().items()}
    found, counts = [], collections.Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        of_a, of_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in of_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in of_b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            found.append(None)
            continue
        ends_a, ends_b = ends_of(raw_a, raw_b)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            k, m = ends_a[end] + 1, ends_b[end] + 1
            groups.append(",".join(map(str, of_a[i:k])) + "|" + ",".join(map(str, of_b[j:m])))
            links.append((of_a[k - 1], of_b[m - 1]))
            i, j = k, m
        counts.update(links)
        found.append((len(of_a), len(of_b), groups, links))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == top[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), ";".join(f[2])) for f in found]


def ends_of(*sides):
    out = []
    for raw in sides:
        at, ends = 0, {}
        for k, x in enumerate(raw):
            at += len(x)
            ends[at] = k
        out.append(ends)
    return out


def test_it_equals_whole_texts(spark):
    rows = corpus()
    want = collections.Counter(zip([r[0] for r in rows], whole([r[1] for r in rows])))
    docs = spark.createDataFrame(rows, DOCS)
    for block in (alignment.BLOCK, 500):
        got = collections.Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in alignment.align(docs, A, B, block).collect())
        assert got == want


def test_texts_that_do_not_come_back_have_no_tokens():
    found = whole(ODD)
    assert all(f[0] == 0 for t, f in zip(ODD, found) if not t or "▁" in t) and all(f[0] > 0 for t, f in zip(ODD, found) if t and t.isascii() and "\x00" not in t)


def test_cuts_are_verified():
    v = alignment.Vocabularies(A, B)
    assert " " in v.cuts and "\n" in v.cuts and "\r" not in v.cuts
    assert v.cut("a b\nc") == [" a", " b", "\nc"] and v.cut("▁a b") == [" ▁a b"] and v.cut("x y z\r\nw") == [" x y", " z\r\nw"]
    assert v.joins(";\r", "\r") and v.joins(" \r", "\r") and not v.joins("  ", " ") and v.joins("a b", " ")
    for text in [t for t in ODD if t]:
        assert "".join(v.cut(text)) == " " + text


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).collect() == []


@pytest.mark.parametrize("n", [0, 1, 70_000])
def test_numbers_come_back(n):
    import numpy as np

    ids = np.arange(n, dtype=np.int64) * 37 % 1_000_000
    assert alignment.spread(alignment.squeeze(ids)).tolist() == ids.tolist()
