"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from trellis.llm.suffixes import united

from .test_alike import components
from .test_passages import brute as cut_passages


def rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(90)
    texts = [prose(r.randint(15, 120)) for _ in range(30)]
    texts += [texts[0], texts[1] + " tail", prose(40) + " " + passage + " " + prose(40), prose(25) + " é " + passage, "short text", "", None, "again and again " * 20, prose(900), prose(2500)]
    return [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]


def good(text):
    w = (text or "").encode().split()
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w) >= 10 and 100 * len(cover) <= 20 * len(w)


def one_of_each(docs):
    """Similarity of four fifths on five-word shingles, every pair."""
    roots = components([d[1] for d in docs])
    return [d for i, d in enumerate(docs) if roots[i] == i]


def without_passages(docs):
    """Repeated strings of 200 bytes, in runs of 50 words or 400 bytes."""
    out = []
    for d, text in zip(docs, cut_passages([d[1].encode() for d in docs], 200, 50)):
        if text.split():
            out.append((d[0], text, d[2], d[3], len(text)))
    return out


def chances(sizes, rest):
    """Inclusion probability by weight (by length 1, 2, 4), heaviest class first; one of those that are taken whole."""
    words = Counter()
    for n in sizes:
        words[1 if n < 64 else 2 if n < 512 else 4] += n
    whole, p = set(), {}
    while True:
        open_ = {x: w for x, w in words.items() if x not in whole}
        level = (rest - sum(words[x] for x in whole)) / sum(x * w for x, w in open_.items()) if any(open_.values()) else 0
        more = {x for x in open_ if level * x >= 1}
        if not more:
            return {x: 1 if x in whole else level * x for x in words}, rest - sum(words[x] for x in whole)
        whole.add(max(more))


def mixed(docs):
    size = {d[0]: len(d[1].encode().split()) for d in docs}
    of = defaultdict(list)
    for d in docs:
        of[d[3]].append(d)
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: sum(size[d[0]] for d in of[s]) for s in order}
    target, open_, rest = {}, set(order), sum(total.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 3 * total[s]]
        if not full:
            break
        s = min(full, key=lambda s: total[s] / weight[s])
        target[s], rest = 3 * total[s], rest - 3 * total[s]
        open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    out = []
    for s in order:
        copies = math.floor(target[s] / total[s])
        p, want = chances([size[d[0]] for d in of[s]], target[s] - copies * total[s])
        ranked = []
        for d in of[s]:
            u = (int(hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            chance = p[1 if size[d[0]] < 64 else 2 if size[d[0]] < 512 else 4]
            out += [d] * (copies + (chance == 1))
            if 0 < chance < 1:
                ranked.append((u / (1 - u) / (chance / (1 - chance)), d))
        upto = 0
        for _, d in sorted(ranked):
            upto += size[d[0]]
            out += [d] * (upto - size[d[0]] / 2 <= want)
    return out


def pieces(docs):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t, *_ in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if not piece else start + 1024]
            out[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, "").write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out.append(docs)
    return out


def test_stages_by_brute_force(stages):
    want = rows()
    for k, step in enumerate((lambda x: [d for d in x if good(d[1])], one_of_each, without_passages, mixed)):
        want = step(want)
        assert sorted(map(tuple, stages[k].collect()), key=str) == sorted(want, key=str), corpus_pipeline.STAGES[k][0]
    got = stages[4].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_stages_are_as_asked():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
