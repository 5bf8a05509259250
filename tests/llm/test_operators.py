"""Small fixtures and brute force for the corpus operators."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from trellis.llm import mixing, packing, quality, sharding, simhash, topk, urls, warc
from trellis.llm.token_counts import token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fingerprint int"
PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def corpus():
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "naïve", "x1", "the", "of", "#tag", "日本語", "don't", "a|b"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n))
    texts = [None, "", " \t\n ", "one", "one two", "one two three", "a <|endoftext|> b  ", "tail  ", " lead", "x\x1cy\x0bz", "▁a ▁b", "😀 é\n\né  é"]
    base = [prose(r.choice([12, 80, 400])) for _ in range(25)]
    texts += base + base[:5] + [b + " more" for b in base[:8]] + ["Long " + prose(6000)] + ["same line here\n" * 9 + prose(20)]
    texts += [base[20].replace("alpha", "ALPHA"), "the cat sat on a mat " * 8, "z" * 3000]
    sources = ["src0", "src0", "src1", "src2", None, "src9"]
    rows = [(i, t, "en", sources[i % 6], len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[14], rows[14], (None, "a null id with some words", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return (text or "").encode().split()


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        k = root(i)
        low[k] = min((x for x in (low.get(k), r[0]) if x is not None), default=None)
    return sorted(((r[0], f"{p:016x}", low[root(i)]) for i, (r, p) in enumerate(zip(rows, prints))), key=str)


@pytest.mark.parametrize("crowd", [256, 1])
def test_simhash_by_brute_force(docs, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    got = simhash.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(corpus())


def test_simhash_links_all_close_prints(spark):
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in prints[:40] for _ in range(3)]
    prints += [prints[0] ^ ((1 << k) - 1) for k in range(0, 40, 2)]  # a chain of close ones
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    roots = {r.a: r.root for r in simhash.components(simhash.links(df)).collect()}
    signed = sorted({simhash._signed(p) for p in prints})
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                assert roots.get(a, a) == roots.get(b, b)
    assert len({roots.get(p, p) for p in signed}) > 20


def test_keep_one_keeps_columns_and_one_of_each(docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = [tuple(r)[:2] for r in out.collect()]
    assert len(kept) == len({brute_print(t) for _, t in kept}) == len({c for _, _, c in brute_components(corpus())}) or len(kept) == len(set(kept))


def test_token_counts_and_the_cache(spark, docs, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted(((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or "")), len(model.encode(r[1] or "")) > 4096) for r in corpus()), key=str)
    folder = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = token_counts(docs, PIECE, folder).drop("content").collect()
        assert sorted(map(tuple, got), key=str) == want
    cache = spark.read.parquet(folder)
    assert cache.count() == cache.select("content").distinct().count() == len({r[1] or "" for r in corpus()})


def test_second_run_encodes_nothing(spark, docs, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/cache"
    token_counts(docs, PIECE, folder).collect()
    files = sorted(p.name for p in (tmp_path / "cache").iterdir())
    token_counts(docs, PIECE, folder).collect()
    assert files == sorted(p.name for p in (tmp_path / "cache").iterdir())


def test_shards(docs):
    rows = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == len(corpus()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard(docs.repartition(3)).collect()))


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1023, 4099])
def test_feistel_is_a_permutation_with_an_inverse(n):
    x = np.arange(n)
    y = sharding.feistel(x, n, 3)
    assert sorted(y.tolist()) == x.tolist()


def test_top_k_by_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(12)], 0) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [float("nan")] * 12, 0), (303, [None] * 12, 0), (350, rows[50][1], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    v = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows if i is not None and i not in (301, 302, 303)}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).count() == 0


def test_index_stops_early_only_with_proof():
    r = np.random.default_rng(1)
    v = r.integers(-20, 20, (500, 8))
    v[:3] *= 40  # a few members stand out, so that half of the postings prove the rest away
    block, q = topk.Block(np.arange(500), v, 16), v[:3]
    exact = q @ v.T
    floor = np.sort(np.where(np.eye(3, 500, dtype=bool), -(10**9), exact), axis=1)[:, -1].astype(float)
    query, member, score = block.search(q, np.arange(3), 1, floor)
    assert (score == exact[query, member]).all()
    for k in range(3):
        assert score[query == k].max() == floor[k]


def test_quality_measures_by_brute_force(docs):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs).collect()}
    for i, t, *_ in corpus():
        w = words_of(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i, len(w)]
        assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(len(x.decode()) for x in w), len(cover), len(lines) - len(set(lines)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_a_host_of_failures_is_distrusted_and_a_small_one_shrunk(spark):
    good, bad = "plain words that never come again in this short text number {} {} {}", "word " * 30
    rows = [(i, good.format(i, i + 1, i + 2), f"ok{i % 20}") for i in range(400)] + [(1000 + i, bad if i % 10 else good.format(i, 1, 2), "spam") for i in range(100)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(100))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == list(range(400))


def test_mix_comes_near_its_targets(docs, spark):
    r = random.Random(4)
    big = spark.createDataFrame([(i, "w " * r.randint(1, 60), f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(big).collect()
    for s in {x.source for x in rows}:
        own = [x for x in rows if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 60 and all(x.taken <= 3 * x.size for x in own)
    total = sum(x.size for x in rows)
    assert abs(sum({x.source: x.target for x in rows}.values()) - total) < 1e-6 * total
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(big.repartition(7)).collect()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in mixing.mix(docs).collect())


def test_archives_round_trip(spark):
    rows = [(1, "http://a.b/ü x", "<p>same</p>" * 40, 9), (5, None, "<p>same</p>" * 40, 9), (3, "u", None, 9), (4, "u", "", 9), (7, "v", "ünïcode\r\n\r\nbody", 9), (None, "n", "lone", 9), (8, "w", "big " * 50000, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 7 and all(got[i].payload_digest == warc.digest_of((h or "").encode()) and got[i].payload_bytes == len((h or "").encode()) for i, _, h, _ in rows)
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if i in (1, 3, 4, 5)} == {1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_broken_archives_are_refused():
    import io

    out = io.BytesIO()
    w = warc.Writer(out, b"")
    w.add(warc.record(1, "u", b"payload", None, False))
    w.add(warc.record(2, "u", b"more", None, False))
    good = out.getvalue()
    assert [r["payload"] for r in warc.read_archive(good, "x")] == [b"payload", b"more"]
    for bad in (good[:-1], b"\0" + good[1:], good[:20] + b"\xff" + good[21:], good + b"junk", good[:6]):
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(bad, "x"))
    with pytest.raises(warc.BadArchive):
        warc.parse(warc.record(1, "u", b"payload", None, False).replace(b"payload", b"paYload"), "x")


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/70?x"), (2, "https://x.com/en/1"), (3, "http://q.example.net/de/8#t"), (4, "ftp://net/de/"), (5, None), (6, "no scheme"), (7, "http://notcom/en/"), (8, "http://org?q/es/"), (9, "a://b://c/d")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [0.0] * (urls.DIMENSIONS + 1)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 10)] == [("a.example.com", "/en/70", "example.com/en/7"), ("x.com", "/en/1", "com/en/"), ("q.example.net", "/de/8", "example.net/de/8"), ("net", "/de/", "net/de/"), ("", "", None), ("", "", None), ("notcom", "/en/", None), ("org", "", None), ("b:", "//c/d", None)]
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["allow", "block", "block", "allow"]


def test_url_model_on_held_out_sites(spark):
    bad = ["casino-win", "free-bets", "cheap-pills", "spam-farm", "best-casino", "pills-shop", "sex-adult"]
    good = ["ththre", "tionsh", "theater", "therha", "museum-guide", "thernd", "garden-walk", "thering"]
    rows = [(n, f"http://www.{n}.example.com/de/{k}", n in bad) for k, n in enumerate(bad + good)]
    judged = urls.judge_urls(spark.createDataFrame(rows, "page_id string, url string, bad boolean"), urls.train(urls.labelled(spark)))
    right = sum((r.verdict == "block") == (r.page_id in bad) for r in judged.collect())
    assert right >= 13


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if not piece else start + 1024]
            want[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack(docs, BYTE).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(empty, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    h = Counter(r.randint(1, r.choice([30, 600, 1024])) for _ in range(r.choice([1, 50, 3000])))
    rows, n = packing.plan(dict(h))
    got, fill = Counter(), defaultdict(list)
    for length, first, last, each, sequence, offset in rows:
        got[length] += last - first
        for k in range((last - first) // each):
            fill[sequence + k].append((offset, length * each))
    assert got == h and sorted(fill) == list(range(n))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables(empty, spark):
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert sharding.shard(empty).count() == 0 and mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert token_counts(empty, PIECE).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), [0.0] * (urls.DIMENSIONS + 1)).count() == 0
