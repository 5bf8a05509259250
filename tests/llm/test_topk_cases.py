"""The walk over posting segments, and vectors that are out of the ordinary."""

import numpy as np
import pytest

from trellis.llm import topk


def test_every_posting_is_gathered_and_bounds_hold_after_each_share():
    r = np.random.default_rng(3)
    v = r.integers(-90, 90, (700, 11))
    block = topk.Block(np.arange(700), v, 16)
    for q in r.integers(-90, 90, (6, 11)):
        impact, least = block.impacts(q)
        exact, seen = v @ q, 0
        for share, gathered, open_, met in block.walk(impact, q >= 0, (0.1, 0.4, 0.8, 1.0)):
            assert (least + gathered + open_[met] >= exact).all() and met.sum() >= seen
            seen = met.sum()
            # segments of the greatest impact first: none that is open has more than one that has been processed
            assert share == 1 or seen <= share * v.size
        assert (met == 11).all() and open_[11] == 0


def test_without_the_walk_nothing_is_found(monkeypatch):
    r = np.random.default_rng(5)
    v = r.integers(-50, 50, (600, 8))
    block = topk.Block(np.arange(600), v)
    stops = []
    query, member, score = block.search(v[:4], np.arange(4), 5, np.full(4, -np.inf), stops=stops)
    exact = v[:4] @ v.T
    for k in range(4):
        want = np.sort(np.delete(exact[k], k))[-5:]
        assert np.sort(score[query == k])[-5:].tolist() == want.tolist() and (query == k).sum() < 600
    assert len(stops) == 4
    monkeypatch.setattr(topk.Block, "walk", lambda self, *a: iter([(1.0, np.zeros(600), np.zeros(9), np.zeros(600, int))]))
    query, member, score = block.search(v[:4], np.arange(4), 5, np.full(4, -np.inf))
    assert all(np.sort(score[query == k])[-5:].tolist() != np.sort(np.delete(exact[k], k))[-5:].tolist() for k in range(4))


def brute(rows, asked, k=5):
    v = {}
    for n, (i, e) in enumerate(rows):
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e):
            v[n] = (i, [int(np.floor(256 * float(x))) for x in e])
    out = []
    for n in v:
        i, q = v[n]
        if asked(i):
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in v.values() if j != i and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 2e6])
def test_lengths_large_components_and_repeated_queries(spark, scale):
    r = np.random.default_rng(7)
    rows = [(i, (scale * r.normal(size=6 if i % 3 else 4)).tolist()) for i in range(120)]
    rows += [(50, rows[50][1]), (100, (scale * r.normal(size=4)).tolist()), (None, [1.0] * 6), (130, []), (131, None), (132, [1.0, None]), (150, [float("inf")] * 6), (7, rows[8][1]), (160, [1.0]), (170, [9e6, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, score string, block int")
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect())) == brute(rows, lambda i: i % 50 == 0)


def test_a_table_of_nulls(spark):
    df = spark.createDataFrame([(None, None), (50, None), (0, [None])], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


def test_a_score_beyond_a_long_is_refused():
    huge = np.full((2, 4), 1 << 40)
    with pytest.raises(OverflowError):
        topk.exact_scores(huge, huge)
    assert topk.exact_scores(huge[:, :1] >> 10, huge[:, :1] >> 10).tolist() == [1 << 60] * 2
