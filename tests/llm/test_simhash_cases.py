"""Candidates come from the pivots' coordinates, and rows of any columns come back."""

import random

import numpy as np

from trellis.llm import simhash


def close_pairs(n=400):
    r = random.Random(31)
    prints = [r.getrandbits(64) for _ in range(n)]
    others = [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in prints]
    return np.array(prints, np.uint64), np.array(others, np.uint64)


def files(prints):
    rows, found = simhash.files_of(simhash.distance_table(prints))
    out = [set() for _ in prints]
    for i, f in zip(rows.tolist(), found.tolist()):
        out[i].add(f)
    return out


def test_prints_within_two_bits_share_a_file_and_far_ones_none():
    a, b = close_pairs()
    x, y = files(a), files(b)
    assert all(p & q for p, q in zip(x, y)) and max(map(len, x)) <= 2 * simhash.PIVOTS + 1
    # candidates need the vectors one step away: own vectors alone would not do
    own = (simhash.BLOCK - (simhash.distance_table(a)[:, 1:] - simhash.distance_table(a)[:, :1])) // 2 @ simhash.STEPS
    other = (simhash.BLOCK - (simhash.distance_table(b)[:, 1:] - simhash.distance_table(b)[:, :1])) // 2 @ simhash.STEPS
    assert 0 < (own == other).sum() < 100
    assert not any(x[i] & x[j] for i in range(100) for j in range(i))


def test_coordinates_discard_before_distances_verify():
    a, _ = close_pairs(60)
    far = np.array([p ^ np.uint64(0b0110) ^ np.uint64(0b11 << 20) for p in a], np.uint64)  # four bits away
    both = np.unique(np.concatenate([a, far])).view(np.int64)
    assert simhash._linked(both) == []
    near = np.array([p ^ np.uint64(1 << 9) for p in a], np.uint64)
    both = np.unique(np.concatenate([a, near])).view(np.int64)
    assert len(simhash._linked(both)) == 60


def test_keep_one_keeps_columns_of_any_name(spark):
    names = ["__h", "_text", "_root", "_id", "_h", "n", "print", "prefix", "_row"]
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate([words, words + " end", None, "", "another text", "another text"])]
    rows.append((None, None, *[None] * len(names)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
