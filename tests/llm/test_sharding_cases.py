"""Every shard and slot computed anew, without the operator's code."""

import math
import zlib

from trellis.llm import sharding

MASK = (1 << 64) - 1


def mixed(x, key):
    x = (x + key) * 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def permuted(x, n, seed):
    if n <= 1:
        return 0
    side = max(2, math.isqrt(n - 1) + 1)
    while True:
        left, right = divmod(x, side)
        for r in range(sharding.ROUNDS):
            left, right = right, (left + mixed(right, seed * 1_000_003 + r * 7919 + 1) % side) % side
        x = left * side + right
        if x < n:
            return x


def test_places_by_hand(spark):
    rows = [(i if i % 17 else None, "text " * (i % 5) if i % 3 else None, f"clash{i}") for i in range(1, 260)]
    rows += [rows[4]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    keyed = [(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, _ in rows]
    order = sorted(keyed, key=lambda k: (k[0] is not None, k[0] or 0, *k[1:]))
    for shards, seed in ((8, 20), (3, 7)):
        want = sorted((str(i), size, crc, "rows", p % shards, p // shards, None) for n, (i, crc, size) in enumerate(order) for p in [permuted(n, len(rows), seed)])
        assert sorted((str(r[0]), *r[1:]) for r in sharding.shard(docs.repartition(7), shards, seed).collect()) == want
    assert sharding.shard(docs.where("doc_id = -1")).count() == 0
