"""Closing an expanded node against brute force, circles and loops included."""

import random

from trellis.operators import graph as G


def brute(expansions, node):
    seen, todo, at = {node: 0}, [node], 0
    while todo:
        at += 1
        todo = sorted({c for p, c in expansions if p in todo} - set(seen))
        seen.update({c: at for c in todo})
    del seen[node]
    return seen


def test_collapse_equals_brute_force(spark):
    r = random.Random(5)
    ids = [f"n{i}" for i in range(40)]
    pairs = {(r.choice(ids), r.choice(ids)) for _ in range(70)}
    expansions = sorted({(r.choice(ids[:20]), r.choice(ids)) for _ in range(30)} | {("n1", "n2"), ("n2", "n1"), ("n3", "n3")})
    nodes = spark.createDataFrame([(i, "l") for i in ids], "id string, label string")
    edges = spark.createDataFrame([(a, b, "t") for a, b in sorted(pairs)], "src_id string, dst_id string, rel_type string")
    x = spark.createDataFrame(expansions, "parent string, child string")
    for node in ("n1", "n3", "n39", "none"):
        gone = brute(expansions, node)
        assert {(row.id, row.round) for row in G.expanded_below(x, node).collect()} == set(gone.items())
        left, kept, still = G.collapse(nodes, edges, x, node)
        assert {row.id for row in left.collect()} == set(ids) - set(gone)
        assert {(row.src_id, row.dst_id) for row in kept.collect()} == {(a, b) for a, b in pairs if a not in gone and b not in gone}
        assert {tuple(row) for row in still.collect()} == {(p, c) for p, c in expansions if p not in gone and p != node}


def test_neighbours(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("a", "a"), ("b", "c")], "src_id string, dst_id string")
    assert {r.id for r in G.neighbour_ids(edges, "a").collect()} == {"a", "b", "c"} and G.neighbour_ids(edges, "z").count() == 0
