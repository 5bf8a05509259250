"""Unequal inclusion, many sources, ties and clashing columns."""

import random
from collections import defaultdict

from trellis.llm import mixing


def rows_of(n, sources, seed):
    r = random.Random(seed)
    return [(i, "w " * r.choice([5, 30, 100, 400, 700]), f"s{i % sources:03d}") for i in range(n)]


def test_inclusion_follows_the_weights(spark):
    docs = spark.createDataFrame(rows_of(4000, 3, 1), "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    share = defaultdict(list)
    for x in rows:
        if x.source == "s002":  # the least weight: a part of its documents is taken
            share[x.size].append(x.copies)
    rate = {k: sum(v) / len(v) for k, v in share.items()}
    target = next(x for x in rows if x.source == "s002")
    assert target.target < target.source_size
    assert abs(rate[100] / rate[30] - 2) < 0.5 and abs(rate[700] / rate[100] - 2) < 0.5  # 1 : 2 : 4
    assert abs(sum(x.taken for x in rows if x.source == "s002") - target.target) <= 700
    equal = defaultdict(list)
    for x in mixing.mix(docs, odds="1D").collect():
        if x.source == "s002":
            equal[x.size].append(x.copies)
    flat = [sum(v) / len(v) for v in equal.values()]
    assert max(flat) - min(flat) < 0.15


def test_a_class_of_probability_one_is_taken_whole(spark):
    rows = [(i, "w " * (600 if i < 20 else 10), "a") for i in range(420)] + [(1000 + i, "w " * 100, "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mixing.mix(docs, weights=(35, 5), odds="CASE WHEN size > 500 THEN 256D ELSE 1D END").collect()}
    whole = int(got[0].target // got[0].source_size)
    assert got[0].target % got[0].source_size > 0 and {got[i].copies for i in range(20)} <= {whole, whole + 1}
    assert abs(sum(got[i].taken for i in range(420)) - got[0].target) <= 600
    rest = got[0].target - whole * got[0].source_size
    if rest >= 20 * 600:
        assert {got[i].copies for i in range(20)} == {whole + 1} and {got[i].copies for i in range(20, 420)} == {whole, whole + 1}


def levels(size, weight, cap=3):
    full, total = set(), sum(size.values())
    while True:
        open_ = [s for s in size if s not in full]
        level = (total - cap * sum(size[s] for s in full)) / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] >= cap * size[s]}
        if not more:
            return {s: cap * size[s] if s in full else level * weight[s] for s in size}
        full |= more


def test_targets_of_many_sources(spark):
    r = random.Random(9)
    size = {f"s{i:04d}": int(10 ** r.uniform(0, 4)) for i in range(500)}
    sized = spark.createDataFrame([*size.items()], "source string, size long")
    got = {x.source: x.target for x in mixing.targets(sized).collect()}
    want = levels(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))})
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * want[s] + 1e-9 for s in want)


def test_ties_repeated_rows_and_clashing_columns(spark):
    names = ["size", "_row", "_u", "_class", "_text", "_odds", "copies", "target", "_cell"]
    rows = [(7, "a b c d", "x"), (7, "a b c d", "x"), (7, "a b", "x"), (None, "a", "x"), (None, None, None), (1, "", None), (2, "w " * 50, "y")]
    docs = spark.createDataFrame([(*x, *[f"{c}{i}" for c in names]) for i, x in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    first, again = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(5)))
    assert first == again and len(first) == len(rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in mixing.mix(docs).collect())
    assert mixing.mix(docs.where("source IS NULL")).count() == 2
