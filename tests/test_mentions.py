"""Mentions against brute force: buffers, leftmost-longest matches, first places."""

import random
import re

from trellis.operators import mentions as M

SKIP = "^索引"


def brute_buffers(rows, size):
    by, out = {}, {}
    for key, no, line in rows:
        by.setdefault(key, []).append((no, line))
    for key, lines in by.items():
        held, start, run = [], None, 0
        for no, line in sorted(lines):
            line = (line or "").strip()
            if not line or re.match(SKIP, line):
                continue
            start = no if not held else start
            held.append(line)
            run += len(line)
            if run >= size:
                out[key, start] = "\n".join(held)
                held, run = [], 0
        if held:
            out[key, start] = "\n".join(held)
    return out


def brute_hits(text, names):
    seen, i = [], 0
    while i < len(text):
        best = max((n for n in names if text.startswith(n, i)), key=len, default=None)
        if best and best not in seen:
            seen.append(best)
        i += len(best) if best else 1
    return seen


def corpus():
    r = random.Random(7)
    words = ["人参", "人参汤", "参汤", "黄芪", "ab", "abc", "abcd", "bcde", "é😀", "😀x", "甘", "草 ", "the long name of it", "x"]
    line = lambda: "".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 30])))
    rows = [(k, no, line()) for k in range(12) for no in range(r.randrange(1, 15))]
    return rows + [(20, 0, None), (21, 0, "  "), (22, 0, "索引 人参"), (22, 1, "人参"), (23, 0, "黄芪" * 5000)]


def test_buffers_and_mentions_equal_brute_force(spark):
    rows = corpus()
    lines = spark.createDataFrame(rows, "key long, line_no long, line string")
    chunks = M.buffers(lines, "key", 40, SKIP)
    want = brute_buffers(rows, 40)
    assert {(r.key, r.start): r.text for r in chunks.collect()} == want
    lexicon = ["人参", "人参汤", "参汤", "黄芪", "ab", "abc", "abcd", "bcde", "é😀", "😀x", "the long name of it", "absent", "甘草 "]
    names = spark.createDataFrame([(n, "t") for n in lexicon], "name string, node_type string")
    found = M.mentions(chunks, ["key", "start"], names)
    hits = {(r.key, r.start, r.name) for r in found.collect()}
    assert hits == {(*k, n) for k, text in want.items() for n in brute_hits(text, lexicon)}
    firsts = {r.name: (r.key, r.start, r.n_chunks) for r in M.first_mentions(found, ["key", "start"]).collect()}
    assert firsts == {n: (*min(k for k, t in want.items() if n in brute_hits(t, lexicon)), sum(n in brute_hits(t, lexicon) for t in want.values())) for n in {h[2] for h in hits}}


def test_lexicon_keeps_the_first_type_of_fitting_names(spark):
    part = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, name string, node_type string")
    got = M.lexicon([part(("人参", "药材"), ("人参", "方剂"), ("一", "药材"), ("x" * 21, "药材"), ("y" * 20, "药材"), ("书", "来源"), (None, "药材")), part(("人参", "病证"), ("黄芪", "病证"))], ["药材", "方剂", "病证"])
    assert {(r.name, r.node_type) for r in got.collect()} == {("人参", "药材"), ("y" * 20, "药材"), ("黄芪", "病证")}


def test_the_map_has_no_false_negatives_and_a_fixed_size(spark):
    names = [f"名{i:05d}" for i in range(3000)]
    marked = M.bitmap(spark.createDataFrame([(n, "t") for n in names], "name string, node_type string"))
    assert len(marked) == M.BITS // 8
    chunks = spark.createDataFrame([(1, "，".join(names[:50]))], "key long, text string")
    assert {r.window[:6] for r in M.candidates(chunks, ["key"], marked).collect()} >= set(names[:50])


def test_empty(spark):
    lines = spark.createDataFrame([], "key long, line_no long, line string")
    names = spark.createDataFrame([], "name string, node_type string")
    assert M.mentions(M.buffers(lines, "key", 40), ["key", "start"], names).collect() == []


def test_names_that_tasks_hold_make_no_rows_of_places(spark):
    rows = corpus()
    chunks = M.buffers(spark.createDataFrame(rows, "key long, line_no long, line string"), "key", 40, SKIP)
    lexicon = ["人参", "人参汤", "参汤", "黄芪", "ab", "abc", "abcd", "bcde", "é😀", "😀x", "the long name of it", "absent", "甘草 "]
    names = spark.createDataFrame([(n, "t") for n in lexicon] + [("x", "t"), (None, "t")], "name string, node_type string")
    held, joined = M.mentions(chunks, ["key", "start"], names), M.mentions(chunks, ["key", "start"], names, held=5)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "window" in plan(joined) and "window" not in plan(held)
    assert {tuple(r) for r in held.select("key", "start", "name", "node_type", "at").collect()} == {tuple(r) for r in joined.select("key", "start", "name", "node_type", "at").collect()}
