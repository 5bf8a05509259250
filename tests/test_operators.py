import pytest
from pyspark.sql import functions as F

from trellis.functions import bags
from trellis.functions import text as X
from trellis.operators import graph as G
from trellis.operators import records as R
from trellis.operators import segment as S
from trellis.operators import state as T

DRAFT = "ordinal int, node_type string, node_name string, stable_id string, parent_name string, aliases array<string>, evidence_refs array<string>, props map<string,string>"


def drafts(spark, *rows):
    return spark.createDataFrame([(i, "herb", *r) for i, r in enumerate(rows)], DRAFT)


def test_strict_merge_raises_and_lenient_keeps_the_first(spark):
    d = drafts(spark, ("麻黄", "1", None, ["a", "b"], ["e1"], {"x": "", "y": "1"}), ("麻黄", "1", None, ["b", "c"], ["e2"], {"x": "2", "y": "3"}))
    with pytest.raises(R.IdentityConflict):
        R.merge_strict(d)
    row = R.merge_lenient(d).first()
    assert row.aliases == ["a", "b", "c"] and row.evidence_refs == ["e1", "e2"] and row.props == {"x": "2", "y": "1"} and row.n_merged == 2
    good, bad = R.quarantine_conflicts(d.unionByName(drafts(spark, ("桂枝", None, None, None, None, None)))) 
    assert good.count() == 1 and [r.conflicting for r in bad.collect()] == [["y"], ["y"]]


def test_display_names(spark):
    d = drafts(spark, ("a", "1", "p", [], [], {}), ("a", "2", "q", [], [], {}), ("b", "1", "p", [], [], {}), ("b", "2", "p", [], [], {}), ("c", "1", None, [], [], {}))
    names = sorted(r.display_name for r in R.display_names(d).collect())
    assert names == sorted(["a（p）", "a（q）", "b〔1〕", "b〔2〕", "c"])


def test_targets_take_the_first_type_and_names_before_aliases(spark):
    e = spark.createDataFrame([(1, "t", "x"), (2, "t", "y"), (3, "u", "x"), (4, "t", "alias")], "edge_key int, type string, target string")
    nodes = spark.createDataFrame([("A", "x", "A:x"), ("B", "x", "B:x"), ("B", "y", "B:y")], "node_type string, node_name string, id string")
    types = spark.createDataFrame([("t", 1, "B"), ("t", 2, "A")], "type string, rank int, node_type string")
    aliases = spark.createDataFrame([("A", "alias", "A:x"), ("B", "x", "B:other")], "node_type string, alias string, id string")
    assert {r.edge_key: r.target_id for r in R.resolve_targets(e, nodes, types, aliases).collect()} == {1: "B:x", 2: "B:y", 3: None, 4: "A:x"}


def graph(spark):
    nodes = spark.createDataFrame([(x, "n", x, "verified", None, {}) for x in "abcdef"], "id string, label string, name string, status string, source string, props map<string,string>")
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d")]
    edges = spark.createDataFrame([(f"{s}{d}", s, "r", d, "pending" if s == "c" else "verified", "x") for s, d in pairs], "edge_id string, src_id string, rel_type string, dst_id string, status string, scope string")
    return nodes, edges


def test_budgets_of_the_expansion(spark):
    n, e = graph(spark)
    start = n.where("id = 'a'")
    assert G.expand(n, e, start, 1, 1)[0].count() == 1  # as many seeds as the limit: nothing
    reached, edges = G.expand(n, e, start, 3, 10)
    assert {r.id: r.hop for r in reached.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert edges.count() == 5
    reached, edges = G.expand(n, e, start, 2, 1)
    assert reached.count() == 2 and edges.count() == 1
    assert G.expand(n, e, n.where("id = 'zz'"), 2, 5)[1].count() == 0


def test_paths_repeat_no_edge(spark):
    _, e = graph(spark)
    paths = {tuple(r.path) for r in G.find_paths(e, "a", "d", 4).collect()}
    assert paths == {("a", "c", "d"), ("a", "b", "c", "d")}
    assert {tuple(r.path) for r in G.find_paths(e, "a", "a", 3).collect()} == {("a", "b", "c", "a"), ("a", "c", "b", "a")}


def test_merge_and_repoint(spark):
    n, e = graph(spark)
    plan = spark.createDataFrame([("b", "a"), ("a", "a")], "id string, keep_id string")
    assert sorted((r.src_id, r.dst_id) for r in R.repoint(e, plan).collect()) == [("a", "c"), ("c", "a"), ("c", "d"), ("e", "d")]


def test_text_functions(spark):
    df = spark.createDataFrame([(" é　", "电话13812345678，住院号：12", "【a】1【b】【a】2", "1.2.3", "甲, 乙，，丙")], "a string, b string, c string, d string, e string")
    r = df.select(X.nfc_strip(F.col("a")).alias("a"), X.redact(F.col("b")).alias("b"), X.bracket_fields(F.col("c")).alias("c"), X.parent_code(F.col("d")).alias("d"), X.split_tokens(F.col("e")).alias("e"), X.fold_key(F.lit("ＡßC ")).alias("f"), X.surface_key(F.lit("置于燥 处（x）～")).alias("g"), *X.sex_age(F.lit("患者男，45岁"))).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("é", "电话[已过滤电话]，住院号[已过滤]", {"a": "2"}, "1.2", ["甲", "乙", "丙"], "assc")
    assert r.g == "置干燥处x" and (r.sex, r.age) == ("男", 45)
    hits = spark.range(1).select(X.lexicon_hits(F.lit("abcabd"), ["ab", "abc", "bd"]).alias("h"), X.trie_hits(["ab", "abc", "bd"])(F.lit("abcabd")).alias("t")).first()
    assert hits.h == hits.t == ["abc", "ab"]


def test_bags(spark):
    df = spark.createDataFrame([({"a": "", "b": "1", "id": "x"}, {"a": "2", "b": "3", "c": "4", "id": "y", "k": "5"})], "p map<string,string>, q map<string,string>")
    r = df.select(bags.fill_if_empty(F.col("p"), F.col("q"), ["id", "k"]).alias("f"), bags.rename_keys(F.col("q"), {"a": "甲"}, True).alias("r"), bags.sorted_json(F.col("p")).alias("j")).first()
    assert r.f == {"a": "2", "b": "1", "c": "4", "id": "x"} and r.r == {"甲": "2"} and r.j == '{"a":"","b":"1","id":"x"}'


def test_run_fold_and_sessions(spark):
    ev = spark.createDataFrame([("r", 1, 0, "preview"), ("r", 2, 0, "confirm"), ("r", 3, 1, "preview"), ("r", 4, 2, "preview"), ("r", 5, 1, "rollback"), ("r", 6, 1, "preview")], "run_id string, seq int, step_index int, action string")
    assert {r.step_index: (r.status, r.version) for r in T.run_fold(ev).collect()} == {0: ("confirmed", 1), 1: ("previewed", 1), 2: ("pending", 1)}
    rows = spark.sql("SELECT 1 AS u, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) AS ts FROM VALUES (0), (30), (61) AS t(m)")
    assert sorted(r.n_events for r in T.sessions(rows, "u", "ts").collect()) == [1, 2]


def test_segments_pairs_gaps(spark):
    rows = S.lines(spark.createDataFrame([(1, "pre\n# a\nx\n# b")], "k int, t string"), "k", "t")
    got = S.segments(rows, "k", F.col("line").startswith("#")).orderBy("segment").collect()
    assert [(r.first_line, r.last_line, r.title) for r in got] == [(0, 0, "pre"), (1, 2, "# a"), (3, 3, "# b")]
    assert [r.id for r in S.missing_ids(spark.createDataFrame([(1,), (4,)], "id int"), "id").orderBy("id").collect()] == [2, 3]
