"""Ordered lists, folded edges and the terminology cleaner on small rows."""

import pytest
from pyspark.sql import functions as F

from trellis.functions import values as V
from trellis.operators import lists as L
from trellis.operators import terminology as T
from trellis.sources.readers import BadInput


def test_pages_and_totals(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(11)], "id int, kind string")
    kept = L.filtered(rows, {"kind": "a", "id": None})
    assert [r.id for r in L.page(kept, [F.desc("id")], 2, 2).collect()] == [5, 3]
    assert tuple(L.totals(kept, 2, 2).first()) == (5, 2, 2, True)
    assert tuple(L.totals(kept.limit(0), 2, 2).first()) == (0, 2, 2, False)
    assert L.page(kept, [F.desc("id")], 2, 20).count() == 0


def test_edges_fold_or_conflict(spark):
    rows = spark.createDataFrame([("a", "x", {"r": "1"}, "f:2", 2), ("a", "x", {"r": "1"}, "f:1", 1), ("b", "y", {"r": "1"}, "f:3", 3), ("b", "y", {}, "f:4", 4)], "s string, t string, props map<string,string>, evidence_ref string, ordinal int")
    good, bad = L.fold_edges(rows, ["s", "t"])
    assert [(r.s, r.evidence, r.n) for r in good.collect()] == [("a", "f:1 || f:2", 2)] and [tuple(r) for r in bad.collect()] == [("b", "y", 2)]
    assert L.fold_edges(rows, ["s", "t"], keep_first=True)[0].first().evidence == "f:1"


def test_last_wins_and_same_ids(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "id int, v string"), spark.createDataFrame([(2, "b"), (3, "b")], "id int, v string")
    assert sorted(map(tuple, L.last_wins([a, b], "id").collect())) == [(1, "a"), (2, "b"), (3, "b")]
    assert tuple(L.same_ids(a, b, column="id").first()) == (1, 1) and tuple(L.same_ids(a, a, a, column="id").first()) == (0, 0)


def test_ranks_ranges_and_nulls(spark):
    rows = spark.createDataFrame([("x", "b", None), ("z", "a", "2010-2020"), ("y", "c", "1999")], "kind string, name string, years string")
    assert [r.name for r in L.by_rank(rows, "kind", ["z", "x"], ["name"]).collect()] == ["a", "b", "c"]
    assert sorted(r.name for r in L.in_range(rows, "years", "2010").collect()) == ["a", "b"]
    got = rows.select(V.clinical_text(F.col("kind"), F.col("years")).alias("t"), V.kept_instruction(F.col("name"), ["a", "b"], ["b"]).alias("k")).collect()
    assert [tuple(r) for r in got] == [("x\n", False), ("z\n2010-2020", True), ("y\n1999", False)]
    one = spark.range(1).select(V.around(F.lit("a\n饮片\nb"), "\n饮片\n").alias("p"), V.replaced(F.array(F.lit("x"), F.lit("y")), "x", "z").alias("r"), V.first_flat(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)), F.array(F.lit(3))), 2).alias("f"), V.known_by(F.create_map(F.lit("alias"), F.lit("n")), F.array(F.lit("n"))).alias("k"), V.is_body(F.lit(" 本品为根")).alias("b")).first()
    assert (one.p.before, one.p.behind, one.r, one.f, one.k, one.b) == ("a", "b", ["z", "y"], [1, 2], True, True)


COLUMNS = {
    "D1": "record_no, TCMT_ID, Chinese_group, English_group, Chinese_term, Pinyin_term, English_term, Chinese_synonyms, Synonyms, English_definition_description",
    "D2": "record_no, CPM_ID, Chinese_patent_medicine, Routes_of_administration",
    "D3": "record_no, CPM_ID, TCMT_ID, Chinese_group, English_group, Chinese_term, Pinyin_term, English_term, Synonyms",
    "D4": "record_no, CPM_ID, CHP_ID, Dosage_ratio",
    "D5": "record_no, CPM_ID, ICD11_code",
    "D6": "record_no, CHP_ID, Chinese_herbal_pieces, Chinese_synonyms, English_term, Sources",
    "D7": "record_no, CHP_ID, Medicinal_properties, Class",
    "D18": "record_no, ICD11_code, English_term, Chinese_term, ClassKind, ChapterNo",
}
ROWS = {
    "D1": [("1", "TCMT00001", "传统医学疾病", "", "感冒", "", "", "伤风|Cold||感冒", "伤风", ""), ("2", "TCMT00002", "药性", "", "辛", "", "Pungent", "", "", ""), ("3", "TCMT00003", "其他", "", "无", "", "", "", "", "")],
    "D2": [("1", "CPM00001", "桂枝丸", "口服"), ("2", "CPM00002", "桂枝丸Ａ", "")],
    "D3": [("1", "CPM00001", "TCMT00001", "传统医学疾病", "", "感冒", "", "", ""), ("2", "CPM00001", "TCMT00001", "传统医学疾病", "", "感冒", "", "", "x")],
    "D4": [("1", "CPM00001", "CHP00001", "0.25"), ("2", "CPM00002", "CHP00001", "")],
    "D5": [("1", "CPM00001", "1A00"), ("2", "CPM00001", "9Z")],
    "D6": [("1", "CHP00001", "桂枝", "嫩桂枝|Cinnamon", "", "Viridiplantae")],
    "D7": [("1", "CHP00001", "Pungent", "Medicinal flavor")],
    "D18": [("1", "1A00", "", "感冒", "category", "1"), ("2", "9Z", "", "外因", "category", "23"), ("3", "", "", "", "block", "1")],
}


def tables(spark, **changed):
    return {k: spark.createDataFrame(changed.get(k, v), ", ".join(f"{c} string" for c in COLUMNS[k].split(", "))) for k, v in ROWS.items()}


def test_terminology(spark):
    nodes, edges, excluded = T.clean(tables(spark))
    got = {(r.node_type, r.node_name): r for r in nodes.collect()}
    assert sorted(got) == sorted([("病证", "感冒"), ("性味", "辛"), ("方剂", "桂枝丸"), ("方剂", "桂枝丸Ａ"), ("饮片", "桂枝")])
    cold = got["病证", "感冒"]  # a term and a disease of one name are one node
    assert cold.evidence_refs == ["D18:record:1", "D1:record:1"] and cold.aliases == ["伤风"] and cold.props["tcmt_id"] == "TCMT00001" and cold.props["icd11_code"] == "1A00"
    assert sorted((r.node_name, r.type, r.target, r.dosage_ratio, r.evidence, r.n) for r in edges.collect()) == sorted([
        ("桂枝丸", "适用于", "感冒", "", "D3:record:1 || D3:record:2 || D5:record:1", 3),
        ("桂枝丸", "组成药材", "桂枝", "0.25", "D4:record:1", 1), ("桂枝丸Ａ", "组成药材", "桂枝", "", "D4:record:2", 1), ("桂枝", "具有性味", "辛", "", "D7:record:1", 1)])
    assert sorted(map(tuple, excluded.collect())) == [("D1_group:其他", 1), ("D5_chapter:23", 1)]


@pytest.mark.parametrize("table, rows, said", [
    ("D2", [("1", "CPM1", "x", "")], "invalid CPM_ID"),
    ("D2", ROWS["D2"][:1] * 2, "duplicate CPM_ID"),
    ("D4", [("1", "CPM00001", "CHP00001", "1.5")], "ratio out of range"),
    ("D4", [("1", "CPM00001", "CHP00009", "")], "missing endpoint"),
    ("D4", [("1", "CPM00001", "CHP00001", "0.5"), ("2", "CPM00001", "CHP00001", "0.6")], "other properties"),
    ("D7", [("1", "CHP00001", "Pungent", "Colour")], "unsupported class"),
    ("D7", [("1", "CHP00001", "Salty", "Medicinal flavor")], "missing from D1"),
    ("D5", [("1", "CPM00001", "none")], "ICD endpoint"),
    ("D3", [("1", "CPM00001", "TCMT00001", "治则", "", "感冒", "", "", "")], "mismatches D1"),
])
def test_terminology_refuses(spark, table, rows, said):
    with pytest.raises(BadInput, match=said):
        T.clean(tables(spark, **{table: rows}))


def test_terminology_takes_keys_beyond_five_digits(spark, tmp_path):
    from trellis.plans.cleaner_queries import terminology_nodes

    src = "/root/testdata/sf0.001"
    for name in ("nation", "customer", "supplier", "orders", "lineitem"):
        spark.read.parquet(f"{src}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    part = spark.read.parquet(f"{src}/part.parquet")
    n, kind = part.count(), part.schema["p_partkey"].dataType
    for shift in (90000, 1000000, 1000001 + n):  # nations' numbers, and numbers that agree in their first five digits
        part.withColumn("p_partkey", (F.col("p_partkey") + shift).cast(kind)).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    part.write.mode("append").parquet(f"{tmp_path}/part.parquet")
    got = {r.refs: r.stable_id for r in terminology_nodes(spark, str(tmp_path)).where("refs LIKE 'D1:%' AND node_type IN ('病证', '治法')").collect()}
    keys = [r.p_partkey for r in part.where("p_size % 5 < 4").collect()]
    assert got == {f"D1:record:{k + s}": f"TCMT{str(k + s).rjust(5, '0')[:5]}" for k in keys for s in (0, 90000, 1000000, 1000001 + n)}
