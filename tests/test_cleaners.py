import pytest

from trellis.operators.cleaners import clean_spans, clean_triples
from trellis.sources.readers import BadInput


def test_triples(spark):
    rows = [("咳嗽", "风寒", "证候"), ("咳嗽", "风寒", "证候"), ("风寒", "风寒", "证候"), ("咳嗽", "麻黄", "中药"), ("麻黄", "肺、膀胱", "归经"), ("麻黄", "风寒", "功能"), ("麻黄", "发汗", "功能"), ("麻黄", "干", "药味"), ("麻黄", "茎", "部位"), ("a", "b", "TS_MS"), ("a", "b", "chemical_MM")]
    df = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "source_file string, line_no int, head string, tail string, relation string")
    nodes, edges, decisions = clean_triples(df)
    assert {r.decision: r.n for r in decisions.collect()} == {"mapped_edge": 5, "self_edge_skipped": 1, "quarantined_function_clinical_overlap": 1, "mapped_property": 1, "quarantined_external_mapping": 1, "excluded_chemical": 1}
    assert {(r.node_name, r.type, r.target) for r in edges.collect()} == {("咳嗽", "关联证候", "风寒"), ("咳嗽", "关联药材", "麻黄"), ("麻黄", "归于经脉", "肺"), ("麻黄", "归于经脉", "膀胱"), ("麻黄", "具有功效", "发汗"), ("麻黄", "具有性味", "甘")}
    by = {(r.node_type, r.node_name): r for r in nodes.collect()}
    assert by["药材", "麻黄"].props == {"location": "茎"} and by["病证", "风寒"].tcm_type == "来源标注证候" and by["病证", "咳嗽"].tcm_type == "未分类临床概念"
    with pytest.raises(BadInput):
        clean_triples(df.selectExpr("source_file", "line_no", "head", "tail", "'其他' AS relation"))


def test_spans(spark):
    schema = "id int, text string, labels array<struct<id:string,type:string,start:int,end:int,surface:string>>"
    text = "用于风寒感冒，含麻黄。同仁堂"
    ok = [(1, text, [("T1", "DISEASE", 2, 6, "风寒感冒"), ("T2", "DRUG", 8, 10, "麻黄"), ("T3", "FOOD", 8, 10, "麻黄"), ("T4", "DRUG", 11, 14, "同仁堂"), ("T5", "SYMPTOM", 4, 6, "感冒"), ("T6", "DISEASE", 4, 6, "感冒")])]
    nodes, report = clean_spans(spark.createDataFrame(ok, schema))
    assert {(r.node_type, r.node_name) for r in nodes.collect()} == {("病证", "风寒感冒"), ("药材", "麻黄")}
    assert {r.route: r.n for r in report.collect()} == {"kept": 2, "noise": 1, "cross_type": 1}
    with pytest.raises(BadInput):
        clean_spans(spark.createDataFrame([(1, text, [("T1", "DRUG", 0, 2, "麻黄")])], schema))
