"""The database cleaner, acceptance rules and the import plan on small rows."""

import pytest

from trellis.functions.vocabulary import EDGE_TARGETS
from trellis.operators import acceptance, importing
from trellis.operators.database import Entity, Relation, clean
from trellis.sources.readers import BadInput


def database(spark, herbs, formulas, links):
    tables = {
        "herbs": spark.createDataFrame(herbs, "id int, name string, taste string"),
        "formulas": spark.createDataFrame(formulas, "id int, name string"),
        "formula_herbs": spark.createDataFrame(links, "_rowid int, formula_id int, herb_id int, dose string"),
    }
    return clean(tables, {"herbs": Entity("药材", {"taste": "flavor_text"}), "formulas": Entity("方剂", {}, warned=True)}, {"formula_herbs": Relation(("formulas", "formula_id"), ("herbs", "herb_id"), "组成药材", "dose")})


def test_database(spark):
    herbs = [(1, "桂枝 ", "辛"), (2, "桂枝", ""), (3, "芍药", "酸"), (4, "芍药", "苦"), (5, "甘草", None)]
    formulas = [(1, "桂枝汤"), (2, "麻黄汤、桂枝汤")]
    nodes, edges, routed = database(spark, herbs, formulas, [(1, 1, 1, "9g"), (2, 1, 3, ""), (3, 2, 1, ""), (4, 1, 2, " "), (5, 1, None, "")])
    assert sorted((r.node_name, r.ids, r.props) for r in nodes.collect()) == sorted([("桂枝", [1, 2], {"flavor_text": "辛"}), ("甘草", [5], {}), ("桂枝汤", [1], {})])
    assert sorted((r.rowid, r.node_name, r.target, r.dosage) for r in edges.collect()) == [(1, "桂枝汤", "桂枝", "9g"), (4, "桂枝汤", "桂枝", None)]
    assert dict(map(tuple, routed.collect())) == {"name_warning_rows": 1, "name_warning_events": 1, "conflicting_groups": 1, "conflicting_rows": 2, "nodes": 3, "edge": 2, "quarantined_endpoint": 3}
    with pytest.raises(BadInput, match="empty name"):
        database(spark, [(1, " ", "")], formulas, [])
    assert database(spark, [], [], [])[0].count() == 0


RECORD = "unit_id string, batch_id string, node_type string, node_name string, evidence_text string, props map<string,string>, edges array<struct<type:string,target:string>>"


def test_acceptance(spark):
    rows = [
        ("u1", "b", "医案", "案一", None, {}, [("治疗病证", "感冒"), ("使用方剂", "感冒"), ("来源于", "源"), ("由证据支持", "无")]),
        ("u1", "b", "病证", "感冒", "", {}, None),
        ("u2", "b", "来源", "道医苏子阳", "", {"skip_reason": "no_clinical_knowledge"}, []),
        ("u2", "x", "药材", "桂枝汤", "", {}, []),
        ("u3", "b", "方剂", "麻黄剂", "麻黄 9 克", {}, []),
    ]
    found = acceptance.broken(spark.createDataFrame(rows, RECORD), spark.createDataFrame([("u1",), ("u9",)], "unit_id string"), EDGE_TARGETS, "b")
    got = {r.rule: (r.n, r["sample"]) for r in acceptance.failures(found).collect()}
    assert got == {
        "missing units": (1, ["u9"]), "skip unit has knowledge": (1, ["药材:桂枝汤"]), "formula typed as 药材": (1, ["桂枝汤"]), "dangling targets": (2, ["无", "源"]),
        "target of a wrong type": (1, ["使用方剂->感冒"]), "方剂 missing 组成药材 despite dosage text": (1, ["麻黄剂"]), "batch_id mismatch": (1, ["桂枝汤"]), "knowledge nodes missing 来源于+由证据支持": (3, ["感冒", "桂枝汤", "麻黄剂"]),
    }
    empty = spark.createDataFrame([], RECORD)
    assert [tuple(r) for r in acceptance.broken(empty, spark.createDataFrame([("u",)], "unit_id string"), EDGE_TARGETS).collect()] == [("missing units", "u")]


def test_import_plan(spark):
    lists = ", ".join(f"{c} array<string>" for c in importing.LISTS)
    existing = spark.createDataFrame([("1", "穴位", "合谷", ["虎口"], {"status": "x", "note": ""}, ["s0"], None, None, None)], f"id string, label string, name string, aliases array<string>, props map<string,string>, {lists}")
    columns = "ordinal int, node_type string, node_name string, props map<string,string>, source_id string, batch_id string, import_scope_key string, prompt_hash string"
    rows = [(1, "穴位", "合谷穴", {"note": "", "status": "y"}, "s1", "b", None, None), (2, "穴位", "虎口", {"note": "a", "drop": "z"}, "s0", "b", "k", "h"), (3, "穴位", "太冲", {"note": "n"}, "s1", "b", "k", ""), (4, "药材", "合谷", {}, "s1", None, "", "")]
    records = importing.prepared(spark.createDataFrame(rows, columns), {"s1": "h1", "s0": "h0"}, ["note", "status"])
    got = {(r.action, r.label, r.name): (r.props, r.source_ids, r.batch_ids, r.scope_keys, r.prompt_hashes, r.n_records) for r in importing.plan(records, existing).collect()}
    assert got == {
        ("update", "穴位", "合谷"): ({"status": "x", "note": "a"}, ["s0", "s1"], ["b"], ["k"], ["h1", "h"], 2),
        ("create", "穴位", "太冲"): ({"note": "n"}, ["s1"], ["b"], ["k"], ["h1"], 1),
        ("create", "药材", "合谷"): ({}, ["s1"], [], [], ["h1"], 1),
    }
    with pytest.raises(BadInput, match="prompt_hash"):
        importing.prepared(spark.createDataFrame(rows, columns), {}, [])


@pytest.mark.parametrize(
    ("module", "name", "query", "most"),
    [("prescription_queries", "lineitem", "prescription_edges", 1), ("compendium_queries", "lineitem", "compendium_set_aside", 1), ("edge_write_queries", "lineitem", "edge_load_counts", 2), ("edge_write_queries", "lineitem", "edge_loads", 2), ("cleaner_queries", "part", "database_nodes", 1)],
)
def test_the_source_is_taken_apart_once(spark, monkeypatch, module, name, query, most):
    """How often jobs of a query and its result read a source's table, as plans of written and collected tables and of the result tell."""
    import importlib

    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter

    scans, parquet, count = [], DataFrameWriter.parquet, lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_partkey#" if name == "lineitem" else "p_partkey#") > 0

    def written(self, path, *args, **kwargs):
        scans.append(count(self._df))
        return parquet(self, path, *args, **kwargs)

    collect = DataFrame.collect

    def collected(self):
        scans.append(count(self))
        return collect(self)

    monkeypatch.setattr(DataFrameWriter, "parquet", written)
    monkeypatch.setattr(DataFrame, "collect", collected)
    result = getattr(importlib.import_module(f"trellis.plans.{module}"), query)(spark, "/root/testdata/sf0.001")
    assert sum(scans) <= most and not count(result)
