"""Tables with JSON text: surfaces merged or kept apart, conditions by tag and identifier, items of all kinds, what is refused."""

import json

import pytest

from trellis.operators import compendium as C
from trellis.sources.readers import BadInput


def rows_of(table, *rows):
    fields = {f: "{}" if kind == "OBJECT" else "[]" for f, kind, _, _ in C.FIELDS[table]}
    base = {"name": "", **({"description": ""} if table == "conditions" else {}), **fields}
    return [{"row_no": i, **base, **{k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in r.items()}} for i, r in enumerate(rows, 1)]


def relation(source, source_type, target, target_type, edge_type, dosage=""):
    return {"source": source, "target": target, "source_type": source_type, "target_type": target_type, "edge_type": edge_type, "dosage": dosage}


HERBS = rows_of("herbs", {"name": "HUANG QI", "synonyms": ["黄芪"], "properties": {"taste": ["甘"], "nature": "温"}}, {"name": "TWIN"}, {"name": "Dang Gui", "category": ["补血"]}, {"name": "DANGGUI", "synonyms": ["当归"]}, {"name": "Ren-Shen", "notes": ["a"]}, {"name": "RenShen", "notes": ["b"]})
FORMULAS = rows_of("formulas", {"name": "BU QI TANG", "composition": {"Huang Qi": {}}, "treats": ["咳", "咳", " "]}, {"name": "TWIN"})
PATTERNS = [{"clinical_manifestations": ["Fatigue", "fatigue", "Sweats", "cut off...", "…", "", 7]}, "no object", {"other": 1}, {"clinical_manifestations": None}, {"clinical_manifestations": "x"}]
CONDITIONS = rows_of(
    "conditions",
    {"name": "WEAKNESS (DISORDER)", "synonyms": ["Weakness", "SNOMED:222222"], "symptoms": PATTERNS, "description": "d"},
    {"name": "COUGH (FINDING)"},
    {"name": "A (DISORDER)", "synonyms": ["SNOMED:333333"]},
    {"name": "B (FINDING)", "synonyms": ["snomed:333333"]},
    {"name": "C (DISORDER)", "synonyms": ["SNOMED:12"]},
    {"name": "D (DISORDER)", "synonyms": ["SNOMED:444444", "SNOMED:555555"]},
    {"name": "E"},
    {"name": "F (DISORDER)"},
)
RELATIONS = [
    relation("BU QI TANG", "formula", "Huang Qi", "herb", "contains", " 10g "), relation("bu qi tang", "formula", "HUANG QI", "herb", "contains", "10g"), relation("BU QI TANG", "formula", "Dang Gui", "herb", "contains"),
    relation("WEAKNESS (DISORDER)", "condition", "BU QI TANG", "formula", "treats"), relation("WEAKNESS (DISORDER)", "condition", "DANGGUI", "herb", "treats"),
    relation("COUGH (FINDING)", "condition", "HUANG QI", "herb", "treats"), relation("WEAKNESS (DISORDER)", "condition", "none", "herb", "treats"), relation("TWIN", "formula", "twin", "herb", "contains"),
]


def tables(spark, **other):
    data = {"herbs": HERBS, "formulas": FORMULAS, "conditions": CONDITIONS, "relations": [{"row_no": i, **r} for i, r in enumerate(RELATIONS, 1)]} | other
    columns = {t: ["row_no", *C.COLUMNS[t], *[f[0] for f in C.FIELDS.get(t, [])]] for t in data}
    schema = {t: ", ".join(f"{c} {'long' if c == 'row_no' else 'string'}" for c in cols) for t, cols in columns.items()}
    return {t: spark.createDataFrame([tuple(r.get(c) for c in columns[t]) for r in rows], schema[t]) for t, rows in data.items()}


@pytest.fixture(scope="module")
def cleaned(spark):
    return C.clean(tables(spark))


def test_nodes_are_merged_where_no_field_contradicts(cleaned):
    nodes = {(n.node_type, n.node_name): n for n in cleaned["nodes"].collect()}
    assert set(nodes) == {("药材", x) for x in ("HUANG QI", "TWIN", "Dang Gui", "Ren-Shen", "RenShen")} | {("方剂", "BU QI TANG"), ("方剂", "TWIN"), ("病证", "WEAKNESS (DISORDER)"), ("病证", "F (DISORDER)"), ("症状", "Fatigue"), ("症状", "Sweats")}
    # equally filled, the name with a blank stays; the other becomes an alias behind those of the list
    merged = nodes["药材", "Dang Gui"]
    assert merged.aliases == ["当归", "DANGGUI"] and merged.lists == {"category": ["补血"]}
    assert nodes["药材", "RenShen"].props["source_notes"] == '["b"]' and nodes["药材", "Ren-Shen"].aliases == []
    assert nodes["药材", "HUANG QI"].props == {"nature": '{"nature":"温","taste":["甘"]}'}
    assert nodes["方剂", "BU QI TANG"].lists == {"indications": ["咳"]} and nodes["方剂", "BU QI TANG"].props["composition_text"] == '{"Huang Qi":{}}'
    weak = nodes["病证", "WEAKNESS (DISORDER)"]
    assert weak.aliases == ["Weakness"] and weak.props["snomed_id"] == "222222" and weak.props["description"] == "d" and weak.props["core_symptoms"].startswith('[{"clinical_manifestations":["Fatigue"')


def test_edges_and_evidence(cleaned):
    edges = {(e.node_name, e.type, e.target): (e.dosage, e.ref, e.n) for e in cleaned["edges"].collect()}
    at = "conditions:row:1:symptoms:1:clinical_manifestations:"
    assert edges == {
        ("BU QI TANG", "组成药材", "HUANG QI"): ("10g", "relations:row:1", 2), ("BU QI TANG", "组成药材", "Dang Gui"): ("", "relations:row:3", 1), ("TWIN", "组成药材", "TWIN"): ("", "relations:row:8", 1),
        ("WEAKNESS (DISORDER)", "关联药材", "Dang Gui"): ("", "relations:row:5", 1), ("WEAKNESS (DISORDER)", "关联症状", "Fatigue"): ("", f"{at}1", 2), ("WEAKNESS (DISORDER)", "关联症状", "Sweats"): ("", f"{at}3", 1),
    }
    refs = {}
    for r in cleaned["evidence"].collect():
        refs.setdefault((r.node_type, r.node_name), set()).add(r.ref)
    assert refs["药材", "Dang Gui"] == {"herbs:row:3", "herbs:row:4"} and refs["症状", "Fatigue"] == {f"{at}1", f"{at}2"} and "relations:row:5" in refs["病证", "WEAKNESS (DISORDER)"]


def test_nothing_is_set_aside_without_a_reason(cleaned):
    said = sorted((r.what, r.ref.removeprefix("conditions:row:").removeprefix("relations:row:"), r.reason) for r in cleaned["set_aside"].collect())
    at = "1:symptoms:1:clinical_manifestations:"
    assert said == sorted(
        [("condition", "2", "unsupported_condition_tag:finding"), ("condition", "3", "duplicate_snomed_id:333333"), ("condition", "4", "duplicate_snomed_id:333333"), ("condition", "5", "invalid_snomed_id"), ("condition", "6", "multiple_snomed_ids"), ("condition", "7", "unsupported_condition_tag:<none>")]
        + [("manifestation", f"{at}4", "truncated_manifestations"), ("manifestation", f"{at}5", "truncated_manifestations"), ("manifestation", f"{at}6", "empty_manifestations"), ("manifestation", f"{at}7", "non_string_manifestations")]
        + [("manifestation", "1:symptoms:2", "invalid_pattern_objects"), ("manifestation", "1:symptoms:3", "missing_manifestation_lists"), ("manifestation", "1:symptoms:4", "missing_manifestation_lists"), ("manifestation", "1:symptoms:5", "invalid_manifestation_lists")]
        + [("relation", "4", "no_neutral_formula_association_edge"), ("relation", "6", "unsupported_condition_tag:finding"), ("relation", "7", "missing_or_quarantined_endpoint")]
    )


def test_report(cleaned):
    told = {(r.section, r.what): r.n for r in C.report(cleaned).collect()}
    assert told["surfaces", "herbs:merged"] == 1 and told["surfaces", "herbs:conflict"] == 1 and told["names", "herb_and_formula"] == 1 and told["names", "chinese_alias_herb_rows"] == 2
    assert told["ends", "other_case"] == 3 and told["ends", "other_surface"] == 1 and told["collapsed", "组成药材"] == 1 and told["snomed", "all_with_id"] == 3 and told["snomed", "accepted_without_id"] == 1


@pytest.mark.parametrize(
    ("other", "what"),
    [
        ({"herbs": rows_of("herbs", {"name": "Huang Qi"}, {"name": "HUANG QI"})}, "ambiguous identity key"),
        ({"herbs": rows_of("herbs", {"name": "x", "synonyms": "no json"})}, "synonyms must be JSON text of an ARRAY"),
        ({"herbs": rows_of("herbs", {"name": "x", "properties": "[]"})}, "properties must be JSON text of an OBJECT"),
        ({"formulas": rows_of("formulas", {"name": "x", "treats": [1]})}, "holds what is no string"),
        ({"formulas": rows_of("formulas", {"name": " "})}, "empty name"),
        ({"relations": [{"row_no": 1, **relation("a", "herb", "b", "herb", "treats")}]}, "unsupported relation shape"),
        ({"relations": [{"row_no": i, **relation("TWIN", "formula", "TWIN", "herb", "contains", f"{i}g")} for i in (1, 2)]}, "conflicting edge properties"),
    ],
)
def test_what_is_refused(spark, other, what):
    with pytest.raises(BadInput, match=what):
        C.clean(tables(spark, **other))


def test_missing_columns_and_empty_tables(spark):
    data = tables(spark)
    with pytest.raises(BadInput, match=r"herbs lacks \['notes'\]"):
        C.clean(data | {"herbs": data["herbs"].drop("notes")})
    nothing = C.clean({t: df.limit(0) for t, df in data.items()})
    assert all(nothing[k].count() == 0 for k in ("nodes", "edges", "evidence", "set_aside"))
