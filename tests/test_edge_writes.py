"""Edges to the nodes they mean, and loads that can be repeated, broken off and raced."""

import pytest

from trellis.operators import edge_writes as E
from trellis.sources.manifests import Conflict, Manifests
from trellis.sources.readers import BadInput

EDGES = ", ".join(f"{c} string" for c in ["label", "name", "rel", "target", "scope", *E.META, *E.FILLED])
EXISTING = "id string, label string, name string, aliases array<string>"


def edges_of(spark, *rows):
    full = [(i, r.get("label", "方剂"), r.get("name", "甲汤"), r["rel"], r["target"], r.get("scope", "s"), *[r.get(c, "m") for c in E.META], *[r.get(c) for c in E.FILLED]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "ordinal long, " + EDGES)


def resolve(spark, rows, written=(), existing=()):
    return E.resolved(edges_of(spark, *rows), spark.createDataFrame(list(written), "label string, given string, name string"), spark.createDataFrame(list(existing), EXISTING))


def plain(spark, rows):
    return resolve(spark, rows, existing=[(f"id{n}", "药材", n, []) for n in ("参", "芪", "草")])


def test_candidates_in_order(spark):
    rows = [{"rel": "组成药材", "target": t} for t in ("参", "片", "又名", "无")]
    got = resolve(spark, rows, written=[("饮片", "片", "片名")], existing=[("1", "药材", "参", []), ("2", "饮片", "参", []), ("3", "药材", "片", []), ("5", "药材", "别", ["又名"]), ("4", "药材", "别的", ["又名"])])
    assert {r.target: (r.target_label, r.target_name) for r in got.collect()} == {"参": ("药材", "参"), "片": ("饮片", "片名"), "又名": ("药材", "别的"), "无": (None, None)}
    with pytest.raises(BadInput, match="unsupported import edge types"):
        resolve(spark, [{"rel": "no such", "target": "x"}])


def rows_in(table):
    return {(r.name, r.rel, r.target_name, r.scope): (r.batch_id, r.dosage, r.evidence_ref, r.load) for r in table.read().collect()}


def test_loads_merge_and_repeat(spark, tmp_path):
    table = E.EdgeTable(spark, f"file://{tmp_path}/edges", buckets=4)
    assert table.read().count() == 0 and table.manifest()["version"] == 0
    base = {"rel": "组成药材"}
    first = plain(spark, [base | {"target": "参", "dosage": "1g", "batch_id": "b1"}, base | {"target": "参", "batch_id": "b2", "evidence_ref": "e"}, base | {"target": "芪", "scope": None}, base | {"target": "无"}])
    told = table.load("one", first)
    assert told == {"version": 1, "rows": 3, "keys": 2, "created": 2, "updated": 0, "dangling": 1}
    assert rows_in(table) == {("甲汤", "组成药材", "参", "s"): ("b2", "1g", "e", "one"), ("甲汤", "组成药材", "芪", None): ("m", None, None, "one")}
    before = rows_in(table)
    assert table.load("one", first) == told and rows_in(table) == before and table.manifest()["version"] == 1
    told = table.load("two", plain(spark, [base | {"target": "参", "batch_id": "b3"}, base | {"target": "芪", "scope": None, "dosage": "2g"}, base | {"target": "草"}]))
    assert (told["created"], told["updated"]) == (1, 2)
    assert rows_in(table) == {("甲汤", "组成药材", "参", "s"): ("b3", "1g", "e", "two"), ("甲汤", "组成药材", "芪", None): ("m", "2g", None, "two"), ("甲汤", "组成药材", "草", "s"): ("m", None, None, "two")}
    # an older version can still be read, and an empty load counts too
    assert table.load("none", plain(spark, [])) == {"version": 3, "rows": 0, "keys": 0, "created": 0, "updated": 0, "dangling": 0}


def test_a_load_that_breaks_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    table = E.EdgeTable(spark, f"file://{tmp_path}/edges", buckets=2)
    table.load("one", plain(spark, [{"rel": "组成药材", "target": "参"}]))
    before = rows_in(table)
    with monkeypatch.context() as m:
        m.setattr(Manifests, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.load("two", plain(spark, [{"rel": "组成药材", "target": "芪"}]))
    assert rows_in(table) == before and table.manifest()["version"] == 1
    assert table.load("two", plain(spark, [{"rel": "组成药材", "target": "芪"}]))["created"] == 1 and len(rows_in(table)) == 2


def test_of_two_loads_at_a_time_one_is_refused(spark, tmp_path):
    table = E.EdgeTable(spark, f"file://{tmp_path}/edges", buckets=2)
    table.load("one", plain(spark, [{"rel": "组成药材", "target": "参"}]))
    with pytest.raises(Conflict):
        table.manifests.commit({"version": 1, "buckets": {}, "loads": {}})
    assert len(rows_in(table)) == 1
