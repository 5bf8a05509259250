"""Catalogue and ledger as they are read, and publishing: by change, by tier, against the manifest."""

import json
from pathlib import Path

import pytest

from trellis.sources import catalog as C
from trellis.sources.readers import BadInput

WHERE = {"source_provider": "p", "dataset_name": "d", "file_path": "f", "import_scope_key": "k"}


def source(source_id, **more):
    return {"source_id": source_id, "title": "t", "status": "done", "kind": "k", "filter": WHERE, "planned": {"n": "1"}, "completed": {}, "paths": {}, **more}


def written(tmp_path, name, doc):
    path = tmp_path / name
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def catalog(tmp_path, *sources, **head):
    return written(tmp_path, "catalog.json", {"dataset_id": "own/set", "visibility": "private", "knowledge_model": "m", "updated_at": "now", "extra": 1, "sources": list(sources), **head})


def test_catalogue_and_ledger(spark, tmp_path):
    rows = C.load_catalog(spark, catalog(tmp_path, source("a", publish=True, more=1), source("b"), source("c", license="mit", license_status="clear")), "own/set")
    got = {r.source_id: (r.release_tier, r.license_status, r.license) for r in rows.collect()}
    assert got == {"a": ("public", "redacted_structured_only", "other"), "b": ("restricted", "unverified", "unknown"), "c": ("restricted", "clear", "mit")}
    assert [r.source_id for r in C.sources_for_tier(rows, "public").collect()] == ["a"] and rows.first().filter.import_scope_key == "k"
    task = {"task_id": "t", "source_id": "a", "status": "s", "unit": "u"}
    assert C.load_ledger(spark, written(tmp_path, "l.json", {"updated_at": "x", "tasks": [task]}), rows).first().planned_units is None
    with pytest.raises(BadInput, match="unknown sources"):
        C.load_ledger(spark, written(tmp_path, "l2.json", {"updated_at": "x", "tasks": [task | {"source_id": "z"}]}), rows)
    folder = tmp_path / "sources/b/processed/latest"
    folder.mkdir(parents=True)
    (folder / "records.jsonl").write_text("{}")
    assert [p.rpartition("sources/")[2] for p in C.record_paths(spark, f"file://{tmp_path}", rows)] == ["b/processed/latest/records.jsonl"]
    assert C.record_paths(spark, f"file://{tmp_path}", rows, "public") == []


@pytest.mark.parametrize(
    ("sources", "head", "what"),
    [
        ([source("a", publish=True, release_tier="restricted")], {}, "incompatible with publish"),
        ([source("a", license_status=" ")], {}, "license_status required"),
        ([source("a"), source("a")], {}, "occur twice"),
        ([{k: v for k, v in source("a").items() if k != "paths"}], {}, "lack fields"),
        ([], {"visibility": "secret"}, "visibility"),
        ([], {"dataset_id": "other"}, "dataset_id must be own/set"),
    ],
)
def test_unsound_catalogues(spark, tmp_path, sources, head, what):
    with pytest.raises(BadInput, match=what):
        C.load_catalog(spark, catalog(tmp_path, *sources, **head), "own/set")


def test_broken_json(spark, tmp_path):
    with pytest.raises(BadInput, match="not one JSON object"):
        C.load_catalog(spark, written(tmp_path, "c.json", "{no"), "own/set")


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, unit string, n long")


def sources_of(spark, **tiers):
    return spark.createDataFrame([(s, t) for s, t in tiers.items()], "source_id string, release_tier string")


def test_only_what_changed_is_written(spark, tmp_path):
    data = C.Dataset(spark, f"file://{tmp_path}/set")
    files = lambda: sorted(p.parent.name for p in Path(tmp_path, "set").rglob("part-*.parquet"))
    one = [("007", "x", 1), ("b", "y", 2), ("b", "y", 2)]
    tiers = {"007": "public", "b": "restricted", "c": "public"}
    assert data.publish(sources_of(spark, **tiers), rows_of(spark, *one))["written"] == ["007", "b", "c"]
    first = files()
    again = data.publish(sources_of(spark, **tiers), rows_of(spark, *reversed(one)).repartition(3))
    assert again == {"written": [], "kept": ["007", "b", "c"], "left": []} and files() == first and data.manifests.newest()["version"] == 1
    # one copy less of a row is a change, another tier as well
    told = data.publish(sources_of(spark, **(tiers | {"007": "restricted"})), rows_of(spark, *one[:2]))
    assert told["written"] == ["007", "b"] and data.manifests.newest()["version"] == 2
    assert sorted(tuple(r)[:3] for r in data.read().select("source_id", "unit", "n").collect()) == [("007", "x", 1), ("b", "y", 2)]
    with pytest.raises(BadInput, match="nothing is published in public"):
        data.read("public")
    assert data.publish(sources_of(spark, b="restricted"), rows_of(spark, ("b", "y", 2))) == {"written": [], "kept": ["b"], "left": ["007", "c"]}
    assert [r.source_id for r in data.read("restricted").collect()] == ["b"]
    with pytest.raises(BadInput, match="unknown sources"):
        data.publish(sources_of(spark, b="restricted"), rows_of(spark, ("z", "y", 2)))


def test_tampered_rows_are_refused(spark, tmp_path):
    data = C.Dataset(spark, f"file://{tmp_path}/set")
    data.publish(sources_of(spark, a="public", b="public"), rows_of(spark, ("a", "x", 1), ("b", "y", 2)))
    assert data.read("public").count() == 2
    folder = next(p.parent for p in Path(tmp_path, "set").rglob("part-*.parquet") if p.parent.name == "source_id=a")
    spark.createDataFrame([("x", 5)], "unit string, n long").write.mode("append").parquet(f"file://{folder}")
    with pytest.raises(BadInput, match=r"differ from the manifest: \['a'\]"):
        data.read("public")
