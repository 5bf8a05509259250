"""Clashing columns, repeated rows, nulls; and no fallback to a local folder on a cluster."""

from types import SimpleNamespace

import pytest

from trellis.llm import common, quality


def test_keep_good_returns_columns_of_any_name(spark):
    names = ["_row", "_t", "_w", "n_words", "base_failed", "host_ok", "_host", "_seq", "kept"]
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "a"), (1, words, "a"), (None, words + " more", None), (2, None, "a"), (3, "", None), (4, "too few", "b"), (5, words + " x", "c")]
    docs = spark.createDataFrame([(*x, *[f"{c}{i}" for c in names]) for i, x in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r._row) for r in out.collect()) == [("1", "_row0"), ("1", "_row1"), ("5", "_row6"), ("None", "_row2")]


def test_a_cluster_needs_a_shared_folder():
    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))))
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))) == "hdfs://x/y"
