import sqlite3

import pytest
from pyspark.sql import functions as F

from trellis.sources import readers, sinks


def test_jsonl_strict_and_permissive(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": null, "b": "y"}\nnot json\n')
    good, bad = readers.jsonl_permissive(spark, str(tmp_path / "a.jsonl"), "a int, b string", ["a"])
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert sorted(r.error for r in bad.collect()) == ["a is absent", "not a JSON object"]
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()


def test_tsv_needs_its_header(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('﻿id\tname\n1\t"two\nlines"\n2\tb\n')
    assert [r.name for r in readers.tsv(spark, str(tmp_path / "t.tsv"), ["id", "name"]).orderBy("id").collect()] == ["two\nlines", "b"]
    with pytest.raises(readers.BadInput):
        readers.tsv(spark, str(tmp_path / "t.tsv"), ["id", "title"])


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE herbs (id INTEGER, name TEXT, dose REAL)")
        db.executemany("INSERT INTO herbs VALUES (?, ?, ?)", [(i, f"h{i}", i / 2) for i in range(25)])
    spark.dataSource.register(readers.SqliteTable)
    df = spark.read.format("sqlite_table").option("path", str(tmp_path / "x.db")).option("table", "herbs").option("rows", "10").load()
    assert df.count() == 25 and df.agg(F.sum("dose")).first()[0] == 150.0


def test_books_and_lines(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("麻黄\r\n桂枝".encode())
    (tmp_path / "g.txt").write_bytes("麻黄".encode("gb18030"))
    books = {r.path.rsplit("/")[-1]: (r.encoding, r.text) for r in readers.decoded_books(spark, str(tmp_path)).collect()}
    assert books == {"u.txt": ("utf-8", "麻黄\r\n桂枝"), "g.txt": ("gb18030", "麻黄")}
    assert [(r.line_no, r.line) for r in readers.numbered_text(spark, str(tmp_path / "u.txt")).orderBy("line_no").collect()] == [(1, "麻黄"), (2, "桂枝")]


def test_bulk_csv_and_batches(spark, tmp_path):
    df = spark.createDataFrame([("herb", "a", ["x;y", "z"]), ("herb", "b", []), ("book", "c", None)], "label string, name string, tags array<string>")
    sinks.bulk_csv(df, str(tmp_path / "csv"), ["label"])
    back = {r.name: r.tags for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert back == {"a": "x y;z", "b": None, "c": None}
    numbered = sinks.batches(spark.range(25), ["id"], 10).collect()
    assert {r.id: r.batch for r in numbered} == {i: i // 10 for i in range(25)}
