import pytest
from pyspark.sql import functions as F

from trellis.functions import bags
from trellis.functions import text as X
from trellis.plans.gate import NotReadOnly, read_only
from trellis.sources.registry import processor, processor_for


def test_gate(spark):
    assert read_only(spark, "SELECT 1 AS offset UNION ALL SELECT 2").count() == 2
    for bad in ("DROP TABLE x", "CREATE TABLE t AS SELECT 1", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2", "SET a = b", "DELETE FROM t"):
        with pytest.raises(NotReadOnly):
            read_only(spark, bad)


def test_processors():
    @processor("p", "d", "*")
    def any_file(df):
        return df

    assert processor_for("p", "d", "x.txt") is any_file
    with pytest.raises(KeyError):
        processor_for("p", "other", "x.txt")


def test_small_functions(spark):
    df = spark.createDataFrame([("\nMa huang\n麻黄\n\nabc", {"chp_id": "", "term_code": "7", "拼音": "x", "别名": "abc", "原文": "t", "e": ""})], "t string, p map<string,string>")
    r = df.select(X.strip_latin_lines(F.col("t")).alias("lines"), bags.stable_id(F.col("p")).alias("id"), bags.for_graph(bags.without_latin(F.col("p"))).alias("p"), X.contains_brand(F.lit("同仁堂丸")).alias("b"), X.admin_id(F.lit("药材"), F.lit("麻黄"), F.lit("")).alias("a"), X.formula_warnings(F.lit("麻黄汤、桂枝汤")).alias("w"), X.edge_id(F.lit(""), F.lit("a"), F.lit("r"), F.lit("b")).alias("e")).first()
    assert (r.lines, r.id, r.p, r.b, r.a, r.w, r.e) == ("麻黄", "7", {"term_code": "7"}, True, "药材:麻黄", ["multiple_entities"], "a:r:b")
