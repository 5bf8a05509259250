"""White space at the ends of a text, as Python's strip() sees it."""

from pyspark.sql import functions as F

from trellis.functions.text import strip_ws
from trellis.functions.values import endpoint


def test_every_character(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, f"{c}{c}a {c}b{c}") for c in chars], "c string, t string").select("t", strip_ws(F.col("t")).alias("s"))
    assert [r.t for r in df.collect() if r.s != r.t.strip()] == []
    assert [strip.s for strip in spark.createDataFrame([("",), (" 　",), (None,)], "t string").select(strip_ws(F.col("t")).alias("s")).collect()] == ["", "", None]


def test_endpoints(spark):
    said = ["a\tb", " a \t　b ", "a", "a\t", "\tb", "a\tb\tc", "a\tb\t", "a\t  ", "", None]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(endpoint(F.col("t")).alias("e")).collect()
    assert [r.e and tuple(r.e) for r in got] == [("a", "b"), ("a", "b")] + [None] * 8
