"""Lines to segments, sections, terms and pairs. Files are cut by windows over (path, line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def segments(rows: DataFrame, key: str, is_start: Column) -> DataFrame:
    """Line ranges between starts; lines before the first start are segment 0."""
    w = W.partitionBy(key).orderBy("line_no")
    numbered = rows.withColumn("segment", F.sum(is_start.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "segment").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count(F.lit(1)).alias("n_lines"), F.min_by("line", "line_no").alias("title"))


def with_context(rows: DataFrame, key: str, ahead: int = 2) -> DataFrame:
    """The next lines beside each one, for classifiers that look ahead."""
    w = W.partitionBy(key).orderBy("line_no")
    for k in range(1, ahead + 1):
        rows = rows.withColumn(f"next{k}", F.lead("line", k).over(w))
    return rows


def split_before(text: Column, marker: str) -> Column:
    """Parts of a text, each starting at a marker; the first may be a preface."""
    return F.filter(F.split(text, f"(?={marker})"), lambda x: x != "")


def adjacent_pairs(rows: DataFrame, key: list[str], order: str, takes: Column, gives: Column, same: str) -> DataFrame:
    """Each row that takes a value gets it from the next row, if that one gives and is about the same thing."""
    w = W.partitionBy(*key).orderBy(order)
    nxt = F.lead(F.struct(gives.alias("gives"), F.col(same).alias("same"), F.col("value").alias("value"))).over(w)
    paired = rows.withColumn("_n", nxt).where(takes)
    return paired.withColumn("paired", F.when(F.col("_n.gives") & (F.col("_n.same") == F.col(same)), F.col("_n.value"))).drop("_n")


def missing_ids(df: DataFrame, column: str) -> DataFrame:
    """Whole numbers absent between the least and the greatest; only these two reach the driver."""
    first, last = df.agg(F.min(column), F.max(column)).first()
    every = df.sparkSession.range(0 if first is None else first, 0 if first is None else last + 1)
    every = every.select(F.col("id").cast(df.schema[column].dataType).alias(column))
    return every.join(df.select(column).distinct(), column, "left_anti")
