"""Writers: published Parquet by tier, bulk CSV by label and by edge group, JSON lines, fixed-size batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def publish(records: DataFrame, edges: DataFrame, folder: str) -> None:
    for name, df in (("records", records), ("edges", edges)):
        df.write.mode("overwrite").partitionBy("release_tier", "source_id").parquet(f"{folder}/{name}")


def csv_cell(value: Column, is_list: bool) -> Column:
    """Lists joined by ';' with inner ones blanked; empty text to null."""
    text = F.array_join(F.transform(value, lambda x: F.replace(x, F.lit(";"), F.lit(" "))), ";") if is_list else value.cast("string")
    return F.nullif(text, F.lit(""))


def bulk_csv(df: DataFrame, folder: str, by: list[str]) -> None:
    """One folder a group, with a header; list columns joined."""
    kinds = dict(df.dtypes)
    out = df.select(*by, *[csv_cell(F.col(c), kinds[c].startswith("array")).alias(c) for c in df.columns if c not in by])
    out.write.mode("overwrite").option("header", True).partitionBy(*by).csv(folder)


def json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place in a total order, from 1. Ranges of the order are numbered one by one and their counts
    added up, so that no window holds the whole table."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return ranged.withColumn("_i", inside).join(before.select("_p", "_b"), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with the number of their fixed-size batch, in order."""
    return numbered(df, order, "_at").withColumn("batch", F.floor((F.col("_at") - 1) / size)).drop("_at")
