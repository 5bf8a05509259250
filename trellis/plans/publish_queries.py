"""Documents published by source, changed and published again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources import catalog as C
from .registry import query
from .views import table


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source_id"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("unit"), "lang")
    public = F.crc32("source_id") % 2 == 0
    return C.checked(C.with_defaults(d.select("source_id").distinct().select("source_id", public.alias("publish"), *[F.lit(None).cast("string").alias(c) for c in ("release_tier", "license_status", "license")]))), d


CHANGED = "sum((doc_id % 97 = 0)::INT) > 0"


def _twice(spark: SparkSession, sf_dir: str) -> tuple[C.Dataset, list[dict]]:
    """Published, published again as it is, and with some documents changed."""
    catalog, d = _records(spark, sf_dir)
    data = C.Dataset(spark, f"{shared_dir(spark)}/trellis/{uuid.uuid4().hex}/dataset")
    changed = d.withColumn("lang", F.when(F.col("doc_id") % 97 == 0, "xx").otherwise(F.col("lang")))
    return data, [data.publish(catalog, d), data.publish(catalog, d.repartition(7)), data.publish(catalog, changed)]


@query(f"""WITH s AS (SELECT coalesce(source, 'none') AS source_id, {CHANGED} AS changed FROM documents GROUP BY 1)
SELECT 1 AS run, source_id, 'written' AS done FROM s UNION ALL SELECT 2, source_id, 'kept' FROM s UNION ALL SELECT 3, source_id, CASE WHEN changed THEN 'written' ELSE 'kept' END FROM s""")
def publish_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three runs wrote."""
    runs = _twice(spark, sf_dir)[1]
    return spark.createDataFrame([(i, s, done) for i, run in enumerate(runs, 1) for done, names in run.items() for s in names], "run int, source_id string, done string")


@query("""SELECT coalesce(source, 'none') AS source_id, doc_id, md5(coalesce(text, '')) AS unit, CASE WHEN doc_id % 97 = 0 THEN 'xx' ELSE lang END AS lang FROM documents""")
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers as a reader sees them after the third run."""
    return _twice(spark, sf_dir)[0].read().drop("release_tier")
