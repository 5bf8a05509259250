"""Edges of lines loaded in two loads, the first one twice, into a versioned table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edge_writes as E
from ..shared import cut, shared_dir
from .registry import query
from .views import table

#: Of two candidate types the first is tried first, in what was written before what was there.
TARGETS = {"made_of": ("part", "supplier"), "stored": ("supplier",)}


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders name a part, a supplier by an alias, or nothing that is there; parts of even size were written under a
    new name by this load."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    c, lit = F.col, F.lit
    written = part.where("p_size % 2 = 0").select(lit("part").alias("label"), F.concat(lit("p"), "p_partkey").alias("given"), F.concat(lit("written "), "p_partkey").alias("name"))
    there = part.select(F.concat(lit("part:"), "p_partkey").alias("id"), lit("part").alias("label"), F.concat(lit("p"), "p_partkey").alias("name"), F.array().cast("array<string>").alias("aliases"))
    there = there.unionByName(supplier.select(F.concat(lit("supplier:"), "s_suppkey").alias("id"), lit("supplier").alias("label"), c("s_name").alias("name"), F.array(F.concat(lit("s"), "s_suppkey")).alias("aliases")))
    n, key = c("l_linenumber"), F.concat(lit("p"), "l_partkey")
    target = F.when(n % 3 == 0, F.concat(lit("s"), "l_suppkey")).when(n == 7, F.concat(lit("lost "), "l_partkey")).otherwise(key)
    lines = table(spark, sf_dir, "lineitem").select(
        F.hash("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("_h"), (c("l_orderkey") * 1_000_000_000 + n * 100_000_000 + c("l_partkey") * 1000 + c("l_suppkey") % 1000).alias("ordinal"),
        lit("customer").alias("label"), c("l_orderkey"), F.when(n % 3 == 0, "stored").otherwise("made_of").alias("rel"), target.alias("target"), c("l_returnflag").alias("scope"),
        F.concat(lit("src"), c("l_orderkey") % 3).alias("source_id"), F.concat(lit("b"), c("l_orderkey") % 5).alias("batch_id"), c("l_orderkey").cast("string").alias("unit_id"), lit("h").alias("prompt_hash"),
        F.when(c("l_orderkey") % 2 == 0, F.concat("l_orderkey", lit(" g"))).alias("dosage"), lit(None).cast("string").alias("dosage_ratio"), F.when(c("l_orderkey") % 4 == 1, F.concat(lit("o"), "l_orderkey")).alias("evidence_ref"),
    ).drop("_h")
    named = lines.join(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), F.concat(lit("c"), c("o_custkey") % 50).alias("name")), "l_orderkey")
    return E.resolved(named, written, there, TARGETS)


LOADS = """l AS (SELECT *, 'c' || o_custkey % 50 AS name, l_linenumber % 3 = 0 AS stored, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordinal,
  CASE WHEN l_linenumber % 3 = 0 THEN s_name WHEN l_linenumber = 7 THEN NULL WHEN p_size % 2 = 0 THEN 'written ' || l_partkey ELSE 'p' || l_partkey END AS target_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT name, CASE WHEN stored THEN 'stored' ELSE 'made_of' END AS rel, CASE WHEN stored THEN 'supplier' ELSE 'part' END AS target_label, target_name, l_returnflag AS scope, ordinal, l_orderkey, l_orderkey % 10 < 6 AS first_load FROM l WHERE target_name IS NOT NULL)"""


@query(f"""WITH {LOADS}, o AS (SELECT *, row_number() OVER (PARTITION BY name, rel, target_label, target_name, scope ORDER BY first_load, ordinal DESC) AS nth FROM g)
SELECT name, rel, target_label, target_name, scope, max(CASE WHEN nth = 1 THEN l_orderkey::VARCHAR END) AS unit_id,
  arg_max(CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey || ' g' END, (NOT first_load, ordinal)) FILTER (WHERE l_orderkey % 2 = 0) AS dosage,
  arg_max(CASE WHEN l_orderkey % 4 = 1 THEN 'o' || l_orderkey END, (NOT first_load, ordinal)) FILTER (WHERE l_orderkey % 4 = 1) AS evidence_ref, CASE WHEN bool_or(NOT first_load) THEN 'second' ELSE 'first' END AS load
FROM o GROUP BY 1, 2, 3, 4, 5""")
def edge_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads, the first of them twice: the table is as after one of each."""
    edges = cut(resolved(spark, sf_dir), "resolved")  # both loads and their counts read it
    store = E.EdgeTable(spark, f"{shared_dir(spark)}/trellis/{uuid.uuid4().hex}/edges")
    first = edges.where("CAST(unit_id AS LONG) % 10 < 6")
    told = store.load("first", first)
    store.load("second", edges.where("CAST(unit_id AS LONG) % 10 >= 6"))
    if store.load("first", first) != told or store.manifest()["version"] != 2:
        raise RuntimeError("a repeated load must change nothing")
    return store.read().select("name", "rel", "target_label", "target_name", "scope", "unit_id", "dosage", "evidence_ref", "load")


@query(f"""WITH {LOADS}, d AS (SELECT l_orderkey % 10 < 6 AS first_load, count(*) AS n FROM l WHERE target_name IS NULL GROUP BY 1),
k AS (SELECT name, rel, target_label, target_name, scope, bool_or(first_load) AS a, bool_or(NOT first_load) AS b FROM g GROUP BY 1, 2, 3, 4, 5)
SELECT 'first' AS load, (SELECT count(*) FROM g WHERE first_load) AS n_rows, count_if(a)::BIGINT AS created, 0::BIGINT AS updated, (SELECT n FROM d WHERE first_load) AS dangling FROM k
UNION ALL SELECT 'second', (SELECT count(*) FROM g WHERE NOT first_load), count_if(b AND NOT a)::BIGINT, count_if(a AND b)::BIGINT, (SELECT n FROM d WHERE NOT first_load) FROM k""")
def edge_load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each load says it did."""
    edges = cut(resolved(spark, sf_dir), "resolved")  # both loads and their counts read it
    store = E.EdgeTable(spark, f"{shared_dir(spark)}/trellis/{uuid.uuid4().hex}/edges")
    told = {name: store.load(name, edges.where(part)) for name, part in (("first", "CAST(unit_id AS LONG) % 10 < 6"), ("second", "CAST(unit_id AS LONG) % 10 >= 6"))}
    return spark.createDataFrame([(n, t["rows"], t["created"], t["updated"], t["dangling"]) for n, t in told.items()], "load string, n_rows long, created long, updated long, dangling long")
