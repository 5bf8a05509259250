"""The property graph and the record tables, seen over the provided tables, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import Link, edge_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status(c: Column) -> Column:
    return F.when(c == "O", "pending").when(c == "F", "verified").otherwise("rejected")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _nodes(df: DataFrame, label: str, key: str, name: Column, status: Column | str = "verified", source: Column | None = None, **props: Column) -> DataFrame:
    bag = F.map_filter(F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull()) if props else F.create_map().cast("map<string,string>")
    return df.select(F.col(key).alias("key"), F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), name.alias("name"), (F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(None).cast("string") if source is None else source).alias("source"), bag.alias("props"))


def node_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nodes by label: their keys within it beside the columns of ``nodes``."""
    t = lambda name: table(spark, sf_dir, name)
    return {
        "region": _nodes(t("region"), "region", "r_regionkey", F.col("r_name")),
        "nation": _nodes(t("nation"), "nation", "n_nationkey", F.col("n_name"), regionkey=F.col("n_regionkey")),
        "customer": _nodes(t("customer"), "customer", "c_custkey", F.col("c_name"), source=F.col("c_mktsegment"), acctbal=_money("c_acctbal"), segment=F.col("c_mktsegment"), nationkey=F.col("c_nationkey")),
        "supplier": _nodes(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), acctbal=_money("s_acctbal"), nationkey=F.col("s_nationkey")),
        "part": _nodes(t("part"), "part", "p_partkey", F.col("p_name"), source=F.col("p_brand"), brand=F.col("p_brand"), type=F.col("p_type"), size=F.col("p_size")),
        "order": _nodes(t("orders"), "order", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey")), _status(F.col("o_orderstatus")), F.col("o_orderpriority"), priority=F.col("o_orderpriority"), day=F.date_format("o_orderdate", "yyyy-MM-dd")),
    }


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.drop("key") for p in node_tables(spark, sf_dir).values()])


def links(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> list[Link]:
    """The edges by relation and labels, ends as keys. ``only``: relation types to build, so that unused branches are never read."""
    t = lambda name: table(spark, sf_dir, name)

    def make(df: DataFrame, src: str, src_key: str, rel: str, dst: str, dst_key: str, status: Column, scope: Column) -> Link:
        return Link(src, rel, dst, df.select(F.col(src_key).alias("src_key"), F.col(dst_key).alias("dst_key"), status.alias("status"), scope.alias("scope")))

    fixed, base = F.lit("verified"), F.lit("base")
    lines = lambda *k: t("lineitem").groupBy(*k).agg(F.max(F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("st"), F.min(F.year("l_shipdate")).alias("y"))
    build = {
        "located_in": lambda: [make(t("nation"), "nation", "n_nationkey", "located_in", "region", "n_regionkey", fixed, base)],
        "from": lambda: [make(t("customer"), "customer", "c_custkey", "from", "nation", "c_nationkey", fixed, base), make(t("supplier"), "supplier", "s_suppkey", "from", "nation", "s_nationkey", fixed, base)],
        "placed": lambda: [make(t("orders"), "customer", "o_custkey", "placed", "order", "o_orderkey", _status(F.col("o_orderstatus")), F.col("o_orderpriority"))],
        "contains": lambda: [make(lines("l_orderkey", "l_partkey"), "order", "l_orderkey", "contains", "part", "l_partkey", F.when(F.col("st") == 2, "rejected").when(F.col("st") == 1, "verified").otherwise("pending"), F.col("y").cast("string"))],
        "supplied_by": lambda: [make(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplied_by", "supplier", "l_suppkey", fixed, F.lit("lineitem"))],
    }
    return [link for rel in only or build for link in build[rel]()]


def edges(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> DataFrame:
    """All links in one table, ends as ids."""
    return edge_table(links(spark, sf_dir, only))


STATUS_SQL = "CASE {0} WHEN 'O' THEN 'pending' WHEN 'F' THEN 'verified' ELSE 'rejected' END"
#: CTEs ``nodes`` (props as a list of key=value rows: ``props``) and ``edges`` for oracles.
GRAPH_SQL = f"""nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS label, r_name AS name, 'verified' AS status, NULL::VARCHAR AS source FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'verified', NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'verified', c_mktsegment FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'verified', NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'verified', p_brand FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'Order#' || o_orderkey, {STATUS_SQL.format('o_orderstatus')}, o_orderpriority FROM orders
), props AS (
  SELECT 'nation:' || n_nationkey AS id, 'nation' AS label, 'regionkey' AS k, n_regionkey::VARCHAR AS v FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'acctbal', c_acctbal::DECIMAL(18,2)::VARCHAR FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'nationkey', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'acctbal', s_acctbal::DECIMAL(18,2)::VARCHAR FROM supplier
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'nationkey', s_nationkey::VARCHAR FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'brand', p_brand FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'type', p_type FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'size', p_size::VARCHAR FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'priority', o_orderpriority FROM orders
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders
), edges0 AS (
  SELECT 'nation:' || n_nationkey AS src_id, 'located_in' AS rel_type, 'region:' || n_regionkey AS dst_id, 'verified' AS status, 'base' AS scope FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'from', 'nation:' || c_nationkey, 'verified', 'base' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'from', 'nation:' || s_nationkey, 'verified', 'base' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'placed', 'order:' || o_orderkey, {STATUS_SQL.format('o_orderstatus')}, o_orderpriority FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey,
    CASE max(CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) WHEN 2 THEN 'rejected' WHEN 1 THEN 'verified' ELSE 'pending' END, min(year(l_shipdate))::VARCHAR FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey, 'verified', 'lineitem' FROM lineitem
), edges AS (
  SELECT src_id || '|' || rel_type || '|' || dst_id AS edge_id, * FROM edges0
)"""
