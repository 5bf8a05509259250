"""Typed triples over the test tables: suppliers as herbs, customers as formula names, orders as prescriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prescriptions as P
from .registry import query
from .views import table


def triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every third order is listed by no name, so that only its numbered base tells the name; every second supplier has a
    dose; lines of an order are numbered by place, as their own numbers repeat."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = lambda at, left, relation, right: F.struct(at.cast("long").alias("line_no"), left.alias("node_1"), F.lit(relation).alias("relation"), right.alias("node_2"))
    kind = lambda k, *v: F.concat(F.lit(f"{k}\t"), *v)
    herb, at, key = kind("中药名", "s_name"), F.col("s_suppkey") * 10, F.col("s_suppkey").cast("string")
    herbs = s.select(F.explode(F.array(
        row(at, F.lit("中药材\t中药材"), "include", herb), row(at + 1, herb, "another name", kind("别名", F.lit("a"), key)), row(at + 2, herb, "another name", kind("别名", F.lit("b"), key)),
        row(at + 3, herb, "distribution area", kind("分布", "n_name")), row(at + 4, herb, "functions", kind("功能", F.lit("f"), (F.col("s_suppkey") % 50).cast("string"))),
        row(at + 5, herb, "attending", kind("主治", "n_name")), row(at + 6, herb, "four properties", kind("四气", F.lit("q"), F.col("n_regionkey").cast("string"))),
        row(at + 7, herb, "five flavors", kind("五味", F.lit("q"), (F.col("s_suppkey") % 5).cast("string"))), row(at + 8, herb, "channel tropism", kind("归经", F.lit("c"), (F.col("s_suppkey") % 12).cast("string"))),
        row(at + 9, herb, "from", kind("来源", F.lit("book"), (F.col("s_suppkey") % 7).cast("string"))),
    )).alias("r")).select("r.*")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "o_orderstatus", "c_name")
    # an order meets its lines as keys, once; the first of them, or none, brings the order's own facts
    place = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey)")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", place.alias("place"))
    known = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")
    rows = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    recipe, name, at = F.concat("c_name", F.lit("_"), F.col("o_orderkey").cast("string")), kind("方名", "c_name"), F.col("o_orderkey") * 1000
    listed = F.array(row(at, name, "prescription type", kind("处方", recipe)), row(at + 1, name, "another name", kind("别名", "o_orderpriority")), row(at + 2, name, "from", kind("来源", "o_orderstatus")))
    heals = F.array(row(at + 3, kind("处方", recipe), "functions", kind("功能主治", "o_orderpriority")))
    facts = F.when(F.coalesce("place", F.lit(1)) > 1, F.array()).when(F.col("o_orderkey") % 3 != 0, F.concat(listed, heals)).otherwise(heals)
    line = at + 10 + 2 * F.col("place")
    made = row(line, kind("处方", recipe), "composition", herb)
    dose = row(line + 1, herb, "dose", kind("剂量", (F.col("s_suppkey") % 9).cast("string"), F.lit("克")))
    said = F.when(F.col("s_suppkey").isNull(), F.array()).when(F.col("s_suppkey") % 2 == 0, F.array(made, dose)).otherwise(F.array(made))
    return herbs, rows.select(F.explode(F.concat(facts, said)).alias("r")).select("r.*")


EDGES = """s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
o AS (SELECT *, c_name || '_' || o_orderkey AS recipe, o_orderkey % 3 <> 0 AS listed FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT recipe, s_suppkey, s_name FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT c_name, count(*) AS n_p, count(DISTINCT o_orderstatus) AS n_s FROM o WHERE listed GROUP BY c_name),
e0 AS (SELECT '药材' AS node_type, s_name AS node_name, '具有功效' AS type, '功效' AS target_type, 'f' || s_suppkey % 50 AS target, '' AS dosage FROM s
  UNION ALL SELECT '药材', s_name, '治疗病证', '病证', n_name, '' FROM s UNION ALL SELECT '药材', s_name, '具有性味', '性味', 'q' || n_regionkey, '' FROM s UNION ALL SELECT '药材', s_name, '具有性味', '性味', 'q' || s_suppkey % 5, '' FROM s
  UNION ALL SELECT '药材', s_name, '归于经脉', '归经', 'c' || s_suppkey % 12, '' FROM s UNION ALL SELECT '药材', s_name, '来源于', '来源', 'book' || s_suppkey % 7, '' FROM s
  UNION ALL SELECT '方剂', recipe, '组成药材', '药材', s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 9 || '克' ELSE '' END FROM l
  UNION ALL SELECT '方剂', recipe, '治疗病证', '病证', o_orderpriority, '' FROM o
  UNION ALL SELECT DISTINCT '方剂', a.recipe, '来源于', '来源', b.o_orderstatus, '' FROM o a JOIN g USING (c_name) JOIN o b USING (c_name) WHERE b.listed AND (n_p = 1 OR n_s = 1)),
e AS (SELECT node_type, node_name, type, target_type, target, min(dosage) AS dosage, count(*) AS n FROM e0 GROUP BY ALL EXCEPT dosage)""".replace("GROUP BY ALL EXCEPT dosage", "GROUP BY node_type, node_name, type, target_type, target")
NODES = """k AS (SELECT node_type, node_name FROM e UNION SELECT target_type, target FROM e),
a AS (SELECT '药材' AS node_type, s_name AS node_name, 'a' || s_suppkey || '|b' || s_suppkey AS aliases FROM s
  UNION ALL SELECT '方剂', recipe, aliases FROM o JOIN (SELECT c_name, string_agg(p, '|' ORDER BY first) AS aliases FROM (SELECT c_name, o_orderpriority AS p, min(o_orderkey) AS first FROM o WHERE listed GROUP BY 1, 2) GROUP BY 1) z USING (c_name)),
n AS (SELECT k.*, CASE node_type WHEN '方剂' THEN split_part(node_name, '_', 1) END AS formula_name, coalesce(aliases, '') AS aliases, coalesce(n_name, '') AS origin
  FROM k LEFT JOIN a USING (node_type, node_name) LEFT JOIN s ON node_type = '药材' AND s_name = node_name)"""


@query(f"WITH {EDGES}, {NODES} SELECT * FROM n")
def prescription_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.clean(*triples(spark, sf_dir))[0]
    return n.select("node_type", "node_name", "formula_name", F.array_join("aliases", "|").alias("aliases"), F.array_join("origin", "|").alias("origin"))


@query(f"WITH {EDGES} SELECT * FROM e")
def prescription_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clean(*triples(spark, sf_dir))[1]


HERB_LINES = ", ".join(f"('{r}', {n})" for r, n in {"include": 1, "another name": 2, "distribution area": 1, "functions": 1, "attending": 1, "four properties": 1, "five flavors": 1, "channel tropism": 1, "from": 1}.items())


@query(f"""WITH {EDGES}, {NODES} SELECT 'herbs' AS section, what, (SELECT count(*) FROM s) * k AS n FROM (VALUES {HERB_LINES}) v(what, k)
  UNION ALL SELECT 'formulas', what, count(*) FROM o, (VALUES ('prescription type'), ('another name'), ('from')) v(what) WHERE listed GROUP BY what UNION ALL SELECT 'formulas', 'functions', count(*) FROM o
  UNION ALL SELECT 'formulas', 'composition', count(*) FROM l UNION ALL SELECT 'formulas', 'dose', count(*) FROM l WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'nodes', node_type, count(*) FROM n GROUP BY node_type UNION ALL SELECT 'edges', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'dosed', type, count(*) FROM e WHERE dosage <> '' GROUP BY type
  UNION ALL SELECT 'repeated', type, (sum(n) - count(*))::BIGINT FROM e GROUP BY type HAVING sum(n) > count(*)""")
def prescription_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clean_report(*triples(spark, sf_dir))
