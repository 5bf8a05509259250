"""JSON tables over the test tables: parts as herbs, customers as formulas, suppliers as conditions, lines as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compendium as C
from .registry import query
from .views import table

#: Every tenth part shares its surface with the next, which contradicts it at every twentieth; some customers have a herb's
#: name; suppliers share identifiers, have broken ones or another tag, and list symptoms of all kinds.
HERBS = """SELECT p_partkey + 1 AS row_no, CASE WHEN twin THEN concat('herb-', p_partkey - 1) ELSE concat('herb ', p_partkey) END AS name,
  CASE WHEN NOT twin THEN concat('["白', p_partkey, '","', p_brand, '","', p_brand, '"]') WHEN p_partkey % 20 = 1 THEN '[]' ELSE '["other"]' END AS synonyms,
  CASE WHEN twin THEN '[]' ELSE concat('["', p_type, '"]') END AS category, CASE WHEN twin THEN concat(char(123), char(125)) ELSE concat(char(123), '"size": ', p_size, ', "at": [1]', char(125)) END AS properties,
  '[]' AS actions, '[]' AS contraindications, '[]' AS interactions, '[]' AS incompatibility, '[]' AS notes, '[]' AS dosage, '[]' AS indications
FROM (SELECT *, p_partkey % 10 = 1 AS twin FROM {part})"""
FORMULAS = """SELECT c_custkey + 1 AS row_no, CASE WHEN c_custkey % 50 = 0 THEN concat('herb ', c_custkey) ELSE c_name END AS name, '[]' AS synonyms, '[]' AS actions, '[]' AS syndromes,
  concat('["', c_mktsegment, '"]') AS treats, '[]' AS contraindications, '[]' AS notes, concat(char(123), '"n": ', char(123), '"k": ', c_nationkey, char(125), char(125)) AS composition FROM {customer}"""
CONDITIONS = """SELECT s_suppkey + 1 AS row_no, concat(s_name, CASE WHEN s_suppkey % 4 = 3 THEN ' (FINDING)' ELSE ' (DISORDER)' END) AS name,
  concat('["', n_name, '", "SNOMED:', CASE WHEN s_suppkey % 25 = 7 THEN 'x' ELSE CAST(100000 + s_suppkey - CASE WHEN s_suppkey % 20 = 1 THEN 1 ELSE 0 END AS STRING) END, '"]') AS synonyms,
  concat('[', char(123), '"clinical_manifestations": ["', CASE WHEN s_suppkey % 2 = 1 THEN lower(n_name) ELSE n_name END, '", "Pain ', s_suppkey % 5, '", "cut...", "", 5, "pain ', s_suppkey % 5, '"]', char(125), ', 3, ', char(123), CASE WHEN s_suppkey % 6 = 0 THEN '"x": 1' ELSE '"clinical_manifestations": "no"' END, char(125), ']') AS symptoms,
  concat('d ', s_nationkey) AS description, '[]' AS herb_formulas, '[]' AS points FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""
RELATIONS = """SELECT l_orderkey * 10 + l_linenumber AS row_no, CASE WHEN l_linenumber % 3 = 0 THEN f ELSE d END AS source, CASE WHEN l_linenumber % 3 = 2 THEN f ELSE h END AS target,
  CASE WHEN l_linenumber % 3 = 0 THEN 'formula' ELSE 'condition' END AS source_type, CASE WHEN l_linenumber % 3 = 2 THEN 'formula' ELSE 'herb' END AS target_type,
  CASE WHEN l_linenumber % 3 = 0 THEN 'contains' ELSE 'treats' END AS edge_type, CASE WHEN l_partkey % 10 = 1 OR l_partkey % 2 = 0 THEN concat((l_partkey - CASE WHEN l_partkey % 10 = 1 THEN 1 ELSE 0 END) % 9, ' g') ELSE '' END AS dosage
FROM (SELECT *, CASE WHEN c_custkey % 50 = 0 THEN concat('herb ', c_custkey) WHEN l_linenumber % 2 = 0 THEN upper(c_name) ELSE c_name END AS f,
  CASE WHEN l_partkey % 10 = 1 THEN concat('HERB-', l_partkey - 1) ELSE concat('herb ', l_partkey) END AS h, concat(s_name, CASE WHEN s_suppkey % 4 = 3 THEN ' (FINDING)' ELSE ' (DISORDER)' END) AS d
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey)"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    views = {n: table(spark, sf_dir, n) for n in ("part", "customer", "supplier", "nation", "lineitem", "orders")}
    made = {"herbs": HERBS, "formulas": FORMULAS, "conditions": CONDITIONS, "relations": RELATIONS}
    return {k: spark.sql(sql, **{n: v for n, v in views.items() if f"{{{n}}}" in sql}) for k, sql in made.items()}


BASE = """h AS (SELECT *, p_partkey % 10 = 1 AS twin, p_partkey % 20 IN (0, 1) AS merged FROM part),
hn AS (SELECT p_partkey, CASE WHEN twin AND merged THEN 'herb ' || (p_partkey - 1) WHEN twin THEN 'herb-' || (p_partkey - 1) ELSE 'herb ' || p_partkey END AS name FROM h),
f AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'herb ' || c_custkey ELSE c_name END AS name, c_mktsegment, c_nationkey FROM customer),
d0 AS (SELECT *, s_suppkey % 4 = 3 AS finding, s_suppkey % 25 = 7 AS broken, s_name || CASE WHEN s_suppkey % 4 = 3 THEN ' (FINDING)' ELSE ' (DISORDER)' END AS name,
  CASE WHEN s_suppkey % 25 <> 7 THEN 100000 + s_suppkey - CASE WHEN s_suppkey % 20 = 1 THEN 1 ELSE 0 END END AS snomed FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT *, CASE WHEN count(snomed) OVER (PARTITION BY snomed) > 1 THEN 'duplicate_snomed_id:' || snomed WHEN broken THEN 'invalid_snomed_id' WHEN finding THEN 'unsupported_condition_tag:finding' END AS reason FROM d0),
m AS (SELECT s_suppkey, name, 1 AS i, CASE WHEN s_suppkey % 2 = 1 THEN lower(n_name) ELSE n_name END AS item FROM d WHERE reason IS NULL
  UNION ALL SELECT s_suppkey, name, 2, 'Pain ' || s_suppkey % 5 FROM d WHERE reason IS NULL UNION ALL SELECT s_suppkey, name, 6, 'pain ' || s_suppkey % 5 FROM d WHERE reason IS NULL),
ms AS (SELECT *, 'conditions:row:' || (s_suppkey + 1) || ':symptoms:1:clinical_manifestations:' || i AS ref, first(item) OVER (PARTITION BY lower(item) ORDER BY s_suppkey, i) AS target FROM m),
l AS (SELECT l_orderkey * 10 + l_linenumber AS no, l_linenumber % 3 AS k, hn.name AS herb, f.name AS formula, d.name AS condition, d.reason, CASE WHEN l_partkey % 10 = 1 OR l_partkey % 2 = 0 THEN (l_partkey - CASE WHEN l_partkey % 10 = 1 THEN 1 ELSE 0 END) % 9 || ' g' ELSE '' END AS dosage,
  l_partkey, c_custkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN f ON o_custkey = c_custkey JOIN hn ON l_partkey = p_partkey JOIN d ON l_suppkey = s_suppkey),
e0 AS (SELECT '方剂' AS node_type, formula AS node_name, '组成药材' AS type, herb AS target, dosage, 'relations:row:' || no AS ref, no AS o FROM l WHERE k = 0
  UNION ALL SELECT '病证', condition, '关联药材', herb, '', 'relations:row:' || no, no FROM l WHERE k = 1 AND reason IS NULL
  UNION ALL SELECT '病证', name, '关联症状', target, '', ref, s_suppkey * 10 + i FROM ms),
e AS (SELECT node_type, node_name, type, target, min(dosage) AS dosage, min_by(ref, o) AS ref, count(*) AS n FROM e0 GROUP BY node_type, node_name, type, target),
n AS (SELECT '药材' AS node_type, name AS node_name, CASE WHEN twin THEN 'other' WHEN merged AND p_partkey % 10 = 0 THEN '白' || p_partkey || '|' || p_brand || '|herb-' || p_partkey ELSE '白' || p_partkey || '|' || p_brand END AS aliases,
    CASE WHEN twin THEN '' ELSE p_type END AS category, '' AS indications, CASE WHEN NOT twin THEN '{"at":[1],"size":' || p_size || '}' END AS nature, NULL AS composition, NULL AS snomed_id FROM h JOIN hn USING (p_partkey) WHERE NOT (twin AND merged)
  UNION ALL SELECT '方剂', name, '', '', c_mktsegment, NULL, '{"n":{"k":' || c_nationkey || '}}', NULL FROM f
  UNION ALL SELECT '病证', name, n_name, '', '', NULL, NULL, snomed::VARCHAR FROM d WHERE reason IS NULL UNION ALL SELECT DISTINCT '症状', target, '', '', '', NULL, NULL, NULL FROM ms)"""


@query(f"WITH {BASE} SELECT * FROM n")
def compendium_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.clean(tables(spark, sf_dir))["nodes"]
    joined = lambda k: F.coalesce(F.array_join(F.try_element_at("lists", F.lit(k)), "|"), F.lit("")).alias(k)
    prop = lambda k, name: F.try_element_at("props", F.lit(k)).alias(name)
    return n.select("node_type", "node_name", F.array_join("aliases", "|").alias("aliases"), joined("category"), joined("indications"), prop("nature", "nature"), prop("composition_text", "composition"), prop("snomed_id", "snomed_id"))


@query(f"WITH {BASE} SELECT * FROM e")
def compendium_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean(tables(spark, sf_dir))["edges"]


@query(f"""WITH {BASE} SELECT '药材' AS node_type, name AS node_name, 'herbs:row:' || (p_partkey + 1) AS ref FROM hn UNION SELECT '方剂', name, 'formulas:row:' || (c_custkey + 1) FROM f UNION SELECT '病证', name, 'conditions:row:' || (s_suppkey + 1) FROM d WHERE reason IS NULL
  UNION SELECT '病证', name, ref FROM ms UNION SELECT '症状', target, ref FROM ms UNION SELECT node_type, node_name, ref FROM e0""")
def compendium_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean(tables(spark, sf_dir))["evidence"]


ASIDE = """a AS (SELECT 'condition' AS what, 'conditions:row:' || (s_suppkey + 1) AS ref, reason FROM d WHERE reason IS NOT NULL
  UNION ALL SELECT 'manifestation', 'conditions:row:' || (s_suppkey + 1) || ':symptoms:' || p, r FROM d, (VALUES ('1:clinical_manifestations:3', 'truncated_manifestations'), ('1:clinical_manifestations:4', 'empty_manifestations'), ('1:clinical_manifestations:5', 'non_string_manifestations'), ('2', 'invalid_pattern_objects')) v(p, r) WHERE reason IS NULL
  UNION ALL SELECT 'manifestation', 'conditions:row:' || (s_suppkey + 1) || ':symptoms:3', CASE WHEN s_suppkey % 6 = 0 THEN 'missing_manifestation_lists' ELSE 'invalid_manifestation_lists' END FROM d WHERE reason IS NULL
  UNION ALL SELECT 'relation', 'relations:row:' || no, reason FROM l WHERE k > 0 AND reason IS NOT NULL UNION ALL SELECT 'relation', 'relations:row:' || no, 'no_neutral_formula_association_edge' FROM l WHERE k = 2 AND reason IS NULL)"""


@query(f"WITH {BASE}, {ASIDE} SELECT * FROM a")
def compendium_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean(tables(spark, sf_dir))["set_aside"]


@query(f"""WITH {BASE}, {ASIDE}, x AS (SELECT l.*, c_custkey % 50 <> 0 AND l_linenumber % 2 = 0 AS upper_f, l_partkey % 10 = 1 AS upper_h, l_partkey % 20 = 1 AS moved_h FROM l WHERE k = 0 OR reason IS NULL)
SELECT 'rows' AS section, 'herbs' AS what, count(*) AS n FROM part UNION ALL SELECT 'rows', 'formulas', count(*) FROM customer UNION ALL SELECT 'rows', 'conditions', count(*) FROM supplier
  UNION ALL SELECT 'relations', CASE k WHEN 0 THEN 'formula->herb->contains' WHEN 1 THEN 'condition->herb->treats' ELSE 'condition->formula->treats' END, count(*) FROM l GROUP BY k
  UNION ALL SELECT 'tags', CASE WHEN finding THEN 'finding' ELSE 'disorder' END, count(*) FROM d GROUP BY finding UNION ALL SELECT 'snomed', 'all_with_id', count(*) FROM d WHERE snomed IS NOT NULL UNION ALL SELECT 'snomed', 'accepted_with_id', count(*) FROM d WHERE reason IS NULL
  UNION ALL SELECT 'surfaces', CASE WHEN merged THEN 'herbs:merged' ELSE 'herbs:conflict' END, count(*) FROM h WHERE twin GROUP BY merged UNION ALL SELECT 'edges', type, count(*) FROM e GROUP BY type
  UNION ALL SELECT 'set_aside', what || ':' || reason, count(*) FROM a GROUP BY what, reason UNION ALL SELECT 'collapsed', type, (sum(n) - count(*))::BIGINT FROM e GROUP BY type HAVING sum(n) > count(*)
  UNION ALL SELECT 'names', 'herb_and_formula', count(*) FROM f WHERE c_custkey % 50 = 0 UNION ALL SELECT 'names', 'chinese_alias_herb_rows', count(*) FROM h WHERE NOT twin
  UNION ALL SELECT 'ends', 'other_case', (SELECT count(*) FROM x WHERE k <> 1 AND upper_f) + (SELECT count(*) FROM x WHERE k <> 2 AND upper_h AND NOT moved_h) UNION ALL SELECT 'ends', 'other_surface', count(*) FROM x WHERE k <> 2 AND moved_h""")
def compendium_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.report(C.clean(tables(spark, sf_dir)))
