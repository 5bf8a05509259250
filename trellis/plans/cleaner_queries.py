"""Source cleaners over the test tables, which take the place of the sources' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terminology as T
from ..shared import cut
from .registry import query
from .views import table

GROUPS = ("传统医学疾病", "传统医学证候", "治则", "治法", "其他")
CLASSES = ("Medicinal flavor", "Therapeutic nature", "Meridian tropism")


#: Identifiers are as wide as keys can get, since five digits are not enough beyond sf0.4; nations are numbered above all keys.
DIGITS, NATIONS, FIRST_NATION = 18, 9 * 10**17, 90000


def _id(kind: str, key: str, shift: int = 0):
    return F.concat(F.lit(kind), F.lpad((F.col(key).cast("long") + shift).cast("string"), DIGITS, "0"))


def _shown(identifier: Column) -> Column:
    """An identifier as the source writes it: five digits."""
    n = F.regexp_extract(identifier, f"^[A-Z]+([0-9]{{{DIGITS}}})$", 1).try_cast("long")
    number = F.when(n >= NATIONS, n - NATIONS + FIRST_NATION).otherwise(n).cast("string")
    return F.when(n.isNull(), identifier).otherwise(F.concat(F.regexp_extract(identifier, "^[A-Z]+", 0), F.lpad(number, 5, "0")))


def terminology_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as terms, customers as formulas, suppliers as pieces, nations as properties and as diseases."""
    part, nation, customer, supplier = (table(spark, sf_dir, n) for n in ("part", "nation", "customer", "supplier"))
    none, lit = F.lit(""), F.lit
    group = F.element_at(F.array(*[lit(g) for g in GROUPS]), (F.col("p_size") % 5 + 1).cast("int"))
    text = lambda **c: [v.cast("string").alias(k) for k, v in c.items()]
    d1 = part.select(*text(record_no=F.col("p_partkey"), TCMT_ID=_id("TCMT", "p_partkey"), Chinese_group=group, English_group=none, Chinese_term=F.concat_ws(" ", "p_name", "p_partkey"), Pinyin_term=none, English_term=none, Chinese_synonyms=F.concat("p_brand", lit("|别名"), "p_partkey"), Synonyms=none, English_definition_description=F.col("p_type")))
    terms = nation.select(*text(record_no=F.col("n_nationkey") + FIRST_NATION, TCMT_ID=_id("TCMT", "n_nationkey", NATIONS), Chinese_group=lit("药性"), English_group=none, Chinese_term=F.concat(lit("性"), "n_name"), Pinyin_term=none, English_term=F.col("n_name"), Chinese_synonyms=none, Synonyms=none, English_definition_description=none))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_no"), "o_custkey", "l_partkey", "l_suppkey")
    named = part.select("p_partkey", group.alias("Chinese_group"), F.concat_ws(" ", "p_name", "p_partkey").alias("Chinese_term"))
    lines = cut(lines.join(named, F.col("l_partkey") == F.col("p_partkey"), "left"), "lines").withColumn("record_no", F.col("record_no").cast("string"))  # both kinds of pairs are read from one table of keys
    d3 = lines.where("p_partkey IS NOT NULL").select("record_no", _id("CPM", "o_custkey").alias("CPM_ID"), _id("TCMT", "l_partkey").alias("TCMT_ID"), "Chinese_group", none.alias("English_group"), "Chinese_term", none.alias("Pinyin_term"), none.alias("English_term"), none.alias("Synonyms"))
    class_ = F.element_at(F.array(*[lit(c) for c in CLASSES]), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return {
        "D1": d1.unionByName(terms),
        "D2": customer.select(*text(record_no=F.col("c_custkey"), CPM_ID=_id("CPM", "c_custkey"), Chinese_patent_medicine=F.col("c_name"), Routes_of_administration=F.col("c_mktsegment"))),
        "D3": d3,
        "D4": lines.select("record_no", _id("CPM", "o_custkey").alias("CPM_ID"), _id("CHP", "l_suppkey").alias("CHP_ID"), lit("0.5").alias("Dosage_ratio")),
        "D5": customer.select(*text(record_no=F.col("c_custkey"), CPM_ID=_id("CPM", "c_custkey"), ICD11_code=F.concat(lit("A"), "c_nationkey"))),
        "D6": supplier.select(*text(record_no=F.col("s_suppkey"), CHP_ID=_id("CHP", "s_suppkey"), Chinese_herbal_pieces=F.col("s_name"), Chinese_synonyms=none, English_term=none, Sources=lit("Viridiplantae"))),
        "D7": supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*text(record_no=F.col("s_suppkey"), CHP_ID=_id("CHP", "s_suppkey"), Medicinal_properties=F.col("n_name"), Class=class_)),
        "D18": nation.select(*text(record_no=F.col("n_nationkey"), ICD11_code=F.concat(lit("A"), "n_nationkey"), English_term=F.col("n_name"), Chinese_term=F.concat(lit("病"), "n_name"), ClassKind=lit("category"), ChapterNo=F.col("n_nationkey") + 1)),
    }


NODE_SQL = """n AS (SELECT CASE WHEN p_size % 5 < 2 THEN '病证' ELSE '治法' END AS node_type, p_name || ' ' || p_partkey AS node_name, 'D1:record:' || p_partkey AS refs, '别名' || p_partkey AS aliases, 'TCMT' || lpad(p_partkey::VARCHAR, 5, '0') AS stable_id FROM part WHERE p_size % 5 < 4
  UNION ALL SELECT CASE WHEN n_nationkey % 3 < 2 THEN '性味' ELSE '归经' END, '性' || n_name, 'D1:record:' || (90000 + n_nationkey), '', 'TCMT' || (90000 + n_nationkey) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT '方剂', c_name, 'D2:record:' || c_custkey, '', 'CPM' || lpad(c_custkey::VARCHAR, 5, '0') FROM customer
  UNION ALL SELECT '饮片', s_name, 'D6:record:' || s_suppkey, '', 'CHP' || lpad(s_suppkey::VARCHAR, 5, '0') FROM supplier
  UNION ALL SELECT '病证', '病' || n_name, 'D18:record:' || n_nationkey, '', 'A' || n_nationkey FROM nation WHERE n_nationkey < 20 AND n_nationkey IN (SELECT c_nationkey FROM customer))"""
EDGE_SQL = """l AS (SELECT *, l_orderkey * 10 + l_linenumber AS no FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
e0 AS (SELECT '方剂' AS node_type, c_name AS node_name, CASE p_size % 5 WHEN 0 THEN '适用于' WHEN 1 THEN '关联证候' ELSE '采用治法' END AS type, p_name || ' ' || p_partkey AS target, '' AS dosage_ratio, 'D3:record:' || no AS ref FROM l JOIN part ON l_partkey = p_partkey WHERE p_size % 5 < 4
  UNION ALL SELECT '方剂', c_name, '组成药材', s_name, '0.5', 'D4:record:' || no FROM l JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT '方剂', c_name, '适用于', '病' || n_name, '', 'D5:record:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20
  UNION ALL SELECT '饮片', s_name, CASE WHEN n_nationkey % 3 < 2 THEN '具有性味' ELSE '归于经脉' END, '性' || n_name, '', 'D7:record:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT node_type, node_name, type, target, min(dosage_ratio) AS dosage_ratio, string_agg(DISTINCT ref, ' || ' ORDER BY ref) AS evidence, count(*) AS n FROM e0 GROUP BY node_type, node_name, type, target)"""


@query(f"WITH {NODE_SQL} SELECT * FROM n")
def terminology_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.clean(terminology_tables(spark, sf_dir), DIGITS)[0]
    key = F.coalesce(*[F.col("props")[k] for k in ("tcmt_id", "cpm_id", "chp_id", "icd11_code")])
    return n.select("node_type", "node_name", F.array_join("evidence_refs", "|").alias("refs"), F.array_join("aliases", "|").alias("aliases"), _shown(key).alias("stable_id"))


@query(f"WITH {EDGE_SQL} SELECT * FROM e")
def terminology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clean(terminology_tables(spark, sf_dir), DIGITS)[1]


@query(f"""WITH {NODE_SQL}, {EDGE_SQL}, x AS (SELECT 'D1_group:其他' AS what FROM part WHERE p_size % 5 = 4 UNION ALL SELECT 'D1_group:药性' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'D3_group:其他' FROM l JOIN part ON l_partkey = p_partkey WHERE p_size % 5 = 4 UNION ALL SELECT 'D5_chapter:' || (c_nationkey + 1) FROM customer WHERE c_nationkey >= 20)
SELECT 'excluded' AS section, what, count(*) AS n FROM x GROUP BY what UNION ALL SELECT 'nodes', node_type, count(*) FROM n GROUP BY node_type UNION ALL SELECT 'edges', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'collapsed', type, (sum(n) - count(*))::BIGINT FROM e GROUP BY type HAVING sum(n) > count(*)
  UNION ALL SELECT 'rows', 'D1', (SELECT count(*) FROM part) + (SELECT count(*) FROM nation) UNION ALL SELECT 'rows', 'D2', count(*) FROM customer UNION ALL SELECT 'rows', 'D3', count(*) FROM l JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'rows', 'D4', count(*) FROM l
  UNION ALL SELECT 'rows', 'D5', count(*) FROM customer UNION ALL SELECT 'rows', 'D6', count(*) FROM supplier UNION ALL SELECT 'rows', 'D7', count(*) FROM supplier UNION ALL SELECT 'rows', 'D18', count(*) FROM nation""")
def terminology_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = terminology_tables(spark, sf_dir)
    n, e, x = T.clean(tables, DIGITS)
    return T.report(tables, n, e, x)


def _database(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as formulas (equal names merge or conflict, some list two), suppliers as herbs, nations as syndromes and
    symptoms, of which every fourth has the syndrome's name."""
    from ..operators.database import Entity, Relation, clean

    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    name = F.when(F.col("p_size") == 7, F.concat(F.lit("甲汤、"), "p_name", F.lit("丸"))).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    tables = {
        "herbs": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "formulas": part.select(F.col("p_partkey").alias("id"), name.alias("name"), "p_type"),
        "syndromes": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "symptoms": nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise(F.concat(F.lit("s "), "n_name")).alias("name")),
        "formula_herbs": table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_rowid"), "l_partkey", "l_suppkey", "l_returnflag"),
        "syndrome_symptoms": nation.select(F.col("n_nationkey").alias("_rowid"), F.col("n_nationkey").alias("syndrome_id"), F.col("n_nationkey").alias("symptom_id")),
    }
    entities = {"herbs": Entity("药材", {}), "formulas": Entity("方剂", {"p_type": "category"}, warned=True), "syndromes": Entity("病证", {}, fixed={"tcm_type": "来源标注证候"}), "symptoms": Entity("症状", {})}
    relations = {"formula_herbs": Relation(("formulas", "l_partkey"), ("herbs", "l_suppkey"), "组成药材", "l_returnflag"), "syndrome_symptoms": Relation(("syndromes", "syndrome_id"), ("symptoms", "symptom_id"), "关联症状", names_differ=True)}
    return clean(tables, entities, relations)


DATABASE_SQL = """f AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN '甲汤、' || p_name || '丸' ELSE p_name || ' ' || p_brand END AS name, p_type, p_size = 7 AS warned FROM part),
g AS (SELECT name, min(p_type) AS category, min(p_type) <> max(p_type) AS conflict, count(*) AS n_rows, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM f WHERE NOT warned GROUP BY name),
l AS (SELECT l_orderkey * 10 + l_linenumber AS rowid, g.name AS node_name, s_name AS target, l_returnflag AS dosage FROM lineitem LEFT JOIN f ON l_partkey = p_partkey LEFT JOIN g ON g.name = f.name AND NOT g.conflict AND NOT f.warned LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {DATABASE_SQL} SELECT '方剂' AS node_type, name AS node_name, category, ids, NULL AS tcm_type FROM g WHERE NOT conflict UNION ALL SELECT '药材', s_name, NULL, s_suppkey::VARCHAR, NULL FROM supplier UNION ALL SELECT '病证', n_name, NULL, n_nationkey::VARCHAR, '来源标注证候' FROM nation
UNION ALL SELECT '症状', CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE 's ' || n_name END, NULL, n_nationkey::VARCHAR, NULL FROM nation""")
def database_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark, sf_dir)[0].select("node_type", "node_name", F.col("props")["category"].alias("category"), F.array_join("ids", ",").alias("ids"), F.col("props")["tcm_type"].alias("tcm_type"))


@query(f"""WITH {DATABASE_SQL} SELECT rowid, '方剂' AS node_type, node_name, '组成药材' AS type, target, dosage FROM l WHERE node_name IS NOT NULL AND target IS NOT NULL UNION ALL SELECT n_nationkey, '病证', n_name, '关联症状', 's ' || n_name, NULL FROM nation WHERE n_nationkey % 4 <> 0""")
def database_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark, sf_dir)[1].select("rowid", "node_type", "node_name", "type", "target", "dosage")


@query(f"""WITH {DATABASE_SQL} SELECT '方剂' AS node_type, f.name AS node_name, 'formulas:' || p_partkey AS ref FROM f JOIN g ON g.name = f.name AND NOT g.conflict WHERE NOT warned UNION ALL SELECT '药材', s_name, 'herbs:' || s_suppkey FROM supplier
UNION ALL SELECT '病证', n_name, 'syndromes:' || n_nationkey FROM nation UNION ALL SELECT '症状', CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE 's ' || n_name END, 'symptoms:' || n_nationkey FROM nation""")
def database_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.database import evidence

    return evidence(_database(spark, sf_dir)[0])


@query(f"""WITH {DATABASE_SQL} SELECT 'name_warning_rows' AS route, count(*) AS n FROM f WHERE warned UNION ALL SELECT 'name_warning_events', count(*) + count_if(length(name) > 8 AND regexp_matches(name, '[。，.,；;：:！!？?]')) FROM f WHERE warned
UNION ALL SELECT 'conflicting_groups', count(*) FROM g WHERE conflict UNION ALL SELECT 'conflicting_rows', sum(n_rows)::BIGINT FROM g WHERE conflict UNION ALL SELECT 'nodes', (SELECT count(*) FROM g WHERE NOT conflict) + (SELECT count(*) FROM supplier) + 2 * (SELECT count(*) FROM nation)
UNION ALL SELECT 'quarantined_endpoint', count(*) FROM l WHERE node_name IS NULL OR target IS NULL UNION ALL SELECT 'same_name_edge', count(*) FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'edge', (SELECT count(*) FROM l WHERE node_name IS NOT NULL AND target IS NOT NULL) + (SELECT count(*) FROM nation WHERE n_nationkey % 4 <> 0)""")
def database_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark, sf_dir)[2]


ACCEPT_SQL = """k AS (SELECT *, p_partkey % 10 AS d, 'part:' || p_partkey AS pn FROM part),
r AS (SELECT 'u' || (p_partkey % 50) AS unit_id, CASE WHEN p_size = 50 THEN 'b2' ELSE 'b1' END AS batch_id, CASE d WHEN 0 THEN '医案' WHEN 1 THEN '方剂' WHEN 2 THEN '药材' WHEN 3 THEN '证据' WHEN 4 THEN '病证' WHEN 5 THEN '治法' ELSE '药材' END AS t,
  CASE WHEN d = 2 THEN pn || '汤' WHEN d = 3 AND p_size % 2 = 0 THEN '证据:' || pn WHEN d = 3 THEN '《' || pn WHEN d = 4 AND p_size < 3 THEN '杂病' WHEN d = 5 AND p_size < 10 THEN '炼气' ELSE pn END AS name, d, p_size,
  'part:' || (p_partkey - p_partkey % 10 + 4) AS disease, CASE WHEN d = 1 THEN '用 ' || p_size || 'g' ELSE '' END AS text FROM k),
e AS (SELECT t, name, CASE WHEN d IN (0, 1, 4) AND p_size % 3 = 0 THEN '治疗病证' WHEN d = 0 AND p_size % 3 = 1 THEN '使用方剂' WHEN d = 1 AND p_size % 3 = 1 THEN '组成药材' END AS type, disease AS target FROM r),
es AS (SELECT * FROM e WHERE type IS NOT NULL), has AS (SELECT DISTINCT name FROM r), dis AS (SELECT DISTINCT name FROM r WHERE t = '病证')"""


@query(f"""WITH {ACCEPT_SQL}, v AS (SELECT 'formula typed as 药材' AS rule FROM r WHERE d = 2 UNION ALL SELECT 'book titled as 证据' FROM r WHERE d = 3 AND p_size % 2 = 1 UNION ALL SELECT 'evidence name must start with 证据:' FROM r WHERE d = 3 AND p_size % 2 = 1
UNION ALL SELECT '病证 emitted 治疗病证' FROM es WHERE t = '病证' UNION ALL SELECT '治疗病证 from unsupported type' FROM es WHERE t = '病证' UNION ALL SELECT 'vague 病证' FROM r WHERE name = '杂病' UNION ALL SELECT 'forbidden 治法' FROM r WHERE name = '炼气'
UNION ALL SELECT '医案 missing 治疗病证' FROM r WHERE d = 0 AND p_size % 3 <> 0 UNION ALL SELECT '医案 missing intervention' FROM r WHERE d = 0 AND p_size % 3 <> 1 UNION ALL SELECT '方剂 missing 组成药材 despite dosage text' FROM r WHERE d = 1 AND p_size % 3 <> 1 UNION ALL SELECT 'batch_id mismatch' FROM r WHERE batch_id = 'b2'
UNION ALL SELECT 'missing units' FROM (VALUES ('u0'), ('none')) u(x) WHERE x NOT IN (SELECT unit_id FROM r) UNION ALL SELECT 'dangling targets' FROM es WHERE target NOT IN (SELECT name FROM has)
UNION ALL SELECT 'target of a wrong type' FROM es WHERE target IN (SELECT name FROM has) AND NOT (type = '治疗病证' AND target IN (SELECT name FROM dis)) UNION ALL SELECT 'knowledge nodes missing 来源于+由证据支持' FROM r WHERE t <> '证据')
SELECT rule, count(*) AS n FROM v GROUP BY rule""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as extracted records of several kinds, held against every rule of a release."""
    from ..functions.vocabulary import EDGE_TARGETS
    from ..operators import acceptance as A

    d, size, pn, c = F.col("p_partkey") % 10, F.col("p_size"), F.concat(F.lit("part:"), "p_partkey"), F.lit
    kind = F.when(d == 0, "医案").when(d == 1, "方剂").when(d == 3, "证据").when(d == 4, "病证").when(d == 5, "治法").otherwise("药材")
    name = F.when(d == 2, F.concat(pn, c("汤"))).when((d == 3) & (size % 2 == 0), F.concat(c("证据:"), pn)).when(d == 3, F.concat(c("《"), pn)).when((d == 4) & (size < 3), "杂病").when((d == 5) & (size < 10), "炼气").otherwise(pn)
    edge = F.when(d.isin(0, 1, 4) & (size % 3 == 0), "治疗病证").when((d == 0) & (size % 3 == 1), "使用方剂").when((d == 1) & (size % 3 == 1), "组成药材")
    target = F.concat(c("part:"), F.col("p_partkey") - d + 4)
    records = table(spark, sf_dir, "part").select(
        F.concat(c("u"), F.col("p_partkey") % 50).alias("unit_id"), F.when(size == 50, "b2").otherwise("b1").alias("batch_id"), kind.alias("node_type"), name.alias("node_name"),
        F.when(d == 1, F.concat(c("用 "), size.cast("string"), c("g"))).otherwise("").alias("evidence_text"), F.create_map().cast("map<string,string>").alias("props"),
        F.filter(F.array(F.struct(edge.alias("type"), target.alias("target"))), lambda e: e["type"].isNotNull()).alias("edges"),
    )
    units = spark.createDataFrame([("u0",), ("none",)], "unit_id string")
    return A.failures(A.broken(records, units, EDGE_TARGETS, "b1")).select("rule", "n")


IMPORT_SQL = """o AS (SELECT s_suppkey AS k, 'n' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE '' END AS grade FROM supplier),
r AS (SELECT p_partkey AS ordinal, 's' || (p_partkey % 3) AS source_id, 'b' || (p_partkey % 2) AS batch_id, p_brand AS grade, p_suppkey, kind FROM (SELECT *, p_partkey % 150 AS p_suppkey, p_partkey % 4 AS kind FROM part)),
m AS (SELECT r.*, CASE WHEN kind < 3 THEN o.id END AS node_id, CASE WHEN kind < 3 AND o.id IS NOT NULL THEN o.name WHEN kind = 3 THEN 'new ' || p_suppkey ELSE CASE kind WHEN 2 THEN 'alias ' || p_suppkey ELSE 'lost ' || p_suppkey END END AS name, o.grade AS old FROM r LEFT JOIN o ON o.k = p_suppkey),
w AS (SELECT node_id, name, any_value(CASE WHEN node_id IS NOT NULL THEN old END) AS old, arg_min(grade, ordinal) AS grade, count(*) AS n_records FROM m GROUP BY node_id, name),
s AS (SELECT node_id, name, string_agg(source_id, ',' ORDER BY o) AS source_ids FROM (SELECT node_id, name, source_id, min(ordinal) AS o FROM m GROUP BY ALL) GROUP BY node_id, name)"""


@query(f"""WITH {IMPORT_SQL} SELECT CASE WHEN w.node_id IS NULL THEN 'create' ELSE 'update' END AS action, w.node_id, w.name, CASE WHEN w.node_id IS NOT NULL AND old <> '' THEN old ELSE grade END AS grade, CASE WHEN w.node_id IS NOT NULL THEN 's9,' ELSE '' END || source_ids AS source_ids, n_records FROM w JOIN s ON w.name = s.name AND w.node_id IS NOT DISTINCT FROM s.node_id""")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records about suppliers: by name, by alias, and new ones."""
    from ..operators import importing as I

    sup, part, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"), F.lit
    existing = sup.select(
        F.concat(c("n"), "s_suppkey").alias("id"), c("supplier").alias("label"), F.col("s_name").alias("name"), F.array(F.concat(c("alias "), "s_suppkey")).alias("aliases"),
        F.create_map(c("grade"), F.when(F.col("s_suppkey") % 2 == 0, "old").otherwise("")).alias("props"), *[F.array(c("s9") if n == "source_ids" else c("x")).alias(n) for n in I.LISTS],
    )
    k, kind = (F.col("p_partkey") % 150).cast("string"), F.col("p_partkey") % 4
    named = part.join(sup.select(F.col("s_suppkey").alias("_k"), "s_name"), F.col("p_partkey") % 150 == F.col("_k"), "left")
    records = named.select(
        F.col("p_partkey").alias("ordinal"), c("supplier").alias("node_type"), F.when(kind < 2, F.coalesce("s_name", F.concat(c("lost "), k))).when(kind == 2, F.concat(c("alias "), k)).otherwise(F.concat(c("new "), k)).alias("node_name"),
        F.create_map(c("grade"), F.col("p_brand"), c("other"), c("dropped")).alias("props"), F.concat(c("s"), F.col("p_partkey") % 3).alias("source_id"), F.concat(c("b"), F.col("p_partkey") % 2).alias("batch_id"), c("scope").alias("import_scope_key"), c(None).cast("string").alias("prompt_hash"),
    )
    out = I.plan(I.prepared(records, {f"s{i}": f"sha256:{i}" for i in range(3)}, ["grade"]), existing)
    return out.select("action", "node_id", "name", F.col("props")["grade"].alias("grade"), F.array_join("source_ids", ",").alias("source_ids"), "n_records")
