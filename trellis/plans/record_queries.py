"""Queries on records: identity, merging, resolution, publishing, statistics, quality, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bags
from ..functions import text as X
from ..operators import graph as G
from ..operators import links as L
from ..operators import records as R
from .registry import query
from .views import GRAPH_SQL, edges, links, node_tables, nodes, table

# Parts seen as entity drafts: a name is the type's last word and the brand, the stable id the size.
DRAFT_SQL = """d AS (SELECT p_partkey AS ordinal, 'herb' AS node_type, split_part(p_type, ' ', -1) || ' ' || p_brand AS node_name, p_size::VARCHAR AS stable_id,
  split_part(p_type, ' ', 1) AS parent_name, p_name AS alias, p_brand AS brand, split_part(p_name, ' ', 1) AS finish FROM part)"""


# The same with sizes by tens as ids, so that identities meet whose finishes conflict.
COARSE_SQL = DRAFT_SQL.replace("p_size::VARCHAR", "(p_size // 10)::VARCHAR")


def drafts(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    words, size = F.split("p_type", " "), F.floor(F.col("p_size") / 10) if coarse else F.col("p_size")
    props = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("finish"), F.element_at(F.split("p_name", " "), 1))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.lit("herb").alias("node_type"), F.concat_ws(" ", F.element_at(words, -1), "p_brand").alias("node_name"), size.cast("string").alias("stable_id"), F.element_at(words, 1).alias("parent_name"), F.array("p_name").alias("aliases"), F.array(F.concat(F.lit("part:"), "p_partkey")).alias("evidence_refs"), props.alias("props"))


@query(f"""WITH {DRAFT_SQL}, a AS (SELECT node_name, stable_id, alias, min(ordinal) AS o FROM d GROUP BY ALL), al AS (SELECT node_name, stable_id, string_agg(alias, '|' ORDER BY o) AS aliases FROM a GROUP BY ALL),
g AS (SELECT node_type, node_name, stable_id, min(ordinal) AS ordinal, count(*) AS n_merged, arg_min(finish, ordinal) FILTER (finish <> '') AS finish, any_value(brand) AS brand FROM d GROUP BY ALL) SELECT g.*, aliases FROM g JOIN al USING (node_name, stable_id)""")
def identity_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of one identity become one; the first non-empty value of a property stays."""
    out = R.merge_lenient(drafts(spark, sf_dir))
    return out.select("node_type", "node_name", "stable_id", "ordinal", "n_merged", F.col("props")["finish"].alias("finish"), F.col("props")["brand"].alias("brand"), F.array_join("aliases", "|").alias("aliases"))


@query(f"""WITH {COARSE_SQL} SELECT node_name, stable_id, 'finish' AS prop, string_agg(DISTINCT finish, ',' ORDER BY finish) AS "values" FROM d WHERE finish <> '' GROUP BY node_name, stable_id HAVING count(DISTINCT finish) > 1""")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conflicts(drafts(spark, sf_dir, coarse=True)).select("node_name", "stable_id", "prop", F.array_join("values", ",").alias("values"))


@query(f"""WITH {COARSE_SQL}, bad AS (SELECT node_name, stable_id FROM d WHERE finish <> '' GROUP BY ALL HAVING count(DISTINCT finish) > 1)
SELECT CASE WHEN b.node_name IS NULL THEN 'kept' ELSE 'quarantined' END AS route, count(*) AS n FROM d LEFT JOIN bad b USING (node_name, stable_id) GROUP BY 1""")
def identity_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = R.quarantine_conflicts(drafts(spark, sf_dir, coarse=True))
    return good.select(F.lit("kept").alias("route")).unionByName(bad.select(F.lit("quarantined").alias("route"))).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DRAFT_SQL}, m AS (SELECT node_name, stable_id, arg_min(parent_name, ordinal) AS parent_name FROM d GROUP BY ALL),
s AS (SELECT node_name, count(DISTINCT stable_id) AS n, count(DISTINCT nullif(trim(parent_name), '')) AS p FROM m GROUP BY node_name)
SELECT node_name, stable_id, CASE WHEN n <= 1 THEN node_name WHEN p = n THEN node_name || '（' || parent_name || '）' ELSE node_name || '〔' || stable_id || '〕' END AS display_name FROM m JOIN s USING (node_name)""")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drafts(spark, sf_dir).groupBy("node_type", "node_name", "stable_id").agg(F.min_by("parent_name", "ordinal").alias("parent_name"))
    return R.display_names(m).select("node_name", "stable_id", "display_name")


# Spellings: part names with dashes or blanks, which share a surface key.
VARIANT_SQL = """v AS (SELECT p_partkey AS ordinal, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN replace(p_type, ' ', '-') ELSE p_type || '.' END AS value FROM part),
k AS (SELECT *, regexp_replace(regexp_replace(value, '\\s+', '', 'g'), '[().,;:!?_~-]', '', 'g') AS surface FROM v)"""


@query(f"""WITH {VARIANT_SQL}, c AS (SELECT surface, value, count(*) AS n, min(ordinal) AS f FROM k GROUP BY ALL)
SELECT surface, value, n, first_value(value) OVER (PARTITION BY surface ORDER BY 10 * n DESC, length(value) DESC, ascii(value), f) AS canonical FROM c""")
def near_dup_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    value = F.when(k == 0, F.col("p_type")).when(k == 1, F.replace("p_type", F.lit(" "), F.lit("-"))).otherwise(F.concat("p_type", F.lit(".")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), value.alias("value"))
    rows = rows.withColumn("surface", X.surface_key(F.col("value"), unicode=False))
    return R.canonical_variants(rows).select("surface", "value", "n", "canonical")


PLAN_SQL = f"""{GRAPH_SQL}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id),
r AS (SELECT n.id, regexp_replace(n.name, '[0-9]$', '') AS surface, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg USING (id) WHERE label = 'customer'),
plan AS (SELECT id, surface, first_value(id) OVER (PARTITION BY surface ORDER BY degree DESC, id) AS keep_id, count(*) OVER (PARTITION BY surface) AS n FROM r)"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    degree = G.both_ways(e).groupBy(F.col("cur").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return R.merge_plan(n.where("label = 'customer'"), degree, F.regexp_replace("name", "[0-9]$", "")), e


@query(f"WITH {PLAN_SQL} SELECT id, keep_id FROM plan WHERE n > 1")
def near_dup_node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[0].select("id", "keep_id")


@query(f"""WITH {PLAN_SQL}, m AS (SELECT id, keep_id FROM plan WHERE n > 1 AND id <> keep_id)
SELECT coalesce(a.keep_id, src_id) AS src_id, rel_type, coalesce(b.keep_id, dst_id) AS dst_id, count(*) AS n_merged FROM edges e LEFT JOIN m a ON a.id = src_id LEFT JOIN m b ON b.id = dst_id
WHERE rel_type IN ('placed', 'from') GROUP BY 1, 2, 3""")
def merge_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, e = _plan(spark, sf_dir)
    return R.repoint(e.where(F.col("rel_type").isin("placed", "from")), plan).select("src_id", "rel_type", "dst_id", "n_merged")


@query(f"""WITH {DRAFT_SQL} SELECT a.node_name, nullif(coalesce(nullif(a.finish, ''), b.finish), '') AS finish, b.brand AS extra FROM (SELECT node_name, arg_min(finish, ordinal) AS finish FROM d WHERE ordinal % 2 = 0 GROUP BY 1) a
  JOIN (SELECT node_name, arg_min(finish, ordinal) AS finish, arg_min(brand, ordinal) AS brand FROM d WHERE ordinal % 2 = 1 GROUP BY 1) b USING (node_name)""")
def fill_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a record; the older one is filled where it is empty."""
    d = drafts(spark, sf_dir)
    pick = lambda odd, bag: d.where(F.col("ordinal") % 2 == odd).groupBy("node_name").agg(F.min_by(bag, "ordinal").alias(f"p{odd}"))
    old = pick(0, F.create_map(F.lit("finish"), F.col("props")["finish"]))
    new = pick(1, F.create_map(F.lit("finish"), F.col("props")["finish"], F.lit("extra"), F.col("props")["brand"]))
    filled = bags.fill_if_empty(F.col("p0"), F.col("p1"))
    return old.join(new, "node_name").withColumn("f", filled).select("node_name", F.col("f")["finish"].alias("finish"), F.col("f")["extra"].alias("extra"))


def documents_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the name, the second word of the text an edge."""
    d = table(spark, sf_dir, "documents")
    line = F.left(F.trim(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)), F.lit(40))
    edges_ = F.when(F.col("doc_id") % 3 == 0, F.array()).otherwise(F.array(F.struct(F.lit("in_language").alias("type"), F.col("lang").alias("target"), F.create_map(F.lit("evidence_ref"), F.concat(F.lit("doc:"), "doc_id")).alias("props")), F.struct(F.lit("from_source").alias("type"), F.col("source").alias("target"), F.create_map(F.lit("dosage"), F.col("n_chars").cast("string")).alias("props")))).cast("array<struct<type:string,target:string,props:map<string,string>>>")
    return d.select(F.col("source").alias("source_id"), F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string")).alias("batch_id"), F.col("doc_id").cast("string").alias("unit_id"), F.col("doc_id").alias("ordinal"), F.col("lang").alias("node_type"), line.alias("node_name"), F.array(F.concat(F.lit("doc:"), "doc_id")).alias("evidence_refs"), F.lit("").alias("evidence_text"), F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang")).alias("props"), edges_.alias("edges"))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().where("source_id <> 'src3'")
    return s.withColumn("release_tier", F.when(F.substring("source_id", -1, 1).isin("1", "3", "5", "7", "9"), "public").otherwise("restricted"))


META_SQL = "m AS (SELECT DISTINCT source AS source_id, CASE WHEN right(source, 1) IN ('1', '3', '5', '7', '9') THEN 'public' ELSE 'restricted' END AS release_tier FROM documents WHERE source <> 'src3')"
NAME_SQL = "left(trim(string_split(coalesce(text, ''), chr(10))[1], ' '), 40)"


@query(f"""WITH {META_SQL} SELECT source AS source_id, 'b' || (doc_id % 4) AS batch_id, doc_id::VARCHAR AS unit_id, lang AS node_type, {NAME_SQL} AS node_name, 'doc:' || doc_id AS refs,
  '{{"lang":"' || lang || '","n_chars":"' || n_chars || '"}}' AS properties_json, coalesce(m.release_tier, '') AS release_tier FROM documents d LEFT JOIN m ON m.source_id = d.source""")
def records_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = R.to_tables(documents_as_records(spark, sf_dir), _meta(spark, sf_dir))
    return r.select(*R.RECORD_KEY, F.array_join("evidence_refs", ",").alias("refs"), "properties_json", "release_tier")


@query(f"""WITH {META_SQL} SELECT d.doc_id::VARCHAR AS unit_id, t AS edge_type, CASE t WHEN 'in_language' THEN lang ELSE source END AS target, CASE t WHEN 'from_source' THEN n_chars::VARCHAR END AS dosage,
  CASE t WHEN 'in_language' THEN 'doc:' || doc_id END AS evidence_ref, coalesce(m.release_tier, '') AS release_tier FROM documents d CROSS JOIN (VALUES ('in_language'), ('from_source')) x(t) LEFT JOIN m ON m.source_id = d.source WHERE doc_id % 3 <> 0""")
def edges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = R.to_tables(documents_as_records(spark, sf_dir), _meta(spark, sf_dir))
    return e.select("unit_id", "edge_type", "target", "dosage", "evidence_ref", "release_tier")


@query(f"SELECT doc_id::VARCHAR AS unit_id, {NAME_SQL} AS node_name, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END::INT AS n_edges, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || ',' || lang END AS targets FROM documents")
def records_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = R.from_tables(*R.to_tables(documents_as_records(spark, sf_dir), _meta(spark, sf_dir)))
    return back.select("unit_id", "node_name", F.size("edges").alias("n_edges"), F.array_join(F.col("edges.target"), ",").alias("targets"))


TARGET_SQL = """e AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_key, CASE WHEN l_linenumber % 3 = 0 THEN 'stored' WHEN l_linenumber % 3 = 1 THEN 'made_of' ELSE 'unknown' END AS type, CASE WHEN l_linenumber % 2 = 0 THEN 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') ELSE p_name END AS target FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
t AS (SELECT 'part' AS node_type, p_name AS node_name, min('part:' || p_partkey) AS id FROM part GROUP BY p_name UNION ALL SELECT 'supplier', s_name, min('supplier:' || s_suppkey) FROM supplier GROUP BY s_name),
y AS (SELECT * FROM (VALUES ('made_of', 1, 'part'), ('made_of', 2, 'supplier'), ('stored', 1, 'supplier')) v(type, rank, node_type)),
b AS (SELECT edge_key, arg_min(t.id, y.rank) AS target_id FROM e JOIN y USING (type) JOIN t ON t.node_type = y.node_type AND t.node_name = e.target GROUP BY edge_key)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    e = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_key"), F.when(n % 3 == 0, "stored").when(n % 3 == 1, "made_of").otherwise("unknown").alias("type"), F.when(n % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))).otherwise(F.col("p_name")).alias("target"))
    t = nodes(spark, sf_dir).where(F.col("label").isin("part", "supplier")).groupBy(F.col("label").alias("node_type"), F.col("name").alias("node_name")).agg(F.min("id").alias("id"))
    y = spark.sql("SELECT * FROM VALUES ('made_of', 1, 'part'), ('made_of', 2, 'supplier'), ('stored', 1, 'supplier') AS t(type, rank, node_type)")
    return R.resolve_targets(e, t, y)


@query(f"WITH {TARGET_SQL} SELECT DISTINCT e.edge_key, e.type, b.target_id FROM e LEFT JOIN b USING (edge_key)")
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate types in order, the first that has the name; unknown types resolve to nothing."""
    return _resolved(spark, sf_dir).select("edge_key", "type", "target_id").distinct()


@query(f"WITH {TARGET_SQL} SELECT e.type, count(*) AS n_edges, count(*) - count(b.target_id) AS n_dangling FROM e LEFT JOIN b USING (edge_key) GROUP BY e.type")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("target_id").isNull()).alias("n_dangling"))


@query(f"WITH {GRAPH_SQL} SELECT label, rel_type, l2 AS target_label, count(*) AS n, count(DISTINCT e.src_id) AS n_sources FROM edges e JOIN (SELECT id, label FROM nodes) a ON a.id = e.src_id JOIN (SELECT id, label AS l2 FROM nodes) b ON b.id = e.dst_id GROUP BY ALL")
def bulk_edge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bulk file for each (source label, relation, target label)."""
    return L.link_counts(links(spark, sf_dir), node_tables(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, s AS (SELECT src_id, string_agg(replace(scope, ';', ' '), ';' ORDER BY scope) AS scopes FROM (SELECT DISTINCT src_id, scope FROM edges) GROUP BY src_id)
SELECT n.id AS admin_id, label, name, coalesce(scopes, '') AS scopes FROM nodes n LEFT JOIN s ON s.src_id = n.id""")
def bulk_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    scopes = e.groupBy(F.col("src_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("scope")), lambda s: F.replace(s, F.lit(";"), F.lit(" "))), ";").alias("scopes"))
    return n.join(scopes, "id", "left").select(F.col("id").alias("admin_id"), "label", "name", F.coalesce("scopes", F.lit("")).alias("scopes"))


@query("""WITH r AS (SELECT 'b' || (doc_id % 4) AS batch_id, lang, doc_id % 3 <> 0 AS has FROM documents),
x AS (SELECT 'node' AS kind, lang AS type, batch_id, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'edge', t, batch_id, count(*) FROM r CROSS JOIN (VALUES ('in_language'), ('from_source')) y(t) WHERE has GROUP BY ALL)
SELECT kind, type, batch_id, n::BIGINT AS n FROM x UNION ALL SELECT kind, type, '*', sum(n)::BIGINT FROM x GROUP BY kind, type""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by node and edge type, by batch and over all."""
    return R.stats(documents_as_records(spark, sf_dir))


@query("""SELECT count(*) AS records, count(DISTINCT (source, doc_id)) AS units, count(DISTINCT source) AS sources, string_agg(DISTINCT lang, ',' ORDER BY lang) AS node_types FROM documents""")
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_records(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_id", "unit_id").alias("units"), F.count_distinct("source_id").alias("sources"), F.array_join(F.array_sort(F.collect_set("node_type")), ",").alias("node_types"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source, n_chars, {NAME_SQL} AS name FROM documents)
SELECT 'empty_name' AS rule, doc_id AS key, '' AS detail FROM d WHERE trim(name, ' ') = '' UNION ALL SELECT 'short_text', doc_id, n_chars::VARCHAR FROM d WHERE length(t) < 40
UNION ALL SELECT 'unknown_type', doc_id, lang FROM d WHERE lang NOT IN ('en', 'fr', 'de') UNION ALL SELECT 'count_differs', doc_id, n_chars::VARCHAR FROM d WHERE n_chars <> length(t)""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit(""))).withColumn("name", F.left(F.trim(F.element_at(F.split("t", "\n"), 1)), F.lit(40)))
    return R.violations(d, "doc_id", {
        "empty_name": (F.trim("name") == "", F.lit("")),
        "short_text": (F.length("t") < 40, F.col("n_chars")),
        "unknown_type": (~F.col("lang").isin("en", "fr", "de"), F.col("lang")),
        "count_differs": (F.col("n_chars") != F.length("t"), F.col("n_chars")),
    })


@query("""SELECT lang, count(*) AS n_groups, sum(c - 1)::BIGINT AS n_extra, max(c) AS largest FROM (SELECT lang, text, count(*) AS c FROM documents GROUP BY ALL HAVING count(*) > 1) GROUP BY lang""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; compared by digest, so texts are not shuffled."""
    g = table(spark, sf_dir, "documents").groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return g.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("c") - 1).alias("n_extra"), F.max("c").alias("largest"))


@query("""WITH p AS (SELECT source, left(string_split(coalesce(text, ''), ' ')[1], 12) AS prefix, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, prefix) AS rank FROM p)
SELECT source, prefix, n, rank::INT AS rank FROM r WHERE rank <= 12""")
def top_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "documents").groupBy("source", F.left(F.element_at(F.split(F.coalesce("text", F.lit("")), " "), 1), F.lit(12)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "prefix"))).where("rank <= 12")


LINEAGE_SQL = f"""{GRAPH_SQL}, ev AS (SELECT src_id AS evidence, dst_id AS entity FROM edges WHERE rel_type = 'contains'), so AS (SELECT dst_id AS evidence, src_id AS source FROM edges WHERE rel_type = 'placed')"""


@query(f"""WITH {LINEAGE_SQL} SELECT entity, min(evidence) AS evidence, min_by(source, evidence) AS source FROM ev JOIN so USING (evidence) GROUP BY entity""")
def entity_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's first evidence (the order that holds it) and that one's source (the customer)."""
    e = edges(spark, sf_dir, ("contains", "placed"))
    ev = e.where("rel_type = 'contains'").select(F.col("src_id").alias("evidence"), F.col("dst_id").alias("entity"))
    so = e.where("rel_type = 'placed'").select(F.col("dst_id").alias("evidence"), F.col("src_id").alias("source"))
    return ev.join(so, "evidence").groupBy("entity").agg(F.min("evidence").alias("evidence"), F.min_by("source", "evidence").alias("source"))


@query(f"""WITH {LINEAGE_SQL}, direct AS (SELECT source, evidence AS entity FROM so), ind AS (SELECT DISTINCT source, entity FROM ev JOIN so USING (evidence))
SELECT kind, count(*) AS n, count(DISTINCT source) AS n_sources FROM (SELECT 'direct' AS kind, * FROM direct UNION SELECT 'indirect', * FROM ind i WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.source = i.source AND d.entity = i.entity)) GROUP BY kind""")
def source_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source gave directly, and what only through evidence (anti-joined against the direct)."""
    e = edges(spark, sf_dir, ("contains", "placed"))
    ev = e.where("rel_type = 'contains'").select(F.col("src_id").alias("evidence"), F.col("dst_id").alias("entity"))
    so = e.where("rel_type = 'placed'").select(F.col("dst_id").alias("evidence"), F.col("src_id").alias("source"))
    direct = so.select("source", F.col("evidence").alias("entity"))
    indirect = ev.join(so, "evidence").select("source", "entity").distinct().join(direct, ["source", "entity"], "left_anti")
    both = direct.distinct().withColumn("kind", F.lit("direct")).unionByName(indirect.withColumn("kind", F.lit("indirect")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))


@query(f"""WITH {LINEAGE_SQL} SELECT n.id, count(DISTINCT ev.evidence) AS n_evidence, count(ev.evidence) > 0 AS has_evidence, count(so.source) > 0 AS has_source FROM nodes n LEFT JOIN ev ON ev.entity = n.id LEFT JOIN so USING (evidence) WHERE n.label = 'part' GROUP BY n.id""")
def lineage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's evidence (the orders that hold it) and whether any has a source (a customer); a pair of part and order is one edge."""
    e = {x.rel: x.rows for x in links(spark, sf_dir, ("contains", "placed"))}
    sourced = e["placed"].where("src_key IS NOT NULL").select(F.col("dst_key").alias("evidence")).distinct().withColumn("sourced", F.lit(True))
    ev = e["contains"].select(F.col("src_key").alias("evidence"), F.col("dst_key").alias("key"))
    per = ev.join(sourced, "evidence", "left").groupBy("key").agg(F.count("evidence").alias("n_evidence"), F.count("sourced").alias("n_sourced"))
    parts = node_tables(spark, sf_dir)["part"].select("key").distinct().join(per, "key", "left").na.fill(0, ["n_evidence", "n_sourced"])
    return parts.select(L.node_id("part", "key").alias("id"), "n_evidence", (F.col("n_evidence") > 0).alias("has_evidence"), (F.col("n_sourced") > 0).alias("has_source"))


@query("""SELECT 'part:' || l_partkey AS entity, 'order:' || l_orderkey AS evidence, coalesce('customer:' || o_custkey, p_brand, '') AS origin FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence pairs with their origin: the evidence's source, else the entity's own."""
    e = edges(spark, sf_dir, ("contains", "placed"))
    ev = e.where("rel_type = 'contains'").select(F.col("src_id").alias("evidence"), F.col("dst_id").alias("entity"))
    so = e.where("rel_type = 'placed'").select(F.col("dst_id").alias("evidence"), F.col("src_id").alias("by_evidence"))
    own = nodes(spark, sf_dir).select(F.col("id").alias("entity"), F.col("source").alias("own"))
    return ev.join(so, "evidence", "left").join(own, "entity", "left").select("entity", "evidence", F.coalesce("by_evidence", "own", F.lit("")).alias("origin"))
