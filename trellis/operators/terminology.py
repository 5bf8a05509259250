"""A source cleaner as one composition: a relational terminology of terms, formulas, pieces and diseases.

Tables (all text; record_no is a row's number in its file): D1 terms, D2 formulas, D3 formula-term pairs, D4
formula-piece pairs, D5 formula-disease pairs, D6 pieces, D7 pieces' properties, D18 diseases. Every rule over rows is a
join or an aggregate; what breaks the source's promises (ids, endpoints, classes, columns that must agree, ratios, edges of
one key with other properties) is an error that names the first few rows. Pairs are moved once, by their formula: targets
are named before by the pair itself or by tables that are small in general, edges are folded where they meet their formula.

Defined cases: nodes of one type whose names agree but for width and case are one, under the first name; empty properties
are left out and a property with two values is an error; groups and chapters that are not consumed are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bags import non_empty
from ..functions.text import fold_key, nfc_strip
from ..functions.values import aliases_of, in_unit_range
from ..shared import cut
from ..sources.readers import BadInput
from .records import conflicts

# What a group of terms becomes, and the edge that leads to it.
TERM_TYPES = {"传统医学疾病": "病证", "传统医学证候": "病证", "治则": "治法", "治法": "治法"}
TERM_EDGES = {"传统医学疾病": "适用于", "传统医学证候": "关联证候", "治则": "采用治法", "治法": "采用治法"}
# What a class of properties becomes, and the edge that leads to it.
PROPERTY_TYPES = {"Medicinal flavor": "性味", "Therapeutic nature": "性味", "Meridian tropism": "归经"}
PROPERTY_EDGES = {"Medicinal flavor": "具有性味", "Therapeutic nature": "具有性味", "Meridian tropism": "归于经脉"}
PROPERTY_GROUP, LAST_CHAPTER, JOINED = "药性", 20, " || "
PAIR_COLUMNS = ("Chinese_group", "English_group", "Chinese_term", "Pinyin_term", "English_term")


def _map(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def _refuse(rows: DataFrame, what: str) -> None:
    if bad := [tuple(r) for r in rows.limit(5).collect()]:
        raise BadInput(f"{what}: {bad}")


def checked(tables: dict[str, DataFrame], digits: int = 5) -> None:
    """Raises at the first promise that the tables break. ``digits``: of the numbers in identifiers."""
    for name, key in (("D1", "TCMT_ID"), ("D2", "CPM_ID"), ("D6", "CHP_ID")):
        rows = tables[name]
        _refuse(rows.where(~F.coalesce(F.col(key).rlike(f"^{key[:-3]}[0-9]{{{digits}}}$"), F.lit(False))).select("record_no", key), f"{name} invalid {key}")
        _refuse(rows.groupBy(key).count().where("count > 1"), f"{name} duplicate {key}")
    d7, d18 = tables["D7"], tables["D18"].where("ICD11_code <> ''")
    _refuse(d7.where(~F.col("Class").isin(*PROPERTY_TYPES)).select("record_no", "Class"), "D7 unsupported class")
    _refuse(d7.groupBy("Medicinal_properties").agg(F.count_distinct("Class").alias("n")).where("n > 1"), "D7 property with several classes")
    terms = tables["D1"].where(F.col("Chinese_group") == PROPERTY_GROUP)
    used = d7.select(F.col("Medicinal_properties").alias("English_term")).distinct()
    _refuse(used.join(terms, "English_term", "left_anti"), "D7 properties missing from D1")
    _refuse(terms.join(used, "English_term", "left_semi").groupBy("English_term").count().where("count > 1"), "D1 duplicate medicinal property")
    _refuse(d18.groupBy("ICD11_code").count().where("count > 1"), "D18 duplicate ICD11_code")
    once = lambda rows, *key: rows.groupBy(*key).agg(F.min(F.col("record_no").cast("long")).alias("record_no"))  # noqa: E731  ends meet once, whatever the number of pairs
    # formulas and pieces of other pairs are looked for where edges are made
    unmapped = tables["D3"].where(_map(TERM_EDGES, F.col("Chinese_group")).isNull())
    for name, rows, key, other in (("D3", unmapped, "CPM_ID", "D2"), ("D7", tables["D7"], "CHP_ID", "D6")):
        _refuse(once(rows, key).join(tables[other], key, "left_anti").select("record_no", key), f"{name} missing endpoint")
    _refuse(tables["D5"].join(d18.where("ClassKind = 'category'"), "ICD11_code", "left_anti").select("record_no", "ICD11_code"), "D5 missing or non-category ICD endpoint")
    canonical = tables["D1"].select("TCMT_ID", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in PAIR_COLUMNS])
    differs = F.lit(False)
    for c in PAIR_COLUMNS:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    said = once(tables["D3"], "TCMT_ID", *PAIR_COLUMNS).join(canonical, "TCMT_ID", "left").select("record_no", "TCMT_ID", F.when(F.col("_known").isNull(), "missing endpoint").when(differs, "mismatches D1").alias("_fault"))
    if bad := said.where("_fault IS NOT NULL").limit(5).collect():
        raise BadInput(f"D3 {bad[0]['_fault']}: {[tuple(r) for r in bad]}")
    _refuse(tables["D4"].where(~F.coalesce(in_unit_range(F.col("Dosage_ratio")), F.lit(True))).select("record_no", "Dosage_ratio"), "D4 ratio out of range")


def _draft(rows: DataFrame, table: str, source_kind: str, key: str, node_type: Column, name: str, aliases: Column, order: Column, **props: Column) -> DataFrame:
    bag = non_empty(F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]))
    clean_name = nfc_strip(F.col(name))
    out = rows.select(
        F.lit(source_kind).alias("source_kind"), F.col(key).alias("source_key"), F.col(name).alias("said"), node_type.alias("node_type"), clean_name.alias("name"), fold_key(clean_name).alias("ident"),
        F.struct(F.lit(("D1", "D2", "D6", "D18").index(table)).alias("table"), order.alias("at")).alias("ordinal"), F.concat(F.lit(f"{table}:record:"), "record_no").alias("ref"), aliases.alias("aliases"), bag.alias("props"),
    )
    return out.withColumn("aliases", F.filter("aliases", lambda a: F.lower(a) != F.col("ident")))


def drafts(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(drafts, (what, n) of what is excluded)."""
    classes = tables["D7"].select(F.col("Medicinal_properties").alias("English_term"), "Class").distinct()
    number = F.col("record_no").cast("long")
    terms = tables["D1"].join(classes, "English_term", "left")
    kind = F.coalesce(_map(TERM_TYPES, F.col("Chinese_group")), _map(PROPERTY_TYPES, F.col("Class")))
    used, unused = terms.where(kind.isNotNull()), terms.where(kind.isNull())
    c = F.col
    d1 = _draft(used, "D1", "TCMT", "TCMT_ID", kind, "Chinese_term", aliases_of(c("Chinese_synonyms"), c("English_term"), c("Synonyms")), number, tcmt_id=c("TCMT_ID"), description=c("English_definition_description"), tcm_type=c("Chinese_group"))
    d2 = _draft(tables["D2"], "D2", "CPM", "CPM_ID", F.lit("方剂"), "Chinese_patent_medicine", F.array().cast("array<string>"), number, cpm_id=c("CPM_ID"), category=F.lit("中成药"), administration_route=c("Routes_of_administration"))
    d6 = _draft(tables["D6"], "D6", "CHP", "CHP_ID", F.lit("饮片"), "Chinese_herbal_pieces", aliases_of(c("Chinese_synonyms"), c("English_term")), number, chp_id=c("CHP_ID"), category=c("Sources"))
    chapters = tables["D5"].join(tables["D18"].select("ICD11_code", "ChapterNo"), "ICD11_code")
    taken = F.col("ChapterNo").cast("int").between(1, LAST_CHAPTER)
    codes = chapters.where(taken).select("ICD11_code").distinct()
    place = F.row_number().over(W.partitionBy("ChapterNo").orderBy("ICD11_code"))  # codes of one chapter are few
    d18 = tables["D18"].join(codes, "ICD11_code", "left_semi").withColumn("_at", F.col("ChapterNo").cast("long") * 1_000_000 + place)
    d18 = _draft(d18, "D18", "ICD11", "ICD11_code", F.lit("病证"), "Chinese_term", aliases_of(c("English_term")), c("_at"), icd11_code=c("ICD11_code"), category=F.lit("ICD-11 category"), chapter=c("ChapterNo"))
    pairs = tables["D3"].where(_map(TERM_EDGES, F.col("Chinese_group")).isNull())  # a pair's group is its term's
    count = lambda rows, what: rows.groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("n"))
    excluded = count(unused, F.concat(F.lit("D1_group:"), "Chinese_group"))
    excluded = excluded.unionByName(count(pairs, F.concat(F.lit("D3_group:"), "Chinese_group"))).unionByName(count(chapters.where(~taken), F.concat(F.lit("D5_chapter:"), "ChapterNo")))
    return d1.unionByName(d2).unionByName(d6).unionByName(d18), excluded


def clean(tables: dict[str, DataFrame], digits: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, excluded). nodes: node_type, node_name, evidence_refs, aliases, props; edges: node_type, node_name,
    type, target, dosage_ratio, evidence, n (rows that are one edge)."""
    checked(tables, digits)
    found, excluded = drafts(tables)
    found = cut(found, "drafts")  # names are folded once
    _refuse(conflicts(found, ["node_type", "ident"]), "a property with several values")
    key = ["node_type", "ident"]
    entries = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_entries("props")))))  # properties agree by now
    nodes = found.where("ident IS NOT NULL").groupBy(*key).agg(
        F.min_by("name", "ordinal").alias("node_name"),
        F.array_sort(F.collect_set("ref")).alias("evidence_refs"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "aliases"))), lambda x: x["aliases"]))).alias("aliases"),
        entries.alias("_entries"),
    )
    nodes = nodes.withColumn("props", F.when(F.size("_entries") > 0, F.map_from_entries("_entries"))).drop("_entries")
    firsts = found.groupBy(*key).agg(F.min_by("name", "ordinal").alias("node_name"))
    at = cut(found.select("source_kind", "source_key", *key, "said").join(firsts, key), "at")
    return nodes.drop("ident"), _edges(tables, at), excluded


def _edges(tables: dict[str, DataFrame], at: DataFrame) -> DataFrame:
    """Edges of all pairs, folded. at: source_kind, source_key, said (the name as written), node_type, node_name. Two
    formulas are never one node: they differ in cpm_id and were refused."""
    none, c = F.lit(""), F.col
    end = lambda kind, name, *more: at.where(c("source_kind") == kind).select(c("source_key").alias(name), *more)
    ref = lambda table: F.concat(F.lit(f"{table}:record:"), "record_no").alias("ref")
    # a term that is a node under another spelling is looked up, all others are named in the pair; written, their sizes are known
    renamed = cut(end("TCMT", "TCMT_ID", c("node_name").alias("_name"), "said").where("said IS DISTINCT FROM _name").drop("said"), "renamed")
    nameless = lambda table, key, name, *more: tables[table].where(c(name).isNull()).select(key, *[F.lit(None).cast("string").alias(m) for m in more], F.lit(True).alias("_known"))  # noqa: E731  rows that are no nodes, but ends
    pieces = cut(end("CHP", "CHP_ID", c("node_name").alias("target"), F.lit(True).alias("_known")).unionByName(nameless("D6", "CHP_ID", "Chinese_herbal_pieces", "target")), "pieces")
    codes = cut(end("ICD11", "ICD11_code", c("node_name").alias("target")), "codes")
    d3 = tables["D3"].withColumn("type", _map(TERM_EDGES, c("Chinese_group"))).where("type IS NOT NULL AND Chinese_term IS NOT NULL").join(renamed, "TCMT_ID", "left")
    rows = d3.select("CPM_ID", "type", F.coalesce("_name", "Chinese_term").alias("target"), none.alias("ratio"), ref("D3"))
    rows = rows.unionByName(tables["D4"].join(pieces, "CHP_ID", "left").where("_known IS NULL OR target IS NOT NULL").select("CPM_ID", F.lit("组成药材").alias("type"), "target", F.coalesce("Dosage_ratio", none).alias("ratio"), ref("D4")))
    rows = rows.unionByName(tables["D5"].join(codes, "ICD11_code").select("CPM_ID", F.lit("适用于").alias("type"), "target", none.alias("ratio"), ref("D5")))
    # a formula's pairs meet once; each key of edges is one run of them
    run = W.partitionBy("CPM_ID", "type", "target").orderBy("ref")
    same, n = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), F.count(F.lit(1))
    refs = F.when(n.over(same) == 1, c("ref")).otherwise(F.array_join(F.array_sort(F.collect_set("ref").over(same)), JOINED))
    rows = rows.repartition("CPM_ID").select("CPM_ID", "type", "target", F.min("ratio").over(same).alias("ratio"), F.max("ratio").over(same).alias("_most"), refs.alias("evidence"), n.over(same).alias("n"), F.row_number().over(run).alias("_nth")).where("_nth = 1")
    formulas = end("CPM", "CPM_ID", "node_type", "node_name", F.lit(True).alias("_known")).unionByName(nameless("D2", "CPM_ID", "Chinese_patent_medicine", "node_type", "node_name"))
    folded = cut(rows.join(formulas, "CPM_ID", "left").where("_known IS NULL OR node_name IS NOT NULL").select(F.when(c("node_name").isNull() | c("target").isNull(), c("CPM_ID")).alias("_lost"), "node_type", "node_name", "type", "target", "ratio", "_most", "evidence", "n"), "edges")
    _refuse(folded.where("_lost IS NOT NULL").select("evidence", "_lost"), "missing endpoint")
    key = ["node_type", "node_name", "type", "target"]
    terms = tables["D1"].where(c("Chinese_group") == PROPERTY_GROUP).select(c("English_term").alias("Medicinal_properties"), "TCMT_ID")
    properties = end("TCMT", "TCMT_ID", c("node_name").alias("target")).join(terms, "TCMT_ID")
    herbs = end("CHP", "CHP_ID", "node_type", "node_name")
    said = tables["D7"].join(properties, "Medicinal_properties").join(herbs, "CHP_ID").select("node_type", "node_name", _map(PROPERTY_EDGES, c("Class")).alias("type"), "target", ref("D7"))
    said = said.groupBy(*key).agg(none.alias("ratio"), none.alias("_most"), F.array_join(F.array_sort(F.collect_set("ref")), JOINED).alias("evidence"), F.count(F.lit(1)).alias("n"))
    out = folded.select(*key, "ratio", "_most", "evidence", "n")
    _refuse(out.where("ratio <> _most").select(*key, "n"), "edges of one key with other properties")
    return out.unionByName(said).select(*key, c("ratio").alias("dosage_ratio"), "evidence", "n")


def report(tables: dict[str, DataFrame], nodes: DataFrame, edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """(section, what, n): rows read, nodes, edges and collapsed repeats by type, what was excluded."""
    out = excluded.select(F.lit("excluded").alias("section"), "what", "n")
    for name, rows in tables.items():
        out = out.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("section"), F.lit(name).alias("what"), "n"))
    out = out.unionByName(nodes.groupBy(F.col("node_type").alias("what")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("section"), "what", "n"))
    by = edges.groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("e"), (F.sum("n") - F.count(F.lit(1))).alias("c"))
    return out.unionByName(by.select(F.lit("edges").alias("section"), "what", F.col("e").alias("n"))).unionByName(by.where("c > 0").select(F.lit("collapsed").alias("section"), "what", F.col("c").alias("n")))
