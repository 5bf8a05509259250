"""Two source cleaners as compositions: a triples file and documents with labelled spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_name, split_tokens
from ..functions.vocabulary import BRANDS, WHOLE_NAMES
from ..sources.readers import BadInput

# What each relation of the triples becomes: decision, type of head, type of tail, edge type.
TRIPLE_RELATIONS = [
    ("证候", "mapped_edge", "病证", "病证", "关联证候"),
    ("中药", "mapped_edge", "病证", "药材", "关联药材"),
    ("治法", "mapped_edge", "病证", "治法", "关联治法"),
    ("功能", "mapped_edge", "药材", "功效", "具有功效"),
    ("归经", "mapped_edge", "药材", "归经", "归于经脉"),
    ("药味", "mapped_edge", "药材", "性味", "具有性味"),
    ("药性", "mapped_edge", "药材", "性味", "具有性味"),
    ("部位", "mapped_property", "药材", "location", "-"),
    ("贮藏", "mapped_property", "药材", "storage_text", "-"),
    ("用量", "mapped_property", "药材", "quantity", "-"),
    ("毒性", "mapped_property", "药材", "toxicity", "-"),
    ("注意", "mapped_property", "药材", "caution_text", "-"),
    ("用法", "mapped_property", "药材", "usage_text", "-"),
    ("TS_MS", "quarantined_external_mapping", "-", "-", "-"),
    ("symmap_chemical", "excluded_chemical", "-", "-", "-"),
    ("chemical_MM", "excluded_chemical", "-", "-", "-"),
]
CLINICAL, FUNCTION, SYNDROME, MULTIPLE = ("证候", "中药", "治法"), "功能", "证候", ("归经", "药味", "药性")
# Span labels that become nodes, with their node types; other known labels are passed over.
SPAN_TYPES = {"DISEASE": "病证", "DISEASE_GROUP": "病证", "SYNDROME": "病证", "SYMPTOM": "症状", "DRUG": "药材", "DRUG_INGREDIENT": "药材", "DRUG_EFFICACY": "功效", "DRUG_TASTE": "性味"}
SPAN_SKIPPED = ("DRUG_DOSAGE", "DRUG_GROUP", "FOOD", "FOOD_GROUP", "PERSON_GROUP")
MAKERS = ("有限公司", "制药厂", "药业股份")


def clean_triples(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, decisions) of source_file, line_no, head, tail, relation rows.

    Equal triples count once, at their first line. What is a clinical name is decided over all rows before any
    row is routed: a function that is also one is quarantined. An unknown relation is an error.
    """
    known = rows.sparkSession.createDataFrame(TRIPLE_RELATIONS, "relation string, decision string, head_type string, tail_type string, edge_type string")
    if bad := [r[0] for r in rows.join(known, "relation", "left_anti").select("relation").distinct().limit(5).collect()]:
        raise BadInput(f"unknown relations: {bad}")
    first = rows.groupBy("head", "tail", "relation").agg(F.min(F.struct("source_file", "line_no")).alias("_at")).select("head", "tail", "relation", "_at.*").join(known, "relation")
    name = lambda c, label: canonical_name(F.col(c), F.col(label) if label in first.columns else F.lit(label), WHOLE_NAMES)
    heads = first.where(F.col("relation").isin(*CLINICAL)).select(name("head", "病证").alias("name"))
    labelled = first.where(F.col("relation") == SYNDROME).select(name("tail", "病证").alias("name")).distinct()
    clinical = heads.unionByName(labelled).distinct().select(F.col("name").alias("_c"))
    routed = first.withColumn("_k", name("tail", "病证")).join(clinical, F.col("_k") == F.col("_c"), "left")
    same = (F.col("relation") == SYNDROME) & (name("head", "病证") == F.col("_k"))
    routed = routed.withColumn("decision", F.when((F.col("relation") == FUNCTION) & F.col("_c").isNotNull(), "quarantined_function_clinical_overlap").when(same, "self_edge_skipped").otherwise(F.col("decision"))).drop("_k", "_c")
    ref = F.concat_ws(":", "source_file", "line_no")
    used = routed.where(F.col("head_type") != "-")
    tails = F.when(F.col("relation").isin(*MULTIPLE), split_tokens(F.col("tail"))).otherwise(F.array("tail"))
    edges = used.where(F.col("decision") == "mapped_edge").withColumn("value", F.explode(tails))
    edges = edges.select(F.col("head_type").alias("node_type"), name("head", "head_type").alias("node_name"), F.col("edge_type").alias("type"), F.col("tail_type").alias("target_type"), canonical_name(F.col("value"), F.col("tail_type"), WHOLE_NAMES).alias("target"), ref.alias("ref"))
    selves = used.where(F.col("decision") == "self_edge_skipped")
    node = lambda df, t, n: df.select(F.col(t).alias("node_type"), F.col(n).alias("node_name"), F.col("ref"))
    named = used.select("head_type", name("head", "head_type").alias("n"), ref.alias("ref"))
    nodes = node(named, "head_type", "n").unionByName(node(edges, "target_type", "target")).unionByName(node(selves.select("tail_type", name("tail", "tail_type").alias("n"), ref.alias("ref")), "tail_type", "n"))
    nodes = nodes.groupBy("node_type", "node_name").agg(F.array_sort(F.collect_set("ref")).alias("evidence_refs"))
    bags = used.where(F.col("decision") == "mapped_property").groupBy(F.col("head_type").alias("node_type"), name("head", "head_type").alias("node_name"), F.col("tail_type").alias("k")).agg(F.array_join(F.array_sort(F.collect_set("tail")), "；").alias("v"))
    bags = bags.groupBy("node_type", "node_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    kind = F.when(F.col("node_type") == "病证", F.when(F.col("_l").isNotNull(), "来源标注证候").otherwise("未分类临床概念"))
    nodes = nodes.join(bags, ["node_type", "node_name"], "left").join(labelled.select(F.col("name").alias("_l")), F.col("node_name") == F.col("_l"), "left").withColumn("tcm_type", kind).drop("_l")
    edges = edges.groupBy("node_type", "node_name", "type", "target").agg(F.count(F.lit(1)).alias("n_rows"))
    return nodes, edges, routed.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def clean_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, report) of id, text, labels(array of id, type, start, end, surface) rows.

    A span must reproduce its surface from the text, else the input is refused. Surfaces that are short, hold
    a brand or a maker, or map to several node types are left out and counted.
    """
    spans = docs.select("id", "text", F.explode("labels").alias("s"))
    known = [*SPAN_TYPES, *SPAN_SKIPPED]
    cut = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    sound = F.col("s.type").isin(known) & (F.col("s.start") >= 0) & (F.col("s.end") <= F.length("text")) & (F.col("s.start") < F.col("s.end")) & (cut == F.col("s.surface"))
    if bad := spans.where(~F.coalesce(sound, F.lit(False))).select("id", "s.type", "s.start", "s.end").limit(5).collect():
        raise BadInput(f"spans do not reproduce their text: {[tuple(r) for r in bad]}")
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in SPAN_TYPES.items() for x in kv]), F.col("s.type"))
    by = spans.select(F.trim("s.surface").alias("name"), mapped.alias("t")).where("name <> ''").groupBy("name").agg(F.collect_set("t").alias("types"), F.count(F.lit(1)).alias("n_spans"))
    noise = (F.length("name") < 2) | F.col("name").rlike("|".join([*BRANDS, *MAKERS])) | (F.size("types") == 0)
    routed = by.withColumn("route", F.when(noise, "noise").when(F.size("types") > 1, "cross_type").otherwise("kept"))
    nodes = routed.where("route = 'kept'").select(F.element_at("types", 1).alias("node_type"), F.col("name").alias("node_name"), F.col("name").alias("stable_id"), "n_spans")
    return nodes, routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
