"""Dataset records (an envelope, a node, its edges): identity, merging, target resolution, publishing.

records: source_id, batch_id, unit_id, ordinal, node_type, node_name, stable_id, parent_name, status,
evidence_refs, evidence_text, props, edges(array of type, target, props).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bags import is_empty, sorted_json
from ..functions.text import PHRASE_FIXES

KEY = ["node_type", "node_name", "stable_id"]
RECORD_KEY = ["source_id", "batch_id", "unit_id", "node_type", "node_name"]


class IdentityConflict(ValueError):
    """Drafts of one identity disagree on a property."""


def property_rows(drafts: DataFrame, key: list[str] = KEY) -> DataFrame:
    return drafts.select(*key, "ordinal", F.explode("props").alias("prop", "value")).where(~is_empty(F.col("value")))


def conflicts(drafts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Properties with several non-empty values in one identity: key, prop, values."""
    found = property_rows(drafts, key).groupBy(*key, "prop").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return found.where(F.size("values") > 1)


def _members(drafts: DataFrame, key: list[str], column: str) -> DataFrame:
    """key and the distinct members of an array column in order of first sight: members meet as rows, repeats once."""
    rows = drafts.select(*key, "ordinal", F.posexplode(column).alias("_pos", "_item"))
    once = rows.groupBy(*key, "_item").agg(F.min(F.struct("ordinal", "_pos")).alias("_at"))
    return once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda x: x["_item"]).alias(column))


def _folded(drafts: DataFrame, key: list[str], lists: list[str]) -> DataFrame:
    firsts = property_rows(drafts, key).groupBy(*key, "prop").agg(F.min_by("value", "ordinal").alias("value"))
    parts = [firsts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "value")))).alias("props"))]
    parts += [_members(drafts, key, c) for c in lists]
    out = drafts.groupBy(*key).agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("n_merged"))
    for part in parts:
        renamed = part.withColumnsRenamed({k: f"_{k}" for k in key})
        on = F.lit(True)
        for k in key:
            on = on & out[k].eqNullSafe(renamed[f"_{k}"])
        out = out.join(renamed, on, "left").drop(*[f"_{k}" for k in key])
    empty = F.array().cast("array<string>")
    return out.select(*key, "ordinal", "n_merged", *[F.coalesce(c, empty).alias(c) for c in lists], F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def merge_strict(drafts: DataFrame, key: list[str] = KEY, lists: list[str] = ("aliases", "evidence_refs")) -> DataFrame:
    """One row an identity; a conflicting property is an error."""
    bad = conflicts(drafts, key).limit(5).collect()
    if bad:
        raise IdentityConflict("; ".join(f"{[r[k] for k in key]}: {r.prop} in {r['values']}" for r in bad))
    return _folded(drafts, key, list(lists))


def merge_lenient(drafts: DataFrame, key: list[str] = KEY, lists: list[str] = ("aliases", "evidence_refs")) -> DataFrame:
    """One row an identity; the first non-empty value of each property stays."""
    return _folded(drafts, key, list(lists))


def quarantine_conflicts(drafts: DataFrame, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(drafts of sound identities, drafts of conflicting ones with the properties in conflict)."""
    bad = conflicts(drafts, key).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.array_sort(F.collect_list("prop")).alias("conflicting"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    aside = drafts.join(bad, same).select(*drafts.columns, "conflicting")
    return drafts.join(bad, same, "left_anti"), aside


def display_names(rows: DataFrame) -> DataFrame:
    """A name that several stable ids of a type share is qualified: by the parent where every sibling has a
    parent of its own, else by the id."""
    parent = F.when(F.trim(F.coalesce("parent_name", F.lit(""))) != "", F.col("parent_name"))
    counts = rows.groupBy(F.col("node_type").alias("_type"), F.col("node_name").alias("_name")).agg(F.count_distinct("stable_id").alias("_n"), F.count_distinct(parent).alias("_p"))
    rows = rows.join(counts, rows.node_type.eqNullSafe(counts["_type"]) & rows.node_name.eqNullSafe(counts["_name"])).drop("_type", "_name")
    name = F.when(F.col("_n") <= 1, F.col("node_name")).when(F.col("_p") == F.col("_n"), F.concat("node_name", F.lit("（"), "parent_name", F.lit("）"))).otherwise(F.concat("node_name", F.lit("〔"), "stable_id", F.lit("〕")))
    return rows.withColumn("display_name", name).drop("_n", "_p")


def collapse_edges(edges: DataFrame) -> DataFrame:
    """Edges with the same source, type, target and properties are one; their evidence refs united and joined."""
    return edges.groupBy("node_type", "node_name", "type", "target", sorted_json(F.col("props")).alias("props_json")).agg(F.array_join(F.array_sort(F.collect_set("evidence_ref")), " || ").alias("evidence"), F.count(F.lit(1)).alias("n"))


def score_variant(text: Column, count: Column, kind: str) -> Column:
    """How canonical a spelling is: often seen; book marks; a full stop; Chinese commas; no recognition residue."""
    score = 10 * count
    if kind == "book":
        score = score + F.when(text.rlike("^《.*》$"), 20).otherwise(0)
    if kind == "sentence":
        score = score + F.when(text.endswith("。"), 8).otherwise(0) + F.when(text.contains("，"), 2).otherwise(0)
    return score - F.when(text.rlike("|".join(wrong for wrong, _ in PHRASE_FIXES)), 30).otherwise(0)


def canonical_variants(values: DataFrame, kind: str = "term") -> DataFrame:
    """(surface, value, ordinal) rows to surface, value, canonical: the best score, then the longest, the
    lower first code point, the first seen."""
    counted = values.groupBy("surface", "value").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    order = F.struct(score_variant(F.col("value"), F.col("n"), kind), F.length("value"), -F.ascii("value"), -F.col("first"))
    best = counted.groupBy("surface").agg(F.max_by("value", order).alias("canonical"), F.count(F.lit(1)).alias("n_variants"))
    return counted.join(best, "surface").select("surface", "value", "n", "canonical", "n_variants")


def merge_plan(nodes: DataFrame, degrees: DataFrame, surface: Column) -> DataFrame:
    """Near-duplicate nodes of a label: id to keep_id. The survivor has most edges, then properties, then the
    canonical name, then the least id."""
    rows = nodes.join(degrees, "id", "left").na.fill(0, ["degree"]).withColumn("surface", surface)
    w = W.partitionBy("label", "surface")
    order = [F.desc("degree"), F.desc(F.size("props")), F.asc("id")]
    kept = rows.withColumn("keep_id", F.first("id").over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    return kept.where("n > 1").select("id", "keep_id", "label", "surface")


def repoint(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Edges with both ends at the survivors, equal ones once, self edges gone."""
    moved = plan.where("id <> keep_id").select("id", "keep_id")
    for end in ("src_id", "dst_id"):
        edges = edges.join(moved.select(F.col("id").alias(end), F.col("keep_id").alias("_k")), end, "left").withColumn(end, F.coalesce("_k", end)).drop("_k")
    out = edges.where("src_id <> dst_id").groupBy("src_id", "rel_type", "dst_id").agg(F.count(F.lit(1)).alias("n_merged"), F.max("status").alias("status"))
    return out


def resolve_targets(edges: DataFrame, targets: DataFrame, types: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The node each edge means: candidate types in order, a name before an alias; no hit or an unknown edge
    type is dangling (null target_id).

    edges(edge_key, type, target); targets(node_type, node_name, id); types(type, rank, node_type);
    aliases(node_type, alias, id).
    """
    wanted = edges.join(types, "type")
    by_name = wanted.join(targets.withColumnRenamed("node_name", "target"), ["node_type", "target"]).select("edge_key", F.lit(0).alias("by"), "rank", "id")
    if aliases is not None:
        by_name = by_name.unionByName(wanted.join(aliases.withColumnRenamed("alias", "target"), ["node_type", "target"]).select("edge_key", F.lit(1).alias("by"), "rank", "id"))
    best = by_name.groupBy("edge_key").agg(F.min(F.struct("by", "rank", "id")).alias("b"))
    return edges.join(best, "edge_key", "left").select(*edges.columns, F.col("b.id").alias("target_id"))


def to_tables(records: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The published records and edges: catalogue metadata attached by source, edges flattened."""
    with_meta = records.join(meta, "source_id", "left").na.fill("", [c for c in meta.columns if c != "source_id"])
    extra = [c for c in meta.columns if c != "source_id"]
    out = with_meta.select(*RECORD_KEY, "evidence_refs", "evidence_text", sorted_json(F.col("props")).alias("properties_json"), *extra)
    edges = with_meta.select("source_id", "batch_id", "unit_id", F.col("node_type").alias("from_node_type"), F.col("node_name").alias("from_node_name"), F.explode("edges").alias("e"), *extra)
    edges = edges.select("source_id", "batch_id", "unit_id", "from_node_type", "from_node_name", F.col("e.type").alias("edge_type"), F.col("e.target").alias("target"), F.col("e.props").getItem("dosage").alias("dosage"), F.col("e.props").getItem("evidence_ref").alias("evidence_ref"), *extra)
    return out, edges


def from_tables(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Records with their edges again; rows without a source are sentinels; equal record keys each get all edges."""
    keyed = edges.where("source_id <> ''").groupBy("source_id", "batch_id", "unit_id", F.col("from_node_type").alias("node_type"), F.col("from_node_name").alias("node_name")).agg(F.array_sort(F.collect_list(F.struct(F.col("edge_type").alias("type"), "target"))).alias("edges"))
    rows = records.where("source_id <> ''").join(keyed, RECORD_KEY, "left")
    return rows.withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<type:string,target:string>>")))


def stats(records: DataFrame) -> DataFrame:
    """Counts by node type and edge type, over all and by batch, in one pass each (grouping sets)."""
    n = records.groupBy("batch_id", "node_type").agg(F.count(F.lit(1)).alias("n"))
    e = records.select("batch_id", F.explode("edges.type").alias("type")).groupBy("batch_id", "type").agg(F.count(F.lit(1)).alias("n"))
    node = n.select(F.lit("node").alias("kind"), F.col("node_type").alias("type"), "batch_id", "n")
    both = node.unionByName(e.select(F.lit("edge").alias("kind"), "type", "batch_id", "n"))
    total = both.groupBy("kind", "type").agg(F.sum("n").alias("n")).withColumn("batch_id", F.lit("*"))
    return both.unionByName(total)


def violations(rows: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(rule, key, detail) for every row and every rule whose condition holds."""
    hit = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (cond, detail) in rules.items()]))
    return rows.select(F.col(key).alias("key"), F.explode(hit).alias("v")).select("v.rule", "key", "v.detail")
