"""Acceptance of extracted records: every rule that a release must keep, as rows that break it.

records: unit_id, batch_id, node_type, node_name, evidence_text, props (map), edges (array of struct<type, target>). A rule
gives (rule, detail) rows; ``failures`` counts them and keeps a bounded sample in order. What is looked up in all records (names,
types of a name, units) is a join, nothing is gathered.

Defined cases: null edges are none; an empty table breaks no rule but that of missing units; repeated records count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Node types that carry knowledge, and the source that a skipped unit may name.
KNOWLEDGE_TYPES = ("医案", "方剂", "药材", "饮片", "穴位", "治法", "病证", "功效", "性味", "归经", "工艺")
SOURCE_NAME = "道医苏子阳"
# Endings of formulas, diseases too vague to use, methods that are no medicine.
FORMULA_ENDINGS = ("散", "汤", "丸", "饮", "方")
VAGUE = ("内科杂病", "疑难杂症", "各种痛症", "杂病")
FORBIDDEN = ("铁布衫", "铁布衫训练", "金钟罩", "金钟罩训练", "八卦掌", "字门拳", "字门小手", "千金功", "子午乾坤功", "诚意正心修身", "说破不灵骗术", "认药", "五运六气", "望而知之", "手诊", "手相诊法", "大周天", "百日筑基", "炼气")
TREATING = ("医案", "方剂", "药材", "治法")
INTERVENTIONS = ("使用方剂", "取用穴位", "采用治法")
SKIPPED, DOSAGE = "no_clinical_knowledge", r"[0-9]+(?:\.[0-9]+)?\s*(?:g|克|钱)"
#: A share of knowledge nodes without source and evidence above which all of them break the rule.
ISOLATED_SHARE = 0.2


def _has(edge_type: str) -> Column:
    return F.exists("edges", lambda e: e["type"] == edge_type)


def own_rules(batch_id: str | None, forbidden: tuple[str, ...] = FORBIDDEN) -> dict[str, Column]:
    """Rules that a record breaks by itself."""
    is_a, name = lambda t: F.col("node_type") == t, F.col("node_name")
    rules = {
        "formula typed as 药材": is_a("药材") & name.rlike(f"({'|'.join(FORMULA_ENDINGS)})$"),
        "book titled as 证据": is_a("证据") & name.startswith("《"),
        "evidence name must start with 证据:": is_a("证据") & ~name.startswith("证据:"),
        "病证 emitted 治疗病证": is_a("病证") & _has("治疗病证"),
        "治疗病证 from unsupported type": ~F.col("node_type").isin(*TREATING) & _has("治疗病证"),
        "vague 病证": is_a("病证") & name.isin(*VAGUE),
        "forbidden 治法": is_a("治法") & name.isin(*forbidden),
        "医案 missing 治疗病证": is_a("医案") & ~_has("治疗病证"),
        "医案 missing intervention": is_a("医案") & ~F.exists("edges", lambda e: e["type"].isin(*INTERVENTIONS)),
        "方剂 missing 组成药材 despite dosage text": is_a("方剂") & F.coalesce(F.col("evidence_text"), F.lit("")).rlike(DOSAGE) & ~_has("组成药材"),
    }
    if batch_id:
        rules["batch_id mismatch"] = F.col("batch_id") != batch_id
    return rules


def broken(records: DataFrame, units: DataFrame, targets: dict[str, tuple[str, ...]], batch_id: str | None = None, source_name: str = SOURCE_NAME, forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """(rule, detail) for everything that breaks a rule. ``units``: the unit_ids that must occur; ``targets``: the
    node types that an edge type may lead to; ``source_name``: the source that a skipped unit may name."""
    rows = records.withColumn("edges", F.coalesce("edges", F.array().cast(records.schema["edges"].dataType)))
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in own_rules(batch_id, forbidden).items()]))
    out = rows.select(F.explode(hits).alias("rule"), F.col("node_name").alias("detail"))

    rule = lambda df, name, detail: df.select(F.lit(name).alias("rule"), detail.alias("detail"))
    reason = F.col("props")["skip_reason"]
    out = out.unionByName(rule(units.select("unit_id").distinct().join(records, "unit_id", "left_anti"), "missing units", F.col("unit_id")))
    skipped = rows.where(reason == SKIPPED).select("unit_id").distinct()
    named = (F.col("node_type") == "来源") & (F.col("node_name") == source_name)
    out = out.unionByName(rule(rows.where(~named).join(skipped, "unit_id", "left_semi"), "skip unit has knowledge", F.concat_ws(":", "node_type", "node_name")))

    edges = rows.select(F.explode("edges").alias("e")).select("e.type", "e.target")
    names = rows.select("node_name", "node_type").distinct()
    out = out.unionByName(rule(edges.join(names, F.col("target") == F.col("node_name"), "left_anti"), "dangling targets", F.col("target")))
    allowed = rows.sparkSession.createDataFrame([(k, t) for k, ts in targets.items() for t in ts], "type string, node_type string")
    ruled = edges.join(F.broadcast(allowed.select("type").distinct()), "type", "left_semi")  # a dozen fixed rows
    known = ruled.join(names.select(F.col("node_name").alias("target")).distinct(), "target", "left_semi")
    good = names.join(F.broadcast(allowed), "node_type").select("type", F.col("node_name").alias("target")).distinct()
    out = out.unionByName(rule(known.join(good, ["type", "target"], "left_anti"), "target of a wrong type", F.concat_ws("->", "type", "target")))

    isolated = F.col("node_type").isin(*KNOWLEDGE_TYPES) & (F.coalesce(reason, F.lit("")) == "") & ~(_has("来源于") & _has("由证据支持"))
    share = rows.agg(F.coalesce(F.try_divide(F.count_if(isolated), F.count(F.lit(1))), F.lit(0.0)).alias("_share"))
    lonely = rows.where(isolated).crossJoin(F.broadcast(share)).where(F.col("_share") > ISOLATED_SHARE)  # one row
    return out.unionByName(rule(lonely, "knowledge nodes missing 来源于+由证据支持", F.col("node_name")))


def failures(found: DataFrame, sample: int = 8) -> DataFrame:
    """rule, n, sample: the first few different details in order."""
    from pyspark.sql import Window as W

    first = found.groupBy("rule", "detail").agg(F.count(F.lit(1)).alias("k"))
    first = first.withColumn("nth", F.row_number().over(W.partitionBy("rule").orderBy("detail")))
    return first.groupBy("rule").agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.when(F.col("nth") <= sample, F.col("detail")))).alias("sample"))
