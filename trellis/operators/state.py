"""Operational state as append-only events and folds over them; mutations as new versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The pipeline's steps in order.
STEPS = ["source_ingest", "source_preview", "normalize", "extract_candidates", "map_to_knowledge_model", "human_review", "export"]
SESSION_GAP = "30 minutes"


def latest(rows: DataFrame, key: list[str], version: str, tie: str) -> DataFrame:
    """The newest version of each key."""
    w = W.partitionBy(*key).orderBy(F.desc(version), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_fold(events: DataFrame) -> DataFrame:
    """run_id, seq, step_index, action (preview, confirm, rollback) to each step's status and version.

    A rollback clears its step and all later ones, and sets the version of its own step alone to zero.
    """
    cleared = events.where("action = 'rollback'").select("run_id", F.col("seq").alias("at"), F.col("step_index").alias("from_step"))
    steps = events.where("action <> 'rollback'")
    hit = steps.join(cleared, "run_id", "left").where("at IS NULL OR (at > seq AND from_step <= step_index)")
    undone = hit.where("at IS NOT NULL").select("run_id", "seq", (F.col("from_step") == F.col("step_index")).alias("zero")).groupBy("run_id", "seq").agg(F.max("zero").alias("zero"))
    rows = steps.join(undone, ["run_id", "seq"], "left")
    live = F.col("zero").isNull()
    return rows.groupBy("run_id", "step_index").agg(
        F.coalesce(F.max_by(F.when(F.col("action") == "confirm", "confirmed").otherwise("previewed"), F.when(live, F.col("seq"))), F.lit("pending")).alias("status"),
        F.count_if((F.col("action") == "preview") & (live | ~F.col("zero"))).alias("version"),
    )


def sessions(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Sessions that end after thirty quiet minutes."""
    return events.groupBy(key, F.session_window(ts, SESSION_GAP).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")


def suffix_chunks(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """What is new in each state of a growing text; all of it if the beginning changed."""
    before = F.lag(text).over(W.partitionBy(key).orderBy(order))
    grew = before.isNotNull() & F.startswith(F.col(text), before)
    return rows.withColumn("chunk", F.when(grew, F.substring(F.col(text), F.length(before) + 1, F.length(text))).otherwise(F.col(text)))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], fill: list[str], lists: list[str]) -> DataFrame:
    """A new version of a table: empty values filled, lists appended to, new keys added."""
    c, i = current.alias("c"), incoming.alias("i")
    joined = c.join(i, key, "full_outer")
    filled = [F.coalesce(F.nullif(F.col(f"c.{x}"), F.lit("")), F.col(f"i.{x}")).alias(x) for x in fill]
    none = F.array().cast("array<string>")
    joins = [F.array_union(F.coalesce(F.col(f"c.{x}"), none), F.coalesce(F.col(f"i.{x}"), none)).alias(x) for x in lists]
    return joined.select(*key, *filled, *joins)


def reset_scope(nodes: DataFrame, edges: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """Edges of a scope go, then the nodes that had only such edges."""
    kept = edges.where(~doomed)
    ends = lambda df: df.select(F.col("src_id").alias("id")).unionByName(df.select(F.col("dst_id").alias("id"))).distinct()
    orphans = ends(edges.where(doomed)).join(ends(kept), "id", "left_anti")
    return nodes.join(orphans, "id", "left_anti"), kept


def verify(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Status by decision, kept from pending alone."""
    d = decisions.select(F.col(key).alias("_k"), "decision")
    out = rows.join(d, rows[key] == F.col("_k"), "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("decision").isNotNull(), F.col("decision")).otherwise(F.col("status"))).drop("_k", "decision")


def three_way(value: Column, high: float = 0.7, low: float = 0.3) -> Column:
    return F.when(value >= high, "yes").when(value <= low, "no").when(value.isNotNull(), "unsure").otherwise("missing")
