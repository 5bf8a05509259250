"""Loading records into a graph: which node each record means, and what it writes there.

A record means the existing node of its type that has one of its names; else one that has such a name as an alias (first
node by id); else it creates a node. Records that mean the same node are one row, in their order: properties fill what is
empty (protected ones stay), and the lists of sources, batches, scopes and prompt hashes grow by what they lack.

Defined cases: a record without a prompt hash takes its source's default, and without that is an error; null lists are empty;
an empty table plans nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bags import allow, fill_if_empty, ordered_union
from ..functions.values import lookup_names
from ..functions.vocabulary import PROTECTED_KEYS
from ..sources.readers import BadInput

LISTS = {"source_ids": "source_id", "batch_ids": "batch_id", "scope_keys": "import_scope_key", "prompt_hashes": "prompt_hash"}


def prepared(records: DataFrame, defaults: dict[str, str], keep: list[str]) -> DataFrame:
    """Records with a prompt hash each and the properties that go to the graph."""
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.create_map().cast("map<string,string>")
    out = records.withColumn("prompt_hash", F.coalesce(F.nullif("prompt_hash", F.lit("")), F.try_element_at(known, F.col("source_id")))).withColumn("props", allow(F.col("props"), keep))
    if bad := [r[0] for r in out.where("prompt_hash IS NULL").select("source_id").distinct().limit(5).collect()]:
        raise BadInput(f"records missing prompt_hash: {bad}")
    return out


def matched(records: DataFrame, existing: DataFrame) -> DataFrame:
    """records with node_id of the node that they mean (null: none). existing: id, label, name, aliases, ..."""
    probes = records.select("ordinal", "node_type", F.posexplode(lookup_names(F.col("node_type"), F.col("node_name"))).alias("at", "probe"))
    names = existing.select(F.col("label").alias("node_type"), F.col("name").alias("probe"), F.lit(0).alias("by"), "id")
    other = existing.select(F.col("label").alias("node_type"), F.explode("aliases").alias("probe"), F.lit(1).alias("by"), "id")
    best = probes.join(names.unionByName(other), ["node_type", "probe"]).groupBy("ordinal").agg(F.min(F.struct("by", "at", "id")).alias("b"))
    return records.join(best, "ordinal", "left").select(*records.columns, F.col("b.id").alias("node_id"))


def plan(records: DataFrame, existing: DataFrame) -> DataFrame:
    """action (update or create), node_id, label, name, props, the LISTS, n_records: one row for every node that is written.

    records: ordinal, node_type, node_name, props and the columns in LISTS; existing: id, label, name, aliases, props and LISTS."""
    rows = matched(records, existing)
    key = [F.col("node_type").alias("label"), "node_id", F.when(F.col("node_id").isNull(), F.col("node_name")).alias("new_name")]
    keyed = rows.select("ordinal", "props", *LISTS.values(), *key)
    on = ["label", "node_id", "new_name"]
    firsts = keyed.select(*on, "ordinal", F.explode("props").alias("k", "v")).groupBy(*on, "k").agg(F.min_by("v", "ordinal").alias("v"))
    bags = firsts.groupBy(*on).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("incoming"))
    written = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("n_records"))
    for name, column in LISTS.items():
        once = keyed.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*on, column).agg(F.min("ordinal").alias("o"))
        part = once.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("o", F.col(column).alias("v")))).alias("seen")).select(*on, F.col("seen.v").alias(f"_{name}"))
        written = _joined(written, part, on)
    written = _joined(written, bags, on)
    old = existing.select(F.col("id").alias("node_id"), F.col("name").alias("old_name"), F.col("props").alias("old_props"), *[F.col(c).alias(f"old_{c}") for c in LISTS])
    both, none = written.join(old, "node_id", "left"), F.create_map().cast("map<string,string>")
    return both.select(
        F.when(F.col("node_id").isNull(), "create").otherwise("update").alias("action"), "node_id", "label", F.coalesce("old_name", "new_name").alias("name"),
        F.when(F.col("node_id").isNull(), F.coalesce("incoming", none)).otherwise(fill_if_empty(F.coalesce("old_props", none), F.coalesce("incoming", none), list(PROTECTED_KEYS))).alias("props"),
        *[ordered_union(F.col(f"old_{c}"), F.col(f"_{c}")).alias(c) for c in LISTS], "n_records",
    )


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join on columns of which some are null."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(renamed[f"__{c}"])
    return left.join(renamed, same, "left").drop(*[f"__{c}" for c in on])
