"""Loading edges: which node each edge means, and an idempotent merge into a versioned table.

An edge means a node that this load wrote, by the candidate types in order; else a node that was there, type by type, by
name before alias. Edges of one source, relation, target and scope are one row: what names the load is the last one's, a
dose, a ratio and a place of evidence are the last ones given. Edges that mean no node are counted, not written.

The table is a folder of Parquet in BUCKETS by key and one manifest a version, a small file that says which folder holds
each bucket and which loads are in. A load reads and writes the buckets that it touches and is done when its manifest is
there, which is created once or not at all: a load that breaks off leaves files that no manifest names, a load that is
repeated finds itself in the manifest and changes nothing, and of two at a time one is refused.

Defined cases: unknown edge types are an error; null scope and name are keys like others; an empty load writes a manifest
and no bucket; a table without a version is empty.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import lookup_names
from ..functions.vocabulary import EDGE_TARGETS
from ..sources.manifests import Manifests
from ..sources.readers import BadInput

BUCKETS = 16
KEY = ["label", "name", "rel", "target_label", "target_name", "scope"]
#: Told by the last row; kept unless a row gives one.
META, FILLED = ["source_id", "batch_id", "unit_id", "prompt_hash"], ["dosage", "dosage_ratio", "evidence_ref"]
TABLE = ", ".join(f"{c} string" for c in [*KEY, *META, *FILLED]) + ", load string, bucket int"


def resolved(edges: DataFrame, written: DataFrame, existing: DataFrame, targets: dict[str, tuple[str, ...]] = EDGE_TARGETS) -> DataFrame:
    """edges with target_label and target_name (null: dangling). edges: ordinal, label, name, rel, target, scope and META and
    FILLED; written: label, given, name (what this load wrote under a given name); existing: id, label, name, aliases."""
    spark = edges.sparkSession
    types = spark.createDataFrame([(rel, i, t) for rel, ts in targets.items() for i, t in enumerate(ts)], "rel string, rank int, target_label string")
    if bad := [r[0] for r in edges.join(types, "rel", "left_anti").select("rel").distinct().limit(5).collect()]:
        raise BadInput(f"unsupported import edge types: {bad}")
    # popular targets are probed once, whatever the number of edges that lead to them
    wanted = edges.select("rel", "target").distinct().join(types, "rel")
    own = written.select(F.col("label").alias("target_label"), F.col("given").alias("target"), F.col("name").alias("found"))
    hit = lambda phase, by, at, node_id: F.struct(phase.alias("phase"), F.col("rank").alias("rank"), by.alias("by"), at.alias("at"), node_id.alias("id"))
    zero, none = F.lit(0), F.lit("")
    hits = [wanted.join(own, ["target_label", "target"]).select("rel", "target", hit(zero, zero, zero, F.col("found")).alias("o"), "target_label", "found")]
    probes = wanted.select("rel", "target", "rank", "target_label", F.posexplode(lookup_names(F.col("target_label"), F.col("target"))).alias("at", "probe"))
    names = existing.select(F.col("label").alias("target_label"), F.col("name").alias("probe"), zero.alias("by"), "id", F.col("name").alias("found"))
    other = existing.select(F.col("label").alias("target_label"), F.explode("aliases").alias("probe"), F.lit(1).alias("by"), "id", F.col("name").alias("found"))
    met = probes.join(names.unionByName(other), ["target_label", "probe"])
    hits.append(met.select("rel", "target", hit(F.lit(1), F.col("by"), F.col("at"), F.coalesce("id", none)).alias("o"), "target_label", "found"))
    best = reduce(DataFrame.unionByName, hits).groupBy("rel", "target").agg(F.min_by(F.struct("target_label", F.col("found").alias("target_name")), "o").alias("b"))
    return edges.join(best, ["rel", "target"], "left").select(*edges.columns, "b.*")


def folded(edges: DataFrame) -> DataFrame:
    """One row a key, with ``n_rows``."""
    last = [F.max_by(c, "ordinal").alias(c) for c in META]
    given = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in FILLED]
    return edges.where("target_name IS NOT NULL").groupBy(*KEY).agg(*last, *given, F.count(F.lit(1)).alias("n_rows"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def merged(current: DataFrame, incoming: DataFrame, load: str) -> DataFrame:
    """The rows of current with those of incoming merged in."""
    new = incoming.select(*[F.col(c).alias(f"_{c}") for c in [*KEY, *META, *FILLED, "bucket"]], F.lit(True).alias("_in"))
    same = reduce(lambda a, b: a & b, [current[c].eqNullSafe(new[f"_{c}"]) for c in KEY])
    both = current.join(new, same, "full_outer")
    came = F.coalesce("_in", F.lit(False))
    key = [F.when(came, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in [*KEY, *META]]
    return both.select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in FILLED], F.when(came, F.lit(load)).otherwise(F.col("load")).alias("load"), F.when(came, F.col("_bucket")).otherwise(F.col("bucket")).alias("bucket"))


class EdgeTable:
    """A versioned table of edges in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.manifests = Manifests(spark, folder, {"buckets": {}, "loads": {}})

    def manifest(self) -> dict:
        """The newest version: version, buckets (folder of each), loads (what each did)."""
        return self.manifests.newest()

    def read(self, manifest: dict | None = None, only: list[int] | None = None) -> DataFrame:
        held = (manifest or self.manifest())["buckets"]
        paths = [f"{self.folder}/{p}/bucket={b}" for b, p in held.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], TABLE)
        plain = TABLE.removesuffix(", bucket int")
        return self.spark.read.schema(plain).parquet(*paths).withColumn("bucket", _bucket(self.buckets))

    def load(self, name: str, edges: DataFrame) -> dict:
        """Merges resolved edges under the load's name: created, updated, dangling, rows. Done once for a name."""
        before = self.manifest()
        if name in before["loads"]:
            return before["loads"][name]
        version, part = before["version"] + 1, f"data/{before['version'] + 1:012d}-{uuid.uuid4().hex}"
        incoming = folded(edges).withColumn("bucket", _bucket(self.buckets))
        staged = f"{self.folder}/{part}-incoming"
        incoming.write.parquet(staged)  # folded once; the true counts are those of what is written
        incoming = self.spark.read.schema(incoming.schema).parquet(staged)
        touched = [r[0] for r in incoming.select("bucket").distinct().collect()]  # BUCKETS at most
        counts = incoming.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
        old = self.read(before, touched)
        n_old = old.count()
        if touched:
            merged(old, incoming, name).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{part}")
        after = before["buckets"] | {str(b): part for b in touched}
        new = self.read({"buckets": after}, touched).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("load") == name).alias("own")).first()
        created = new["all"] - n_old
        if new["own"] != counts["keys"] or not 0 <= created <= counts["keys"]:
            raise RuntimeError(f"{counts['keys']} keys were planned, {new['own']} were written")
        told = {"version": version, "rows": counts["rows"], "keys": counts["keys"], "created": created, "updated": counts["keys"] - created, "dangling": edges.where("target_name IS NULL").count()}
        self.manifests.commit({"version": version, "buckets": after, "loads": before["loads"] | {name: told}})
        self.manifests.delete(f"{part}-incoming")
        return told
