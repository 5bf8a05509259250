"""Catalogue, ledger and publishing: which sources there are, in which tier, and what of them is published.

A source is published as rows of one folder under its tier. The manifest says for each source its tier, folder, number of
rows and digest; readers take folders from the newest manifest alone and hold the rows against the digest. Publishing
computes the digests of all sources in one pass, writes those that changed (or moved to another tier) in one job, and
commits a new manifest; if nothing changed there is nothing to write and no new version.

A digest does not depend on the order or the partitioning of rows: rows are hashed (SHA-256 of their JSON, columns in
order of name) and the halves of the hashes are added up and xored. Repeated rows count.

Defined cases: a source without rows is published with none; rows of sources that the catalogue lacks are an error, as are
tiers that contradict ``publish``, blank licences' status, unknown visibility, a task of an unknown source; a source that
left the catalogue leaves the manifest.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .manifests import Manifests
from .readers import BadInput

PUBLIC, RESTRICTED = "public", "restricted"
FILTER = "struct<source_provider:string,dataset_name:string,file_path:string,import_scope_key:string>"
SOURCE = f"source_id string, title string, status string, kind string, publish boolean, release_tier string, license_status string, license string, filter {FILTER}, planned map<string,string>, completed map<string,string>, paths map<string,string>"
CATALOG = f"dataset_id string, visibility string, knowledge_model string, updated_at string, sources array<struct<{SOURCE.replace(' ', ':').replace(',:', ',')}>>"
LEDGER = "updated_at string, tasks array<struct<task_id:string,source_id:string,status:string,unit:string,planned_units:long,completed_units:long>>"
REQUIRED = ("source_id", "title", "status", "kind", "filter", "planned", "completed", "paths")


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document of a file."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("d"))
    rows = text.select("d.*")
    if rows.where("_bad IS NOT NULL").count() or not rows.count():
        raise BadInput(f"{path} is not one JSON object")
    return rows.drop("_bad")


def with_defaults(sources: DataFrame) -> DataFrame:
    """What ``publish`` says about tier and licence where they are not given."""
    public = F.coalesce("publish", F.lit(False))
    by = lambda c, yes, no: F.coalesce(c, F.when(public, yes).otherwise(no)).alias(c)
    rest = [c for c in sources.columns if c not in ("publish", "release_tier", "license_status", "license")]
    return sources.select(*rest, public.alias("publish"), by("release_tier", PUBLIC, RESTRICTED), by("license_status", "redacted_structured_only", "unverified"), by("license", "other", "unknown"))


def checked(sources: DataFrame) -> DataFrame:
    """sources, if each of them is sound."""
    fault = F.when((F.col("release_tier") == PUBLIC) != F.col("publish"), F.concat(F.lit("release_tier="), "release_tier", F.lit(" incompatible with publish="), F.col("publish").cast("string"))).when(F.trim("license_status") == "", "license_status required")
    if bad := sources.select("source_id", fault.alias("f")).where("f IS NOT NULL").limit(5).collect():
        raise BadInput("; ".join(f"{r.source_id}: {r.f}" for r in bad))
    if bad := sources.groupBy("source_id").count().where("count > 1").limit(5).collect():
        raise BadInput(f"sources that occur twice: {[r.source_id for r in bad]}")
    return sources


def load_catalog(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """A row a source."""
    rows = _document(spark, path, CATALOG)
    head = rows.select("dataset_id", "visibility").first()
    if head.visibility not in ("private", "public"):
        raise BadInput("visibility must be private or public")
    if head.dataset_id != dataset_id:
        raise BadInput(f"dataset_id must be {dataset_id}")
    sources = rows.select(F.explode("sources").alias("s")).select("s.*")
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    if bad := sources.select("source_id", lacking.alias("l")).where(F.size("l") > 0).limit(5).collect():
        raise BadInput(f"sources lack fields: {[(r.source_id, r.l) for r in bad]}")
    return checked(with_defaults(sources))


def load_ledger(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """A row a task, each of a known source."""
    tasks = _document(spark, path, LEDGER).select(F.explode("tasks").alias("t")).select("t.*")
    if bad := tasks.join(catalog, "source_id", "left_anti").limit(5).collect():
        raise BadInput(f"tasks of unknown sources: {[r.source_id for r in bad]}")
    return tasks


def sources_for_tier(catalog: DataFrame, tier: str | None) -> DataFrame:
    return catalog if tier is None else catalog.where(F.col("release_tier") == tier)


def record_paths(spark: SparkSession, root: str, catalog: DataFrame, tier: str | None = None) -> list[str]:
    """The newest processed records of the tier's sources, where there are any."""
    files = Manifests(spark, root, {})
    wanted = [f"sources/{r.source_id}/processed/latest/records.jsonl" for r in sources_for_tier(catalog, tier).select("source_id").orderBy("source_id").collect()]
    return [f"{files.folder}/{p}" for p in wanted if files.exists(p)]


def digests(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """key, rows, digest: one pass, whatever the order of rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != key))), 256)
    half = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("long")
    sums = rows.select(key, half(1).alias("a"), half(16).alias("b")).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("a").cast("decimal(38,0)")).alias("sa"), F.sum(F.col("b").cast("decimal(38,0)")).alias("sb"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb")
    )
    return sums.select(key, "rows", F.sha2(F.concat_ws(":", "rows", "sa", "sb", "xa", "xb"), 256).alias("digest"))


NONE = "none"


class Dataset:
    """A published dataset in a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.manifests = spark, Manifests(spark, root, {"sources": {}})

    def publish(self, catalog: DataFrame, records: DataFrame) -> dict[str, list[str]]:
        """written, kept and left sources. A second run over the same rows writes nothing."""
        if bad := records.join(catalog, "source_id", "left_anti").select("source_id").distinct().limit(5).collect():
            raise BadInput(f"rows of unknown sources: {[r.source_id for r in bad]}")
        before = self.manifests.newest()
        found = {r.source_id: r for r in digests(records).collect()}  # a row a source of the catalogue
        tiers = {r.source_id: r.release_tier for r in catalog.select("source_id", "release_tier").collect()}
        now = {s: {"tier": t, "rows": found[s].rows if s in found else 0, "digest": found[s].digest if s in found else NONE} for s, t in tiers.items()}
        old = before["sources"]
        changed = sorted(s for s, x in now.items() if s not in old or any(old[s][k] != x[k] for k in ("tier", "digest", "rows")))
        left = sorted(set(old) - set(now))
        if not changed and not left:
            return {"written": [], "kept": sorted(now), "left": []}
        part = f"data/{before['version'] + 1:012d}-{uuid.uuid4().hex}"
        if changed:
            rows = records.join(catalog.select("source_id", "release_tier").where(F.col("source_id").isin(changed)), "source_id")
            rows.write.partitionBy("release_tier", "source_id").parquet(f"{self.manifests.folder}/{part}")
        schema = records.select(*[c for c in records.columns if c != "source_id"]).schema.add("release_tier", "string").add("source_id", "string").jsonValue()
        sources = {s: (x | {"part": part, "schema": schema} if s in changed else old[s]) for s, x in now.items()}
        self.manifests.commit({"version": before["version"] + 1, "sources": sources})
        return {"written": changed, "kept": sorted(set(now) - set(changed)), "left": left}

    def read(self, tier: str | None = None) -> DataFrame:
        """The published rows of a tier, held against their digests."""
        held = {s: x for s, x in self.manifests.newest()["sources"].items() if tier in (None, x["tier"]) and x["rows"]}
        if not held:
            raise BadInput(f"nothing is published in {tier or 'any tier'}")
        parts: dict[str, list[str]] = {}
        for s, x in sorted(held.items()):
            parts.setdefault(x["part"], []).append(s)
        # names of sources are text, whatever they look like
        read = lambda p, names: self.spark.read.schema(StructType.fromJson(held[names[0]]["schema"])).parquet(f"{self.manifests.folder}/{p}").where(F.col("source_id").isin(names))
        rows = reduce(DataFrame.unionByName, [read(p, names) for p, names in parts.items()])
        found = {r.source_id: (r.rows, r.digest) for r in digests(rows.drop("release_tier")).collect()}
        if bad := sorted(s for s, x in held.items() if found.get(s) != (x["rows"], x["digest"])):
            raise BadInput(f"published rows differ from the manifest: {bad}")
        return rows
