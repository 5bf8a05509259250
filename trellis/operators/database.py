"""A source cleaner as one composition: a database of entity tables and of relation tables between them.

Rows of an entity table that share a canonical name are one node if no property of theirs differs, else all of them are set
aside. Relations to a row that has become no node are set aside too, as are edges between equal names where the
specification forbids them. An empty name is an error.

Defined cases: blank values are no values; repeated rows are one node with the evidence of each; a relation row is an edge of
its own (repeats stay); empty tables give no rows and counts of 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bags import is_empty
from ..functions.text import canonical_name, formula_warnings, strip_ws
from ..functions.vocabulary import WHOLE_NAMES
from ..shared import cut
from ..sources.readers import BadInput


@dataclass(frozen=True)
class Entity:
    """A table with id and name: what its rows become, and its columns' names as properties."""

    node_type: str
    columns: dict[str, str]
    warned: bool = False
    #: Properties that every row has.
    fixed: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Relation:
    """A table with _rowid: the entity tables and columns of both ends, and the edge."""

    source: tuple[str, str]
    target: tuple[str, str]
    edge_type: str
    dosage: str | None = None
    names_differ: bool = False


def entity_rows(tables: dict[str, DataFrame], entities: dict[str, Entity]) -> DataFrame:
    """table, id, node_type, name, props, warnings for every row of every entity table."""
    out = None
    for table, e in entities.items():
        rows = tables[table]
        value = lambda c: F.nullif(strip_ws(F.col(c).cast("string")), F.lit(""))
        pairs = [(p, value(c)) for c, p in e.columns.items()] + [(p, F.lit(v)) for p, v in e.fixed.items()]
        bag = F.map_filter(F.create_map(*[x for p, v in pairs for x in (F.lit(p), v)]), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        name = canonical_name(F.coalesce(F.col("name"), F.lit("")), F.lit(e.node_type), WHOLE_NAMES)
        part = rows.select(F.lit(table).alias("table"), F.col("id").cast("long").alias("id"), F.lit(e.node_type).alias("node_type"), name.alias("name"), bag.alias("props"))
        warned = formula_warnings(name) if e.warned else F.array().cast("array<string>")
        part = part.withColumn("warnings", warned)
        out = part if out is None else out.unionByName(part)
    return out


def clean(tables: dict[str, DataFrame], entities: dict[str, Entity], relations: dict[str, Relation]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, routed). nodes: table, node_type, node_name, props, ids; edges: table, rowid, node_type, node_name, type,
    target, dosage; routed: (route, n) of rows set aside or kept."""
    rows = cut(entity_rows(tables, entities), "entities")  # names are cleaned once
    if bad := [tuple(r) for r in rows.where(is_empty(F.col("name"))).select("table", "id").limit(5).collect()]:
        raise BadInput(f"empty name: {bad}")
    warned, sound = rows.where(F.size("warnings") > 0), rows.where(F.size("warnings") == 0)
    values = sound.select("table", "name", F.explode("props").alias("k", "v")).groupBy("table", "name", "k").agg(F.min("v").alias("v"), F.max("v").alias("_most"))
    conflicting = values.where("v <> _most").select("table", "name").distinct().withColumn("conflict", F.lit(True))
    bags = values.groupBy("table", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    groups = sound.groupBy("table", "node_type", "name").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count(F.lit(1)).alias("n_rows"))
    groups = groups.join(conflicting, ["table", "name"], "left").join(bags, ["table", "name"], "left")
    good = groups.where("conflict IS NULL").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
    nodes = good.select("table", "node_type", F.col("name").alias("node_name"), "props", "ids")

    at = nodes.select("table", "node_type", "node_name", F.explode("ids").alias("id"))
    edges = None
    for table, r in relations.items():
        end = lambda name, prefix: at.where(F.col("table") == name).select(F.col("id").alias(f"{prefix}_id"), F.col("node_name").alias(f"{prefix}_name"))
        dosage = F.nullif(strip_ws(F.col(r.dosage).cast("string")), F.lit("")) if r.dosage else F.lit(None).cast("string")
        part = tables[table].select(F.lit(table).alias("table"), F.col("_rowid").cast("long").alias("rowid"), F.col(r.source[1]).cast("long").alias("s_id"), F.col(r.target[1]).cast("long").alias("t_id"), dosage.alias("dosage"))
        part = part.join(end(r.source[0], "s"), "s_id", "left").join(end(r.target[0], "t"), "t_id", "left")
        same = (F.col("s_name") == F.col("t_name")) if r.names_differ else F.lit(False)
        route = F.when(F.col("s_name").isNull() | F.col("t_name").isNull(), "quarantined_endpoint").when(same, "same_name_edge").otherwise("edge")
        part = part.select("table", "rowid", F.lit(entities[r.source[0]].node_type).alias("node_type"), F.col("s_name").alias("node_name"), F.lit(r.edge_type).alias("type"), F.col("t_name").alias("target"), "dosage", route.alias("route"))
        edges = part if edges is None else edges.unionByName(part)

    count = lambda df, route, n: df.groupBy().agg(n.alias("n")).select(F.lit(route).alias("route"), F.coalesce("n", F.lit(0)).alias("n"))
    routed = count(warned, "name_warning_rows", F.count(F.lit(1))).unionByName(count(warned, "name_warning_events", F.sum(F.size("warnings")).cast("long")))
    aside = groups.where("conflict")
    routed = routed.unionByName(count(aside, "conflicting_groups", F.count(F.lit(1)))).unionByName(count(aside, "conflicting_rows", F.sum("n_rows"))).unionByName(count(nodes, "nodes", F.count(F.lit(1))))
    routed = routed.unionByName(edges.groupBy("route").agg(F.count(F.lit(1)).alias("n")))
    return nodes, edges.where("route = 'edge'").drop("route"), routed


def evidence(nodes: DataFrame) -> DataFrame:
    """node_type, node_name, ref: the rows that each node comes from, one a row."""
    return nodes.select("node_type", "node_name", F.explode("ids").alias("id"), "table").select("node_type", "node_name", F.concat_ws(":", "table", "id").alias("ref"))
