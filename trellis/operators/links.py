"""The graph by relation: edges between two labels as pairs of keys, so that joins and exchanges carry numbers and not ids.

nodes: label to a table with ``key``; an id is the label, a colon and the key, so equal ids have equal labels and keys.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


@dataclass(frozen=True)
class Link:
    """The edges of a relation from one label to another: rows(src_key, dst_key, status, scope)."""

    src: str
    rel: str
    dst: str
    rows: DataFrame

    def label(self, end: str) -> str:
        return self.src if end == "src" else self.dst

    def turned(self) -> Link:
        return Link(self.dst, self.rel, self.src, self.rows.select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"), "status", "scope"))

    def ends(self, end: str) -> DataFrame:
        return self.rows.select(F.col(f"{end}_key").alias("key"))


def node_id(label: str, key: str) -> Column:
    return F.concat(F.lit(label + ":"), F.col(key).cast("string"))


def edge_table(links: list[Link]) -> DataFrame:
    """edge_id, src_id, rel_type, dst_id, status, scope of all links."""
    parts = []
    for x in links:
        a, b = node_id(x.src, "src_key"), node_id(x.dst, "dst_key")
        parts.append(x.rows.select(F.concat_ws("|", a, F.lit(x.rel), b).alias("edge_id"), a.alias("src_id"), F.lit(x.rel).alias("rel_type"), b.alias("dst_id"), "status", "scope"))
    return reduce(DataFrame.unionByName, parts)


def _at(nodes: DataFrame, end: str) -> DataFrame:
    return nodes.select(F.col("key").alias(f"{end}_key"))


def between(links: list[Link], sources: dict[str, DataFrame], targets: dict[str, DataFrame]) -> list[Link]:
    """The edges with both ends among the nodes given; a label that is not given has none."""
    found = [x for x in links if x.src in sources and x.dst in targets]
    return [replace(x, rows=x.rows.join(_at(sources[x.src], "src"), "src_key", "left_semi").join(_at(targets[x.dst], "dst"), "dst_key", "left_semi")) for x in found]


def link_counts(links: list[Link], nodes: dict[str, DataFrame]) -> DataFrame:
    """label, rel_type, target_label, n (edges whose ends are nodes), n_sources.

    Edges are counted by source before their source is looked up, so that nothing is sorted out of repeats later.
    """
    parts = []
    for x in links:
        held = x.rows.join(_at(nodes[x.dst], "dst"), "dst_key").groupBy("src_key").agg(F.count(F.lit(1)).alias("n"))
        held = held.join(_at(nodes[x.src], "src"), "src_key").groupBy("src_key").agg(F.sum("n").alias("n"))
        total = held.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sources")).where("n_sources > 0")
        parts.append(total.select(F.lit(x.src).alias("label"), F.lit(x.rel).alias("rel_type"), F.lit(x.dst).alias("target_label"), "n", "n_sources"))
    return reduce(DataFrame.unionByName, parts)


def expanded_below(expansions: list[Link], label: str, key: int) -> dict[str, DataFrame]:
    """(key, round) by label of all that was brought in by expanding a node, or by expanding what that brought, and so on.

    expansions: links from parents to children. A round joins the links from labels with nodes of the last round; a
    node counts at its first round, so circles end. The node itself is there at round 0.
    """
    spark = expansions[0].rows.sparkSession
    found = {label: cut(spark.createDataFrame([(key, 0)], "key long, round int"))}
    last, n = dict(found), 0
    while last:
        n += 1
        steps: dict[str, list[DataFrame]] = {}
        for x in expansions:
            if x.src in last:
                steps.setdefault(x.dst, []).append(x.rows.join(_at(last[x.src], "src"), "src_key").select(F.col("dst_key").cast("long").alias("key")))
        last = {}
        for to, parts in steps.items():
            step = reduce(DataFrame.unionByName, parts).distinct()
            if to in found:
                step = step.join(found[to].select("key"), "key", "left_anti")
            step = cut(step.withColumn("round", F.lit(n)))
            if not step.isEmpty():
                last[to] = step
        for to, step in last.items():
            found[to] = cut(found[to].unionByName(step)) if to in found else step
    return found


def collapse(nodes: dict[str, DataFrame], links: list[Link], expansions: list[Link], label: str, key: int) -> tuple[dict[str, DataFrame], list[Link], list[Link]]:
    """(nodes, links, expansions) without all that expanding a node has brought in; the node itself stays, collapsed.

    Labels of which nothing goes are not joined.
    """
    found = expanded_below(expansions, label, key)
    closed = {x: rows.select("key") for x, rows in found.items()}
    gone = closed | {label: found[label].where("round > 0").select("key")}
    left = {x: rows.join(gone[x], "key", "left_anti") if x in gone else rows for x, rows in nodes.items()}

    def without(x: Link, aside: dict[str, DataFrame], *ends: str) -> Link:
        rows = x.rows
        for end in ends:
            if x.label(end) in aside:
                rows = rows.join(_at(aside[x.label(end)], end), f"{end}_key", "left_anti")
        return replace(x, rows=rows)

    return left, [without(x, gone, "src", "dst") for x in links], [without(x, closed, "src") for x in expansions]


def reset_scope(nodes: dict[str, DataFrame], links: list[Link], doomed: Column) -> tuple[dict[str, DataFrame], list[Link]]:
    """Edges of a scope go, then the nodes that had only such edges.

    The doomed edges are found once; of the others only the ends at labels that lose edges are compared.
    """
    kept = [replace(x, rows=x.rows.where(~doomed)) for x in links]
    losses = [replace(x, rows=cut(x.rows.where(doomed).select("src_key", "dst_key"))) for x in links]
    losses = [x for x in losses if not x.rows.isEmpty()]

    def at(some: list[Link], label: str) -> list[DataFrame]:
        return [x.ends(end) for x in some for end in ("src", "dst") if x.label(end) == label]

    left = dict(nodes)
    for label in sorted({x.label(end) for x in losses for end in ("src", "dst")} & set(nodes)):
        orphans = reduce(DataFrame.unionByName, at(losses, label)).distinct()
        for ends in at(kept, label):
            orphans = orphans.join(ends, "key", "left_anti")
        left[label] = nodes[label].join(orphans, "key", "left_anti")
    return left, kept


def totals(parts: dict[str, list[DataFrame]]) -> DataFrame:
    """what, n: the rows of each name's tables; a name without rows is left out."""
    counted = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, tables in parts.items() for rows in [reduce(DataFrame.unionByName, tables)]]
    return reduce(DataFrame.unionByName, counted).where("n > 0")
