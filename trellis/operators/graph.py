"""The property graph as two DataFrames, and everything asked of it.

nodes(id, label, name, status, source, props); edges(edge_id, src_id, rel_type, dst_id, status, scope).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import cut

MAX_DEPTH, MAX_LIMIT, EXPAND_DEPTH, EXPAND_LIMIT = 6, 100, 2, 50


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


@dataclass(frozen=True)
class NodeFilter:
    """A conjunction; a part that is None asks nothing."""

    label: str | None = None
    name: str | None = None
    status: str | None = None
    source: str | None = None
    has_property: str | None = None
    property_contains: tuple[str, str] | None = None


@dataclass(frozen=True)
class EdgeFilter:
    """All parts must hold for one and the same undirected edge."""

    rel_type: str | None = None
    status: str | None = None
    neighbour: str | None = None

    def empty(self) -> bool:
        return self == EdgeFilter()


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: cur, nb, and the edge as stored."""
    there = edges.select(F.col("src_id").alias("cur"), F.col("dst_id").alias("nb"), *edges.columns)
    back = edges.select(F.col("dst_id").alias("cur"), F.col("src_id").alias("nb"), *edges.columns)
    return there.unionByName(back)


def node_condition(f: NodeFilter) -> Column:
    parts = [F.lit(True)]
    if f.label:
        parts.append(F.col("label") == f.label)
    if f.name:
        parts.append(F.col("name").contains(f.name))
    if f.status:
        parts.append(F.col("status") == f.status)
    if f.source:
        parts.append(F.coalesce("source", F.lit("")).contains(f.source))
    if f.has_property:
        parts.append(F.col("props")[f.has_property].isNotNull())
    if f.property_contains:
        key, text = f.property_contains
        parts.append(F.col("props")[key].contains(text))
    return reduce(lambda a, b: a & b, parts)


def matching_edges(nodes: DataFrame, edges: DataFrame, f: EdgeFilter) -> DataFrame:
    """Both directions of the edges that pass; the neighbour's name is that of ``nb``."""
    if f.rel_type:
        edges = edges.where(F.col("rel_type") == f.rel_type)
    if f.status:
        edges = edges.where(F.col("status") == f.status)
    both = both_ways(edges)
    if f.neighbour:
        named = nodes.where(F.col("name").contains(f.neighbour)).select(F.col("id").alias("nb"))
        both = both.join(named, "nb", "left_semi")
    return both


def seeds(nodes: DataFrame, edges: DataFrame, node: NodeFilter, edge: EdgeFilter = EdgeFilter(), limit: int = 20) -> DataFrame:
    """The first limit + 1 nodes by (name, id): the last one only tells that there are more."""
    found = nodes.where(node_condition(node))
    if not edge.empty():
        found = found.join(matching_edges(nodes, edges, edge).select(F.col("cur").alias("id")), "id", "left_semi")
    return found.orderBy("name", "id").limit(clamp(limit, 1, MAX_LIMIT) + 1)


def search_nodes(nodes: DataFrame, text: str, label: str | None = None, limit: int = 20) -> DataFrame:
    """Name contains the text or the id is it; ordered, where the original had no order."""
    found = nodes.where(F.col("name").contains(text) | (F.col("id") == text))
    return (found.where(F.col("label") == label) if label else found).orderBy("name", "id").limit(limit)


def search_edges(nodes: DataFrame, edges: DataFrame, rel: str, src_label: str | None = None, dst_label: str | None = None, limit: int = 20) -> DataFrame:
    """Relation type contains the text, with the ends' names and labels."""
    found = edges.where(F.col("rel_type").contains(rel))
    for end, label in (("src", src_label), ("dst", dst_label)):
        side = nodes.where(F.col("label") == label) if label else nodes
        found = found.join(side.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"), F.col("label").alias(f"{end}_label")), f"{end}_id")
    return found.orderBy("rel_type", "src_id", "dst_id").limit(limit)


def lookup_nodes(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """In the order asked; missing ids skipped."""
    asked = nodes.sparkSession.createDataFrame(list(enumerate(ids)), "ordinal int, id string")
    return nodes.join(F.broadcast(asked), "id").orderBy("ordinal")  # as many rows as ids were passed in


def relationships(nodes: DataFrame, edges: DataFrame, node_id: str, status: str | None = None) -> DataFrame:
    """Edges at a node in either direction, with both ends."""
    at = edges.where((F.col("src_id") == node_id) | (F.col("dst_id") == node_id))
    at = at.where(F.col("status") == status) if status else at
    for end in ("src", "dst"):
        at = at.join(nodes.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id")
    return at


def expand(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int, limit: int, f: EdgeFilter = EdgeFilter()) -> tuple[DataFrame, DataFrame]:
    """Budgeted breadth-first expansion: (id, hop) of all nodes reached, and the edges with their hop.

    Rows of a hop are taken in the order (cur, rel_type, nb, src_id), cut at the smaller budget left before
    repeats are removed; a repeated node may still bring a new edge; only new nodes are expanded further.
    The budgets bound every table the loop carries, whatever the graph's size.
    """
    depth, limit = clamp(depth, 1, MAX_DEPTH), clamp(limit, 1, MAX_LIMIT)
    reached = cut(start.select("id", F.lit(0).alias("hop")))
    n = reached.count()
    node_budget, edge_budget = max(limit * depth, n) - n, limit * depth
    steps = matching_edges(nodes, edges, f)
    kept: DataFrame | None = None
    for hop in range(1, depth + 1):
        frontier = reached.where(F.col("hop") == hop - 1).select(F.col("id").alias("cur"))
        rows_allowed = min(node_budget, edge_budget)
        if rows_allowed <= 0 or frontier.isEmpty():
            break
        rows = steps.join(frontier, "cur").orderBy("cur", "rel_type", "nb", "src_id").limit(rows_allowed)
        rows = cut(rows.select("nb", "edge_id", "src_id", "rel_type", "dst_id", "status").withColumn("hop", F.lit(hop)))
        new_edges = rows.drop("nb").dropDuplicates(["src_id", "rel_type", "dst_id"])
        if kept is not None:
            new_edges = new_edges.join(kept, ["src_id", "rel_type", "dst_id"], "left_anti")
        new_nodes = cut(rows.select(F.col("nb").alias("id")).distinct().join(reached, "id", "left_anti").withColumn("hop", F.lit(hop)))
        new_edges = cut(new_edges.select("edge_id", "src_id", "rel_type", "dst_id", "status", "hop"))
        node_budget -= new_nodes.count()
        edge_budget -= new_edges.count()
        reached = cut(reached.unionByName(new_nodes))
        kept = new_edges if kept is None else cut(kept.unionByName(new_edges))
    if kept is None:
        kept = edges.limit(0).select("edge_id", "src_id", "rel_type", "dst_id", "status").withColumn("hop", F.lit(0))
    return reached, kept


def neighbourhood(edges: DataFrame, centre: DataFrame, depth: int, limit: int) -> tuple[DataFrame, bool]:
    """Undirected trails of 1..depth edges from the centre, the first ``limit`` by (length, node path), and
    whether there are more. A trail repeats no edge."""
    found = trails(edges, centre.select("id"), depth).orderBy("length", "path", "edge_path").limit(limit + 1)
    found = cut(found)
    more = found.count() > limit
    return found.orderBy("length", "path", "edge_path").limit(limit), more


def trails(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """All trails of up to ``depth`` edges: path (node ids), edge_path, length. One join a hop."""
    both = both_ways(edges).select("cur", "nb", "edge_id")
    ahead = start.select(F.col("id").alias("cur"), F.array("id").alias("path"), F.array().cast("array<string>").alias("edge_path"))
    out: DataFrame | None = None
    for length in range(1, depth + 1):
        ahead = ahead.join(both, "cur").where(~F.array_contains("edge_path", F.col("edge_id")))
        ahead = ahead.select(F.col("nb").alias("cur"), F.concat("path", F.array("nb")).alias("path"), F.concat("edge_path", F.array("edge_id")).alias("edge_path"))
        step = ahead.select("path", "edge_path", F.lit(length).alias("length"))
        out = step if out is None else out.unionByName(step)
    return out


def find_paths(edges: DataFrame, a: str, b: str, max_depth: int) -> DataFrame:
    """All undirected trails between two nodes. Met in the middle: half of the hops from either end, so the
    fan-out is that of half the depth."""
    spark = edges.sparkSession
    first = clamp(max_depth, 1, MAX_DEPTH) // 2
    last = clamp(max_depth, 1, MAX_DEPTH) - first
    none = lambda x: spark.range(1).select(F.array(F.lit(x)).alias("path"), F.array().cast("array<string>").alias("edge_path"), F.lit(0).alias("length"))
    one = lambda x: spark.range(1).select(F.lit(x).alias("id"))
    left = none(a).unionByName(trails(edges, one(a), first)) if first else none(a)
    right = none(b).unionByName(trails(edges, one(b), last))
    left = left.select("path", "edge_path", "length", F.element_at("path", -1).alias("mid"))
    right = right.select(F.col("path").alias("p2"), F.col("edge_path").alias("e2"), F.col("length").alias("n2"), F.element_at("path", -1).alias("mid"))
    # every trail splits in one way only: the right part starts once the left one is full, or is empty before
    met = left.join(right, "mid").where(((F.col("length") == first) | (F.col("n2") == 0)) & ~F.arrays_overlap("edge_path", "e2") & (F.col("length") + F.col("n2") > 0))
    return met.select(F.concat("path", F.slice(F.reverse("p2"), F.lit(2), F.greatest(F.size("p2") - 1, F.lit(0)))).alias("path"), F.concat("edge_path", F.reverse("e2")).alias("edge_path"), (F.col("length") + F.col("n2")).alias("length"))


def pair_groups(edges: DataFrame) -> DataFrame:
    """Edges by unordered pair of ends."""
    return edges.groupBy(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("rel_types"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Five named totals, each from one pass."""
    n = nodes.agg(F.countDistinct("label").alias("labels"), F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.countDistinct("rel_type").alias("rel_types"), F.count(F.lit(1)).alias("edges"))
    k = nodes.select(F.explode(F.map_keys("props")).alias("k")).agg(F.countDistinct("k").alias("keys"))
    return n.crossJoin(e).crossJoin(k).selectExpr("stack(5, 'labels', labels, 'nodes', nodes, 'relationship_types', rel_types, 'edges', edges, 'property_keys', keys) AS (metric, value)")


def labels(nodes: DataFrame) -> DataFrame:
    """Per label: nodes and distinct property keys; a node without keys counts."""
    rows = nodes.select("label", "id", F.explode_outer(F.map_keys("props")).alias("k"))
    per_key = rows.groupBy("label", "k").agg(F.count(F.lit(1)).alias("n"))
    counted = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"))
    keys = per_key.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keys"))
    return counted.join(keys, "label", "left")


def relationship_types(edges: DataFrame, known: list[str] = ()) -> DataFrame:
    """Per type the number of edges; known types without edges count zero."""
    found = edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("status").alias("n_statuses"))
    if not known:
        return found
    types = edges.sparkSession.createDataFrame([(t,) for t in known], "rel_type string")
    return types.join(found, "rel_type", "left").na.fill(0, ["n_edges", "n_statuses"])


def property_keys(nodes: DataFrame) -> DataFrame:
    """Inverted index: key to the labels that have it, and how many nodes."""
    rows = nodes.select("label", F.explode(F.map_keys("props")).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_nodes"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def last_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last value of each key, at the place where the key was first seen."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*key, seq)]), seq).alias("_v"), F.min(seq).alias("first_seen")).select(*key, "first_seen", "_v.*")


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def neighbour_ids(edges: DataFrame, node_id: str) -> DataFrame:
    """Distinct ids at the other end of a node's edges, itself where an edge is a loop."""
    at = edges.where((F.col("src_id") == node_id) | (F.col("dst_id") == node_id))
    return at.select(F.when(F.col("src_id") == node_id, F.col("dst_id")).otherwise(F.col("src_id")).alias("id")).distinct()


def expanded_below(expansions: DataFrame, node_id: str) -> DataFrame:
    """(id, round) of all that was brought in by expanding a node, or by expanding what that brought, and so on.

    expansions: parent, child. Every round joins what the last one found; a node counts at its first round, so circles end.
    """
    spark = expansions.sparkSession
    found = cut(spark.createDataFrame([(node_id, 0)], "id string, round int"))
    last, n = found, 0
    while True:
        n += 1
        step = expansions.join(last.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct()
        last = cut(step.join(found.select("id"), "id", "left_anti").withColumn("round", F.lit(n)))
        if last.isEmpty():
            return found.where("round > 0")
        found = cut(found.unionByName(last))


def collapse(nodes: DataFrame, edges: DataFrame, expansions: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, expansions) without all that expanding a node has brought in; the node itself stays, collapsed."""
    gone = expanded_below(expansions, node_id).select("id")
    left = nodes.join(gone, "id", "left_anti")
    for end in ("src_id", "dst_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    closed = gone.unionByName(gone.sparkSession.createDataFrame([(node_id,)], "id string"))
    return left, edges, expansions.join(closed.withColumnRenamed("id", "parent"), "parent", "left_anti")
