"""Queries on the property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import links as L
from ..operators.graph import EdgeFilter, NodeFilter
from .registry import query
from .views import GRAPH_SQL, edges, links, node_tables, nodes


def _props_text(df: DataFrame) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return df.withColumn("props", F.array_join(pairs, ";"))


@query(f"""WITH {GRAPH_SQL}, p AS (SELECT id, string_agg(k || '=' || v, ';' ORDER BY k) AS props FROM props GROUP BY id)
SELECT n.*, coalesce(p.props, '') AS props FROM nodes n LEFT JOIN p USING (id)""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _props_text(nodes(spark, sf_dir))


@query(f"WITH {GRAPH_SQL} SELECT edge_id, src_id, rel_type, dst_id, status, scope FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(f"""WITH {GRAPH_SQL}, hit AS (
  SELECT n.id, n.name FROM nodes n JOIN props p ON p.id = n.id AND p.k = 'segment' AND contains(p.v, 'BUILDING')
  WHERE n.label = 'customer' AND contains(n.name, '7')
    AND EXISTS (SELECT 1 FROM edges e WHERE e.src_id = n.id AND e.rel_type = 'placed' AND e.status = 'verified')
), numbered AS (SELECT *, count(*) OVER () AS total FROM hit ORDER BY name, id LIMIT 21)
SELECT id, name, (SELECT count(*) FROM numbered) > 20 AS truncated FROM numbered""")
def seed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment whose name holds a text and that placed a verified order, by name, n + 1, and a truncated flag."""
    f = NodeFilter(label="customer", name="7", property_contains=("segment", "BUILDING"))
    found = G.seeds(nodes(spark, sf_dir), edges(spark, sf_dir, ("placed",)), f, EdgeFilter("placed", "verified"), 20)
    return found.select("id", "name").crossJoin(found.agg((F.count(F.lit(1)) > 20).alias("truncated")))


@query(f"""WITH {GRAPH_SQL} SELECT id FROM nodes n WHERE label = 'customer' AND contains(name, '7')
  AND EXISTS (SELECT 1 FROM edges e WHERE e.rel_type = 'placed' AND e.src_id = n.id)""")
def seed_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir).where(G.node_condition(NodeFilter(label="customer", name="7")))
    placed = edges(spark, sf_dir, ("placed",)).select(F.col("src_id").alias("id"))
    return found.join(placed, "id", "left_semi").select("id")


@query(f"""WITH {GRAPH_SQL} SELECT n.id FROM nodes n WHERE label = 'part' AND contains(coalesce(source, ''), 'Brand#1')
  AND EXISTS (SELECT 1 FROM (SELECT src_id AS cur, dst_id AS nb, status, rel_type FROM edges UNION ALL SELECT dst_id, src_id, status, rel_type FROM edges) e
    JOIN nodes m ON m.id = e.nb WHERE e.cur = n.id AND e.rel_type = 'contains' AND e.status = 'pending' AND contains(m.name, '99'))""")
def seed_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a brand with a pending line in an order whose name holds a text: one edge meets all three."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir, ("contains",))
    found = n.where(G.node_condition(NodeFilter(label="part", source="Brand#1")))
    return found.join(G.matching_edges(n, e, EdgeFilter("contains", "pending", "99")).select(F.col("cur").alias("id")), "id", "left_semi").select("id")


@query(f"WITH {GRAPH_SQL} SELECT id, label, name FROM nodes WHERE contains(name, '12') OR id = 'nation:3' ORDER BY name, id LIMIT 50")
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir).where(F.col("name").contains("12") | (F.col("id") == "nation:3"))
    return found.select("id", "label", "name").orderBy("name", "id").limit(50)


@query(f"""WITH {GRAPH_SQL} SELECT src_id, rel_type, dst_id, a.name AS src_name, b.name AS dst_name FROM edges e
  JOIN nodes a ON a.id = e.src_id AND a.label = 'supplier' JOIN nodes b ON b.id = e.dst_id WHERE contains(rel_type, 'fro') ORDER BY rel_type, src_id, dst_id LIMIT 40""")
def search_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.search_edges(nodes(spark, sf_dir), edges(spark, sf_dir), "fro", "supplier", None, 40).select("src_id", "rel_type", "dst_id", "src_name", "dst_name")


@query(f"""WITH {GRAPH_SQL} SELECT i::INT AS ordinal, n.id, n.name FROM (VALUES (0, 'part:5'), (1, 'none:1'), (2, 'customer:7'), (3, 'region:1')) a(i, id) JOIN nodes n ON n.id = a.id""")
def lookup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lookup_nodes(nodes(spark, sf_dir), ["part:5", "none:1", "customer:7", "region:1"]).select("ordinal", "id", "name")


@query(f"WITH {GRAPH_SQL} SELECT id, name FROM nodes WHERE status = 'pending'")
def pending_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where(F.col("status") == "pending").select("id", "name")


@query(f"WITH {GRAPH_SQL} SELECT edge_id FROM edges WHERE status = 'pending'")
def pending_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was meant: edges are compared with the status they are stored with."""
    return edges(spark, sf_dir).where(F.col("status") == "pending").select("edge_id")


@query(f"""WITH {GRAPH_SQL} SELECT 'labels' AS metric, count(DISTINCT label) AS value FROM nodes UNION ALL SELECT 'nodes', count(*) FROM nodes
  UNION ALL SELECT 'relationship_types', count(DISTINCT rel_type) FROM edges UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'property_keys', count(DISTINCT k) FROM props""")
def meta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, k AS (SELECT label, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM props GROUP BY label)
SELECT label, count(*) AS n_nodes, coalesce(any_value(k.keys), '') AS keys FROM nodes LEFT JOIN k USING (label) GROUP BY label""")
def meta_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.labels(nodes(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL} SELECT rel_type, count(*) AS n_edges, count(DISTINCT status) AS n_statuses FROM edges GROUP BY rel_type UNION ALL SELECT 'treats', 0, 0""")
def meta_rel_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relationship_types(edges(spark, sf_dir), ["located_in", "from", "placed", "contains", "supplied_by", "treats"])


@query(f"WITH {GRAPH_SQL} SELECT k AS key, count(*) AS n_nodes, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM props GROUP BY k")
def meta_property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.property_keys(nodes(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, k AS (SELECT k AS key, count(*) AS n_nodes FROM props GROUP BY k) SELECT key, n_nodes FROM k WHERE contains(key, 'e') ORDER BY key LIMIT 3 OFFSET 1""")
def meta_keys_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered before paging, as meant."""
    return G.page(G.property_keys(nodes(spark, sf_dir)).where(F.col("key").contains("e")), ["key"], 1, 3).select("key", "n_nodes")


@query(f"""WITH {GRAPH_SQL} SELECT edge_id, a.name AS src_name, b.name AS dst_name FROM edges e JOIN nodes a ON a.id = src_id JOIN nodes b ON b.id = dst_id WHERE 'nation:3' IN (src_id, dst_id)""")
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relationships(nodes(spark, sf_dir), edges(spark, sf_dir), "nation:3").select("edge_id", "src_name", "dst_name")


def _hops(depth: int, limit: int) -> str:
    """The expansion's rules as unrolled SQL: five seeds, edges placed and contains."""
    sql = f"""WITH {GRAPH_SQL}, sym AS (
  SELECT src_id AS cur, dst_id AS nb, * FROM edges WHERE rel_type IN ('placed', 'contains') UNION ALL SELECT dst_id, src_id, * FROM edges WHERE rel_type IN ('placed', 'contains')
), n0 AS (SELECT id, 0 AS hop FROM (SELECT id, name FROM nodes WHERE label = 'customer' AND contains(name, '7') ORDER BY name, id LIMIT 5)),
e0 AS (SELECT edge_id, 0 AS hop FROM edges WHERE false), b0 AS (SELECT greatest({limit * depth}, (SELECT count(*) FROM n0)) - (SELECT count(*) FROM n0) AS nb_, {limit * depth} AS eb_)"""
    for h in range(1, depth + 1):
        p = h - 1
        sql += f""", r{h} AS (SELECT * FROM (SELECT nb, edge_id, row_number() OVER (ORDER BY cur, rel_type, nb, src_id) AS rn FROM sym WHERE cur IN (SELECT id FROM n{p} WHERE hop = {p})) WHERE rn <= (SELECT greatest(least(nb_, eb_), 0) FROM b{p})),
n{h} AS (SELECT * FROM n{p} UNION ALL SELECT DISTINCT nb, {h} FROM r{h} WHERE nb NOT IN (SELECT id FROM n{p})),
e{h} AS (SELECT * FROM e{p} UNION ALL SELECT DISTINCT edge_id, {h} FROM r{h} WHERE edge_id NOT IN (SELECT edge_id FROM e{p})),
b{h} AS (SELECT nb_ - (SELECT count(*) FROM n{h} WHERE hop = {h}) AS nb_, eb_ - (SELECT count(*) FROM e{h} WHERE hop = {h}) AS eb_ FROM b{p})"""
    return sql + f" SELECT 'node' AS kind, id, hop::INT AS hop FROM n{depth} UNION ALL SELECT 'edge', edge_id, hop::INT FROM e{depth}"


def _expanded(spark: SparkSession, sf_dir: str, depth: int, limit: int) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir, ("placed", "contains"))
    start = n.where(G.node_condition(NodeFilter(label="customer", name="7"))).orderBy("name", "id").limit(5)
    reached, kept = G.expand(n, e, start, depth, limit)
    return reached.select(F.lit("node").alias("kind"), "id", "hop").unionByName(kept.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "hop"))


@query(_hops(2, 20))
def expand_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, budgeted expansion, repeats removed: the flagship."""
    return _expanded(spark, sf_dir, 2, 20)


@query(_hops(3, 5))
def expand_budgeted_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 3, 5)


@query(_hops(1, 5))
def expand_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With as many seeds as the limit nothing is expanded at depth one."""
    return _expanded(spark, sf_dir, 1, 5)


@query(f"""WITH {GRAPH_SQL}, sym AS (SELECT src_id AS cur, dst_id AS nb, edge_id FROM edges WHERE rel_type IN ('located_in', 'from') UNION ALL SELECT dst_id, src_id, edge_id FROM edges WHERE rel_type IN ('located_in', 'from')),
t1 AS (SELECT nb, ['region:1', nb] AS path, [edge_id] AS ep, 1 AS length FROM sym WHERE cur = 'region:1'),
t2 AS (SELECT b.nb, list_append(path, b.nb) AS path, list_append(ep, b.edge_id) AS ep, 2 AS length FROM t1 JOIN sym b ON b.cur = t1.nb WHERE NOT list_contains(ep, b.edge_id))
SELECT array_to_string(path, '>') AS path, length::INT AS length FROM (SELECT * FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) AS t ORDER BY t.length, t.path, t.ep LIMIT 60)""")
def neighbourhood_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir, ("located_in", "from"))
    found, _ = G.neighbourhood(e, spark.range(1).select(F.lit("region:1").alias("id")), 2, 60)
    return found.select(F.array_join("path", ">").alias("path"), "length")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, sym AS (SELECT src_id AS cur, dst_id AS nb, edge_id FROM edges WHERE rel_type IN ('contains', 'supplied_by') UNION ALL SELECT dst_id, src_id, edge_id FROM edges WHERE rel_type IN ('contains', 'supplied_by')),
walk AS (SELECT 'part:1' AS cur, ['part:1'] AS path, []::VARCHAR[] AS ep UNION ALL
  SELECT b.nb, list_append(path, b.nb), list_append(ep, b.edge_id) FROM walk w JOIN sym b ON b.cur = w.cur WHERE len(ep) < 2 AND NOT list_contains(ep, b.edge_id))
SELECT array_to_string(path, '>') AS path, len(ep)::INT AS length FROM walk WHERE cur = 'part:2' AND len(ep) > 0""")
def find_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir, ("contains", "supplied_by"))
    return G.find_paths(e, "part:1", "part:2", 2).select(F.array_join("path", ">").alias("path"), F.col("length").cast("int").alias("length"))


@query(f"""WITH {GRAPH_SQL} SELECT least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b, count(*) AS n_edges, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS rel_types FROM edges GROUP BY ALL""")
def pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pair_groups(edges(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, o AS (SELECT src_id AS id, count(DISTINCT dst_id) AS n FROM edges WHERE rel_type = 'placed' GROUP BY 1), f AS (SELECT src_id AS id, string_agg(DISTINCT dst_id, ',' ORDER BY dst_id) AS nations FROM edges WHERE rel_type = 'from' GROUP BY 1)
SELECT v.id, name, coalesce(o.n, 0) AS n_orders, nations FROM nodes v LEFT JOIN o USING (id) LEFT JOIN f USING (id) WHERE label IN ('customer', 'supplier')""")
def variant_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node with two optional hops, each gathered before it is joined, so they do not multiply."""
    v = nodes(spark, sf_dir).where(F.col("label").isin("customer", "supplier")).select("id", "name")
    orders = edges(spark, sf_dir, ("placed",)).groupBy(F.col("src_id").alias("id")).agg(F.count_distinct("dst_id").alias("n_orders"))
    home = edges(spark, sf_dir, ("from",)).groupBy(F.col("src_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("dst_id")), ",").alias("nations"))
    return v.join(orders, "id", "left").join(home, "id", "left").na.fill(0, ["n_orders"])


@query(f"WITH {GRAPH_SQL} SELECT e.edge_id FROM edges e SEMI JOIN (SELECT id FROM nodes WHERE label IN ('customer', 'order') AND status <> 'rejected') a ON a.id = e.src_id SEMI JOIN (SELECT id FROM nodes WHERE status = 'verified') b ON b.id = e.dst_id")
def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referential filter: both ends must be among the nodes shown."""
    n = node_tables(spark, sf_dir)
    a = {x: n[x].where(F.col("status") != "rejected") for x in ("customer", "order")}
    b = {x: rows.where(F.col("status") == "verified") for x, rows in n.items()}
    return L.edge_table(L.between(links(spark, sf_dir), a, b)).select("edge_id")


@query(f"""WITH {GRAPH_SQL}, x AS (SELECT DISTINCT k FROM props WHERE label = 'customer'), y AS (SELECT DISTINCT k FROM props WHERE label = 'supplier'), z AS (SELECT DISTINCT k FROM props WHERE label = 'part')
SELECT 'both' AS kind, k AS key FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT 'only_customer', k FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT 'any', k FROM (SELECT * FROM x UNION SELECT * FROM z)""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of key sets."""
    k = nodes(spark, sf_dir).select("label", F.explode(F.map_keys("props")).alias("key")).distinct()
    x, y, z = (k.where(F.col("label") == s).select("key") for s in ("customer", "supplier", "part"))
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "key")
    return named("both", x.intersect(y)).unionByName(named("only_customer", x.subtract(y))).unionByName(named("any", x.unionByName(z).distinct()))


def _expansions(spark: SparkSession, sf_dir: str) -> list[L.Link]:
    """What opening a region brings: its nations, their customers and suppliers, the customers' orders."""
    return [x if x.rel == "placed" else x.turned() for x in links(spark, sf_dir, ("located_in", "from", "placed"))]


BELOW_SQL = """x AS (SELECT dst_id AS parent, src_id AS child FROM edges WHERE rel_type IN ('located_in', 'from') UNION ALL SELECT src_id, dst_id FROM edges WHERE rel_type = 'placed'),
below AS (SELECT 'region:1' AS id, 0 AS round UNION SELECT child, round + 1 FROM below JOIN x ON parent = id)"""


@query(f"WITH RECURSIVE {GRAPH_SQL}, {BELOW_SQL} SELECT id, round FROM below WHERE round > 0")
def expanded_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.expanded_below(_expansions(spark, sf_dir), "region", 1)
    rows = [rows.select(L.node_id(label, "key").alias("id"), "round") for label, rows in found.items()]
    return reduce(DataFrame.unionByName, rows).where("round > 0")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {BELOW_SQL}, gone AS (SELECT id FROM below WHERE round > 0) SELECT 'node' AS kind, label AS what, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY label
UNION ALL SELECT 'edge', rel_type, count(*) FROM edges WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone) GROUP BY rel_type UNION ALL SELECT 'expansion', split_part(parent, ':', 1), count(*) FROM x WHERE parent NOT IN (SELECT id FROM below) GROUP BY 2""")
def collapsed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the graph once a region is closed."""
    n, e, x = L.collapse(node_tables(spark, sf_dir), links(spark, sf_dir), _expansions(spark, sf_dir), "region", 1)
    by = lambda some, what: {k: [y.rows for y in some if what(y) == k] for k in dict.fromkeys(map(what, some))}
    part = lambda parts, kind: L.totals(parts).select(F.lit(kind).alias("kind"), "what", "n")
    nodes_left = part({label: [rows] for label, rows in n.items()}, "node")
    return nodes_left.unionByName(part(by(e, lambda y: y.rel), "edge")).unionByName(part(by(x, lambda y: y.src), "expansion"))


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT CASE WHEN src_id = 'nation:3' THEN dst_id ELSE src_id END AS id FROM edges WHERE 'nation:3' IN (src_id, dst_id)")
def neighbour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbour_ids(edges(spark, sf_dir), "nation:3")
