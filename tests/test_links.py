"""Queries on links: equal to their SQL on odd tables, with keys in their exchanges and not ids."""

import duckdb
import pytest

from trellis.plans.registry import ORACLES, QUERIES

SOURCE = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Rows added: keys seen twice, ends without a node, an order without lines, wide keys.
ODD = {
    "part": "SELECT * FROM part UNION ALL SELECT * FROM part WHERE p_partkey < 9",
    "orders": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey < 20 UNION ALL SELECT * REPLACE (9000000000000000001 + 2 * o_orderkey AS o_orderkey, '1-URGENT' AS o_orderpriority) FROM orders WHERE o_orderkey < 40 UNION ALL SELECT * REPLACE (7777 AS o_orderkey, 8888 AS o_custkey) FROM orders WHERE o_orderkey = 3",
    "lineitem": "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey < 30 UNION ALL SELECT * REPLACE (6666 AS l_orderkey) FROM lineitem WHERE l_orderkey < 5 UNION ALL SELECT * REPLACE (9000000000000000001 AS l_orderkey, 5555 AS l_partkey, 4444 AS l_suppkey) FROM lineitem WHERE l_orderkey = 1",
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SOURCE}/{t}.parquet'")
    for t in TABLES:
        con.execute(f"COPY ({ODD.get(t, f'SELECT * FROM {t}')}) TO '{at}/{t}.parquet' (FORMAT parquet)")
    return str(at)


def exchanged_text(df):
    """Text columns that any exchange of the plan carries, broadcasts being off."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found += [f.name() for f in node.schema().fields() if f.dataType().typeName() == "string"]
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def check(spark, odd, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    wanted = con.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    rows = sorted(wanted.fetchall(), key=repr)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = QUERIES[name](spark, odd)
        assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == rows and rows
        assert exchanged_text(df) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges_between(spark, odd):
    check(spark, odd, "edges_between")


def test_bulk_edge_groups(spark, odd):
    check(spark, odd, "bulk_edge_groups")


def test_lineage_completeness(spark, odd):
    check(spark, odd, "lineage_completeness")


def test_collapsed_graph(spark, odd):
    check(spark, odd, "collapsed_graph")


def test_expanded_below(spark, odd):
    check(spark, odd, "expanded_below")


def test_reset_scope(spark, odd):
    check(spark, odd, "reset_scope")
