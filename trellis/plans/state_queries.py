"""Queries on operational state: sessions, turns, runs, reviews, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links as L
from ..operators import state as T
from .registry import query
from .views import GRAPH_SQL, links, node_tables, nodes, table


@query("""SELECT event_type, user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_type", "user_id", "event_id", "ts")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sessions(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""SELECT event_type, count(*) AS n, count_if(value >= 50) AS n_kept, count_if(value < 50) AS n_dropped, round(count_if(value >= 50) / count(*)::DOUBLE, 6) AS success_rate FROM events GROUP BY event_type""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.count_if(F.col("value") >= 50)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), ok.alias("n_kept"), F.count_if(F.col("value") < 50).alias("n_dropped"), F.round(F.coalesce(F.try_divide(ok, F.count(F.lit(1))), F.lit(0.0)), 6).alias("success_rate"))


RUN_SQL = """ev AS (SELECT user_id AS run_id, event_id AS seq, (hour(ts) % 7)::INT AS step_index, CASE WHEN event_id % 23 = 0 THEN 'rollback' WHEN event_id % 3 = 0 THEN 'confirm' ELSE 'preview' END AS action FROM events)"""


@query(f"""WITH {RUN_SQL}, st AS (SELECT * FROM ev WHERE action <> 'rollback'),
j AS (SELECT s.*, (SELECT max(CASE WHEN r.step_index = s.step_index THEN 1 ELSE 0 END) FROM ev r WHERE r.action = 'rollback' AND r.run_id = s.run_id AND r.seq > s.seq AND r.step_index <= s.step_index) AS z FROM st s)
SELECT run_id, step_index, coalesce(max_by(CASE action WHEN 'confirm' THEN 'confirmed' ELSE 'previewed' END, seq) FILTER (z IS NULL), 'pending') AS status, count(*) FILTER (action = 'preview' AND (z IS NULL OR z = 0)) AS version FROM j GROUP BY run_id, step_index""")
def run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of runs after previews, confirmations and rollbacks."""
    action = F.when(F.col("event_id") % 23 == 0, "rollback").when(F.col("event_id") % 3 == 0, "confirm").otherwise("preview")
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.hour("ts") % 7).cast("int").alias("step_index"), action.alias("action"))
    return T.run_fold(ev)


@query("""SELECT conv_id, count(*) AS n_turns, count_if(role = 'user') AS n_user, sum(length(text))::BIGINT AS n_chars, arg_max(role, turn) AS last_role, arg_min(left(text, 20), turn) AS opening FROM conversations GROUP BY conv_id""")
def turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"), F.max_by("role", "turn").alias("last_role"), F.min_by(F.left("text", F.lit(20)), "turn").alias("opening"))


@query("""WITH g AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'reset ' ELSE '' END || string_agg(coalesce(text, ''), '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc FROM conversations),
l AS (SELECT *, lag(acc) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM g) SELECT conv_id, turn, CASE WHEN b IS NOT NULL AND starts_with(acc, b) THEN substr(acc, length(b) + 1) ELSE acc END AS chunk FROM l""".replace(" ORDER BY turn) OVER", ") OVER"))
def suffix_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what a growing answer (all turns so far) adds; all of it where it was begun anew."""
    from pyspark.sql import Window as W

    so_far = F.collect_list(F.coalesce("text", F.lit(""))).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    acc = F.concat(F.when(F.col("turn") % 4 == 3, "reset ").otherwise(""), F.array_join(so_far, ""))
    return T.suffix_chunks(table(spark, sf_dir, "conversations").withColumn("acc", acc), "conv_id", "turn", "acc").select("conv_id", "turn", "chunk")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS seg, 's' || (c_custkey % 2) AS src FROM customer WHERE c_acctbal >= 0), o AS (SELECT o_custkey AS k, max(o_orderpriority) AS seg FROM orders GROUP BY 1),
i AS (SELECT c_custkey AS k, coalesce(o.seg, c_mktsegment) AS seg, CASE WHEN o.k IS NULL THEN 'late' ELSE 'orders' END AS src FROM customer LEFT JOIN o ON o.k = c_custkey WHERE o.k IS NOT NULL OR c_acctbal < 0)
SELECT coalesce(c.k, i.k) AS k, coalesce(nullif(c.seg, ''), i.seg) AS seg, concat_ws(',', c.src, i.src) AS srcs FROM c FULL JOIN i ON c.k = i.k""")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, or fill what is empty and append to the lists. Customers in credit are there, all others come in
    with those that have orders."""
    k, customers = F.col("c_custkey"), table(spark, sf_dir, "customer")
    c = customers.where("c_acctbal >= 0").select(k.alias("k"), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"), F.array(F.concat(F.lit("s"), (k % 2).cast("string"))).alias("srcs"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("o")).agg(F.max("o_orderpriority").alias("top"))
    i = customers.join(o, k == F.col("o"), "left").where("o IS NOT NULL OR c_acctbal < 0")
    i = i.select(k.alias("k"), F.coalesce("top", "c_mktsegment").alias("seg"), F.array(F.when(F.col("o").isNull(), "late").otherwise("orders")).alias("srcs"))
    return T.upsert(c, i, ["k"], ["seg"], ["srcs"]).select("k", "seg", F.array_join("srcs", ",").alias("srcs"))


@query(f"""WITH {GRAPH_SQL}, d AS (SELECT 'order:' || l_orderkey AS id, CASE WHEN sum(l_quantity) > 100 THEN 'verified' ELSE 'rejected' END AS decision FROM lineitem GROUP BY 1)
SELECT n.id, CASE WHEN n.status = 'pending' AND d.decision IS NOT NULL THEN d.decision ELSE n.status END AS status FROM nodes n LEFT JOIN d USING (id) WHERE label = 'order'""")
def verify_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("label = 'order'")
    d = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("order:"), "l_orderkey").alias("id")).agg(F.when(F.sum("l_quantity") > 100, "verified").otherwise("rejected").alias("decision"))
    return T.verify(n, d, "id").select("id", "status")


@query(f"""WITH {GRAPH_SQL}, gone AS (SELECT * FROM edges WHERE scope = '1-URGENT'), kept AS (SELECT * FROM edges WHERE scope <> '1-URGENT'), x AS (SELECT src_id AS id FROM gone UNION SELECT dst_id FROM gone), y AS (SELECT src_id AS id FROM kept UNION SELECT dst_id FROM kept)
SELECT 'nodes' AS kind, label AS what, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM x EXCEPT SELECT id FROM y) GROUP BY label UNION ALL SELECT 'edges', rel_type, count(*) FROM kept GROUP BY rel_type""")
def reset_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = L.reset_scope(node_tables(spark, sf_dir), links(spark, sf_dir), F.col("scope") == "1-URGENT")
    a = L.totals({label: [rows] for label, rows in n.items()}).withColumn("kind", F.lit("nodes"))
    return a.unionByName(L.totals({rel: [x.rows for x in e if x.rel == rel] for rel in dict.fromkeys(x.rel for x in e)}).withColumn("kind", F.lit("edges")))


@query("""SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'yes' WHEN value / 100 <= 0.3 THEN 'no' WHEN value IS NOT NULL THEN 'unsure' ELSE 'missing' END AS verdict FROM events""")
def judgement_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.three_way(F.col("value") / 100).alias("verdict"))


@query("""WITH p AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k, k % 10 AS bucket FROM p""")
def json_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return p.select("event_id", "k", (F.col("k") % 10).alias("bucket"))


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e),
a AS (SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, s) SELECT * FROM a WHERE last_ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions from a stream over the events' files, written out as they close.

    A finished run returns the sessions that are closed by then: those whose thirty quiet minutes end before the
    watermark, one hour behind the last event. Later ones stay in the stream's state for the next run.
    """
    import uuid

    from ..shared import shared_dir
    from ..streaming.sessions import event_stream, session_stream

    at = f"{shared_dir(spark)}/trellis/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(2).write.parquet(f"{at}/in")
    out = session_stream(event_stream(spark, f"{at}/in", source.schema))
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    kind = events.schema["ts"].dataType
    return spark.read.schema(out.schema).parquet(f"{at}/out").withColumns({c: F.col(c).cast(kind) for c in ("first_ts", "last_ts")})
