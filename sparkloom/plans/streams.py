"""Event streams: windows, sessions, duplicates, late data, changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import load
from ..streaming.run import drain, stream
from ..streaming.state import changes
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


def _events(spark, sf_dir):
    return stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def q_stream_tumbling(spark, sf_dir):
    e = _events(spark, sf_dir).withWatermark("ts", "1 day")
    counts = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return drain(counts.select(F.col("w.start").alias("day"), "event_type", "n", "first_event"), "complete")


@R.query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def q_stream_session(spark, sf_dir):
    e = _events(spark, sf_dir).withWatermark("ts", "1 hour")
    sessions = e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drain(sessions.select("user_id", F.col("w.start").alias("started"), "n"), "complete")


@R.query("SELECT DISTINCT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day FROM events")
def q_stream_dedupe(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    return drain(e.withWatermark("day", "2 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]))


@R.query("""
    SELECT user_id, event_id, event_type, before FROM (SELECT user_id, event_id, event_type,
        lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type""")
def q_stream_changes(spark, sf_dir):
    return drain(changes(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", "event_type"))


@R.query("""
    SELECT user_id, event_id, value, before FROM (SELECT user_id, event_id, value,
        lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE abs(value - before) > 50""")
def q_fingerprint_change(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lag("value").over(w).alias("before"))
    return e.where(F.abs(F.col("value") - F.col("before")) > 50)


@R.query("""
    SELECT event_type, CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR THEN 'due' ELSE 'cancelled' END AS outcome, count(*) AS n
    FROM events GROUP BY 1, 2""")
def q_late(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    top = e.agg(F.max("ts").alias("top"))  # one row
    outcome = F.when(F.col("ts") >= F.col("top") - F.expr("INTERVAL 24 HOURS"), "due").otherwise("cancelled")
    return e.join(F.broadcast(top)).groupBy("event_type", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@R.query("""
    SELECT user_id, event_type, count(*) AS evals, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2
    HAVING count(*) >= 10 ORDER BY evals DESC, user_id, event_type LIMIT 50""")
def q_recurring(spark, sf_dir):
    g = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("evals"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return g.where("evals >= 10").orderBy(F.desc("evals"), "user_id", "event_type").limit(50)


@R.query("""
    WITH b AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS open_orders, max(o_orderdate) AS last_at FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN open_orders = 0 THEN 'finished' ELSE 'waiting' END AS event, sha256(n::VARCHAR || ':' || open_orders::VARCHAR) AS fingerprint FROM b""")
def q_group_barrier(spark, sf_dir):
    g = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("open"))
    return g.select(
        "o_custkey", F.when(F.col("open") == 0, "finished").otherwise("waiting").alias("event"),
        F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("open").cast("string")), 256).alias("fingerprint"),
    )
