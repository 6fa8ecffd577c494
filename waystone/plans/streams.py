"""Queries that run the streaming jobs over `events` and `orders`, with their batch twins as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waystone.plans.columns import AS_OF
from waystone.plans.feeds import _REC
from waystone.plans.registry import query
from waystone.streaming import jobs as J


def _snapshots(v):
    e = J.event_stream(v.spark, v.sf_dir)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("source_id"), "ts", F.sha2("event_type", 256).alias("content_sha"))


def _audits(v):
    e = J.event_stream(v.spark, v.sf_dir)
    return e.select(F.col("user_id").alias("source_id"), F.to_date("ts").cast("string").alias("day"), (F.col("event_type") == "error").alias("active"))


query("STM-01", "SELECT user_id AS source_id, event_id AS seq, CASE WHEN p IS NULL THEN 'first_seen' WHEN p = event_type THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")(
    lambda v: v.spark.read.parquet(J.drained(J.content_changes(_snapshots(v))))
)


def _merge(v):
    stream = J.event_stream(v.spark, v.sf_dir, "orders.parquet")
    # the collected feed's rows as a stream: orders joined with the static side of the view
    rows = stream.select(F.col("o_orderkey").alias("event_id")).filter("event_id % 10 >= 3").join(v.new_feed, "event_id")
    return J.merged(rows.select(*v.old_feed.columns), v.old_feed, AS_OF).select("event_id", "start_date", "end_date")


query("STM-02", _REC + " SELECT event_id, start_date, end_date FROM fresh UNION ALL SELECT event_id, start_date, end_date FROM kept WHERE event_id NOT IN (SELECT old_id FROM pairs WHERE old_id IS NOT NULL)")(_merge)
query("STM-03", "WITH d AS (SELECT user_id AS source_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'error') AS a FROM events GROUP BY 1, 2), m AS (SELECT *, sum(CASE WHEN a THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY day) AS island FROM d) SELECT source_id, CAST(day AS VARCHAR) AS run_date, CASE WHEN a THEN CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, island ORDER BY day) AS BIGINT) ELSE 0 END AS streak FROM m")(
    lambda v: v.spark.read.parquet(J.drained(J.day_streaks(_audits(v))))
)
query("STM-04", "SELECT source_id, CAST(day AS VARCHAR) AS run_date, CAST((row_number() OVER (PARTITION BY source_id ORDER BY day) - 1) * 3 % 10 AS BIGINT) AS start FROM (SELECT DISTINCT user_id AS source_id, CAST(ts AS DATE) AS day FROM events)")(
    lambda v: v.spark.read.parquet(J.drained(J.rotation_cursors(_audits(v), 3, 10)))
)
query(
    "STM-05",
    "WITH RECURSIVE d AS (SELECT DISTINCT user_id AS source_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT source_id, min(day) AS day FROM d GROUP BY source_id UNION ALL SELECT r.source_id, (SELECT min(d.day) FROM d WHERE d.source_id = r.source_id AND d.day >= r.day + 7) FROM r WHERE r.day IS NOT NULL) SELECT source_id, CAST(day AS VARCHAR) AS checked_on FROM r WHERE day IS NOT NULL",
)(lambda v: v.spark.read.parquet(J.drained(J.due_rechecks(_audits(v)))))
query("STM-06", "SELECT DISTINCT user_id AS source_id, sha256(event_type) AS content_sha FROM events")(lambda v: v.spark.read.parquet(J.drained(J.without_repeats(_snapshots(v), ["source_id", "content_sha"]))).select("source_id", "content_sha"))
query("STM-07", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")(lambda v: _daily(v))


def _daily(v):
    return v.spark.read.parquet(J.drained(J.daily_counts(J.event_stream(v.spark, v.sf_dir))))


def _visits(v):
    e = J.event_stream(v.spark, v.sf_dir)
    lat = F.lit(24.0) + (F.col("event_id") * 7919 % 20000).cast("double") / 1e3 + 1e-3
    return J.snapped_visits(e.select(F.col("event_id").alias("visit_id"), lat.alias("lat"), (F.lit(123.0) + (F.col("event_id") * 104729 % 22000).cast("double") / 1e3).alias("lng")), v.stations)


from waystone.plans.registry import ORACLE_SQL  # noqa: E402

query("STM-08")(_visits)
if "JN-11" in ORACLE_SQL:
    ORACLE_SQL["STM-08"] = ORACLE_SQL["JN-11"]
