"""Queries on published events and feeds: FLT, WIN-01 to 04, JN-07 and 09, REC, SET, SRT-01."""

from __future__ import annotations

from pyspark.sql import functions as F

from waystone.operators import reconcile as R
from waystone.operators.setops import union_feeds
from waystone.plans.columns import AS_OF, clean
from waystone.plans.registry import query

_OK = "url <> '' AND road_name <> '' AND title <> '' AND start_date <= end_date AND end_date >= DATE '1996-01-01'"
_LIVE = "end_date >= DATE '1996-01-01' AND status <> 'cancelled' AND (published_at IS NULL OR published_at <= DATE '1996-01-01')"
query("FLT-01", f"SELECT event_id, road_name, start_date, end_date FROM events_pub WHERE {_OK}")(lambda v: v.events_pub.filter(R.plausible(v.events_pub, AS_OF)).select("event_id", "road_name", "start_date", "end_date"))
query("FLT-02", f"SELECT event_id, road_name, start_date, end_date FROM events_pub WHERE {_LIVE}")(lambda v: v.events_pub.filter(R.live(AS_OF)).select("event_id", "road_name", "start_date", "end_date"))
query("FLT-03", "WITH r AS (SELECT event_id, substring(title, 1, 10) AS title, CASE WHEN event_id % 5 > 0 THEN url ELSE '' END AS url, coalesce(title IS NULL OR start_date > end_date, TRUE) AS bad FROM events_pub) SELECT *, (SELECT count(*) FILTER (bad) = 0 FROM r) AS accepted FROM r")(
    lambda v: R.sanitised(v.events_pub.withColumn("url", F.when(F.col("event_id") % 5 > 0, F.col("url")).otherwise(F.replace("url", F.lit("https:"), F.lit("http:")))), 10)
)
query("FLT-04", "SELECT event_id, CASE WHEN published_at > DATE '1996-01-01' THEN NULL ELSE published_at END AS published_at FROM events_pub")(lambda v: R.without_future_stamps(v.events_pub, AS_OF)[0].select("event_id", "published_at"))
query("FLT-04-warnings", "SELECT DISTINCT url, published_at FROM events_pub WHERE published_at > DATE '1996-01-01'")(lambda v: R.without_future_stamps(v.events_pub, AS_OF)[1])
query("FLT-09", "SELECT event_id FROM periods WHERE NOT regexp_matches(trim(text), '^[～〜~]')")(lambda v: v.periods.filter(~R.open_start(F.col("text"))).select("event_id"))
query("WIN-01", "SELECT road_name, start_date, event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY road_name, start_date ORDER BY length(title), seq) AS rn, min(seq) OVER (PARTITION BY road_name, start_date) AS position FROM events_pub) WHERE rn = 1")(
    lambda v: R.shortest_title(v.events_pub, ["road_name", "start_date"]).select("road_name", "start_date", "event_id", "position")
)
_BOTH = "(SELECT *, 0 AS side FROM old_feed UNION ALL SELECT *, 1 FROM new_feed)"
_BADGE = f"trim(regexp_replace(regexp_replace(regexp_replace({clean('title')}, '(?i)\\s+new!?$', ''), '^[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}\\s*', ''), '(?i)^(event|news)\\s+', ''))"


def _both(v):
    return v.old_feed.withColumn("side", F.lit(0)).unionByName(v.new_feed.withColumn("side", F.lit(1)))


query("WIN-02", f"SELECT event_id, side, headline FROM (SELECT *, row_number() OVER (PARTITION BY url, road_name, prefecture, headline, start_date, end_date ORDER BY seq, side) AS rn FROM (SELECT *, {_BADGE} AS headline FROM {_BOTH})) WHERE rn = 1")(
    lambda v: R.first_of(_both(v).withColumn("headline", R.T.strip_badges(F.col("title"))), ["url", "road_name", "prefecture", "headline", "start_date", "end_date"], ["seq", "side"]).select("event_id", "side", "headline")
)
query("WIN-03", "SELECT prefecture, status, max(event_id) AS event_id FROM events_pub GROUP BY prefecture, status")(lambda v: R.last_wins(v.events_pub.select("prefecture", "status", "seq", "event_id"), ["prefecture", "status"], "seq").select("prefecture", "status", "event_id"))
query("WIN-04", "SELECT prefecture, status, min(event_id) AS event_id FROM events_pub GROUP BY prefecture, status")(lambda v: R.first_wins(v.events_pub.select("prefecture", "status", "seq", "event_id"), ["prefecture", "status"], "seq").select("prefecture", "status", "event_id"))
query("JN-07", "SELECT x.event_id AS new_id, y.event_id AS old_id, count(*) OVER (PARTITION BY x.event_id) = 1 AS correction FROM new_feed x JOIN old_feed y ON x.road_name = y.road_name AND x.start_date <= y.end_date AND y.start_date <= x.end_date")(lambda v: R.overlaps(v.new_feed, v.old_feed, "road_name"))
_IDENT = "lower(road_name)"
query("JN-09", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events_pub a JOIN events_pub b ON a.prefecture = b.prefecture AND a.start_date = b.start_date AND a.title = b.title AND a.url < b.url")(
    lambda v: R.possible_duplicates(v.events_pub.withColumn("road_name", F.col("prefecture")))
)
_SIDE = """SELECT event_id, seq, road_name, prefecture, {badge} AS title, start_date, end_date, url FROM {side}"""
_REC = f"""WITH o AS ({_SIDE.format(badge=_BADGE, side='old_feed')}), n AS ({_SIDE.format(badge=_BADGE, side='new_feed')}),
kept AS (SELECT *, concat_ws('|', url, road_name, title) AS ident FROM o WHERE {_OK}), fresh AS (SELECT *, concat_ws('|', url, road_name, title) AS ident FROM n WHERE {_OK}),
pairs AS (SELECT f.*, k.event_id AS old_id, k.start_date AS old_start, k.end_date AS old_end FROM fresh f LEFT JOIN kept k ON f.ident = k.ident AND k.start_date <= f.end_date AND f.start_date <= k.end_date)"""
query("REC-01", _REC + " SELECT event_id, start_date, end_date FROM fresh UNION ALL SELECT event_id, start_date, end_date FROM kept WHERE event_id NOT IN (SELECT old_id FROM pairs WHERE old_id IS NOT NULL)")(
    lambda v: R.reconcile(v.old_feed, v.new_feed, AS_OF)["published"].select("event_id", "start_date", "end_date")
)
query("REC-01-corrected", _REC + " SELECT event_id, old_start, start_date, end_date FROM pairs WHERE old_id IS NOT NULL AND (old_start <> start_date OR old_end <> end_date)")(
    lambda v: R.reconcile(v.old_feed, v.new_feed, AS_OF)["corrected"].select("event_id", "old_start", "start_date", "end_date")
)
query("REC-01-exact", _REC + " SELECT event_id FROM pairs WHERE old_start = start_date AND old_end = end_date")(lambda v: R.reconcile(v.old_feed, v.new_feed, AS_OF)["exact_duplicates"].select("event_id"))
query("REC-01-unseen", _REC + " SELECT event_id FROM kept WHERE ident NOT IN (SELECT ident FROM fresh)")(lambda v: R.reconcile(v.old_feed, v.new_feed, AS_OF)["not_reconfirmed"].select("event_id"))
query("REC-01-expired", f"SELECT event_id FROM old_feed WHERE NOT coalesce({_OK}, FALSE)")(lambda v: R.reconcile(v.old_feed, v.new_feed, AS_OF)["expired_or_invalid"].select("event_id"))
query("REC-01-invalid-new", f"SELECT event_id FROM new_feed WHERE NOT coalesce({_OK}, FALSE)")(lambda v: R.reconcile(v.old_feed, v.new_feed, AS_OF)["invalid_new"].select("event_id"))
query("REC-02", "SELECT url, start_date, max(event_id) AS event_id FROM (SELECT * FROM old_feed WHERE end_date >= DATE '1996-01-01' UNION ALL SELECT * FROM new_feed) GROUP BY url, road_name, start_date")(
    lambda v: R.merged_stage(v.old_feed, v.new_feed, AS_OF).select("url", "start_date", "event_id")
)
query("SET-01", "SELECT 0 AS feed, count(*) AS n, count(label) AS labels FROM (SELECT NULL AS label FROM old_feed) UNION ALL SELECT 2, count(*), count(*) FROM new_feed")(
    lambda v: union_feeds({0: v.old_feed, 1: None, 2: v.new_feed.withColumn("label", F.lit("new"))}).groupBy("feed").agg(F.count("*").alias("n"), F.count("label").alias("labels"))
)
query("SET-02", "SELECT road_name, 'history_only' AS kind FROM (SELECT road_name FROM old_feed EXCEPT SELECT road_name FROM new_feed) UNION ALL SELECT road_name, 'both' FROM (SELECT road_name FROM old_feed INTERSECT SELECT road_name FROM new_feed)")(
    lambda v: v.old_feed.select("road_name").subtract(v.new_feed.select("road_name")).withColumn("kind", F.lit("history_only")).unionByName(v.old_feed.select("road_name").intersect(v.new_feed.select("road_name")).withColumn("kind", F.lit("both")))
)
query("SET-03", f"SELECT road_name FROM old_feed UNION SELECT road_name FROM new_feed WHERE {_OK}")(lambda v: v.old_feed.select("road_name").unionByName(v.new_feed.filter(R.plausible(v.new_feed, AS_OF)).select("road_name")).distinct())
query("SET-04", "SELECT 'road' AS kind, id, name, lat, lng FROM stations UNION ALL SELECT 'landmark', id, name, lat, lng FROM landmarks")(
    lambda v: v.stations.select(F.lit("road").alias("kind"), "id", "name", "lat", "lng").unionByName(v.landmarks.select(F.lit("landmark").alias("kind"), "id", "name", "level", "lat", "lng"), allowMissingColumns=True).drop("level")
)
query("SNK-01", f"SELECT count(*) AS n, count(DISTINCT event_id) AS ids, TRUE AS first_written, FALSE AS written_again FROM events_pub WHERE {_LIVE}")(lambda v: _published(v))


def _published(v):
    """The live events, published twice: the second time nothing has changed."""
    from waystone.sources.files import scratch

    path, rows = scratch(v.spark), v.events_pub.filter(R.live(AS_OF))
    wrote = [R.write_if_changed(rows, path), R.write_if_changed(rows, path)]
    held = v.spark.read.schema(rows.schema).parquet(path)
    return held.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.lit(wrote[0]).alias("first_written"), F.lit(wrote[1]).alias("written_again"))


query("SRT-01", f"SELECT event_id, start_date, road_name, title FROM events_pub WHERE {_LIVE} ORDER BY start_date, road_name, title, event_id")(
    lambda v: v.events_pub.filter(R.live(AS_OF)).select("event_id", "start_date", "road_name", "title").orderBy("start_date", "road_name", "title", "event_id")
)
