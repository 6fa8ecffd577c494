"""Queries on stations, sources and audits: JN, AGG, WIN-05 to 12, SRT-02 to 06 and 12, SET-05."""

from __future__ import annotations

from pyspark.sql import functions as F

from waystone.operators import coverage as C
from waystone.operators import reconcile as R
from waystone.operators import schedule as S
from waystone.operators.setops import source_warnings, warnings
from waystone.plans.columns import AS_OF
from waystone.plans.feeds import _LIVE
from waystone.plans.registry import query

# Joins ------------------------------------------------------------------------------------------------------------
query("JN-01", f"SELECT s.id, e.event_id, e.start_date FROM stations s JOIN events_pub e ON s.name = e.road_name AND (e.event_id % 3 = 0 OR e.prefecture = s.prefecture) WHERE {_LIVE}")(
    lambda v: C.live_at_station(v.stations, v.events_pub.filter(R.live(AS_OF)).withColumn("prefecture", F.when(F.col("event_id") % 3 > 0, F.col("prefecture")))).select("id", "event_id", "start_date")
)
query(
    "JN-02",
    f"""SELECT s.id, n.events, a.audits, CASE WHEN n.live > 0 THEN 'verified_event' WHEN a.audits > 0 THEN 'audited_source' WHEN s.id % 5 = 0 THEN 'configured_not_checked' WHEN n.events > 0 THEN 'other_collector' ELSE 'none' END AS state
FROM stations s LEFT JOIN (SELECT road_name, count(*) AS events, count(*) FILTER ({_LIVE}) AS live FROM events_pub GROUP BY road_name) n ON s.name = n.road_name LEFT JOIN (SELECT source_id, count(*) AS audits FROM source_audit GROUP BY source_id) a ON s.id = a.source_id""",
)(
    lambda v: C.inventory(
        v.stations.select("id", "name"),
        [v.events_pub.join(v.stations.select(F.col("name").alias("road_name"), "id"), "road_name").groupBy("id").agg(F.count("*").alias("events"), F.count_if(R.live(AS_OF)).alias("live")), v.source_audit.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("audits"))],
    ).select("id", "events", "audits", C.coverage_state(F.col("live") > 0, F.col("audits") > 0, F.col("id") % 5 == 0, F.col("events") > 0).alias("state"))
)
query("JN-03", f"SELECT id FROM stations WHERE name IN (SELECT road_name FROM events_pub WHERE {_LIVE})")(lambda v: v.stations.join(v.events_pub.filter(R.live(AS_OF)).select(F.col("road_name").alias("name")), "name", "left_semi").select("id"))
query("JN-04", "SELECT id FROM stations WHERE id NOT IN (SELECT source_id FROM source_audit)")(lambda v: v.stations.join(v.source_audit.select(F.col("source_id").alias("id")), "id", "left_anti").select("id"))
query("JN-05", "SELECT l.id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS state, CASE WHEN n = 1 THEN m END AS match_id FROM (SELECT id, id % 1500 * 2 AS k FROM landmarks) l LEFT JOIN (SELECT k, count(*) AS n, min(id) AS m FROM (SELECT id, id - id % 3 AS k FROM stations) GROUP BY k) s USING (k)")(
    lambda v: C.unique_match(v.landmarks.select("id", (F.col("id") % 1500 * 2).alias("k")), v.stations.select((F.col("id") - F.col("id") % 3).alias("k"), F.col("id").alias("station_id")), "k", "id", "station_id").select("id", "state", "match_id")
)
_BARE = "regexp_replace({0}, '^道の駅|[\\s・･.\\-‐–—「」]', '', 'g')"
query(
    "JN-06",
    f"""WITH l AS (SELECT event_id, unnest(list_concat(regexp_extract_all(title, '【([^】]{{2,80}})】', 1), regexp_extract_all(title, '〖([^〗]{{2,80}})〗', 1))) AS label FROM notices),
k AS (SELECT event_id, label, {_BARE.format('label')} AS t FROM l), m AS (SELECT id, {_BARE.format('name')} AS t FROM stations),
hit AS (SELECT event_id, id FROM k JOIN m ON k.t = m.t AND length(m.t) >= 2 UNION SELECT event_id, id FROM k JOIN m ON contains(label, '道の駅') AND length(m.t) >= 3 AND contains(k.t, m.t))
SELECT event_id, min(id) AS station FROM hit GROUP BY event_id HAVING count(DISTINCT id) = 1""",
)(lambda v: C.named_stations(v.notices, v.stations))


def _listed_ratios() -> str:
    """The ratios of all title keys that the fixtures can have."""
    from difflib import SequenceMatcher

    keys = [p + s + n for p in ("1urgent", "2high", "3medium", "4notspecified", "5low") for s in "fop" for n in ("", "new")]
    return "(VALUES " + ", ".join(f"('{a}', '{b}', {SequenceMatcher(None, a, b, autojunk=False).ratio()}::DOUBLE)" for a in keys for b in keys) + ") s(t, o, score)"


def _ratios(pairs: str) -> str:
    """The matching-blocks ratio `score` of each two texts (t, o) of a query: the longest block that both have, the first of these in
    the one and then in the other text, and the same again for what lies before it in both and what lies behind it."""
    block = "list_max(list_filter(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(x) - i + 2), lambda n: {'n': n, 'i': -i}))), lambda e: contains(y, substring(x, -e.i, e.n))))"
    return f"""(WITH RECURSIVE pr AS (SELECT DISTINCT t, o FROM ({pairs})),
w AS (SELECT t, o, side, CASE WHEN side = 0 THEN t END AS x, CASE WHEN side = 0 THEN o END AS y, CAST(0 AS BIGINT) AS n FROM pr, (VALUES (0)) z(side)
UNION ALL SELECT t, o, side, CASE WHEN side = 1 THEN left(x, -m.i - 1) ELSE substring(x, -m.i + m.n, length(x)) END, CASE WHEN side = 1 THEN left(y, j - 1) ELSE substring(y, j + m.n, length(y)) END, CASE WHEN side = 1 THEN m.n ELSE 0 END
FROM (SELECT t, o, x, y, m, instr(y, substring(x, -m.i, m.n)) AS j FROM (SELECT t, o, x, y, {block} AS m FROM w WHERE x <> '' AND y <> '') WHERE m IS NOT NULL), (VALUES (1), (2)) z(side))
SELECT t, o, CASE WHEN length(t) + length(o) = 0 THEN 1.0 ELSE 2.0 * CAST(sum(n) AS DOUBLE) / (length(t) + length(o)) END AS score FROM w GROUP BY t, o) s"""


_KEY8 = "regexp_replace(lower({0}), '[\\s\\-]', '', 'g')"
_LIKE8 = f"(SELECT x.event_id, y.event_id AS b_id, {_KEY8.format('x.title')} AS t, {_KEY8.format('y.title')} AS o FROM new_feed x JOIN old_feed y ON x.road_name = y.road_name AND x.start_date <= y.end_date AND y.start_date <= x.end_date)"
_LIKE9 = f"new_feed x JOIN old_feed y ON x.road_name = y.road_name AND x.start_date <= y.end_date AND y.start_date <= x.end_date JOIN {_listed_ratios()} ON s.t = {_KEY8.format('x.title')} AND s.o = {_KEY8.format('y.title')}"
query("JN-08", f"WITH like8 AS {_LIKE8} SELECT event_id AS a_id, b_id, round(score, 6) AS score FROM like8 JOIN {_ratios('SELECT t, o FROM like8')} USING (t, o) WHERE score >= 0.75")(lambda v: C.similar_titles(v.new_feed, v.old_feed, "road_name", 0.75))


def _rules(v):
    return v.nation.select(F.col("n_name").alias("prefecture"), F.col("n_nationkey").alias("rule_id"), F.col("n_regionkey").alias("rule_order"), F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("h"), i.cast("string"), F.lit(".example.jp"))).alias("hosts"), F.when(F.col("n_nationkey") % 2 == 0, "/news/[0-9]+").otherwise("/news/[0-4]+").alias("path_pattern"))


query("JN-10", "SELECT e.event_id, n.n_nationkey AS rule_id FROM events_pub e JOIN nation n ON e.prefecture = n.n_name WHERE regexp_matches(regexp_extract(url, '^https://[^/]+(/.*)$', 1), CASE WHEN n.n_nationkey % 2 = 0 THEN '^(?:/news/[0-9]+)$' ELSE '^(?:/news/[0-4]+)$' END)")(
    lambda v: C.first_rule(v.events_pub, _rules(v))
)
query("JN-14", "SELECT id, CASE WHEN region IN ('ASIA', 'EUROPE') THEN concat(region, ' summary') WHEN region = 'AFRICA' THEN 'EUROPE summary' END AS summary, region IN ('ASIA', 'EUROPE', 'AFRICA') AS matched FROM stations")(
    lambda v: C.alias_overlay(v.stations, v.region.filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_name").alias("region"), F.concat("r_name", F.lit(" summary")).alias("summary")), v.region.filter("r_name = 'EUROPE'").select(F.col("r_name").alias("region"), F.lit("AFRICA").alias("alias")), "region").select("id", "summary", "matched")
)
query("JN-15", "SELECT n.event_id, coalesce(o.status, 'pending') AS review_status FROM new_feed n LEFT JOIN old_feed o ON n.event_id = o.event_id AND n.url = o.url")(
    lambda v: C.carried(v.new_feed.select("event_id", "url"), v.old_feed.select("event_id", "url", F.col("status").alias("review_status")), ["event_id", "url"]).select("event_id", "review_status")
)
query("JN-16", "SELECT n.event_id, CASE WHEN o.title = n.title AND o.start_date = n.start_date AND o.end_date = n.end_date THEN 'confirmed' WHEN o.url IS NOT NULL THEN 'identity_changed' ELSE 'unknown' END AS state FROM new_feed n LEFT JOIN old_feed o ON n.url = o.url")(lambda v: C.reconfirmed(v.new_feed, v.old_feed))
query("JN-18", "SELECT event_id FROM events_pub e WHERE feed < 3 OR NOT EXISTS (SELECT 1 FROM events_pub p WHERE p.feed < 3 AND p.prefecture = e.prefecture AND p.title = e.title AND p.start_date = e.start_date)")(lambda v: C.without_secondary(v.events_pub, F.col("feed") < 3, ["prefecture", "title", "start_date"]).select("event_id"))
query("JN-19", "SELECT source_id, kind, priority FROM (SELECT DISTINCT user_id AS source_id, event_type AS kind FROM events) JOIN (VALUES ('error', 1), ('view', 3), ('click', 2)) r(kind, priority) USING (kind)")(
    lambda v: v.events.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("kind")).distinct().withColumn("priority", F.try_element_at(F.create_map(F.lit("error"), F.lit(1), F.lit("view"), F.lit(3), F.lit("click"), F.lit(2)), F.col("kind"))).filter("priority is not null")
)
_NAV = "title IN ('イベント', 'イベント情報', 'お知らせ', '催し') OR contains(url, '/category/') OR regexp_matches(url, '/(events|news|notices|news-tag/event)/?$')"
_T20 = "regexp_replace(lower({0}title), '[\\s\\-]', '', 'g')"
query(
    "JN-20",
    f"""WITH n AS (SELECT event_id, road_name, url, {_T20.format('')} AS t FROM (SELECT * REPLACE (CASE WHEN event_id % 41 = 0 THEN 'イベント情報' ELSE title END AS title, CASE WHEN event_id % 7 = 0 THEN concat(url, '-b') ELSE url END AS url) FROM new_feed) WHERE NOT ({_NAV})),
o AS (SELECT url, road_name, {_T20.format('')} AS t FROM old_feed),
pu AS (SELECT n.event_id, n.t, o.t AS o FROM n JOIN o ON n.url = o.url), pr AS (SELECT DISTINCT n.event_id, n.t, o.t AS o FROM n JOIN o ON n.road_name = o.road_name),
sc AS MATERIALIZED (SELECT t, o, score FROM {_ratios('SELECT t, o FROM pu UNION ALL SELECT t, o FROM pr')}),
u AS (SELECT event_id, bool_or(contains(o, t) OR contains(t, o) OR score >= 0.75) AS same FROM pu JOIN sc USING (t, o) GROUP BY event_id),
r AS (SELECT event_id, bool_or(score >= 0.8) AS near FROM pr JOIN sc USING (t, o) GROUP BY event_id)
SELECT n.event_id, CASE WHEN u.same THEN 'same_url_and_title' WHEN u.event_id IS NOT NULL THEN 'same_url_title_differs' WHEN r.near THEN 'possible_same_event_other_url' WHEN r.event_id IS NOT NULL THEN 'unmatched_official_notice' ELSE 'station_not_identified' END AS state FROM n LEFT JOIN u USING (event_id) LEFT JOIN r USING (event_id)""",
)(
    lambda v: C.classified(
        v.new_feed.withColumns({"title": F.when(F.col("event_id") % 41 == 0, "イベント情報").otherwise(F.col("title")), "url": F.when(F.col("event_id") % 7 == 0, F.concat("url", F.lit("-b"))).otherwise(F.col("url"))}),
        v.old_feed,
    )
)


# Aggregations -----------------------------------------------------------------------------------------------------
_UN = "SELECT prefecture FROM old_feed WHERE event_id % 97 = 0 AND prefecture < 'NATION_2'"
_RULE01 = "CASE WHEN coalesce(u, 0) > 0 THEN '{0}' WHEN coalesce(events, 0) > 0 THEN '{1}' WHEN coalesce(c, 0) > 0 THEN '{2}' ELSE '{3}' END"
query(
    "AGG-01",
    f"""SELECT n_name AS prefecture, coalesce(events, 0) AS events, coalesce(stations, 0) AS stations, coalesce(feeds, 0) AS feeds, coalesce(u, 0) AS unconfirmed, coalesce(c, 0) AS configured, h.prefecture IS NOT NULL OR coalesce(events, 0) > 0 AS ever_observed,
  {_RULE01.format('needs_reconfirmation', 'events_observed', 'targeted_feed_no_registered_events', 'no_registered_events')} AS state, {_RULE01.format('recheck_known_event', 'expand_station_coverage', 'inspect_official_article_dates', 'discover_prefecture_station_feeds')} AS next_action
FROM nation LEFT JOIN (SELECT prefecture, count(*) AS events, count(DISTINCT road_name) AS stations, count(DISTINCT feed) AS feeds FROM events_pub WHERE {_LIVE} AND prefecture < 'NATION_7' GROUP BY prefecture) e ON n_name = e.prefecture LEFT JOIN (SELECT prefecture, count(*) AS u FROM ({_UN}) GROUP BY prefecture) u ON n_name = u.prefecture
LEFT JOIN (SELECT prefecture, count(*) AS c FROM stations WHERE id % 9 = 0 AND prefecture > 'NATION_5' GROUP BY prefecture) c ON n_name = c.prefecture LEFT JOIN (SELECT DISTINCT prefecture FROM old_feed WHERE prefecture < 'NATION_8') h ON n_name = h.prefecture""",
)(
    lambda v: C.by_prefecture(
        v.nation.select(F.col("n_name").alias("prefecture")), v.events_pub.filter(R.live(AS_OF) & (F.col("prefecture") < "NATION_7")), v.old_feed.filter((F.col("event_id") % 97 == 0) & (F.col("prefecture") < "NATION_2")),
        v.old_feed.filter("prefecture < 'NATION_8'"), v.stations.filter("id % 9 = 0 and prefecture > 'NATION_5'"),
    )
)
query("AGG-02", "SELECT region, s.prefecture, CAST(grouping(region, s.prefecture) AS INT) AS grain, count(*) AS events, count(DISTINCT road_name) AS stations FROM events_pub e JOIN (SELECT DISTINCT prefecture, region FROM stations) s ON e.prefecture = s.prefecture GROUP BY ROLLUP (region, s.prefecture)")(
    lambda v: C.rolled_up(v.events_pub.join(v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("prefecture"), F.col("r_name").alias("region")), "prefecture"))
)
query("AGG-03", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'view') AS past, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id")(
    lambda v: C.counters(v.events, "user_id", {"accepted": F.col("event_type") == "purchase", "past": F.col("event_type") == "view", "failed": F.col("event_type") == "error"})
)
query("AGG-04", "SELECT status, count(*) AS n FROM events_pub GROUP BY status")(lambda v: C.status_counts(v.events_pub, "status"))
query("AGG-05", "SELECT source_id % 47 AS bucket, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(accepted) AS BIGINT) AS accepted, count(*) FILTER (fetch_failed > 0) AS trouble, count(*) FILTER (candidates > 0) AS working, CAST(sum(greatest(0, candidates - checked - accepted)) AS BIGINT) AS unverified FROM source_audit GROUP BY 1")(
    lambda v: C.source_health(v.source_audit.withColumn("bucket", F.col("source_id") % 47))
)
query("AGG-06", "SELECT source_id, CAST(sum(CASE WHEN source_id % 2 = 0 THEN candidates END) AS BIGINT) AS candidates, CAST(sum(CASE WHEN source_id % 2 = 1 THEN checked END) AS BIGINT) AS checked FROM source_audit GROUP BY source_id")(
    lambda v: C.unified_health([v.source_audit.filter("source_id % 2 = 0").select("source_id", "candidates"), v.source_audit.filter("source_id % 2 = 1").select("source_id", "checked")])
)
query("AGG-07", f"SELECT prefecture, count(*) AS stations, count(*) FILTER (id IN (SELECT source_id FROM source_audit)) AS with_source, count(*) FILTER (name IN (SELECT road_name FROM events_pub WHERE {_LIVE})) AS with_event FROM stations GROUP BY prefecture")(
    lambda v: v.stations.join(v.source_audit.select(F.col("source_id").alias("id")).distinct().withColumn("s", F.lit(True)), "id", "left").join(v.events_pub.filter(R.live(AS_OF)).select(F.col("road_name").alias("name")).distinct().withColumn("e", F.lit(True)), "name", "left").groupBy("prefecture").agg(F.count("*").alias("stations"), F.count_if("s").alias("with_source"), F.count_if("e").alias("with_event"))
)
_ONE = {
    "stations": ("stations", "count(*)"),
    "stations_with_source": ("stations SEMI JOIN source_audit ON id = source_id", "count(*)"),
    "live": (f"events_pub WHERE {_LIVE}", "count(*)"),
    "prefectures": (f"events_pub WHERE {_LIVE}", "count(DISTINCT prefecture)"),
    "published_stations": (f"events_pub WHERE {_LIVE}", "count(DISTINCT road_name)"),
    "sources": ("source_audit", "count(DISTINCT source_id)"),
    "audits": ("source_audit", "count(*)"),
    "fetch_problems": ("source_audit", "count(DISTINCT source_id) FILTER (fetch_failed > 0)"),
    "without_candidates": ("source_audit", "count(*) FILTER (candidates = 0)"),
    "at_limit": ("source_audit", "count(*) FILTER (candidates >= 4)"),
    "uninspected": ("source_audit", "CAST(sum(greatest(0, candidates - checked)) AS BIGINT)"),
    "accepted": ("source_audit", "CAST(sum(accepted) AS BIGINT)"),
    "last_audit": ("source_audit", "max(run_date)"),
    "leads": ("old_feed", "count(*)"),
    "lead_prefectures": ("old_feed", "count(DISTINCT prefecture)"),
    "cancelled": ("events_pub", "count(*) FILTER (status = 'cancelled')"),
}
query("AGG-08", "SELECT " + ", ".join(f"(SELECT {what} FROM {table}) AS {name}" for name, (table, what) in _ONE.items()))(lambda v: C.run_summary(v.stations, v.events_pub, v.events_pub.filter(R.live(AS_OF)), v.source_audit, v.old_feed, 4))
_R9 = f"SELECT x.event_id FROM {_LIKE9} WHERE score >= 0.83"
query("AGG-09", f"SELECT p AS positives, f AS found, round(CASE WHEN p > 0 THEN f / p END, 3) AS recall FROM (SELECT count(*) AS p, count(*) FILTER (event_id IN ({_R9})) AS f FROM new_feed WHERE end_date >= DATE '1996-01-01')")(lambda v: C.recall(v.new_feed, v.old_feed, AS_OF))
query(
    "AGG-10",
    f"""WITH zero AS (SELECT n_name AS prefecture FROM nation WHERE n_name NOT IN (SELECT prefecture FROM events_pub WHERE {_LIVE} AND event_id % 4 = 0)),
a AS (SELECT prefecture, count(DISTINCT source_id) AS sources, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(greatest(0, candidates - checked)) AS BIGINT) AS uninspected, CAST(sum(fetch_failed) AS BIGINT) AS failed FROM source_audit JOIN stations ON id = source_id GROUP BY prefecture),
o AS (SELECT prefecture, count(*) AS leads FROM old_feed GROUP BY prefecture)
SELECT prefecture, coalesce(sources, 0) AS sources, coalesce(candidates, 0) AS candidates, coalesce(checked, 0) AS checked, coalesce(accepted, 0) AS accepted, coalesce(uninspected, 0) AS uninspected, coalesce(failed, 0) AS failed, coalesce(leads, 0) AS leads,
  CASE WHEN coalesce(sources, 0) > 0 THEN 'verify_existing_adapter_rejections' ELSE 'configure_and_verify_new_official_station_feed' END AS next_action
FROM zero LEFT JOIN a USING (prefecture) LEFT JOIN o USING (prefecture)""",
)(
    lambda v: C.zero_coverage_actions(
        v.nation.select(F.col("n_name").alias("prefecture")).join(v.events_pub.filter(R.live(AS_OF) & (F.col("event_id") % 4 == 0)).select("prefecture"), "prefecture", "left_anti"),
        v.source_audit.join(v.stations.select(F.col("id").alias("source_id"), "prefecture"), "source_id"),
        v.old_feed,
    )
)
query(
    "AGG-11",
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY prefecture, road_name, title, start_date, end_date ORDER BY event_id) AS copy FROM events_pub) SELECT event_id, 'critical' AS level, 'duplicate' AS reason FROM e WHERE copy > 1 UNION ALL SELECT event_id, 'critical', 'expired' FROM e WHERE end_date < DATE '1996-01-01' UNION ALL SELECT event_id, 'review', 'long_period' FROM e WHERE date_diff('day', start_date, end_date) > 120 UNION ALL SELECT event_id, 'review', 'future_stamp' FROM e WHERE published_at > DATE '1996-01-01' UNION ALL SELECT event_id, 'review', 'unknown_station' FROM e WHERE road_name NOT IN (SELECT name FROM stations WHERE id % 100 > 0)",
)(lambda v: C.quality_issues(v.events_pub, v.stations.filter("id % 100 > 0"), AS_OF))
query(
    "AGG-12",
    "SELECT 'prefectures' AS name, (SELECT count(*) FROM nation) = 25 AS ok UNION ALL SELECT 'unique_ids', (SELECT count(*) = count(DISTINCT id) FROM stations) UNION ALL SELECT 'totals_agree', (SELECT count(*) FROM events_pub) = (SELECT count(*) FROM orders) UNION ALL SELECT 'same_prefectures', (SELECT count(*) FROM ((SELECT prefecture FROM stations EXCEPT SELECT n_name FROM nation) UNION ALL (SELECT n_name FROM nation EXCEPT SELECT prefecture FROM stations))) = 0 UNION ALL SELECT 'audits_fresh', coalesce((SELECT date_diff('day', max(run_date), DATE '2024-02-02') FROM source_audit) BETWEEN 0 AND 7, FALSE)",
)(
    lambda v: C.invariants(
        [
            ("prefectures", v.nation.agg((F.count("*") == 25).alias("ok"))),
            ("unique_ids", v.stations.agg((F.count("*") == F.countDistinct("id")).alias("ok"))),
            ("totals_agree", v.events_pub.agg(F.count("*").alias("a")).crossJoin(F.broadcast(v.orders.agg(F.count("*").alias("b")))).select((F.col("a") == F.col("b")).alias("ok"))),
            ("same_prefectures", C.same_set(v.stations.select("prefecture"), v.nation.select(F.col("n_name").alias("prefecture")))),
            ("audits_fresh", C.fresh(v.source_audit, "run_date", "2024-02-02", 7)),
        ]
    )
)
query("AGG-13", "SELECT count(DISTINCT id) AS total, count(DISTINCT CASE WHEN id % 4 > 0 THEN id END) AS inspected, count(DISTINCT id) - count(DISTINCT CASE WHEN id % 4 > 0 THEN id END) AS remaining, CAST(ceil((count(DISTINCT id) - count(DISTINCT CASE WHEN id % 4 > 0 THEN id END)) / 96) AS BIGINT) AS days FROM stations")(lambda v: C.backlog(v.stations, "id", F.col("id") % 4 > 0, 96))
query("AGG-14", "WITH k AS (SELECT regexp_replace(lower(name), '[\\s。、.,!?]', '', 'g') AS k, count(*) AS n, count(*) FILTER (length(name) > 0) AS f, count(*) FILTER (length(name) < 25) AS s, count(*) FILTER (length(name) > 35) AS l FROM landmarks GROUP BY 1) SELECT CAST(sum(f) AS BIGINT) AS filled, CAST(sum(s) AS BIGINT) AS short, CAST(sum(l) AS BIGINT) AS long, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicates FROM k")(lambda v: C.summary_audit(v.landmarks, "name"))
_SOURCES = ("purchase", "click", "error")
query("AGG-15", f"SELECT user_id, coalesce(visits, 0) AS visits, last_visit, latest, greatest(last_visit, other) AS last_activity FROM (SELECT user_id, count(*) AS visits, max(ts) AS last_visit, max({{'t': ts, 'v': visit_id}}).v AS latest FROM visits WHERE visit_id % 2 = 0 GROUP BY user_id) FULL JOIN (SELECT user_id, max(ts) AS other FROM events WHERE event_type IN {_SOURCES} GROUP BY user_id) USING (user_id)")(
    lambda v: C.activity(v.visits.filter("visit_id % 2 = 0"), *[v.events.filter(F.col("event_type") == k).select("user_id", "ts") for k in _SOURCES]).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_visit", "last_activity")})
)
_HAV = "(12742.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _km(a, b, c, d):
    return _HAV.format(h=f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))")


query(
    "AGG-16",
    f"WITH t AS (SELECT user_id, {_km('p', 'q', 'lat', 'lng')} AS leg, {_km('f', 'g', 'lat', 'lng')} AS direct, ts, visit_id FROM (SELECT user_id, lat, lng, ts, visit_id, lag(lat) OVER w AS p, lag(lng) OVER w AS q, first_value(lat) OVER w AS f, first_value(lng) OVER w AS g FROM visits WINDOW w AS (PARTITION BY user_id ORDER BY ts, visit_id))), s AS (SELECT user_id, sum(leg) AS total, max({{'t': ts, 'v': visit_id, 'd': direct}}).d AS direct FROM t GROUP BY user_id) SELECT user_id, round(total, 6) AS total, round(CASE WHEN direct > 0 THEN total / direct END, 6) AS ratio FROM s",
)(lambda v: C.leg_totals(v.visits))
query("AGG-17", "SELECT road_name, string_agg(concat(start_date, ':', event_id), ',' ORDER BY start_date, event_id) AS events, min(start_date) AS first_start FROM events_pub GROUP BY road_name")(lambda v: C.grouped_events(v.events_pub))
query("AGG-18", "SELECT source_id, run_date, CASE WHEN fetch_failed > 0 THEN 'error' WHEN candidates = 0 THEN 'no_candidates' WHEN checked < candidates THEN 'review_candidates' ELSE 'active' END AS state, greatest(0, candidates - checked) AS uninspected, candidates >= 4 AS at_limit FROM source_audit")(lambda v: C.health_row(v.source_audit, 4))
_WARN = [("fetch_error", "fetch_failed > 0"), ("nothing_accepted", "accepted = 0"), ("at_limit", "candidates >= 4"), ("not_audited_since", "run_date < DATE '2024-01-15'")]
query("AGG-19", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM source_audit WHERE {c} HAVING count(*) > 0" for k, c in _WARN))(lambda v: C.status_counts(warnings(v.source_audit, ["source_id"], [(k, F.expr(c)) for k, c in _WARN]), "kind"))
_CONF = "(SELECT id AS source_id, region FROM stations WHERE id % 7 > 0)"
query(
    "SET-05",
    f"""WITH c AS {_CONF}, l AS (SELECT source_id, max(run_date) AS run_date FROM source_audit GROUP BY source_id),
m AS (SELECT *, sum(CASE WHEN accepted = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY run_date) AS island FROM source_audit),
e AS (SELECT source_id, run_date, accepted, sum(CASE WHEN accepted = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, island ORDER BY run_date) AS streak FROM m)
SELECT source_id, run_date, 'fetch_error' AS kind FROM source_audit WHERE fetch_failed > 0 UNION ALL SELECT source_id, run_date, 'suspended_evidence' FROM source_audit WHERE candidates > 0 AND checked = 0
UNION ALL SELECT source_id, run_date, 'at_limit' FROM source_audit WHERE candidates >= 4 UNION ALL SELECT source_id, run_date, 'stale_audit' FROM l WHERE date_diff('day', run_date, DATE '2024-02-02') > 7
UNION ALL SELECT source_id, run_date, 'unknown_source' FROM l WHERE source_id NOT IN (SELECT source_id FROM c) UNION ALL SELECT source_id, NULL, 'not_audited' FROM c WHERE source_id NOT IN (SELECT source_id FROM l)
UNION ALL SELECT source_id, run_date, 'repeatedly_empty' FROM e WHERE accepted = 0 AND streak = 3
UNION ALL SELECT min(a.source_id), run_date, 'region_unreachable' FROM source_audit a JOIN c ON a.source_id = c.source_id GROUP BY region, run_date HAVING bool_and(fetch_failed > 0)""",
)(lambda v: source_warnings(v.source_audit, v.stations.filter("id % 7 > 0").select(F.col("id").alias("source_id"), "region"), "2024-02-02", 4))

# Windows and orders -----------------------------------------------------------------------------------------------
query("WIN-05", "WITH m AS (SELECT *, fetch_failed > 0 AS a, sum(CASE WHEN fetch_failed > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY run_date) AS island FROM source_audit) SELECT source_id, run_date, CASE WHEN a THEN CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, island ORDER BY run_date) AS BIGINT) ELSE 0 END AS streak FROM m")(
    lambda v: S.streaks(v.source_audit, F.col("fetch_failed") > 0).select("source_id", "run_date", "streak")
)
query("WIN-06", "SELECT source_id, event_id FROM (SELECT user_id AS source_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 12 OR rn <= 9 OR ((rn - 9 - 1 - source_id % 5) % (n - 9) + (n - 9)) % (n - 9) < 3")(
    lambda v: S.budgeted(v.events.select(F.col("user_id").alias("source_id"), "event_id", "event_type"), "source_id", ["event_type", "event_id"], 12, None, F.col("source_id") % 5).select("source_id", "event_id")
)
query("WIN-07", "SELECT prefecture, id FROM (SELECT prefecture, id, row_number() OVER (PARTITION BY prefecture ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY prefecture) AS n FROM stations) WHERE n <= 20 OR ((rn - (date_diff('day', DATE '1970-01-01', DATE '1996-01-01') + 719163) * 20 % n) % n + n) % n < 20")(
    lambda v: S.rechecked(v.stations, "prefecture", ["id"], 20, AS_OF).select("prefecture", "id")
)
query("WIN-08", "SELECT event_id FROM (SELECT event_id, road_name, start_date, event_id % 3 = 0 AS seen, row_number() OVER (PARTITION BY road_name ORDER BY start_date, event_id) AS rn FROM events_pub) ORDER BY CASE WHEN NOT seen AND rn = 1 THEN 0 ELSE 1 END, seen, start_date, event_id LIMIT 700")(
    lambda v: S.fair_first_pass(v.events_pub.withColumn("seen", F.col("event_id") % 3 == 0), "road_name", "seen", ["start_date", "event_id"], 700).select("event_id")
)
query("WIN-09", "SELECT id FROM stations LEFT JOIN (SELECT source_id, max(run_date) AS d FROM source_audit GROUP BY source_id) ON id = source_id WHERE d IS NULL OR date_diff('day', d, DATE '2024-02-02') >= 7")(
    lambda v: S.eligible(v.stations, v.source_audit.withColumnRenamed("source_id", "id"), ["id"], "2024-02-02").select("id")
)
query("WIN-10", "SELECT id, CAST(('0x' || substring(sha256(CAST(id AS VARCHAR)), 1, 8))::BIGINT % 7 AS INT) AS slot FROM stations")(lambda v: v.stations.select("id", S.slot(F.col("id"), 7).alias("slot")))
query("WIN-11", "SELECT id FROM (SELECT id, id // 40 AS page, row_number() OVER (PARTITION BY id // 40 ORDER BY id) - 1 AS pos FROM stations) WHERE page > 5 OR (page = 5 AND pos >= 7) ORDER BY page, pos LIMIT 96")(
    lambda v: S.page_batch(v.stations, F.floor(F.col("id") / 40), ["id"], 40, (5, 7), 96).select("id")
)
query("WIN-12", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 3")(lambda v: S.capped(v.events, ["user_id", "event_type"], ["event_id"], 3).select("user_id", "event_type", "event_id"))
_RANK = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


def _queue(v, limit):
    return S.ranked_queue(v.orders.select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus", F.col("o_custkey") % 47), {"o_orderpriority": _RANK, "o_orderstatus": {"F": 1, "O": 2}}, ["id"], limit).select("id", "o_orderpriority_rank")


def _queue_sql(limit):
    case = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 99 END"
    return f"SELECT o_orderkey AS id, CAST({case} AS INT) AS o_orderpriority_rank FROM orders ORDER BY 2, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 99 END, 1 LIMIT {limit}"


query("SRT-02", _queue_sql(120))(lambda v: _queue(v, 120))
query("SRT-03", "SELECT event_id AS id, url FROM new_feed ORDER BY CASE substring(title, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 ELSE 99 END, CASE status WHEN 'scheduled' THEN 1 ELSE 99 END, feed, url, event_id LIMIT 150")(
    lambda v: S.ranked_queue(v.new_feed.withColumn("priority", F.substring("title", 1, 1)), {"priority": {"1": 1, "2": 2, "3": 3}, "status": {"scheduled": 1}}, ["feed", "url", "event_id"], 150).select(F.col("event_id").alias("id"), "url")
)
query("SRT-04", "SELECT region, count(*) AS gap, CASE WHEN count(*) > 300 THEN 1 ELSE 2 END AS action_rank FROM stations WHERE id NOT IN (SELECT source_id FROM source_audit) GROUP BY region ORDER BY 3, 2 DESC, 1")(
    lambda v: v.stations.join(v.source_audit.select(F.col("source_id").alias("id")), "id", "left_anti").groupBy("region").agg(F.count("*").alias("gap")).withColumn("action_rank", F.when(F.col("gap") > 300, 1).otherwise(2)).orderBy("action_rank", F.desc("gap"), "region")
)
query("SRT-05", "SELECT id, (SELECT count(*) FROM stations) - 50 AS remaining FROM stations ORDER BY CASE WHEN prefecture IN ('NATION_3', 'NATION_7') THEN 0 ELSE 1 END, id % 3, id LIMIT 50")(
    lambda v: S.shortlist(v.stations, [F.when(F.col("prefecture").isin("NATION_3", "NATION_7"), 0).otherwise(1), F.col("id") % 3, F.col("id")], 50).select("id", "remaining")
)
query("SRT-06", "SELECT id FROM stations ORDER BY CASE WHEN prefecture = 'NATION_5' THEN 0 ELSE 1 END, CASE category WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 99 END, id LIMIT 96")(
    lambda v: S.ranked_queue(v.stations.withColumn("urgent", F.when(F.col("prefecture") == "NATION_5", "y").otherwise("n")), {"urgent": {"y": 0, "n": 1}, "category": {"BUILDING": 1, "MACHINERY": 2}}, ["id"], 96).select("id")
)
query("SRT-12", "SELECT prefecture, n_nationkey AS ord, count(*) AS n FROM stations JOIN nation ON prefecture = n_name GROUP BY 1, 2 ORDER BY 2, 1")(
    lambda v: v.stations.groupBy("prefecture").agg(F.count("*").alias("n")).join(v.nation.select(F.col("n_name").alias("prefecture"), F.col("n_nationkey").alias("ord")), "prefecture").orderBy("ord", "prefecture")
)
