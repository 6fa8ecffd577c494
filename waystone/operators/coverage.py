"""Joins of stations, sources, audits and events, and the reports on them (JN, AGG)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.functions import geo as G
from waystone.functions import text as T
from waystone.functions.udfs import ratcliff
from waystone.operators.reconcile import overlapping
from waystone.sources.files import written


def live_at_station(stations: DataFrame, events: DataFrame) -> DataFrame:
    """JN-01: stations with events of the same name key whose prefecture is equal or unknown on a side."""
    e = events.select(T.station_key(F.col("road_name")).alias("_key"), F.col("prefecture").alias("_p"), "event_id", "start_date")
    s = stations.withColumn("_key", T.station_key(F.col("name")))
    return s.join(e, "_key").filter(F.col("_p").isNull() | F.col("prefecture").isNull() | (F.col("_p") == F.col("prefecture"))).drop("_key", "_p")


def inventory(stations: DataFrame, sides: list[DataFrame], key: str = "id") -> DataFrame:
    """JN-02: every station with the counts of several pre-aggregated sides; no side fans out. Absent counts are null."""
    return reduce(lambda a, b: a.join(b, key, "left"), sides, stations)


def coverage_state(verified: Column, audited: Column, configured: Column, other: Column) -> Column:
    """JN-02 states: the strongest evidence wins."""
    return F.when(verified, "verified_event").when(audited, "audited_source").when(configured, "configured_not_checked").when(other, "other_collector").otherwise("none")


def unique_match(notices: DataFrame, master: DataFrame, key: str, id: str, other_id: str) -> DataFrame:
    """JN-05: matched if exactly one master row has the notice's key, else ambiguous or unmatched."""
    n = master.groupBy(key).agg(F.count("*").alias("_n"), F.min(other_id).alias("_m"))
    got = notices.join(n, key, "left")
    return got.select(*[c for c in notices.columns], F.when(F.col("_n") == 1, "matched").when(F.col("_n") > 1, "ambiguous").otherwise("unmatched").alias("state"), F.when(F.col("_n") == 1, F.col("_m")).alias("match_id"))


#: The most beginnings of keys that are sent to all tasks.
BEGINNINGS = 2000


def containment(notices: DataFrame, master: DataFrame, text: str, key: str, least: int = 3) -> DataFrame:
    """Notices whose text contains a master key of `least` or more characters.

    Each text gives its parts of the lengths that keys have, so containment is an equi-join, whatever the keys share. Parts
    that begin as no key does go first: of the beginnings of equal length, the longest that are at most about
    `BEGINNINGS` are sent to all tasks. What the driver reads is the distinct lengths of keys and one row of counts.
    """
    names = master.filter(F.length(key) >= least)
    sizes = sorted(r["n"] for r in names.select(F.length(key).alias("n")).distinct().collect())
    if not sizes:
        return notices.join(master.limit(0), F.lit(True))
    # F.transform counts a second parameter of its function, default or not, as the place in the array
    cut = lambda n: lambda i: F.substring(F.col(text), i, F.lit(n))
    parts = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), cut(n))).otherwise(F.array().cast("array<string>")) for n in sizes]
    # outer: Spark would push "has parts" below, which makes the parts twice
    a = notices.withColumn("_part", F.explode_outer(F.array_distinct(F.concat(*parts)))).filter("_part is not null")
    tried = range(1, min(sizes[-1], 32) + 1)
    counts = names.agg(*[F.approx_count_distinct(F.substring(key, 1, n), 0.02) for n in tried]).first()
    short = max((n for n, c in zip(tried, counts, strict=True) if c <= BEGINNINGS), default=0)
    if short:
        begins = names.select(F.substring(key, 1, short).alias("_begin")).distinct()
        a = a.join(F.broadcast(begins), F.substring("_part", 1, short) == F.col("_begin"), "left_semi")
    return a.join(names, F.col("_part") == F.col(key)).drop("_part")


def named_stations(notices: DataFrame, stations: DataFrame, id: str = "event_id", title: str = "title") -> DataFrame:
    """JN-06: (id, station) where the title's 【】 or 〖〗 labels name exactly one station.

    A label names a station if their keys are equal (two characters or more), or if it says 道の駅 and its key contains
    the station's (three or more).
    """
    bare = lambda c: F.regexp_replace(T.station_key(c), "[「」]", "")
    labels = F.flatten(F.array(*[F.regexp_extract_all(F.col(title), F.lit(p), F.lit(1)) for p in ("【([^】]{2,80})】", "〖([^〗]{2,80})〗")]))
    parts = notices.select(id, F.explode(labels).alias("_label")).select(id, bare(F.col("_label")).alias("_text"), F.contains("_label", F.lit("道の駅")).alias("_says"))
    master = stations.select(F.col("id").alias("station"), bare(F.col("name")).alias("_key"))
    equal = parts.join(master.filter(F.length("_key") >= 2), F.col("_text") == F.col("_key")).select(id, "station")
    inside = containment(parts.filter("_says").select(id, "_text"), master, "_text", "_key").select(id, "station")
    both = equal.union(inside).groupBy(id).agg(F.min("station").alias("station"), F.max("station").alias("_last"))
    return both.filter("station = _last").drop("_last")


def ratio_bound(a: Column, b: Column) -> Column:
    """What the matching-blocks ratio can't exceed: twice the characters that both have, over both lengths. Native."""
    n = F.length(a) + F.length(b)
    many = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda m, c: m + F.when(c == "", 0).otherwise(F.least(many(a, c), many(b, c))))
    return F.when(n == 0, 1.0).otherwise(2.0 * common / n)


def alike(rows: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Rows whose columns a and b have a matching-blocks ratio (`score`) of `least` or more. Only rows that pass the bounds by lengths
    and by characters go to Python."""
    x, y = F.col(a), F.col(b)
    n = F.length(x) + F.length(y)
    near = rows.filter((2 * F.least(F.length(x), F.length(y)) >= least * n) & (ratio_bound(x, y) >= least))
    return near.withColumn("score", F.when(x == y, 1.0).otherwise(ratcliff(x, y))).filter(F.col("score") >= least)


def similar_titles(a: DataFrame, b: DataFrame, key: str, least: float) -> DataFrame:
    """JN-08: rows of one station with overlapping periods and titles whose keys have a matching-blocks ratio of `least`
    or more; blocked by station and time, and each two different titles are compared once."""
    got = overlapping(a, b, key).select(F.col("x.event_id").alias("a_id"), F.col("y.event_id").alias("b_id"), T.title_key(F.col("x.title")).alias("_t"), T.title_key(F.col("y.title")).alias("_o"))
    scored = alike(got.select("_t", "_o").distinct(), "_t", "_o", least)
    return got.join(scored, ["_t", "_o"]).select("a_id", "b_id", F.round("score", 6).alias("score"))


def first_rule(events: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-10: the first rule, by its order, of the event's prefecture whose hosts and path pattern fit its url."""
    from waystone.functions.urls import part

    got = events.join(rules, "prefecture").filter(F.array_contains("hosts", part(F.col("url"), 2)) & F.rlike(part(F.col("url"), 3), F.concat(F.lit("^(?:"), F.col("path_pattern"), F.lit(")$"))))
    return got.groupBy("event_id").agg(F.min_by("rule_id", "rule_order").alias("rule_id"))


def alias_overlay(rows: DataFrame, summaries: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """JN-14: the summary under the name's key or under the key it is an alias of."""
    table = summaries.unionByName(aliases.join(summaries, key).select(F.col("alias").alias(key), "summary"))
    return rows.join(table.groupBy(key).agg(F.min("summary").alias("summary")), key, "left").withColumn("matched", F.col("summary").isNotNull())


def carried(queue: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """JN-15: review flags of the previous queue, pending where there are none."""
    return queue.join(previous, keys, "left").withColumn("review_status", F.coalesce("review_status", F.lit("pending")))


def reconfirmed(events: DataFrame, verified: DataFrame) -> DataFrame:
    """JN-16: confirmed if url, title, start and end are those of a verified event; identity_changed if only the url is."""
    full = verified.select("url", "title", "start_date", "end_date").distinct().withColumn("_same", F.lit(True))
    known = verified.select("url").distinct().withColumn("_known", F.lit(True))
    got = events.join(full, ["url", "title", "start_date", "end_date"], "left").join(known, "url", "left")
    return got.select("event_id", F.when(F.col("_same"), "confirmed").when(F.col("_known"), "identity_changed").otherwise("unknown").alias("state"))


def without_secondary(rows: DataFrame, primary: Column, keys: list[str]) -> DataFrame:
    """JN-18: rows of secondary sources go where the primary source has the same keys."""
    main = rows.filter(primary).select(*keys).distinct()
    return rows.filter(primary).unionByName(rows.filter(~primary).join(main, keys, "left_anti"))


def by_prefecture(prefectures: DataFrame, events: DataFrame, unconfirmed: DataFrame, history: DataFrame, configured: DataFrame) -> DataFrame:
    """AGG-01: events, stations, feeds, unconfirmed events, whether any was ever observed, configured sources, state and
    next action of every prefecture, those without rows included. `history` and `configured` have a column prefecture."""
    e = events.groupBy("prefecture").agg(F.count("*").alias("events"), F.countDistinct("road_name").alias("stations"), F.countDistinct("feed").alias("feeds"))
    u = unconfirmed.groupBy("prefecture").agg(F.count("*").alias("unconfirmed"))
    c = configured.groupBy("prefecture").agg(F.count("*").alias("configured"))
    h = history.select("prefecture").distinct().withColumn("_ever", F.lit(True))
    got = prefectures.join(e, "prefecture", "left").join(u, "prefecture", "left").join(c, "prefecture", "left").join(h, "prefecture", "left")
    got = got.fillna(0, ["events", "stations", "feeds", "unconfirmed", "configured"])
    rule = lambda *names: F.when(F.col("unconfirmed") > 0, names[0]).when(F.col("events") > 0, names[1]).when(F.col("configured") > 0, names[2]).otherwise(names[3])
    state = rule("needs_reconfirmation", "events_observed", "targeted_feed_no_registered_events", "no_registered_events")
    action = rule("recheck_known_event", "expand_station_coverage", "inspect_official_article_dates", "discover_prefecture_station_feeds")
    return got.withColumns({"ever_observed": F.coalesce("_ever", F.col("events") > 0), "state": state, "next_action": action}).drop("_ever")


def rolled_up(rows: DataFrame) -> DataFrame:
    """AGG-02: the same measures for prefectures, regions and the nation; `grain` is 0, 1 or 3."""
    return rows.rollup("region", "prefecture").agg(F.grouping_id().cast("int").alias("grain"), F.count("*").alias("events"), F.countDistinct("road_name").alias("stations"))


def counters(rows: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """AGG-03: a count for each kind and source."""
    return rows.groupBy(key).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in kinds.items()])


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """AGG-04."""
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def source_health(audit: DataFrame) -> DataFrame:
    """AGG-05: sums, troubled sources, working listings and unverified candidates for each group."""
    return audit.groupBy("bucket").agg(
        F.sum("candidates").alias("candidates"), F.sum("accepted").alias("accepted"), F.count_if(F.col("fetch_failed") > 0).alias("trouble"), F.count_if(F.col("candidates") > 0).alias("working"), F.sum(F.greatest(F.lit(0), F.col("candidates") - F.col("checked") - F.col("accepted"))).alias("unverified")
    )


def unified_health(parts: list[DataFrame]) -> DataFrame:
    """AGG-06: audits of different shapes as one table; what a source does not report stays null, sums skip it."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "source_id"])


def recall(reviews: DataFrame, published: DataFrame, as_of: str, least: float = 0.83) -> DataFrame:
    """AGG-09: found / positives among reviewed events that are not over; null without positives."""
    live = reviews.filter(F.col("end_date") >= F.lit(as_of).cast("date"))
    hits = similar_titles(live, published, "road_name", least).select(F.col("a_id").alias("event_id")).distinct().withColumn("_hit", F.lit(True))
    got = live.select("event_id").join(hits, "event_id", "left")
    n = F.count("*")
    return got.agg(n.alias("positives"), F.count_if("_hit").alias("found"), F.round(F.when(n > 0, F.count_if("_hit") / n), 3).alias("recall"))


def quality_issues(events: DataFrame, stations: DataFrame, as_of: str, long_days: int = 120) -> DataFrame:
    """AGG-11: (event_id, level, reason) of every check that a published event fails.

    Of events equal in place, title and period all but the first by id are duplicates. An unknown station, a period of
    more than `long_days` and a publication stamp in the future are for review; everything else is critical.
    """
    known = stations.select(F.col("name").alias("road_name"), "prefecture").distinct().withColumn("_known", F.lit(True))
    rows = events.join(known, ["road_name", "prefecture"], "left")
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("prefecture", "road_name", "title", "start_date", "end_date").orderBy("event_id")))
    d = F.lit(as_of).cast("date")
    rule = lambda c, level, reason: F.when(c, F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason")))
    checks = F.array_compact(
        F.array(
            rule(F.col("_copy") > 1, "critical", "duplicate"),
            rule(F.col("start_date").isNull() | F.col("end_date").isNull(), "critical", "invalid_date"),
            rule(F.col("end_date") < F.col("start_date"), "critical", "reversed"),
            rule(F.col("end_date") < d, "critical", "expired"),
            rule(~F.rlike(F.coalesce(F.col("url"), F.lit("")), F.lit("^https://[^/@?#]+([/?#]|$)")), "critical", "unsafe_link"),
            rule(F.datediff("end_date", "start_date") > long_days, "review", "long_period"),
            rule(F.col("_known").isNull(), "review", "unknown_station"),
            rule(F.coalesce(F.trim("title"), F.lit("")) == "", "critical", "missing_title"),
            rule(F.col("published_at") > d, "review", "future_stamp"),
        )
    )
    return rows.select("event_id", F.inline(checks))


def run_summary(stations: DataFrame, events: DataFrame, live: DataFrame, audit: DataFrame, leads: DataFrame, limit: int) -> DataFrame:
    """AGG-08: the measures of a run as one row: one aggregate of each table, one row each, side by side."""
    n = F.count("*")
    parts = [
        stations.join(audit.select(F.col("source_id").alias("id"), F.lit(True).alias("_s")).distinct(), "id", "left").agg(n.alias("stations"), F.count_if("_s").alias("stations_with_source")),
        live.agg(n.alias("live"), F.countDistinct("prefecture").alias("prefectures"), F.countDistinct("road_name").alias("published_stations")),
        audit.agg(
            F.countDistinct("source_id").alias("sources"),
            n.alias("audits"),
            F.countDistinct(F.when(F.col("fetch_failed") > 0, F.col("source_id"))).alias("fetch_problems"),
            F.count_if(F.col("candidates") == 0).alias("without_candidates"),
            F.count_if(F.col("candidates") >= limit).alias("at_limit"),
            F.sum(F.greatest(F.lit(0), F.col("candidates") - F.col("checked"))).alias("uninspected"),
            F.sum("accepted").alias("accepted"),
            F.max("run_date").alias("last_audit"),
        ),
        leads.agg(n.alias("leads"), F.countDistinct("prefecture").alias("lead_prefectures")),
        events.agg(F.count_if(F.col("status") == "cancelled").alias("cancelled")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def zero_coverage_actions(zero: DataFrame, audit: DataFrame, leads: DataFrame) -> DataFrame:
    """AGG-10: for each prefecture without events its sources, what they found, the leads and the next action. `audit` has
    the prefecture of each source."""
    sums = {c: F.sum(c) for c in ("candidates", "checked", "accepted")} | {"uninspected": F.sum(F.greatest(F.lit(0), F.col("candidates") - F.col("checked"))), "failed": F.sum("fetch_failed")}
    a = audit.groupBy("prefecture").agg(F.countDistinct("source_id").alias("sources"), *[x.alias(c) for c, x in sums.items()])
    got = zero.join(a, "prefecture", "left").join(leads.groupBy("prefecture").agg(F.count("*").alias("leads")), "prefecture", "left").fillna(0, ["sources", *sums, "leads"])
    return got.withColumn("next_action", F.when(F.col("sources") > 0, "verify_existing_adapter_rejections").otherwise("configure_and_verify_new_official_station_feed"))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """AGG-12: whether two tables of one column hold the same values."""
    odd = a.subtract(b).union(b.subtract(a))
    return odd.agg((F.count("*") == 0).alias("ok"))


def fresh(rows: DataFrame, day: str, as_of: str, most: int) -> DataFrame:
    """AGG-12: whether the last day is `most` days old at most; false for no rows and for a day to come."""
    return rows.agg(F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.max(day)).between(0, most), F.lit(False)).alias("ok"))


#: Titles and addresses of pages that only lead to notices.
#: Titles and paths of pages that list notices and are none.
NAVIGATION = ("イベント", "イベント情報", "お知らせ", "催し")
INDEX_PAGE = "/category/|/(?:events|news|notices|news-tag/event)/?$"


def classified(notices: DataFrame, published: DataFrame, same: float = 0.75, near: float = 0.8) -> DataFrame:
    """JN-20: (event_id, state) of each notice: published at its url with a like title (one contains the other, or the
    ratio is `same` or more), at its url with another title, probably at another url of its station (`near`), not at all,
    or of no known station. Navigation pages are left out.

    Titles are compared once for each distinct (url, title) and (station, title), not for each row.
    """
    t = T.title_key(F.col("title"))
    n = notices.filter(~F.col("title").isin(*NAVIGATION) & ~F.rlike("url", F.lit(INDEX_PAGE))).select("event_id", "road_name", "url", t.alias("_t"))
    o = published.select("road_name", "url", t.alias("_o"))
    urls = n.select("url", "_t").distinct().join(o.select("url", "_o").distinct(), "url")
    names = n.select("road_name", "_t").distinct().join(o.select("road_name", "_o").distinct(), "road_name")
    # written, as the filters would else be moved before the distinct and Python would compare the titles of every row
    pairs = written(urls.select("_t", "_o").unionByName(names.select("_t", "_o")).distinct())
    scored = alike(pairs, "_t", "_o", min(same, near))
    at_least = lambda x: F.coalesce(F.col("score") >= x, F.lit(False))
    like = F.contains("_o", "_t") | F.contains("_t", "_o") | at_least(same)
    by_url = urls.join(scored, ["_t", "_o"], "left").groupBy("url", "_t").agg(F.bool_or(like).alias("_same"))
    by_name = names.join(scored, ["_t", "_o"], "left").groupBy("road_name", "_t").agg(F.bool_or(at_least(near)).alias("_near"))
    got = n.join(by_url, ["url", "_t"], "left").join(by_name, ["road_name", "_t"], "left")
    state = F.when(F.col("_same"), "same_url_and_title").when(F.col("_same").isNotNull(), "same_url_title_differs").when(F.col("_near"), "possible_same_event_other_url").when(F.col("_near").isNotNull(), "unmatched_official_notice").otherwise("station_not_identified")
    return got.select("event_id", state.alias("state"))


def invariants(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """AGG-12: (name, ok) of checks that are each one row with a boolean `ok`."""
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("name"), "ok") for name, df in checks])


def backlog(rows: DataFrame, id: str, inspected: Column, daily: int) -> DataFrame:
    """AGG-13: distinct ids, those inspected, those that remain, and the days that takes."""
    done = F.countDistinct(F.when(inspected, F.col(id)))
    total = F.countDistinct(id)
    return rows.agg(total.alias("total"), done.alias("inspected"), (total - done).alias("remaining"), F.ceil((total - done) / daily).cast("bigint").alias("days"))


def summary_audit(rows: DataFrame, text: str) -> DataFrame:
    """AGG-14: filled, short and long texts, and texts that are equal without punctuation and spaces."""
    key = F.regexp_replace(F.lower(text), r"[\s。、.,!?]", "")
    n = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.length(text) > 0).alias("f"), F.count_if(F.length(text) < 25).alias("s"), F.count_if(F.length(text) > 35).alias("l"))
    return n.agg(F.sum("f").alias("filled"), F.sum("s").alias("short"), F.sum("l").alias("long"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))


def activity(visits: DataFrame, *others: DataFrame, key: str = "user_id") -> DataFrame:
    """AGG-15: visits, last visit and latest visit of each key, and its last activity: the latest stamp of the visits
    and of the other sources (key, ts). Keys that only other sources have stay, with no visits."""
    own = visits.groupBy(key).agg(F.count("*").alias("visits"), F.max("ts").alias("last_visit"), F.max(F.struct("ts", "visit_id"))["visit_id"].alias("latest"))
    last = [o.groupBy(key).agg(F.max("ts").alias(f"_last{k}")) for k, o in enumerate(others)]
    got = reduce(lambda a, b: a.join(b, key, "full"), last, own)
    stamps = [F.col("last_visit"), *[F.col(f"_last{k}") for k in range(len(others))]]
    latest = F.greatest(*stamps) if others else stamps[0]
    return got.select(key, F.coalesce("visits", F.lit(0)).alias("visits"), "last_visit", "latest", latest.alias("last_activity"))


def leg_totals(visits: DataFrame, key: str = "user_id") -> DataFrame:
    """AGG-16: the kilometres of all legs of each key's track, and their ratio to the way from its first to its last
    place (null where these are one)."""
    w = Window.partitionBy(key).orderBy("ts", "visit_id")
    first = {c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("lat", "lng")}
    rows = visits.withColumns({"_leg": G.haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), "_direct": G.haversine(first["lat"], first["lng"], F.col("lat"), F.col("lng"))})
    got = rows.groupBy(key).agg(F.sum("_leg").alias("total"), F.max(F.struct("ts", "visit_id", "_direct"))["_direct"].alias("d"))
    return got.select(key, F.round("total", 6).alias("total"), F.round(F.when(F.col("d") > 0, F.col("total") / F.col("d")), 6).alias("ratio"))


def grouped_events(events: DataFrame) -> DataFrame:
    """AGG-17: each station's events by start, as one text, and the first start."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("start_date", "event_id"))), lambda x: F.concat_ws(":", x["start_date"].cast("string"), x["event_id"].cast("string")))
    return events.groupBy("road_name").agg(F.array_join(items, ",").alias("events"), F.min("start_date").alias("first_start"))


def health_row(audit: DataFrame, limit: int) -> DataFrame:
    """AGG-18: state, uninspected count and at-limit flag of each audit."""
    state = F.when(F.col("fetch_failed") > 0, "error").when(F.col("candidates") == 0, "no_candidates").when(F.col("checked") < F.col("candidates"), "review_candidates").otherwise("active")
    return audit.select("source_id", "run_date", state.alias("state"), F.greatest(F.lit(0), F.col("candidates") - F.col("checked")).cast("bigint").alias("uninspected"), (F.col("candidates") >= limit).alias("at_limit"))
