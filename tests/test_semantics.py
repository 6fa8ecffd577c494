"""Semantics that the tables cannot show: ties, nulls, reruns, rollovers, conflicts and routes by brute force."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from waystone.functions import dates as D
from waystone.functions import text as T
from waystone.functions import udfs
from waystone.functions import urls as U
from waystone.operators import coverage as C
from waystone.operators import extract as X
from waystone.operators import reconcile as R
from waystone.operators import schedule as S
from waystone.operators import search as G
from waystone.sources import files

day = dt.date


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text,published,want",
    [
        ("2026年12月28日～1月3日", None, (day(2026, 12, 28), day(2027, 1, 3))),
        ("開催日時：1月5日", day(2025, 12, 20), (day(2026, 1, 5), day(2026, 1, 5))),
        ("令和元年5月1日（水）から5月3日", None, (day(2019, 5, 1), day(2019, 5, 3))),
        ("2026年2月30日", None, None),
        ("2026年5月10日～5月1日", None, None),
        ("2026年1月1日～8月1日", None, None),
        ("5月1日", None, None),
        ("no date", day(2026, 1, 1), None),
        ("2026年10月10日（日）", None, None),
        ("10月17日(土)", day(2026, 10, 8), (day(2026, 10, 17), day(2026, 10, 17))),
        ("10月17日（土）", None, None),
        ("10月30日～1月3日", day(2026, 9, 1), (day(2026, 10, 30), day(2027, 1, 3))),
        ("2026-10-10", None, (day(2026, 10, 10), day(2026, 10, 10))),
        ("2026年10月10日(土)・11日(日)", None, (day(2026, 10, 10), day(2026, 10, 11))),
        ("2026年10月10日(土)・11日(月)", None, None),
        ("開園祭（2026.10.10～12）", None, (day(2026, 10, 10), day(2026, 10, 12))),
        ("日時：2026年11月25日（水）～2026年11月27日（金）", None, (day(2026, 11, 25), day(2026, 11, 27))),
        ("体験 (2026年10月16日〜11月3日)", None, (day(2026, 10, 16), day(2026, 11, 3))),
        ("10/11（日）実演販売", day(2026, 9, 28), (day(2026, 10, 11), day(2026, 10, 11))),
        ("9月27日(日) 2026 音楽祭", day(2026, 9, 2), (day(2026, 9, 27), day(2026, 9, 27))),
        ("2026年10月24日▶▷25日 10:00～15:00", None, (day(2026, 10, 24), day(2026, 10, 24))),
        ("10月10日 10:00～15:00", day(2026, 9, 1), (day(2026, 10, 10), day(2026, 10, 10))),
        ("11月14日（日）", day(2026, 10, 1), None),
        (None, day(2026, 1, 1), None),
    ],
)
def test_period(spark, text, published, want):
    got = spark.createDataFrame([(text, published)], "t string, p date").select(D.period(F.col("t"), F.col("p")).alias("d")).first().d
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "text,options,want",
    [
        ("5月1日～5月3日", {}, (day(2026, 5, 1), day(2026, 5, 3))),
        ("5月1日", {"year": "explicit"}, None),
        ("5月1日", {"end": "required"}, None),
        ("5月1日～3日", {"end": "ignored"}, (day(2026, 5, 1), day(2026, 5, 1))),
        ("5月1日 受付5月9日 締切6月2日", {"end": "last"}, (day(2026, 5, 1), day(2026, 6, 2))),
        ("5月1日(月)", {"weekday": False}, (day(2026, 5, 1), day(2026, 5, 1))),
        ("5月1日、5月2日、5月9日", {"most_dates": 2}, None),
        ("●～5月1日", {"open_start": False}, None),
        ("●～5月1日", {}, (day(2026, 5, 1), day(2026, 5, 1))),
        ("2月1日", {"not_before": "start"}, None),
        ("2月1日～4月9日", {"not_before": "end"}, (day(2026, 2, 1), day(2026, 4, 9))),
        ("受付 4月9日 日時：5月1日", {"label": "日時 ?: ?"}, (day(2026, 5, 1), day(2026, 5, 1))),
        ("受付 4月9日", {"label": "日時 ?: ?"}, None),
        ("5月1日～9日", {"max_span": 7}, None),
    ],
)
def test_period_options(spark, text, options, want):
    got = one(spark, text, lambda c: D.period(c, F.lit("2026-03-20").cast("date"), D.Options(**options)))
    assert (tuple(got) if got else None) == want


def test_date_tokens(spark):
    got = one(spark, "令和８年３月１日（日・祝）から２日　Ｒ元.5.1", lambda c: D.tokens(D.folded(c)))
    assert [tuple(x) for x in got] == [("", 2026, 3, 1, "日"), ("", None, None, 2, ""), (" ", 2019, 5, 1, "")]


def test_schedule_hints(spark):
    hint = lambda t: one(spark, t, lambda c: D.schedule_hint(c, F.lit("2026-10-12").cast("date")))
    assert [hint(t) for t in ("令和8年10月20日開催", "2026年10月10日 開催", "開演は2026/10/12", "2026年10月20日の記事", "2026年11月1日から5日まで", "実施" + "あ" * 30 + "2026.11.1", "2025.1.1 記事" + "い" * 30 + "日程 2027-01-02", None)] == [
        "future", "past", "future", "unknown", "future", "unknown", "future", "unknown",
    ]


def test_weekday_mismatch(spark):
    make = lambda x: D.safe_date(F.lit(2026), F.lit(3), F.lit(1), x)  # noqa: E731  a Sunday
    assert one(spark, "日", make) == day(2026, 3, 1) and one(spark, "月", make) is None and one(spark, None, make) == day(2026, 3, 1)


def test_titles(spark):
    assert one(spark, "　ＡＢＣ　１２ ", T.clean) == "ABC 12"
    assert one(spark, "【道の駅 あ・い】 祭り", lambda c: T.identity_title(c, F.lit("あい"))) == "祭り"
    assert one(spark, "【別の駅】 祭り", lambda c: T.identity_title(c, F.lit("あい"))) == "【別の駅】 祭り"
    assert one(spark, "「一」と「二」のお知らせ", T.subject) == "二"
    assert one(spark, "2026.03.01 EVENT 市 NEW", T.strip_badges) == "市"


def test_urls(spark):
    base = F.lit("https://a.jp/news/list.html?x=1")
    want = {"/b": "https://a.jp/b", "c.html#t": "https://a.jp/news/c.html", "?p=2": "https://a.jp/news/list.html?p=2", "//a.jp/d": "https://a.jp/d", "//b.jp/d": None, "http://a.jp/e": None, "javascript:x": None, "": None}
    assert {k: one(spark, k, lambda c: U.resolve(c, base)) for k in want} == want
    assert one(spark, "https://u@a.jp/x", U.url_key) == "" and one(spark, "HTTPS://A.jp", U.url_key) == "" and one(spark, "https://A.jp/x/#f", U.url_key) == "https://a.jp/x"
    key = lambda u: one(spark, u, U.url_key)
    assert key("http://a.jp/x") == "" and key("https://A.jp") == key("https://a.jp//") == "https://a.jp/" and key(None) == ""
    assert key("https://a.jp/祭 り+*~/%7E?q=%41#x") == "https://a.jp/%E7%A5%AD%20%E3%82%8A%2B%2A~/~?q=%41"


EVENT = "event_id long, seq long, road_name string, prefecture string, title string, start_date date, end_date date, published_at date, url string, status string, feed int"


def event(i, title="t", start=day(2026, 1, 10), end=day(2026, 1, 12), url="https://a.jp/1", seq=None, published=None):
    return (i, seq or i, "あ", "県", title, start, end, published, url, "scheduled", 0)


def test_reconcile(spark):
    old = [event(1), event(2, url="https://a.jp/2", start=day(2026, 2, 1), end=day(2026, 2, 3)), event(3, url="https://a.jp/3", end=day(2025, 12, 1), start=day(2025, 11, 1)), event(4, url="https://a.jp/4"), event(5, title="～1月20日まで", url="https://a.jp/5")]
    new = [event(11, title="t NEW"), event(12, url="https://a.jp/2", start=day(2026, 2, 2), end=day(2026, 2, 4)), event(13, url="https://a.jp/9", published=day(2027, 1, 1)), event(14, url="https://a.jp/8", start=None)]
    got = {k: sorted(r.event_id for r in v.collect()) for k, v in R.reconcile(spark.createDataFrame(old, EVENT), spark.createDataFrame(new, EVENT), "2026-01-01").items() if k != "possible_duplicates"}
    assert got == {"published": [4, 11, 12, 13], "exact_duplicates": [11], "corrected": [12], "not_reconfirmed": [4], "expired_or_invalid": [3, 5], "invalid_new": [14]}


def test_reconcile_two_overlaps_is_an_insert(spark):
    old = [event(1, start=day(2026, 1, 1), end=day(2026, 1, 5)), event(2, start=day(2026, 1, 8), end=day(2026, 1, 12))]
    got = R.reconcile(spark.createDataFrame(old, EVENT), spark.createDataFrame([event(9, start=day(2026, 1, 4), end=day(2026, 1, 9))], EVENT), "2026-01-01")
    assert sorted(r.event_id for r in got["published"].collect()) == [1, 2, 9] and got["corrected"].count() == 0


def test_reconcile_within_a_batch(spark):
    new = [event(1, start=day(2026, 1, 1), end=day(2026, 1, 9)), event(2, start=day(2026, 1, 5), end=day(2026, 1, 6))]
    got = R.reconcile(spark.createDataFrame([], EVENT), spark.createDataFrame(new, EVENT), "2026-01-01")
    assert [r.event_id for r in got["published"].collect()] == [2]


def test_streak_counts_a_day_once_and_ignores_gaps(spark):
    rows = [("a", day(2026, 1, 1), 1, True), ("a", day(2026, 1, 1), 2, True), ("a", day(2026, 1, 9), 3, True), ("a", day(2026, 1, 10), 4, False), ("a", day(2026, 1, 11), 5, True), ("a", day(2026, 1, 12), 6, None)]
    got = S.streaks(spark.createDataFrame(rows, "source_id string, run_date date, seq int, bad boolean"), F.col("bad"), seq="seq").orderBy("seq").collect()
    assert [r.streak for r in got] == [1, 1, 2, 0, 1, 0]


def test_budget_rotates(spark):
    rows = spark.createDataFrame([("s", i) for i in range(20)], "k string, i int")
    take = lambda start: sorted(r.i for r in S.budgeted(rows, "k", ["i"], 8, None, F.lit(start)).collect())
    assert take(0) == [*range(6), 6, 7] and take(13) == [*range(6), 6, 19]
    assert S.budgeted(rows, "k", ["i"], 8, None, F.lit(13)).first().next == 1
    assert S.budgeted(rows, "k", ["i"], 20, None, F.lit(5)).count() == 20


def test_recall_without_positives(spark):
    e = spark.createDataFrame([], EVENT)
    assert tuple(C.recall(e, e, "2026-01-01").first()) == (0, 0, None)


def test_unknown_stays_null(spark):
    a, b = spark.createDataFrame([(1, 5)], "source_id long, x long"), spark.createDataFrame([(2, 7)], "source_id long, y long")
    assert {tuple(r) for r in C.unified_health([a, b]).collect()} == {(1, 5, None), (2, None, 7)}


def test_venue_is_never_borrowed(spark):
    lines = [(1, 1, "【A】祭"), (1, 2, "開催日時：2026年3月1日"), (1, 3, "【B】祭"), (1, 4, "開催日時：2026年3月2日"), (1, 5, "会場：道の駅 あ")]
    rows = spark.createDataFrame(lines, "article_id long, line_no int, line_text string")
    assert [(r.title, r.day) for r in X.section_events(rows).collect()] == [("【B】祭", day(2026, 3, 2))]
    assert [r.section for r in X.notice_blocks(rows).collect()] == [2]


def test_a_task_sorts_a_share_of_the_lines(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_LINES", 100, raising=False)
    kinds = ["【A】祭", "開催日時：2026年3月1日", "会場：道の駅 あ", "x"]
    rows = spark.createDataFrame([(a, n, kinds[n]) for a in range(500) for n in range(4)], "article_id long, line_no int, line_text string")
    for got in (X.section_events(rows), X.notice_blocks(rows), X.heading_context(rows, 60)):
        per = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in per) == 500 and max(r["count"] for r in per) < 100


def test_section_events_by_brute_force(spark):
    rng = random.Random(5)
    kinds = ["【A】祭", "【B】", "開催日時：2026年3月1日", "日時：令和8年4月2日", "期間：未定", "会場：あ", "場所：い", "a", "b", "c", "d", "e", None]
    lines = [(a if a else None, rng.randrange(30), rng.choice(kinds[: rng.choice([5, 8, 13])])) for a in range(60) for _ in range(rng.randrange(40))]
    want, parts = [], {}
    for a, n, t in lines:
        parts.setdefault(a, []).append((n, t is not None, t or ""))
    for a, of in parts.items():
        heads, of = [], sorted(of)
        for i, (_, _, t) in enumerate(of):
            if t.startswith("【"):
                heads.append(i)
        for k, i in enumerate(heads):
            own = [t for _, _, t in of[i : min(i + 10, heads[k + 1] if k + 1 < len(heads) else len(of))]]
            days = [day(2026, 3, 1) if "3月" in t else day(2026, 4, 2) for t in own if "日時：" in t]
            venues = [t[3:] for t in own if t[:3] in ("会場：", "場所：")]
            if days and venues:
                want.append((a, k + 1, own[0], days[0], venues[0]))
    got = X.section_events(spark.createDataFrame(lines, "article_id long, line_no int, line_text string"))
    assert len(want) > 20 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_reason_order(spark):
    lines = [(1, 1, "【A】中止"), (2, 1, "x"), (3, 1, "【A】"), (3, 2, "【B】"), (4, 1, "【A】"), (5, 1, "【A】"), (5, 2, "会場：い"), (5, 3, "会場：う"), (6, 1, "【A】"), (6, 2, "会場：い"), (7, 1, "【A】"), (7, 2, "会場：い"), (7, 3, "日時：2020年1月1日"), (8, 1, "【A】"), (8, 2, "会場：い"), (8, 3, "日時：2026年2月1日"), (9, 1, "【A】"), (9, 2, "会場：い"), (9, 3, "日時：2026年2月1日"), (9, 4, "期間：2026年2月3日")]
    got = X.with_reasons(spark.createDataFrame(lines, "article_id long, line_no int, line_text string"), "2026-01-01", spark.createDataFrame([(k, "い") for k in range(1, 10)], "article_id long, station string")).orderBy("article_id").collect()
    assert [r.reason for r in got] == ["cancelled", "not_event", "multi_event_overview", "venue_missing", "offsite", "undated", "past", "accepted", "date_conflict"]


def test_routes_by_brute_force(spark):
    places = [(i, 35 + 0.09 * i + 0.02 * ((i * 7) % 5 - 2), 135 + 0.05 * ((i * 3) % 4 - 1.5)) for i in range(1, 9)]
    r = spark.createDataFrame([(1, 35.0, 135.0, 36.0, 135.0)], "request_id long, lat double, lng double, goal_lat double, goal_lng double")
    p = spark.createDataFrame(places, "id long, lat double, lng double")
    cand = {c.id: c for c in G.corridor(r, p).collect()}
    got = G.routes(r, p, stops=2).first()

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 12742 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    d, best = km((35, 135), (36, 135)), []
    for path in itertools.permutations(cand, 2):
        c = [cand[i] for i in path]
        if c[1].along - c[0].along < 0.025 * d:
            continue
        legs = [km((35, 135), (c[0].lat, c[0].lng)), km((c[0].lat, c[0].lng), (c[1].lat, c[1].lng)), km((c[1].lat, c[1].lng), (36, 135))]
        if sum(legs) <= 1.3 * d:
            best.append((sum(legs) + 0.25 * d * sum(abs(x.along / d - (k + 1) / 3) for k, x in enumerate(c)), list(path)))
    assert cand and got.stops == 2 and got.path == min(best)[1] and got.score == pytest.approx(min(best)[0], abs=1e-6)


def test_routes_without_stops_go_straight(spark):
    r = spark.createDataFrame([(1, 35.0, 135.0, 36.0, 135.0), (2, 10.0, 10.0, 10.5, 10.0)], "request_id long, lat double, lng double, goal_lat double, goal_lng double")
    p = spark.createDataFrame([(7, 35.5, 135.0)], "id long, lat double, lng double")
    got = {x.request_id: x for x in G.routes(r, p).collect()}
    assert (got[1].stops, got[1].path) == (1, [7]) and (got[2].stops, got[2].path, got[2].score) == (0, [], got[2].length) and got[2].length == pytest.approx(55.597, abs=1e-2)


def test_five_stops_by_brute_force(spark):
    places = [(i, 35 + 0.12 * i, 135 + 0.03 * ((i * 5) % 3 - 1)) for i in range(1, 8)]
    r = spark.createDataFrame([(1, 35.0, 135.0, 36.0, 135.0)], "request_id long, lat double, lng double, goal_lat double, goal_lng double")
    p = spark.createDataFrame(places, "id long, lat double, lng double")
    cand = {c.id: c for c in G.corridor(r, p).collect()}

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 12742 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    d, best = km((35, 135), (36, 135)), []
    for path in itertools.permutations(cand, 5):
        c = [cand[i] for i in path]
        points = [(35, 135), *[(x.lat, x.lng) for x in c], (36, 135)]
        legs = sum(km(a, b) for a, b in itertools.pairwise(points))
        if all(b.along - a.along >= max(1, 0.025 * d) for a, b in itertools.pairwise(c)) and legs <= 1.3 * d:
            best.append((legs + 0.25 * d * sum(abs(x.along / d - (k + 1) / 6) for k, x in enumerate(c)), list(path)))
    got = G.routes(r, p).first()
    assert got.stops == 5 and got.path == min(best)[1] and got.score == pytest.approx(min(best)[0], abs=1e-5)


def test_neighbours_across_180_degrees(spark):
    a = spark.createDataFrame([(1, 10.0, 179.99), (2, 89.95, 0.0)], "id long, lat double, lng double")
    b = spark.createDataFrame([(7, 10.0, -179.99), (8, 89.95, 180.0), (9, 10.0, 178.0)], "id long, lat double, lng double")
    for size in (1.0, 0.25, 0.7):
        assert sorted((r.req_id, r.id) for r in G.within(a, b, F.lit(30.0), size).collect()) == [(1, 7), (2, 8)]


def test_route_text(spark):
    rows = [(1, 1, 'a "b"', 35.0, 135.0), (1, 2, "c", 36.0, 136.0), (1, 3, "d", 37.0, 137.0), (2, 1, "x", 1.0, 2.0), (2, 2, None, 3.0, 4.0)]
    d = spark.createDataFrame(rows, "r long, k int, name string, lat double, lng double")
    got = {x.r: x.route.split("\n") for x in files.route_text(d, "r", "k").collect()}
    assert got[1] == ["ROUTE/1", 'START,"a ""b""",35.0000000,135.0000000', 'VIA,"c",36.0000000,136.0000000', 'GOAL,"d",37.0000000,137.0000000']
    assert got[2][1:] == ['START,"x",1.0000000,2.0000000', 'GOAL,"",3.0000000,4.0000000']
    with pytest.raises(Exception, match="too many places"):
        files.route_text(d, "r", "k", vias=0).collect()


def test_stations_named_in_labels(spark):
    s = spark.createDataFrame([(1, "あさひ"), (2, "ひ"), (3, "みなと"), (4, "みなと朝市"), (5, "う・み")], "id long, name string")
    titles = ["【道の駅 あさひ】祭", "【あさひ】", "【あさひの丘】", "【ひ】", "【道の駅みなと朝市広場】", "【うみ】〖みなと〗", "[あさひ]", None, "〖うみ〗祭", "【道の駅 みなと】祭"]
    n = spark.createDataFrame(list(enumerate(titles)), "event_id long, title string")
    # containment wants 道の駅 in the label, and more than one station is none
    assert {r.event_id: r.station for r in C.named_stations(n, s).collect()} == {0: 1, 1: 1, 8: 5, 9: 3}


def test_quality_levels(spark):
    e = spark.createDataFrame([(1, "A", "p", "x", day(2026, 1, 1), day(2026, 1, 2)), (2, "A", "p", "x", day(2026, 1, 1), day(2026, 1, 2)), (3, "B", "p", " ", day(2026, 1, 1), day(2026, 5, 2)), (4, "A", "p", "y", day(2026, 1, 1), day(2026, 5, 1)), (5, "A", "p", "z", None, day(2026, 5, 1))], "event_id long, road_name string, prefecture string, title string, start_date date, end_date date")
    e = e.withColumns({"url": F.lit("https://a.jp/x"), "published_at": F.lit(None).cast("date")})
    got = sorted(tuple(r) for r in C.quality_issues(e, spark.createDataFrame([("A", "p")], "name string, prefecture string"), "2025-12-01").collect())
    assert got == [(2, "critical", "duplicate"), (3, "critical", "missing_title"), (3, "review", "long_period"), (3, "review", "unknown_station"), (5, "critical", "invalid_date")]


def test_review_priorities(spark):
    as_of = F.lit("2026-06-01").cast("date")
    texts = {"2024年の祭": "older_year_mentioned", "2024/2026": "date_and_venue_verification_needed", "令和 6年": "older_year_mentioned", "6月7日(日)": "date_and_venue_verification_needed", "6月7日（月）": "weekday_year_mismatch_check", "2月30日(月) 6月7日（月）": "date_in_title_needs_verification", "12026": "date_and_venue_verification_needed", "祭": "date_and_venue_verification_needed"}
    assert {t: one(spark, t, lambda c: D.review_priority(c, F.lit("unknown"), as_of)) for t in texts} == texts
    assert [one(spark, "2024年", lambda c, h=h: D.review_priority(c, F.lit(h), as_of)) for h in ("future", "past")] == ["future_schedule_hint", "older_year_mentioned"]


def test_title_year_periods(spark):
    got = [one(spark, t, lambda c: D.title_year_period(c, c)) for t in ("令和7年 3月1日", "令和7年 3月1日・3月2日", "令和7年 2月28日と3月1日", "令和7年 3月1日・3月3日", "令和7年 2月30日", "3月1日")]
    assert [g and (g.start_date, g.end_date) for g in got] == [(day(2025, 3, 1), day(2025, 3, 1)), (day(2025, 3, 1), day(2025, 3, 2)), (day(2025, 2, 28), day(2025, 3, 1)), None, None, None]


def test_nearest_without_limit(spark):
    points = spark.createDataFrame([(1, 35.0, 135.0), (2, -40.0, -70.0)], "visit_id long, lat double, lng double")
    places = spark.createDataFrame([(7, 35.5, 135.0), (8, 36.0, 135.0)], "id long, lat double, lng double")
    assert {r.visit_id: r.place_id for r in G.nearest_any(points, places, "visit_id", 10.0).collect()} == {1: 7, 2: 7}


def test_publish_only_changes(spark, tmp_path):
    path, a = f"file://{tmp_path}/t", spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert R.write_if_changed(a, path) and not R.write_if_changed(a.orderBy(F.desc("i")), path) and R.write_if_changed(a.limit(1), path)


def test_feed_version(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"schemaVersion": 2, "events": []}')
    with pytest.raises(Exception, match="unexpected feed version"):
        files.read_feed(spark, f"file://{tmp_path}/f.json").count()


def test_html_tokens_and_nfkc(spark):
    pages = spark.createDataFrame([(1, "<p>a <a href='/x'>b</a><script>z</script>"), (2, None)], "page_id long, html string")
    got = [(r.kind, r.tag, r.text, r.href) for r in udfs.html_tokens(pages).collect()]
    assert got == [("start", "p", None, None), ("text", "p", "a", None), ("start", "a", None, "/x"), ("text", "a", "b", None), ("start", "script", None, None)]
    import unicodedata

    texts = ["①ｶﾞ", "ＡＢ　c", None, "第Ⅱ回 ￥500", "か\u3099", "e\u0301", "゛", "㌔", "ﬃ", "日本・語ー", "Ａé", "¼ cup", "株㈱"]
    got = [r.t for r in udfs.nfkc(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t").collect()]
    assert sorted(map(str, got)) == sorted(str(t and " ".join(unicodedata.normalize("NFKC", t).split())) for t in texts)
    assert one(spark, "abcd", lambda c: udfs.ratcliff(c, F.lit("bcde"))) == pytest.approx(0.75)


def test_similarity_by_matching_blocks(spark):
    """The bounds never lose a pair, and the ratio is that of matching blocks."""
    from difflib import SequenceMatcher

    from waystone.operators import coverage as C

    titles = ["秋の収穫祭", "秋の大収穫祭", "収穫の秋祭", "春祭", "", "aab", "abb", "秋の収穫祭2026"]
    pairs = [(a, b) for a in titles for b in titles]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for least in (0.75, 0.8, 0.83):
        got = {(r.a, r.b): r.score for r in C.alike(rows, "a", "b", least).collect()}
        want = {(a, b): SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs}
        assert got == {k: pytest.approx(v) for k, v in want.items() if v >= least}
    assert all(r.bound >= want[r.a, r.b] - 1e-12 for r in rows.withColumn("bound", C.ratio_bound(F.col("a"), F.col("b"))).collect())


def test_venues_and_listings(spark):
    """Suffixes that belong to the station, labels of another place, one off-site venue, another title."""
    from waystone.operators import extract as X

    lines = spark.createDataFrame(
        [(1, 1, "【秋祭】"), (1, 2, "開催日時：2026年10月10日"), (1, 3, "会場：道の駅 あい 芝生広場"), (2, 1, "【市】"), (2, 2, "開催日時：2026年10月11日"), (2, 3, "会場：市役所"), (3, 1, "【市】"), (3, 2, "会場：道の駅あい"), (3, 3, "別会場あり"), (3, 4, "開催日時：2026年10月12日")],
        "article_id int, line_no int, line_text string",
    )
    stations = spark.createDataFrame([(k, "あい") for k in (1, 2, 3)], "article_id int, station string")
    proof = lambda **o: {r.article_id: r.on_site for r in X.venue_proof(lines, stations, **o).collect()}
    assert proof() == {1: False, 2: False, 3: True}
    assert proof(suffix="芝生広場|前") == {1: True, 2: False, 3: True}
    assert proof(suffix="芝生広場", elsewhere="別会場|市役所") == {1: True, 2: False, 3: False}
    assert {r.article_id: r.reason for r in X.with_reasons(lines, "2026-10-01", stations, "芝生広場").collect()} == {1: "accepted", 2: "offsite", 3: "accepted"}
    listing = spark.createDataFrame([(1, day(2026, 10, 10), "秋祭開催"), (2, day(2026, 10, 11), "別の祭"), (3, day(2026, 10, 11), "市"), (4, day(2026, 1, 1), "無")], "article_id int, listed date, title string")
    state = lambda x: {r.article_id: r.state for r in X.listing_conflicts(lines, x).collect()}
    assert state(listing.drop("title")) == {1: "agrees", 2: "agrees", 3: "listing_article_date_conflict", 4: "listing_only"}
    assert state(listing) == {1: "agrees", 2: "listing_article_title_conflict", 3: "listing_article_date_conflict", 4: "listing_only"}


def test_places_along_tracks_by_brute_force(spark):
    """Steep, flat, single-point and long segments, places on cell borders and beside the ends."""
    import random

    from waystone.operators import tracks as K

    rng = random.Random(7)
    points = [(k, n, rng.choice([35.0, 35.5, rng.uniform(34, 37)]), rng.choice([135.0, 136.5, rng.uniform(134, 138)])) for k in range(12) for n in range(k % 5 + 1)] + [(50, 1, 35.0, 135.0), (50, 2, 35.0, 135.0)]
    places = [(i, rng.choice([35.0, 35.5, rng.uniform(33.5, 37.5)]), rng.choice([135.0, 136.0, rng.uniform(133.5, 138.5)])) for i in range(300)]
    segs = K.segments(spark.createDataFrame(points, "track int, n int, lat double, lng double"), "track", "n")
    got = {(r.track, r.id): (r.progress, r.away) for r in K.places_along(segs, "track", spark.createDataFrame(places, "id int, lat double, lng double"), reach=0.3).collect()}
    want = {}
    for s in segs.collect():
        for i, y, x in places:
            dx, dy = s.lng2 - s.lng, s.lat2 - s.lat
            raw = ((x - s.lng) * dx + (y - s.lat) * dy) / max(s.len**2, 1e-12)
            t = min(1.0, max(0.0, raw)) if s.len else 0.0
            away = math.hypot(x - s.lng - t * dx, y - s.lat - t * dy)
            if away <= 0.3:
                key = (round(away + (0 if 0 <= raw <= 1 else 20), 9), s.rn)
                if (s.track, i) not in want or key < want[s.track, i][0]:
                    want[s.track, i] = (key, (s.before + t * s.len) / s.total if s.total else None, away)
    assert got == {k: (None if p is None else pytest.approx(p), pytest.approx(a)) for k, (_, p, a) in want.items()} and len(got) > 100


def test_pairs_by_cells_equal_brute_force_and_are_dealt_by_cell(spark):
    """Anywhere on the globe, for circles, rings and corridors; small files must not make it a broadcast join."""
    import math
    import random

    from waystone.functions import geo as G
    from waystone.operators import search as S

    rng = random.Random(3)
    point = lambda: (rng.choice([0.0, 35.0, 88.5, -88.9]) + rng.uniform(-4, 4) / 4, rng.choice([-179.5, 179.5, 0.0, 135.0]) + rng.uniform(-4, 4) / 8)
    places = spark.createDataFrame([(i, *point()) for i in range(300)], "id bigint, lat double, lng double")
    asked = spark.createDataFrame([(i, *point(), rng.choice([5.0, 60.0, 300.0]), rng.choice([1.0, 20.0, 80.0]), 45.0 * i) for i in range(60)], "request_id bigint, lat double, lng double, km double, tol double, bearing double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 12742.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    every = list(itertools.product(asked.collect(), places.collect()))
    ring = S.annulus(asked, places)
    assert "SortMergeJoin" in ring._jdf.queryExecution().sparkPlan().toString()
    got = {(r.req_request_id, r.id) for r in ring.collect()}
    assert got == {(q.request_id, p.id) for q, p in every if max(0, q.km - q.tol) <= km(q.lat, q.lng, p.lat, p.lng) <= q.km + q.tol}
    near = {(r.req_request_id, r.id) for r in S.within(asked, places, F.col("km")).collect()}
    assert near == {(q.request_id, p.id) for q, p in every if km(q.lat, q.lng, p.lat, p.lng) <= q.km}
    way = S.with_goal(asked.filter("abs(lat) < 80 and km > 50"))
    pairs = way.select("request_id", *[F.col(c).alias(f"r_{c}") for c in ("lat", "lng", "goal_lat", "goal_lng")]).crossJoin(places)
    (gx, gy), (px, py) = G.offset(F.col("r_lat"), F.col("r_lng"), F.col("r_goal_lat"), F.col("r_goal_lng")), G.offset(F.col("r_lat"), F.col("r_lng"), F.col("lat"), F.col("lng"))
    d, direct = F.sqrt(gx * gx + gy * gy), G.haversine(F.col("r_lat"), F.col("r_lng"), F.col("r_goal_lat"), F.col("r_goal_lng"))
    along, side, m = (px * gx + py * gy) / d, F.abs(px * gy - py * gx) / d, F.greatest(F.lit(1.0), 0.04 * d)
    angle = G.difference(G.heading(F.col("r_lat"), F.col("r_lng"), F.col("lat"), F.col("lng")), G.heading(F.col("r_lat"), F.col("r_lng"), F.col("r_goal_lat"), F.col("r_goal_lng")))
    reached = G.haversine(F.col("r_lat"), F.col("r_lng"), F.col("lat"), F.col("lng")) <= direct + 1
    want = pairs.filter(reached & (along > m) & (along < d - m) & (side <= F.least(F.lit(35.0), F.greatest(F.lit(6.0), 0.2 * direct))) & (side <= 2 + 0.85 * F.least(along, d - along)) & (angle <= 45))
    found = {(r.req_request_id, r.id) for r in S.corridor(way, places).collect()}
    assert found == {(r.request_id, r.id) for r in want.collect()} and found


def test_small_rules_are_broadcast(spark):
    """lines are not dealt by their source, of which there are few."""
    from waystone.operators import patterns as R
    from waystone.plans.extraction import RULES

    lines = spark.createDataFrame([], "adapter int, article_id long, line_no int, text string, published date")
    docs = spark.createDataFrame([], "adapter int, doc_id long, text string, published date")
    names = spark.createDataFrame([(1, "a", "b", "c")], "adapter int, name string, venue string, verb string")
    for got in (R.row_events(lines, R.rules_table(spark, RULES)), R.sentence_events(docs, names)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == plan.count("rightHint=(strategy=broadcast)") > 0


def test_periods_by_source_cut_a_text_once(spark):
    """the dates of a text are cut once for each label, not once for each kind of source."""
    from waystone.functions import dates as D

    rows = spark.createDataFrame([(1, "日時：2026年3月1日～5日", None), (2, None, None)], "event_id long, text string, published date")
    got = D.periods_by_source(rows, "text", "published", D.SOURCES)
    assert {(r.event_id, r.source, str(r.p.start_date) if r.p else None) for r in got.collect()} >= {(1, "labelled", "2026-03-01"), (2, "labelled", None)}
    assert got.count() == 2 * len(D.SOURCES)
    # the pattern of a date stands once for each of the two labels
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(D.TOKEN[:40]) == 2


def test_tokens_come_in_bounded_batches(spark, monkeypatch):
    """a task hands its rows on before it has read a whole batch of pages."""
    import pyarrow as pa

    from waystone.functions import udfs

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            n = udfs.MOST_ROWS
            page = pa.RecordBatch.from_pydict({"page_id": pa.array(range(n), pa.int64()), "html": ["<p>a<p>b"] * n})
            return list(f(iter([page])))

    got = udfs.html_tokens(Pages())
    assert sum(b.num_rows for b in got) == 4 * udfs.MOST_ROWS and max(b.num_rows for b in got) < udfs.MOST_ROWS + 4


def test_sql_of_like_titles_takes_any_title():
    """F16, F17: the SQL of JN-08 and JN-20 computes the ratio, it does not look it up among the titles of the fixtures."""
    import random
    from difflib import SequenceMatcher

    import duckdb

    from waystone.plans.registry import ORACLE_SQL
    from waystone.plans.reports import _ratios

    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abc祭り") for _ in range(rng.randrange(0, 12)))
    pairs = {(text(), text()) for _ in range(200)}
    got = duckdb.sql(f"SELECT t, o, score FROM {_ratios(f'SELECT * FROM (VALUES {str(sorted(pairs))[1:-1]}) v(t, o)')}").fetchall()
    assert {(t, o): round(x, 9) for t, o, x in got} == {(t, o): round(SequenceMatcher(None, t, o, autojunk=False).ratio(), 9) for t, o in pairs}
    assert not any("1urgent" in ORACLE_SQL[q] for q in ("JN-08", "JN-20"))


def test_stream_of_a_table_of_several_files(spark, tmp_path):
    """a table that is a folder of files was streamed as if it had no rows, so STM-02 merged nothing."""
    from waystone.streaming import jobs

    rows = spark.range(40).selectExpr("id AS o_orderkey")
    rows.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    got = spark.read.parquet(jobs.drained(jobs.event_stream(spark, str(tmp_path), "orders.parquet")))
    assert sorted(r.o_orderkey for r in got.collect()) == list(range(40))


def test_titles_are_compared_after_the_distinct(spark, monkeypatch):
    """the filters on the ratio were moved before the distinct, so Python compared the titles of every joined row."""
    from waystone.operators import coverage

    seen, alike = [], coverage.alike
    monkeypatch.setattr(coverage, "alike", lambda rows, *a: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or alike(rows, *a))
    rows = spark.createDataFrame([(i, "s", f"u{i}", "abcdef" if i % 2 else "abcdeg") for i in range(6)], "event_id long, road_name string, url string, title string")
    assert coverage.classified(rows, rows).count() == 6
    assert len(seen) == 1 and "Join" not in seen[0] and "Aggregate" not in seen[0]
