"""Row patterns over an article's lines, sentences that tell of an event, and records that must agree."""

import datetime as dt

import pytest

from waystone.operators import patterns as R

day = dt.date
PUBLISHED = day(2026, 9, 20)


def lines(spark, *articles):
    rows = [(a, k, n, t, PUBLISHED) for a, k, texts in articles for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "adapter int, article_id int, line_no int, text string, published date").repartition(3)


def events(spark, rules, *articles):
    got = R.row_events(lines(spark, *articles), R.rules_table(spark, rules)).collect()
    return sorted((r.adapter, r.article_id, r.title, r.venue, r.start_date, r.end_date) for r in got)


def test_all_sources_in_one_pass(spark):
    """A monthly programme, named programmes, triples and dated titles, each by its own rule."""
    rules = [
        R.Rule(1, "monthly", "祭|フェア", "TD", "^[0-9]+月", offsite="市役所|別会場", scope="^[^D]{0,8}", year="heading"),
        R.Rule(2, "named", "(?:猿まわし|太鼓)", "B|T.?D", title_part="(猿まわし|太鼓)"),
        R.Rule(3, "triples", "^【", "TDV", "^日時", need_venue=True),
        R.Rule(4, "published", "祭", "B", year="published", title_part="日(?:\\(.\\))? ?(.*)$", max_span=5),
    ]
    monthly = ["2026年10月 道の駅イベントのご案内", "「秋のフェア」", "10月10日（土）", "雨天決行", "『市の祭』", "10月11日(日)", "市役所にて", "前の祭", "10月12日(日)", "冬のフェア", "10月13日（火）～14日（水）", "参加者募集の祭", "10月17日(土)"]
    named = ["太鼓の練習", "3月の話", "太鼓の演奏", "場所は広場", "2026年10月18日(日)", "猿まわし 2026年10月25日", "猿まわし", "10月30日", "太鼓の演奏", "あ", "い", "2026年11月1日"]
    triple = ["【一】", "日時：2026年10月10日", "会場：道の駅　あ", "【二】", "日時：2026年10月11日", "【三】", "会場：道の駅"]
    own = ["10月24日(土) 沖縄祭", "12月1日～12月20日 長い祭", "1月5日 初祭", "2026年10月24日（日） 誤った祭"]
    got = events(spark, rules, (1, 1, monthly), (1, 2, monthly[1:]), (2, 1, named), (3, 1, triple), (4, 1, own), (9, 1, own))
    assert got == [
        (1, 1, "冬のフェア", None, day(2026, 10, 13), day(2026, 10, 14)),
        (1, 1, "秋のフェア", None, day(2026, 10, 10), day(2026, 10, 10)),
        (2, 1, "太鼓", None, day(2026, 10, 18), day(2026, 10, 18)),
        (2, 1, "猿まわし", None, day(2026, 10, 25), day(2026, 10, 25)),
        (3, 1, "【一】", "道の駅 あ", day(2026, 10, 10), day(2026, 10, 10)),
        (4, 1, "初祭", None, day(2026, 1, 5), day(2026, 1, 5)),
        (4, 1, "沖縄祭", None, day(2026, 10, 24), day(2026, 10, 24)),
    ]


def test_plan_does_not_grow_with_the_rules(spark):
    plan = lambda n: R.row_events(lines(spark, (0, 1, ["【祭】"])), R.rules_table(spark, [R.Rule(k, "x", "祭", "TD") for k in range(n)]))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(1) == plan(15)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("10月25日(日)に道の駅かでなで秋まつりを開催します。", day(2026, 10, 25)),
        ("2026年9月20日 お知らせ 10月25日(日)道の駅かでなで秋まつりを開催", day(2026, 10, 25)),
        ("道の駅かでなで10月25日(日)秋まつり開催。", None),
        ("10月25日に道の駅かでなで秋まつりを開催。", None),
        ("10月25日(月)に道の駅かでなで秋まつりを開催。", None),
        ("10月25日(日)、11月1日(日)に道の駅かでなで秋まつりを開催。", None),
        ("10月25日(日)に道の駅かでなで。秋まつりを開催。", None),
        ("10月25日(日)に市役所で秋まつりを開催。", None),
        (None, None),
    ],
)
def test_sentences(spark, text, want):
    docs = spark.createDataFrame([(1, 5, text, PUBLISHED)], "adapter int, doc_id int, text string, published date")
    rules = spark.createDataFrame([(1, "秋まつり", "道の駅かでな", "開催"), (2, "別", "別", "別")], "adapter int, name string, venue string, verb string")
    got = R.sentence_events(docs, rules).collect()
    assert [(r.title, r.start_date, r.end_date) for r in got] == ([("秋まつり", want, want)] if want else [])


GOOD = ["10月の催事1 パン市", "催事場所 施設内 道の駅むなかた", "催事日 2026年10月24日～25日", "10月の催事2 別の市", "催事場所 駅前", "催事日 2026年10月3日"]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, "accepted"),
        ({0: "10月の催事1 菓子市"}, "title_missing"),
        ({0: "パン市"}, "section_missing"),
        ({1: "催事場所 駅前"}, "venue_missing"),
        ({1: "催事場所 施設外 道の駅むなかた"}, "offsite"),
        ({2: "催事日 未定"}, "date_missing"),
        ({2: "催事日 2026年10月25日～24日"}, "invalid_date"),
        ({2: "催事日 2026年9月24日"}, "past"),
        ({1: "催事場所 施設内 道の駅むなかた 中止"}, "cancelled"),
        ({4: "駅前 中止"}, "accepted"),
        ({3: "次の市", 4: ""}, "accepted"),
    ],
)
def test_records_by_section(spark, change, want):
    rule = R.Record(1, "vendor", "パン市", start="10月の催事[0-9] パン市", stop="10月の催事[0-9]", venue="道の駅むなかた", offsite="施設外", date_label="催事日", max_span=30)
    text = [change.get(k, t) for k, t in enumerate(GOOD)]
    got = R.verified_records(lines(spark, (1, 1, text)), R.records_table(spark, [rule]), as_of="2026-10-01").collect()
    assert [r.reason for r in got] == [want]
    assert [r.start_date for r in got] == [day(2026, 10, 24) if want == "accepted" else None]


def test_records_need_every_word(spark):
    rule = R.Record(1, "checkpoint", "スタンプ", needs="クイズ 各スポット", venue="スポット:.*むなかた", date_label="開催期間")
    text = ["スタンプ大会", "各スポットでクイズ", "スポット：道の駅むなかた", "開催期間：令和8年10月1日(木)〜11月3日"]
    run = lambda t: R.verified_records(lines(spark, (1, 1, t)), R.records_table(spark, [rule]), as_of="2026-10-10").first()
    got = run(text)
    assert (got.reason, got.start_date, got.end_date) == ("accepted", day(2026, 10, 1), day(2026, 11, 3))
    assert run([text[0], text[2], text[3]]).reason == "activity_missing"
