"""Notices, stations, places and audits derived from the base tables. Each view is one SELECT that any engine runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "stations": """SELECT c.c_custkey AS id, c.c_name AS name, n.n_name AS prefecture, r.r_name AS region, c.c_mktsegment AS category,
  CAST(24 AS DOUBLE) + CAST((c.c_custkey * 7919) % 20000 AS DOUBLE) / 1e3 AS lat, CAST(123 AS DOUBLE) + CAST((c.c_custkey * 104729) % 22000 AS DOUBLE) / 1e3 AS lng
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "landmarks": """SELECT p_partkey AS id, p_name AS name, p_type AS category, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'B' END AS level,
  CAST(24 AS DOUBLE) + CAST((p_partkey * 6007) % 20000 AS DOUBLE) / 1e3 AS lat, CAST(123 AS DOUBLE) + CAST((p_partkey * 91193) % 22000 AS DOUBLE) / 1e3 AS lng FROM {part}""",
    "requests": """SELECT s_suppkey AS request_id, CAST(26 AS DOUBLE) + CAST((s_suppkey * 4001) % 16000 AS DOUBLE) / 1e3 AS lat,
  CAST(125 AS DOUBLE) + CAST((s_suppkey * 7001) % 18000 AS DOUBLE) / 1e3 AS lng, CAST(50 + (s_suppkey * 37) % 250 AS DOUBLE) AS km,
  CAST(20 + s_suppkey % 30 AS DOUBLE) AS tol, CAST((s_suppkey % 4) * 90 AS DOUBLE) AS bearing FROM {supplier}""",
    "events_pub": """SELECT o.o_orderkey AS event_id, o.o_orderkey AS seq, c.c_name AS road_name, n.n_name AS prefecture, concat(o.o_orderpriority, ' ', o.o_orderstatus) AS title,
  CAST(o.o_orderdate AS DATE) AS start_date, CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 14 AS INT) AS end_date, CAST(o.o_orderdate AS DATE) - CAST(o.o_orderkey % 45 AS INT) AS published_at,
  concat('https://h', CAST(o.o_custkey % 50 AS VARCHAR(20)), '.example.jp/news/', CAST(o.o_orderkey AS VARCHAR(20))) AS url,
  CASE WHEN o.o_orderkey % 17 = 0 THEN 'cancelled' ELSE 'scheduled' END AS status, CAST(o.o_orderkey % 15 AS INT) AS feed
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "article_lines": """SELECT l.l_orderkey AS article_id, l.l_linenumber AS line_no,
  CASE WHEN l.l_linenumber % 4 = 1 THEN concat('【', p.p_brand, '】', p.p_type, '祭')
    WHEN l.l_linenumber % 4 = 2 THEN concat('開催日時：令和', CAST(year(l.l_shipdate) - 1988 AS VARCHAR(10)), '年', CAST(month(l.l_shipdate) AS VARCHAR(10)), '月', CAST(day(l.l_shipdate) AS VARCHAR(10)), '日')
    WHEN l.l_linenumber % 4 = 3 THEN concat('会場：道の駅 ', s.s_name) WHEN l.l_orderkey % 29 = 0 THEN concat(p.p_name, ' 中止') ELSE p.p_name END AS line_text
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "source_audit": """SELECT user_id AS source_id, CAST(ts AS DATE) AS run_date, CAST(COUNT(*) AS BIGINT) AS candidates,
  CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS fetch_failed, CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
  CAST(SUM(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) AS BIGINT) AS checked FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "page_snapshots": "SELECT event_id AS seq, user_id AS source_id, ts, sha256(concat(event_type, '|', props)) AS content_sha FROM {events}",
    "visits": """SELECT event_id AS visit_id, user_id, ts, CAST(24 AS DOUBLE) + CAST((event_id * 7919) % 20000 AS DOUBLE) / 1e3 + 1e-3 AS lat,
  CAST(123 AS DOUBLE) + CAST((event_id * 104729) % 22000 AS DOUBLE) / 1e3 AS lng FROM {events}""",
    # titles as notices write them: bullets, bracket labels, quotations, full-width forms, dates and badges
    "notices": """SELECT event_id, road_name, prefecture, published_at, start_date, end_date, url, CASE event_id % 8 WHEN 0 THEN concat('・【イベント】', title, ' NEW') WHEN 1 THEN concat('【', road_name, '】', title)
  WHEN 2 THEN concat('【道の駅 ', road_name, '】 ', title, '！') WHEN 3 THEN concat('「', title, '」開催のお知らせ') WHEN 4 THEN concat('　ＥＶＥＮＴ　', title, '  ') WHEN 5 THEN concat('2026.03.01 EVENT ', title)
  WHEN 6 THEN concat('[', road_name, '] ', title, '  new') ELSE concat(title, ' in ', prefecture) END AS title FROM events_pub""",
    # periods as notices write them; years lie 30 ahead, so eras apply
    "periods": """SELECT event_id, published, CASE event_id % 16 WHEN 0 THEN concat(y, '年', m, '月', d, '日（土）～', m2, '月', d2, '日') WHEN 1 THEN concat('令和', era, '年', m, '月', d, '日から', m2, '月', d2, '日')
  WHEN 2 THEN concat('開催日時：', m, '月', d, '日～', d2, '日') WHEN 3 THEN concat('期間 ', y, '/', m, '/', d, ' - ', y, '/', m2, '/', d2) WHEN 4 THEN concat(m, '月', d, '日') WHEN 5 THEN concat(y, '年2月30日') WHEN 6 THEN concat('～', m2, '月', d2, '日')
  WHEN 7 THEN concat(y, '-', m, '-', d, ' 開催') WHEN 8 THEN concat(m, '/', d, '（日・祝）・', d2, '日(月)') WHEN 9 THEN concat('10月30日～1月3日 受付', m, '月') WHEN 10 THEN concat('令和元年', m, '月', d, '日 10:00～15:00 実施')
  WHEN 11 THEN concat('祭り（', y, '.', m, '.', d, '～', d2, '）') WHEN 12 THEN concat('日時：', y, '年', m, '月', d, '日（水）～', y, '年', m2, '月', d2, '日（金）') WHEN 13 THEN concat('● ～', m, '月', d, '日')
  WHEN 14 THEN concat(m, '月', d, '日、', m2, '月', d2, '日、', y, '年', m2, '月28日') ELSE concat('令和', era, '年', m, '月', d, '日開催 ', y, '年の記録') END AS text
FROM (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) + CAST(10927 AS INT) AS published, CAST(year(o_orderdate) + 30 AS VARCHAR(10)) AS y, CAST(year(o_orderdate) + 12 - 2000 AS VARCHAR(10)) AS era, CAST(month(o_orderdate) AS VARCHAR(10)) AS m, CAST(day(o_orderdate) AS VARCHAR(10)) AS d,
  CAST(month(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT)) AS VARCHAR(10)) AS m2, CAST(day(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT)) AS VARCHAR(10)) AS d2 FROM {orders}) x""",
    # pages with cards in nested containers: two cards each, some with two stations, three dates, no link, another host or open elements
    "event_pages": """SELECT event_id AS page_id, url, road_name, CASE WHEN event_id % 3 = 0 THEN concat('EVENT 2026.10.08 ', title, '祭') WHEN event_id % 3 = 1 THEN concat('2026年3月1日 ', title) ELSE concat(title, ' 祭　募集') END AS listed,
  concat('<html><head><title>', title, '</title><script>if (a < b) write("</div><li>");</script></head><body><nav><ul><li><h1>', road_name, '祭り</h1> ', d1, ' ', d1, '</li></ul></nav><!-- <li> --><main><h1>',
    CASE event_id % 4 WHEN 0 THEN 'イベント一覧' WHEN 1 THEN concat(title, ' &amp; 祭り') WHEN 2 THEN '募集 祭り' ELSE '' END, '</h1><h2>', CASE WHEN event_id % 5 = 0 THEN '秋の<b>フェア</b>' ELSE '一覧' END, '</h2><div class="list"><DIV><section><ul><li class="card">',
    CASE event_id % 6 WHEN 0 THEN concat('<a href="/event/?article=', event_id, '"><span>', title, '</span> 大会</a>') WHEN 1 THEN '<a href="https://other.example.jp/event/1">大会の詳細を見る</a>' WHEN 2 THEN concat('<a href="../event/x', event_id, '#top">詳細を見る 一覧</a>') ELSE '' END,
    '<p>', road_name, CASE WHEN event_id % 7 = 3 THEN ' Customer#000000001' ELSE '' END, '</p><p>', d1, '<br>', d2, CASE WHEN event_id % 7 = 5 THEN ' 締切2026年1月9日' ELSE '' END, '<p>・', title, '&nbsp;のお祭り</li><li><p>', road_name, '</p><p>', d2, ' ', d3, '</p><p>次の', title, '</p></li></ul></section></div></div></main><footer><p>', d1, '</p></footer></body></html>') AS html
FROM (SELECT *, concat(CAST(year(start_date) + 30 AS VARCHAR(10)), '年', CAST(month(start_date) AS VARCHAR(10)), '月', CAST(day(start_date) AS VARCHAR(10)), '日') AS d1,
  concat(CAST(year(end_date) + 30 AS VARCHAR(10)), '年', CAST(month(end_date) AS VARCHAR(10)), '月', CAST(day(end_date) AS VARCHAR(10)), '日') AS d2, concat(CAST(year(end_date) + 31 AS VARCHAR(10)), '年1月', CAST(1 + event_id % 28 AS VARCHAR(10)), '日') AS d3 FROM events_pub) x""",
    # lines of 15 sources, each with its own way to write titles, dates and venues
    "adapter_lines": """SELECT CAST(a.article_id % 15 AS INT) AS adapter, a.article_id, CAST(a.line_no * 3 AS INT) AS line_no, CASE WHEN a.line_text LIKE '開催日時%' AND a.article_id % 5 IN (1, 3) THEN regexp_replace(a.line_text, '^開催日時：令和[0-9]+年', '')
  WHEN a.line_text LIKE '【%' AND a.article_id % 5 = 4 THEN concat(a.line_text, ' 2026年', CAST(1 + a.article_id % 12 AS VARCHAR(10)), '月5日～8日') WHEN a.article_id % 4 = 0 AND a.line_no % 4 = 0 THEN concat(a.line_text, ' 別会場') ELSE a.line_text END AS text,
  CAST(o.o_orderdate AS DATE) + CAST(10927 AS INT) AS published FROM article_lines a JOIN {orders} o ON a.article_id = o.o_orderkey
UNION ALL SELECT CAST(o_orderkey % 15 AS INT), o_orderkey, 0, concat(CAST(2022 + o_orderkey % 6 AS VARCHAR(10)), '年', CAST(1 + o_orderkey % 12 AS VARCHAR(10)), '月 道の駅イベントのご案内'), CAST(o_orderdate AS DATE) + CAST(10927 AS INT) FROM {orders} WHERE o_orderkey % 5 = 1""",
    # sentences that tell of an event: in order, venue first, two dates, with the day of publication, without weekday
    "announcements": """SELECT doc_id, adapter, published, CASE doc_id % 6 WHEN 0 THEN concat('本日更新。', title, 'は', m, '月', d, '日（土）に道の駅で開催します。次回は来月！') WHEN 1 THEN concat('道の駅で', title, 'を', m, '月', d, '日（日）開催。') WHEN 2 THEN concat(title, 'は', m, '月', d, '日（月）、締切は', m, '月1日。道の駅で開催')
  WHEN 3 THEN concat(p, ' ', title, 'を', m, '月', d, '日(水)より道の駅にて開催!') WHEN 4 THEN concat(title, 'は', m, '月', d, '日に道の駅で開催') ELSE concat('他のお知らせ。', title, '！', m, '月', d, '日（火）道の駅で', title, '開催') END AS text
FROM (SELECT event_id AS doc_id, CAST(event_id % 3 AS INT) AS adapter, title, published_at + CAST(10927 AS INT) AS published, CAST(month(start_date) AS VARCHAR(10)) AS m, CAST(day(start_date) AS VARCHAR(10)) AS d,
  concat(CAST(year(published_at + CAST(10927 AS INT)) AS VARCHAR(10)), '年', CAST(month(published_at + CAST(10927 AS INT)) AS VARCHAR(10)), '月', CAST(day(published_at + CAST(10927 AS INT)) AS VARCHAR(10)), '日') AS p FROM events_pub) x""",
    "old_feed": "SELECT * FROM events_pub WHERE event_id % 10 < 7",
    "new_feed": """SELECT event_id, seq, road_name, prefecture, CASE WHEN event_id % 13 = 0 THEN concat(title, ' NEW') ELSE title END AS title, start_date + CAST(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS start_date,
  end_date + CAST(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS end_date, published_at, url, status, feed FROM events_pub WHERE event_id % 10 >= 3""",
}


def _named(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(FROM|JOIN|,)\s*{v}\b", sql) or re.search(rf"\b{v}\b", sql)]


#: Views whose rows are dear to read: they are dealt by key before, as the files may have few parts.
DEALT = {"event_pages": ("events_pub", "event_id"), "announcements": ("events_pub", "event_id"), "periods": ("orders", "o_orderkey")}


class Views:
    """Base tables and views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # streams of events come without a zone; all sessions here are in UTC
        return df.withColumn("ts", df["ts"].cast("timestamp")) if name == "events" else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[name].replace("sha256(concat(event_type, '|', props))", "sha2(concat(event_type, '|', props), 256)").replace("'\\", "'\\\\")
        own = {t: self.table(t) for t in BASE if f"{{{t}}}" in sql}
        for v in VIEWS:
            if v != name and re.search(rf"\bFROM {v}\b", sql):
                sql = re.sub(rf"\bFROM {v}\b", f"FROM {{{v}}}", sql)
                own[v] = getattr(self, v)
        if name in DEALT:
            source, by = DEALT[name]
            own[source] = own[source].repartition(4 * self.spark.sparkContext.defaultParallelism, by)
        return self.spark.sql(sql, **own)


def with_views(sql: str) -> str:
    """The SQL with the views it names as common table expressions, for engines where base tables are registered."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    text = ", ".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in need)
    if not need:
        return sql
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {text}, {body[5:]}"
    return f"WITH {text} {body}"
