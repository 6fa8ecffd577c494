"""Queries for the column functions: STR, URL, DAT, CAT, MAP."""

from __future__ import annotations

from pyspark.sql import functions as F

from waystone.functions import categories as C
from waystone.functions import dates as D
from waystone.functions import text as T
from waystone.functions import urls as U
from waystone.plans.registry import query

AS_OF = "1996-01-01"
ERA_AS_OF = "2026-01-01"

_WIDE, _NARROW = T.WIDE.replace("'", "''"), T.NARROW.replace("'", "''")


def clean(x: str) -> str:
    """The same folding in SQL."""
    return f"trim(regexp_replace(translate({x}, '{_WIDE}', '{_NARROW}'), '\\s+', ' ', 'g'))"


def key(x: str) -> str:
    return f"regexp_replace(regexp_replace({clean(x)}, '^道の駅', ''), '[\\s・･.\\-‐–—]', '', 'g')"


def canonical(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({clean(x)}, '^[・●◆■*]+\\s*', ''), '^[【\\[][^】\\]]*[】\\]]\\s*', ''))"


def _notices(name: str, column: str, sql: str, make):
    query(name, f"SELECT event_id, {sql} AS {column} FROM notices")(lambda v: v.notices.select("event_id", make(F.col("title")).alias(column)))


_notices("STR-01", "cleaned", clean("title"), T.clean)
query("STR-02", f"SELECT event_id, prefecture, {key("concat('道の駅 ', road_name)")} AS station_key FROM notices")(
    lambda v: v.notices.select("event_id", "prefecture", T.station_key(F.concat(F.lit("道の駅 "), "road_name")).alias("station_key"))
)
_notices("STR-03", "title_key", f"regexp_replace(lower({clean('title')}), '[\\s「」『』【】\\[\\]()!?、。・,.\\-]', '', 'g')", T.title_key)
_notices("STR-04", "canonical", canonical("title"), T.canonical_title)
_LABEL = f"trim(regexp_extract({clean('title')}, '^[【\\[]([^】\\]]*)[】\\]]', 1))"
query("STR-05", f"SELECT event_id, CASE WHEN {key(_LABEL)} = {key('road_name')} THEN trim(regexp_replace({clean('title')}, '^[【\\[][^】\\]]*[】\\]]', '')) ELSE {clean('title')} END AS identity FROM notices")(
    lambda v: v.notices.select("event_id", T.identity_title(F.col("title"), F.col("road_name")).alias("identity"))
)
_QUOTED = f"regexp_extract_all({clean('title')}, '[「『]([^」』]+)[」』]', 1)"
_notices("STR-06", "subject", f"coalesce({_QUOTED}[-1], trim(regexp_replace({canonical('title')}, '(開催|のお知らせ|について|イベント|NEW)', '', 'g')))", T.subject)
_notices(
    "STR-07", "headline", f"trim(regexp_replace(regexp_replace(regexp_replace({clean('title')}, '(?i)\\s+new!?$', ''), '^[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}\\s*', ''), '(?i)^(event|news)\\s+', ''))", T.strip_badges
)
query("STR-08", "SELECT DISTINCT regexp_replace(trim(concat(prefecture, CASE event_id % 4 WHEN 0 THEN '県' WHEN 1 THEN '府' WHEN 2 THEN '都' ELSE '道' END)), '[都道府県]$', '') AS prefecture_key FROM notices")(
    lambda v: v.notices.select(T.prefecture_key(F.concat("prefecture", F.element_at(F.array(*map(F.lit, "県府都道")), (F.col("event_id") % 4 + 1).cast("int")))).alias("prefecture_key")).distinct()
)
_notices(
    "STR-09", "station", f"trim(regexp_replace(coalesce(nullif(regexp_extract({clean('title')}, '[【\\[]([^】\\]]+)[】\\]]', 1), ''), nullif(regexp_extract({clean('title')}, '道の駅\\s*「([^」]+)」', 1), '')), '^道の駅\\s*', ''))", T.station_from_title
)
_NATIONS = [f"NATION_{i}" for i in (17, 4, 21, 2, 11, 9)]
_notices("STR-10", "prefecture_found", f"list_filter([{', '.join(repr(n) for n in _NATIONS)}], lambda n: contains(title, n))[1]", lambda c: T.first_contained(c, _NATIONS))
query("STR-11", f"SELECT id, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '[。！？]$') THEN t ELSE concat(t, '。') END AS summary FROM (SELECT id, {clean("concat(name, CASE WHEN id % 3 = 0 THEN '。' ELSE '  ' END)")} AS t FROM landmarks)")(
    lambda v: v.landmarks.select("id", T.summary(F.concat("name", F.when(F.col("id") % 3 == 0, "。").otherwise("  "))).alias("summary"))
)
query("STR-12", "SELECT id, coalesce(nullif(trim(CASE WHEN id % 2 = 0 THEN name ELSE ' ' END), ''), concat_ws(' ', prefecture, name)) AS query FROM stations")(
    lambda v: v.stations.select("id", T.navigation_query(F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(" "), F.col("prefecture"), F.col("name")).alias("query"))
)
_notices("STR-13", "cell", "regexp_replace(regexp_replace(substring(title, 1, 20), '[,\"\\r\\n\\t]', ' ', 'g'), '\\|', '\\\\|', 'g')", lambda c: T.cell(c, 20))
query("STR-14", "SELECT id, CASE WHEN id % 3 > 0 THEN concat('road:id:', CAST(id AS VARCHAR)) ELSE concat('road', printf(':geo:%.6f,%.6f', lat, lng)) END AS place_key FROM stations")(
    lambda v: v.stations.select("id", T.place_key(F.lit("road"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")), F.col("lat"), F.col("lng")).alias("place_key"))
)

# URLs -------------------------------------------------------------------------------------------------------------
_RAW = "SELECT event_id, start_date, CASE event_id % 7 WHEN 0 THEN replace(url, 'https', 'http') WHEN 1 THEN concat(url, '/?article=', event_id, '#top') WHEN 2 THEN concat(upper(substring(url, 1, 14)), substring(url, 15), '/') WHEN 3 THEN replace(url, 'https://', 'https://user@') WHEN 4 THEN 'https://www.city.h1.lg.jp/news/' WHEN 5 THEN 'https://www.michi-no-eki.jp/stations/1' ELSE url END AS url FROM events_pub"


def _links(v):
    """URLs of all kinds that the functions tell apart."""
    u, n = F.col("url"), F.col("event_id") % 7
    made = (
        F.when(n == 0, F.replace(u, F.lit("https"), F.lit("http")))
        .when(n == 1, F.concat(u, F.lit("/?article="), "event_id", F.lit("#top")))
        .when(n == 2, F.concat(F.upper(F.substring(u, 1, 14)), F.substring(u, 15, 1000), F.lit("/")))
        .when(n == 3, F.replace(u, F.lit("https://"), F.lit("https://user@")))
        .when(n == 4, "https://www.city.h1.lg.jp/news/")
        .when(n == 5, "https://www.michi-no-eki.jp/stations/1")
        .otherwise(u)
    )
    return v.events_pub.select("event_id", "start_date", made.alias("url"))


_PART = "regexp_extract(trim({0}), '^(https?)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$', {1})"


def part(x: str, n: int) -> str:
    return _PART.format(x, n)


_HOST = f"lower({part('url', 2)})"
query("URL-01", f"SELECT event_id, {part('url', 1)} = 'https' AND NOT regexp_matches({_HOST}, '[@:]') AND {_HOST} IN ('h1.example.jp', 'h2.example.jp') AND regexp_matches({part('url', 3)}, '^(?:/news/[0-9]+)$') AS ok FROM ({_RAW})")(
    lambda v: _links(v).select("event_id", U.safe_official(F.col("url"), F.array(F.lit("h1.example.jp"), F.lit("h2.example.jp")), F.lit("/news/[0-9]+")).alias("ok"))
)
_PATH2 = f"replace(replace(url_encode(regexp_replace(url_decode({part('url', 3)}), '/+$', '')), '%2F', '/'), '%7E', '~')"
_RAW2 = f"SELECT event_id, CASE event_id % 9 WHEN 6 THEN replace(url, '/news/', '/%6eews%2F%E7%A5%AD %e3%81%ab~_-./') WHEN 7 THEN regexp_replace(url, '/news/.*$', '//') WHEN 8 THEN replace(url, '.jp/', '.jp:8443/?q=%41&') ELSE url END AS url FROM ({_RAW})"
query("URL-02", f"SELECT event_id, CASE WHEN {part('url', 1)} = 'https' AND {_HOST} <> '' AND NOT contains({_HOST}, '@') THEN concat('https://', regexp_replace({_HOST}, ':[0-9]*$', ''), CASE WHEN {_PATH2} = '' THEN '/' ELSE {_PATH2} END, {part('url', 4)}) ELSE '' END AS url_key FROM ({_RAW2})")(
    lambda v: _links(v)
    .withColumn("n", F.col("event_id") % 9)
    .select("event_id", F.when(F.col("n") == 6, F.replace("url", F.lit("/news/"), F.lit("/%6eews%2F%E7%A5%AD %e3%81%ab~_-./"))).when(F.col("n") == 7, F.regexp_replace("url", "/news/.*$", "//")).when(F.col("n") == 8, F.replace("url", F.lit(".jp/"), F.lit(".jp:8443/?q=%41&"))).otherwise(F.col("url")).alias("url"))
    .select("event_id", U.url_key(F.col("url")).alias("url_key"))
)
_HREF = "CASE event_id % 6 WHEN 0 THEN '/a/b#x' WHEN 1 THEN 'c.html' WHEN 2 THEN '?p=2' WHEN 3 THEN '//other.example.jp/x' WHEN 4 THEN 'mailto:a@b.jp' ELSE concat(url, '#f') END"
query(
    "URL-03",
    f"""WITH l AS (SELECT event_id, url AS base, regexp_replace({_HREF}, '#.*$', '') AS link FROM events_pub),
f AS (SELECT event_id, base, lower({part('base', 2)}) AS host, CASE WHEN regexp_matches(link, '^https?://') THEN link WHEN link LIKE '//%' THEN concat('https:', link) WHEN link LIKE '/%' THEN concat('https://', lower({part('base', 2)}), link)
 WHEN link LIKE '?%' THEN concat('https://', lower({part('base', 2)}), {part('base', 3)}, link) WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL ELSE concat('https://', lower({part('base', 2)}), regexp_replace({part('base', 3)}, '[^/]*$', ''), link) END AS u FROM l)
SELECT event_id, CASE WHEN lower({part('u', 2)}) = host AND {part('u', 1)} = 'https' THEN u END AS resolved FROM f""",
)(
    lambda v: v.events_pub.select(
        "event_id",
        U.resolve(
            F.when(F.col("event_id") % 6 == 0, "/a/b#x").when(F.col("event_id") % 6 == 1, "c.html").when(F.col("event_id") % 6 == 2, "?p=2").when(F.col("event_id") % 6 == 3, "//other.example.jp/x").when(F.col("event_id") % 6 == 4, "mailto:a@b.jp").otherwise(F.concat("url", F.lit("#f"))),
            F.col("url"),
        ).alias("resolved"),
    )
)
query("URL-04", f"SELECT event_id, CASE WHEN coalesce({_HOST}, '') = '' THEN 'invalid' WHEN {_HOST} IN ('www.michi-no-eki.jp', 'michi-no-eki.jp') THEN 'regional_directory' WHEN regexp_matches({_HOST}, '\\.(lg|go)\\.jp$|^(city|town|vill|pref)\\.|\\.(city|town|vill|pref)\\.') THEN 'municipal' ELSE 'station_or_partner' END AS kind FROM ({_RAW})")(
    lambda v: _links(v).select("event_id", U.classify(F.col("url")).alias("kind"))
)
query("URL-05", f"SELECT event_id, url, CAST(NULL AS VARCHAR) AS upgraded_from FROM ({_RAW}) UNION SELECT event_id, regexp_replace(url, '^http:', 'https:'), url FROM ({_RAW}) WHERE url LIKE 'http:%'")(
    lambda v: _links(v).select("event_id", F.inline(U.with_upgrade(F.col("url")))).distinct()
)
_ART = f"nullif(regexp_extract({part('url', 4)}, '[?&]article=([0-9]+)', 1), '')"
query("URL-06", f"SELECT event_id, {_ART} AS article_id, CASE WHEN {_ART} IS NOT NULL THEN concat(regexp_replace(url, '\\?.*$', ''), '?article=', {_ART}, '&start=', CAST(start_date AS VARCHAR)) ELSE url END AS pinned FROM ({_RAW})")(
    lambda v: _links(v).select("event_id", U.article_id(F.col("url")).alias("article_id"), U.pinned(F.col("url"), F.col("start_date")).alias("pinned"))
)
query("URL-07", f"SELECT event_id, array_to_string(list_sort(list_distinct(list_filter([trim(url), CAST(NULL AS VARCHAR), trim(concat(' ', url)), 'ftp://x'], lambda u: u IS NOT NULL AND regexp_matches({part('u', 1)}, '^https?$') AND NOT regexp_matches(lower({part('u', 2)}), '(^|\\.)(michi-no-eki\\.jp|h9\\.example\\.jp)$')))), ' ') AS websites FROM ({_RAW})")(
    lambda v: _links(v).select("event_id", F.array_join(U.websites([F.col("url"), F.lit(None).cast("string"), F.concat(F.lit(" "), "url"), F.lit("ftp://x")], ["michi-no-eki.jp", "h9.example.jp"]), " ").alias("websites"))
)
_MAP = "CASE id % 4 WHEN 0 THEN concat('https://maps.example/@', la, ',', ln, ',15z') WHEN 1 THEN concat('https://maps.example/?q=', la, '%2C', ln) WHEN 2 THEN concat('https://maps.example/x!3d', la, '!4d', ln) ELSE 'https://maps.example/none' END"
query(
    "URL-08",
    f"""WITH m AS (SELECT id, {_MAP} AS u FROM (SELECT id, printf('%.3f', lat) AS la, printf('%.3f', lng) AS ln FROM stations)), b AS (SELECT id, u, url_decode(u) AS d FROM m),
g AS (SELECT id, {{}} FROM b) SELECT id, CASE WHEN lat BETWEEN 20 AND 46 AND lng BETWEEN 122 AND 154 THEN lat END AS lat, CASE WHEN lat BETWEEN 20 AND 46 AND lng BETWEEN 122 AND 154 THEN lng END AS lng FROM g""".format(
        ", ".join("CAST(coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{p}', {n}), '')" for c in ("u", "d") for p in U.MAP_PATTERNS) + f") AS DOUBLE) AS {a}" for n, a in ((1, "lat"), (2, "lng")))
    ),
)(
    lambda v: v.stations.select("id", F.format_string("%.3f", "lat").alias("la"), F.format_string("%.3f", "lng").alias("ln"))
    .select(
        "id",
        U.map_coordinates(
            F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://maps.example/@"), "la", F.lit(","), "ln", F.lit(",15z")))
            .when(F.col("id") % 4 == 1, F.concat(F.lit("https://maps.example/?q="), "la", F.lit("%2C"), "ln"))
            .when(F.col("id") % 4 == 2, F.concat(F.lit("https://maps.example/x!3d"), "la", F.lit("!4d"), "ln"))
            .otherwise("https://maps.example/none")
        ).alias("p"),
    )
    .select("id", "p.lat", "p.lng")
)

# Dates ------------------------------------------------------------------------------------------------------------
query("DAT-01", "SELECT article_id, line_no, CAST(CASE WHEN n = '元' THEN 2019 WHEN n <> '' THEN 2018 + TRY_CAST(n AS INT) END AS INT) AS year FROM (SELECT article_id, line_no, regexp_extract(line_text, '(?:令和|R)([0-9]+|元)年?', 1) AS n FROM article_lines)")(
    lambda v: v.article_lines.select("article_id", "line_no", D.era_year(F.col("line_text")).alias("year"))
)
query(
    "DAT-02",
    "WITH d AS (SELECT o_orderkey AS id, TRY_CAST(printf('%04d-%02d-%02d', year(o_orderdate), CAST(1 + o_orderkey % 13 AS INT), CAST(1 + o_orderkey % 31 AS INT)) AS DATE) AS day, substring('月火水木金土日', CAST(1 + o_orderkey % 7 AS INT), 1) AS sign FROM orders) SELECT id, day, CASE WHEN sign = substring('月火水木金土日', CAST(isodow(day) AS INT), 1) THEN day END AS checked FROM d",
)(
    lambda v: v.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 13 + 1).cast("int").alias("m"), (F.col("o_orderkey") % 31 + 1).cast("int").alias("d"), F.substring(F.lit(D.WEEKDAYS), (F.col("o_orderkey") % 7 + 1).cast("int"), F.lit(1)).alias("sign")).select(
        "id", D.safe_date(F.col("y"), F.col("m"), F.col("d")).alias("day"), D.safe_date(F.col("y"), F.col("m"), F.col("d"), F.col("sign")).alias("checked")
    )
)


def folded(x: str) -> str:
    return f"translate({clean(x)}, concat(chr(1), chr(2)), '')"


_LISTS = ", ".join(f"regexp_extract_all(v, '{D.TOKEN}', {k}) AS g{k}" for k in range(8))
_YEAR = "CASE WHEN g1[i] = '元' THEN 2019 WHEN g1[i] <> '' THEN 2018 + TRY_CAST(g1[i] AS INT) ELSE TRY_CAST(g2[i] AS INT) END"


def _tokens(table: str) -> str:
    """The dates of folded texts `v` of a table, as lists."""
    one = f"{{'gap': gaps[i], 'year': {_YEAR}, 'month': TRY_CAST(g3[i] AS INT), 'day': coalesce(TRY_CAST(g4[i] AS INT), TRY_CAST(g6[i] AS INT)), 'sign': concat(g5[i], g7[i])}}"
    return f"SELECT *, list_transform(range(1, len(g0) + 1), lambda i: {one}) AS tok FROM (SELECT *, string_split_regex(v, '{D.TOKEN}') AS gaps, {_LISTS} FROM {table})"


def _day(y: str, m: str, d: str, sign: str | None = None) -> str:
    day = f"TRY_CAST(concat(lpad(CAST({y} AS VARCHAR), 4, '0'), '-', lpad(CAST({m} AS VARCHAR), 2, '0'), '-', lpad(CAST({d} AS VARCHAR), 2, '0')) AS DATE)"
    return day if sign is None else f"CASE WHEN {sign} = '' OR {sign} = substring('月火水木金土日', CAST(isodow({day}) AS INT), 1) THEN {day} END"


def period_sql(source: str, o: D.Options = D.Options()) -> str:
    """The rule of DAT-03 to DAT-05 over lists."""
    text = folded("text") if o.label is None else f"regexp_extract({folded('text')}, '(?:{o.label})(.*)$', 1)"
    own = lambda x: f"{x}.year" if o.year == "explicit" else f"coalesce({x}.year, year(published) + CASE WHEN month(published) >= 11 AND {x}.month <= 2 THEN 1 ELSE 0 END)"
    sign = lambda x: f"{x}.sign" if o.weekday else None
    joined = f"CASE WHEN b.month IS NULL THEN trim(b.gap) = '' ELSE regexp_matches(b.gap, '^ ?{D.JOIN} ?$') END"
    last = _day("coalesce(b.year, y + CASE WHEN coalesce(b.month, a.month) < a.month THEN 1 ELSE 0 END)", "coalesce(b.month, a.month)", "b.day", sign("b"))
    start = _day("y", "a.month", "a.day", sign("a"))
    days = f"list_filter(list_transform(dated, lambda x: {_day(own('x'), 'x.month', 'x.day', sign('x'))}), lambda x: x IS NOT NULL)"
    s, e = {"ignored": (start, start), "last": (f"{days}[1]", f"{days}[-1]")}.get(o.end, (start, f"CASE WHEN {joined} THEN {last} ELSE {start if o.end == 'optional' else 'NULL::DATE'} END"))
    more = ["TRUE"] + ([f"len(tok) <= {o.most_dates}"] if o.most_dates is not None else []) + ([f"NOT regexp_matches(v, '{D.OPEN_START}')"] if not o.open_start else []) + ([f"{'s' if o.not_before == 'start' else 'e'} >= published"] if o.not_before else [])
    ok = f"coalesce(e >= s AND date_diff('day', s, e) <= {o.max_span} AND {' AND '.join(more)}, FALSE)"
    return f"""SELECT event_id, CASE WHEN {ok} THEN s END AS start_date, CASE WHEN {ok} THEN e END AS end_date FROM (SELECT *, {s} AS s, {e} AS e FROM (SELECT *, {own('a')} AS y FROM (
SELECT *, dated[1] AS a, tok[list_position(list_transform(tok, lambda x: x.month IS NOT NULL), TRUE) + 1] AS b FROM (SELECT *, list_filter(tok, lambda x: x.month IS NOT NULL) AS dated FROM ({_tokens(f"(SELECT event_id, published, {text} AS v FROM {source})")})))))"""


query("DAT-03", period_sql("periods"))(lambda v: v.periods.select("event_id", D.period(F.col("text"), F.col("published")).alias("p")).select("event_id", "p.start_date", "p.end_date"))
query("DAT-04", period_sql("periods", D.STRICT))(lambda v: v.periods.select("event_id", D.strict_period(F.col("text"), F.col("published")).alias("p")).select("event_id", "p.start_date", "p.end_date"))


def _by_source(v):
    return D.periods_by_source(v.periods, "text", "published", D.SOURCES).select("event_id", "source", "p.start_date", "p.end_date")


query("DAT-05", " UNION ALL ".join(f"SELECT event_id, '{n}' AS source, start_date, end_date FROM ({period_sql('periods', o)})" for n, o in D.SOURCES.items()))(_by_source)
# one day, the next one too, or some other one too
_D6 = "concat(p_name, ' 令和7年開催 ', CAST(1 + p_partkey % 12 AS VARCHAR), '月', CAST(1 + p_partkey % 30 AS VARCHAR), '日', CASE p_partkey % 3 WHEN 0 THEN concat(' ', CAST(1 + p_partkey % 11 AS VARCHAR), '月1日') WHEN 1 THEN concat('・', CAST(1 + p_partkey % 12 AS VARCHAR), '月', CAST(2 + p_partkey % 30 AS VARCHAR), '日') ELSE '' END)"
_DAY6 = "TRY_CAST(concat(y, '-', lpad(regexp_extract(days[{0}], '^([0-9]+)', 1), 2, '0'), '-', lpad(regexp_extract(days[{0}], '月([0-9]+)', 1), 2, '0')) AS DATE)"
query(
    "DAT-06",
    f"WITH t AS (SELECT p_partkey AS id, {_D6} AS text FROM part), m AS (SELECT id, 2018 + CAST(regexp_extract(text, '令和([0-9]+)年', 1) AS INT) AS y, regexp_extract_all(text, '[0-9]{{1,2}}月[0-9]{{1,2}}日') AS x FROM t), g AS (SELECT id, y, list_filter(x, lambda e, i: list_position(x, e) = i) AS days FROM m), d AS (SELECT *, {_DAY6.format(1)} AS a, {_DAY6.format(2)} AS b FROM g) SELECT id, CASE WHEN len(days) = 1 OR len(days) = 2 AND date_diff('day', a, b) = 1 THEN a END AS start_date, CASE WHEN len(days) = 1 THEN a WHEN len(days) = 2 AND date_diff('day', a, b) = 1 THEN b END AS end_date FROM d",
)(lambda v: _title_periods(v))


def _title_periods(v):
    k = F.col("p_partkey")
    more = F.when(k % 3 == 0, F.concat(F.lit(" "), k % 11 + 1, F.lit("月1日"))).when(k % 3 == 1, F.concat(F.lit("・"), k % 12 + 1, F.lit("月"), k % 30 + 2, F.lit("日"))).otherwise("")
    text = F.concat("p_name", F.lit(" 令和7年開催 "), k % 12 + 1, F.lit("月"), k % 30 + 1, F.lit("日"), more)
    return v.part.select(k.alias("id"), text.alias("text")).select("id", D.title_year_period(F.col("text"), F.col("text")).alias("p")).select("id", "p.start_date", "p.end_date")


_AROUND = "concat(right(concat(array_to_string(list_transform(range(1, i), lambda j: concat(gaps[j], g0[j])), ''), gaps[i]), 24), g0[i], left(concat(gaps[i + 1], array_to_string(list_transform(range(i + 1, len(g0) + 1), lambda j: concat(g0[j], gaps[j + 1])), '')), 24))"
_HINT = f"SELECT event_id, text, CASE WHEN d IS NULL THEN 'unknown' WHEN d >= DATE '{ERA_AS_OF}' THEN 'future' ELSE 'past' END AS hint FROM (SELECT *, list_filter(list_transform(range(1, len(g0) + 1), lambda i: CASE WHEN tok[i].year IS NOT NULL AND regexp_matches({_AROUND}, '{D.SCHEDULED}') THEN {_day('tok[i].year', 'tok[i].month', 'tok[i].day')} END), lambda x: x IS NOT NULL)[1] AS d FROM ({_tokens(f"(SELECT event_id, text, {folded('text')} AS v FROM periods)")}))"
query("DAT-07", f"SELECT event_id, hint FROM ({_HINT})")(lambda v: v.periods.select("event_id", D.schedule_hint(F.col("text"), F.lit(ERA_AS_OF).cast("date")).alias("hint")))
_MARK = "([0-9]{1,2})月 *([0-9]{1,2})日 *[(（]([月火水木金土日])[)）]"
_Y8 = ERA_AS_OF[:4]
_D8 = f"TRY_CAST(concat('{_Y8}-', lpad(m[i], 2, '0'), '-', lpad(d[i], 2, '0')) AS DATE)"
query(
    "DAT-08",
    f"""WITH h AS ({_HINT}),
p AS (SELECT event_id, hint, list_max(list_concat(list_transform(regexp_extract_all(regexp_replace(text, '([0-9]+)', ' \\1 ', 'g'), ' (20[0-9]{{2}}) ', 1), lambda x: CAST(x AS INT)), list_transform(regexp_extract_all(text, '令和 *([0-9]{{1,2}})年', 1), lambda x: CAST(x AS INT) + 2018))) AS top,
  regexp_extract_all(text, '{_MARK}', 1) AS m, regexp_extract_all(text, '{_MARK}', 2) AS d, regexp_extract_all(text, '{_MARK}', 3) AS w FROM h),
k AS (SELECT *, list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN {_D8} IS NULL THEN 'date_in_title_needs_verification' WHEN substring('月火水木金土日', isodow({_D8}), 1) <> w[i] THEN 'weekday_year_mismatch_check' END), lambda x: x IS NOT NULL) AS bad FROM p)
SELECT event_id, CASE WHEN hint = 'future' THEN 'future_schedule_hint' WHEN top < {_Y8} THEN 'older_year_mentioned' WHEN len(bad) > 0 THEN bad[1] WHEN hint = 'past' THEN 'past_schedule_hint' ELSE 'date_and_venue_verification_needed' END AS priority FROM k""",
)(lambda v: v.periods.select("event_id", D.review_priority(F.col("text"), D.schedule_hint(F.col("text"), F.lit(ERA_AS_OF).cast("date")), F.lit(ERA_AS_OF).cast("date")).alias("priority")))
query(
    "DAT-09",
    "SELECT article_id, min({'r': r, 'd': d}).d AS published FROM (SELECT l_orderkey AS article_id, CAST(l_shipdate AS DATE) + CAST(l_linenumber % 3 * 30 AS INT) AS d, l_linenumber * 2 AS r FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_shipdate AS DATE), l_linenumber * 2 + 1 FROM lineitem) WHERE d <= DATE '1997-06-01' GROUP BY article_id",
)(
    lambda v: D.publication(
        v.lineitem.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("n"), F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_linenumber") % 3 * 30).cast("int")).alias("a"), F.col("l_shipdate").cast("date").alias("b")), "article_id", "n", ["a", "b"], "1997-06-01"
    )
)
query(
    "DAT-10",
    "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'closed' WHEN isodow(ts) = 7 THEN 'unknown' WHEN isodow(ts) = 1 THEN 'holiday' WHEN (h * 60 + mi >= 540 AND h * 60 + mi < 720) OR (h * 60 + mi >= 780 AND h * 60 + mi < 1050) THEN 'open' WHEN h * 60 + mi < 780 THEN 'before' ELSE 'closed' END AS status FROM (SELECT event_id, ts, hour(ts) AS h, minute(ts) AS mi FROM events)",
)(
    lambda v: v.events.select(
        "event_id",
        D.opening_status(
            F.create_map(F.lit("0"), F.array().cast("array<array<string>>"), *[x for d in "12345" for x in (F.lit(d), F.array(F.array(F.lit("09:00"), F.lit("12:00")), F.array(F.lit("13:00"), F.lit("17:30"))))]), F.col("ts"), F.when(F.col("event_id") % 11 == 0, "closed")
        ).alias("status"),
    )
)
query(
    "DAT-11",
    f"SELECT event_id, CASE WHEN month(start_date) BETWEEN 3 AND 5 THEN 'spring' WHEN month(start_date) BETWEEN 6 AND 8 THEN 'summer' WHEN month(start_date) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season, CAST(CASE WHEN start_date <= DATE '{AS_OF}' THEN 0 WHEN isodow(start_date) >= 6 AND start_date <= DATE '{AS_OF}' + CAST(7 - isodow(DATE '{AS_OF}') AS INT) THEN 1 ELSE 2 END AS INT) AS bucket FROM events_pub",
)(lambda v: v.events_pub.select("event_id", D.season(F.col("start_date")).alias("season"), D.weekend_bucket(F.col("start_date"), F.lit(AS_OF).cast("date")).alias("bucket")))

# Categories and maps ------------------------------------------------------------------------------------------------
query("CAT-01", f"SELECT id, array_to_string(CASE WHEN len(t) = 0 THEN ['unusual'] ELSE t END, ',') AS tags FROM (SELECT id, list_filter([{', '.join(f"CASE WHEN regexp_matches(category, '{p}') THEN '{t}' END" for t, p in C.TAG_RULES)}], lambda x: x IS NOT NULL) AS t FROM landmarks)")(
    lambda v: v.landmarks.select("id", F.array_join(C.tags(F.col("category")), ",").alias("tags"))
)
query("CAT-02", f"SELECT id, genre FROM landmarks, (VALUES {', '.join(f"('{g}', '{p}')" for g, p in C.GENRES)}) AS g(genre, pattern) WHERE regexp_matches(category, pattern)")(lambda v: C.genres(v.landmarks, F.col("category")).select("id", "genre"))
query("CAT-03", "SELECT p_partkey AS id, len(list_filter(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')), lambda x: regexp_matches(x, '^(?:blue|LARGE|red)'))) > 0 AS food FROM part")(
    lambda v: v.part.select(F.col("p_partkey").alias("id"), C.food_match(F.split("p_name", " "), F.split("p_type", " "), "^(?:blue|LARGE|red)").alias("food"))
)
query("CAT-04", f"SELECT id, CAST(CASE {' '.join(f"WHEN regexp_matches(category, '{p}') THEN {m}" for p, m in C.STAY)} ELSE 30 END AS INT) AS stay_minutes FROM landmarks")(lambda v: v.landmarks.select("id", C.stay_minutes(F.col("category")).alias("stay_minutes")))
query("CAT-05", "SELECT event_id, regexp_matches(title, 'URGENT|HIGH|MEDIUM') AND NOT regexp_matches(title, ' P') AS is_event FROM notices")(lambda v: v.notices.select("event_id", C.keywords(F.col("title"), ["URGENT", "HIGH", "MEDIUM"], [" P"]).alias("is_event")))
query(
    "CAT-06",
    "SELECT source_id, run_date, CASE WHEN fetch_failed > 0 THEN 'retry_fetch' WHEN candidates = 0 THEN 'check_listing' WHEN accepted > 0 THEN 'none' WHEN checked < candidates THEN 'inspect_candidates' ELSE 'watch' END AS next_action FROM source_audit",
)(lambda v: v.source_audit.select("source_id", "run_date", C.next_action(F.col("candidates"), F.col("checked"), F.col("accepted"), F.col("fetch_failed")).alias("next_action")))
query("MAP-01", "SELECT user_id AS source_id, event_type AS reason, count(*) AS n FROM events GROUP BY ALL")(
    lambda v: C.merged_counts(v.events.groupBy("user_id", F.to_date("ts").alias("d")).pivot("event_type", ["view", "click", "purchase", "signup", "error"]).count().select(F.col("user_id").alias("source_id"), F.create_map(*[x for t in ("view", "click", "purchase", "signup", "error") for x in (F.lit(t), F.col(t))]).alias("reasons")), "source_id", "reasons")
)
query("MAP-02", "SELECT event_id, CAST(greatest(0, coalesce(TRY_CAST(x AS INT), 0)) AS INT) AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '-5' WHEN 1 THEN 'x7' WHEN 2 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS x FROM events_pub)")(
    lambda v: v.events_pub.select("event_id", C.safe_count(F.when(F.col("event_id") % 4 == 0, "-5").when(F.col("event_id") % 4 == 1, "x7").when(F.col("event_id") % 4 == 3, F.col("event_id").cast("string"))).alias("n"))
)
