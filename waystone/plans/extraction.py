"""Queries on pages, lines and files: EXT, JN-13, JN-17, FLT-11, SRC, SNK-02, U."""

from __future__ import annotations

from pyspark.sql import functions as F

from waystone.functions import dates as D
from waystone.functions import text as T
from waystone.functions import udfs
from waystone.operators import extract as X
from waystone.operators import pages as P
from waystone.operators import patterns as R
from waystone.operators import search as S
from waystone.plans.columns import ERA_AS_OF, clean, folded, key, part, period_sql
from waystone.plans.registry import query
from waystone.sources import files



def day_sql(x: str) -> str:
    """The day of a date with its year."""
    return f"TRY_CAST(concat(regexp_extract({x}, '([0-9]{{4}})年', 1), '-', lpad(regexp_extract({x}, '年 *([0-9]+)', 1), 2, '0'), '-', lpad(regexp_extract({x}, '月 *([0-9]+)', 1), 2, '0')) AS DATE)"


_A = "<a [^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>"
query(
    "EXT-01",
    f"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_A}', 1)) AS href, {{}} AS text, unnest(range(0, len(regexp_extract_all(html, '{_A}', 1)))) AS pos FROM pages), k AS (SELECT * FROM l WHERE length(text) BETWEEN 1 AND 8), f AS (SELECT page_id, href, min({{{{'pos': pos, 'text': text}}}}) AS f FROM k GROUP BY page_id, href), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY f.pos) AS rn FROM f) SELECT page_id, href, f.text AS text FROM r WHERE rn <= 4".format(clean(f"unnest(regexp_extract_all(html, '{_A}', 2))")),
)(lambda v: X.links(v.pages, 8, 4).select("page_id", "href", "text"))
_BODY = "html"
for _t in X.SKIPPED:
    _BODY = f"regexp_replace({_BODY}, '(?s)<{_t}[ >].*?</{_t}>', chr(10), 'g')"
_BODY = f"regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)<!--.*?-->', '', 'g'), '</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|table|article|section|body|html)(?:[ /][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
query("EXT-02", f"SELECT * FROM (SELECT page_id, CAST(pos AS INT) AS pos, {clean('raw')} AS line FROM (SELECT page_id, unnest(x) AS raw, unnest(range(0, len(x))) AS pos FROM (SELECT page_id, string_split({_BODY}, chr(10)) AS x FROM pages))) WHERE length(line) BETWEEN 1 AND 5000")(lambda v: X.page_lines(v.pages))
_HEAD = ", ".join(f"nullif({clean(f"regexp_replace(regexp_extract(html, '(?s)<{t}[^>]*>(.*?)</{t}>', 1), '<[^>]*>', '', 'g')")}, '')" for t in ("h1", "h2", "title"))
query("EXT-03", f"SELECT page_id, coalesce({_HEAD}) AS headline FROM pages")(lambda v: v.pages.select("page_id", X.headline(F.col("html")).alias("headline")))
query("EXT-04", "SELECT article_id, line_no, coalesce(nullif(trim(regexp_extract(line_text, '^(?:会場|場所)[：:](.*)$', 1)), ''), nxt) AS value FROM (SELECT *, lead(line_text) OVER (PARTITION BY article_id ORDER BY line_no, line_text) AS nxt FROM article_lines) WHERE regexp_matches(line_text, '^(?:会場|場所)[：:]')")(
    lambda v: X.labelled(v.article_lines, X.VENUE_LABEL)
)
_STATION = "SELECT article_id, concat('道の駅 ', min(substring(line_text, 8))) AS station FROM article_lines WHERE line_text LIKE '会場%' GROUP BY article_id"
query("EXT-05", f"SELECT l.article_id, bool_or({key('substring(line_text, 4)')} = {key('station')}) AS any_on_site, bool_and({key('substring(line_text, 4)')} = {key('station')}) AS on_site FROM article_lines l JOIN ({_STATION}) s ON l.article_id = s.article_id WHERE line_text LIKE '会場%' GROUP BY l.article_id")(
    lambda v: X.venue_proof(v.article_lines, v.article_lines.filter("line_text like '会場%'").groupBy("article_id").agg(F.concat(F.lit("道の駅 "), F.min(F.substring("line_text", 8, 100))).alias("station")))
)
#: Lines with their kinds and days.
_M = "m AS (SELECT *, line_text LIKE '【%' AS is_heading, line_text LIKE '開催日時：%' AS is_date, line_text LIKE '会場：%' AS is_venue, TRY_CAST(concat(2018 + TRY_CAST(regexp_extract(line_text, '^開催日時：令和([0-9]+)年', 1) AS INT), '-', lpad(regexp_extract(line_text, '年([0-9]+)月', 1), 2, '0'), '-', lpad(regexp_extract(line_text, '月([0-9]+)日', 1), 2, '0')) AS DATE) AS day FROM article_lines)"
_W = "(PARTITION BY article_id ORDER BY line_no, line_text)"
_SEC = f"{_M}, s0 AS (SELECT *, CAST(sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY line_no, line_text ROWS UNBOUNDED PRECEDING) AS INT) AS section, row_number() OVER {_W} AS rn FROM m), s AS (SELECT *, rn - min(rn) OVER (PARTITION BY article_id, section) AS gap FROM s0 WHERE section > 0)"
_REASON = f"CASE WHEN cancelled THEN 'cancelled' WHEN headings = 0 THEN 'not_event' WHEN headings > 1 THEN 'multi_event_overview' WHEN venues = 0 THEN 'venue_missing' WHEN NOT coalesce(on_site, FALSE) THEN 'offsite' WHEN day IS NULL THEN 'undated' WHEN day <> last_day THEN 'date_conflict' WHEN day < DATE '{ERA_AS_OF}' THEN 'past' ELSE 'accepted' END"
_STATION6 = f"SELECT article_id, CASE WHEN article_id % 3 = 0 THEN '道の駅 Supplier#000000001' ELSE station END AS station FROM ({_STATION})"
query("EXT-06", f"WITH {_M}, st AS ({_STATION6}), v AS (SELECT l.article_id, bool_and({key('substring(line_text, 4)')} = {key('station')}) AS on_site FROM article_lines l JOIN st ON l.article_id = st.article_id WHERE line_text LIKE '会場%' GROUP BY l.article_id), a AS (SELECT article_id, count(*) FILTER (is_heading) AS headings, count(*) FILTER (is_venue) AS venues, min(day) AS day, max(day) AS last_day, bool_or(regexp_matches(line_text, '中止|延期')) AS cancelled, min(CASE WHEN is_heading THEN {{'n': line_no, 't': line_text}} END).t AS title FROM m GROUP BY article_id), r AS (SELECT *, {_REASON} AS reason FROM a LEFT JOIN v USING (article_id)) SELECT article_id, reason, CASE WHEN reason = 'accepted' THEN title END AS title, CASE WHEN reason = 'accepted' THEN day END AS day FROM r")(
    lambda v: X.with_reasons(v.article_lines, ERA_AS_OF, v.article_lines.filter("line_text like '会場%'").groupBy("article_id").agg(F.when(F.col("article_id") % 3 == 0, "道の駅 Supplier#000000001").otherwise(F.concat(F.lit("道の駅 "), F.min(F.substring("line_text", 8, 100)))).alias("station")))
)
query("EXT-07-titles", f"WITH {_M}, l AS (SELECT l_orderkey AS article_id, CAST(l_shipdate AS DATE) + CAST(l_linenumber % 2 AS INT) AS listed, concat('道の駅 ', upper(p_brand)) AS title FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 2), d AS (SELECT article_id, list(DISTINCT day) AS days FROM m WHERE day IS NOT NULL GROUP BY article_id), h AS (SELECT article_id, list(regexp_replace(lower(line_text), '[\\s「」『』【】\\[\\]()!?、。・,.\\-]', '', 'g')) AS heads FROM m WHERE is_heading GROUP BY article_id), k AS (SELECT *, regexp_replace(lower(title), '[\\s「」『』【】\\[\\]()!?、。・,.\\-]', '', 'g') AS k FROM l) SELECT article_id, CASE WHEN len(list_filter(heads, lambda h: contains(h, k) OR contains(k, h))) = 0 THEN 'listing_article_title_conflict' WHEN len(list_filter(days, lambda x: month(x) <> month(listed) OR day(x) <> day(listed))) > 0 THEN 'listing_article_date_conflict' WHEN days IS NULL THEN 'listing_only' ELSE 'agrees' END AS state FROM k LEFT JOIN d USING (article_id) LEFT JOIN h USING (article_id)")(
    lambda v: X.listing_conflicts(v.article_lines, v.lineitem.filter("l_linenumber = 2").join(v.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("article_id"), F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_linenumber") % 2).cast("int")).alias("listed"), F.concat(F.lit("道の駅 "), F.upper("p_brand")).alias("title")))
)
query("EXT-07", f"WITH {_M}, l AS (SELECT o_orderkey AS article_id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS listed FROM orders), j AS (SELECT l.article_id, bool_or(month(day) <> month(listed) OR day(day) <> day(listed)) AS bad, count(day) AS n FROM l LEFT JOIN (SELECT * FROM m WHERE day IS NOT NULL) m ON l.article_id = m.article_id GROUP BY l.article_id, listed) SELECT article_id, CASE WHEN n = 0 THEN 'listing_only' WHEN bad THEN 'listing_article_date_conflict' ELSE 'agrees' END AS state FROM j")(
    lambda v: X.listing_conflicts(v.article_lines, v.orders.select(F.col("o_orderkey").alias("article_id"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 40).cast("int")).alias("listed")))
)
_FIRST = lambda c, x: f"min(CASE WHEN {c} THEN {{'rn': rn, 'x': {x}}} END).x"
query("EXT-08", f"WITH {_SEC} SELECT * FROM (SELECT article_id, section, {_FIRST('is_heading', 'line_text')} AS title, {_FIRST('day IS NOT NULL', 'day')} AS day, regexp_replace({_FIRST('is_venue', 'line_text')}, '^会場：', '') AS venue FROM s WHERE gap <= 9 GROUP BY article_id, section) WHERE day IS NOT NULL AND venue IS NOT NULL")(lambda v: X.section_events(v.article_lines, total=v.lineitem.count()))
query("EXT-09", f"WITH {_M} SELECT article_id, line_no, title, day, has_venue FROM (SELECT *, lag(line_text) OVER {_W} AS title, coalesce(max(is_venue) OVER (PARTITION BY article_id ORDER BY line_no, line_text ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), FALSE) AS has_venue FROM m) WHERE day IS NOT NULL AND title IS NOT NULL")(lambda v: X.dated_with_context(v.article_lines))
query("EXT-10", f"WITH {_M} SELECT article_id, line_no, line_text AS title, d1 AS day, regexp_replace(t2, '^会場：', '') AS venue FROM (SELECT *, lead(day) OVER {_W} AS d1, lead(is_venue, 2) OVER {_W} AS v2, lead(line_text, 2) OVER {_W} AS t2 FROM m) WHERE is_heading AND d1 IS NOT NULL AND v2")(lambda v: X.triples(v.article_lines))
query("EXT-11", f"WITH {_SEC} SELECT * FROM (SELECT article_id, section, min(CASE WHEN gap <= 3 THEN day END) AS day FROM s GROUP BY article_id, section HAVING bool_or(is_venue AND gap <= 18)) WHERE day IS NOT NULL")(lambda v: X.notice_blocks(v.article_lines, total=v.lineitem.count()))
query("EXT-12", f"WITH {_M}, n AS (SELECT *, min(day) OVER (PARTITION BY article_id ORDER BY line_no, line_text ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS near FROM m), p AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_partkey % 7 = 0) SELECT article_id, line_no, name, near AS day FROM n JOIN p ON regexp_extract(line_text, '【([^】]+)】', 1) = name WHERE near IS NOT NULL")(
    lambda v: X.named_programs(v.article_lines, v.part.filter("p_partkey % 7 = 0").select(F.col("p_brand").alias("name")).distinct())
)
query("EXT-13-agreed", f"WITH {_M} SELECT article_id, min(CASE WHEN is_heading THEN line_text END) AS title, min(day) AS day FROM m GROUP BY article_id HAVING count(DISTINCT CASE WHEN is_heading THEN line_text END) = 1 AND count(DISTINCT day) = 1 AND count(DISTINCT CASE WHEN is_venue THEN line_text END) = 1")(lambda v: X.agreed(v.article_lines))
query("EXT-14", f"WITH {_SEC} SELECT article_id, section, substring(string_agg(line_text, ' ' ORDER BY rn), 1, 60) AS context FROM s GROUP BY article_id, section")(lambda v: X.heading_context(v.article_lines, 60, total=v.lineitem.count()))
_POS = "SELECT l_suppkey AS page, CAST(l_partkey % 2 AS INT) AS side, CAST(l_orderkey % 700 AS DOUBLE) AS y, l_orderkey * 10 + l_linenumber AS id, l_linenumber = 1 AS is_station FROM lineitem"


def _positions(v):
    return v.lineitem.select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 2).cast("int").alias("side"), (F.col("l_orderkey") % 700).cast("double").alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") == 1).alias("is_station"))


_W15 = "PARTITION BY page, side ORDER BY y, id, is_station"
query(
    "EXT-15",
    f"WITH p AS (SELECT page, side, y, id, is_station FROM ({_POS}) GROUP BY ALL), g AS (SELECT *, CASE WHEN is_station THEN {{'y': y, 'id': id}} END AS st FROM p), w AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY page, side ORDER BY y, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, first_value(st IGNORE NULLS) OVER (PARTITION BY page, side ORDER BY y, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM g) SELECT page, id, CASE WHEN y - s.y <= 90 THEN s.id WHEN a IS NULL OR y - s.y <= a.y - y THEN s.id ELSE a.id END AS station_id FROM w WHERE NOT is_station",
)(lambda v: X.paired_rows(_positions(v).distinct(), 90.0))
query("JN-13", f"WITH p AS (SELECT DISTINCT page, y, is_station FROM ({_POS})), s AS (SELECT page, y FROM p WHERE is_station) SELECT e.page, e.y, max(s.y) AS station_y FROM (SELECT DISTINCT page, y FROM p WHERE NOT is_station) e ASOF LEFT JOIN s ON e.page = s.page AND s.y <= e.y GROUP BY e.page, e.y")(
    lambda v: _as_of(v)
)


def _as_of(v):
    from pyspark.sql import Window

    p = _positions(v).select("page", "y", "is_station").distinct()
    both = p.groupBy("page", "y").agg(F.bool_or("is_station").alias("st"), F.bool_or(~F.col("is_station")).alias("ev"))
    w = Window.partitionBy("page").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("station_y", F.last(F.when(F.col("st"), F.col("y")), ignorenulls=True).over(w)).filter("ev").select("page", "y", "station_y")


query("EXT-16-shortest", "SELECT conv_id, min({'n': length(text), 't': text}).t AS text FROM conversations WHERE len(regexp_extract_all(text, '[.?]')) = 1 AND len(regexp_extract_all(text, '[A-Z]')) = 1 GROUP BY conv_id")(lambda v: X.smallest_card(v.conversations, "conv_id", "text", {"[.?]": 1, "[A-Z]": 1}))
#: Pages as nested sets, by the same rules over lists: r (tags and texts), el (elements).
_TEXT = "x[3]"
for _e, _s in P.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_e}', '{_s.replace("'", "''")}')"
_VOID = ", ".join(f"'{v}'" for v in P.VOID)


def _tree(pages: str) -> str:
    marked = f"regexp_replace(regexp_replace(html, '{P.NO_MARKUP}', '', 'g'), '{P.TAG}', concat(chr(1), '\\1', chr(2), '\\2', chr(2)), 'g')"
    return f"""pg AS (SELECT * FROM {pages}), r0 AS (SELECT page_id, pos, CASE WHEN pos = 0 THEN ['', '', x] ELSE string_split(x, chr(2)) END AS x FROM (SELECT page_id, unnest(p) AS x, CAST(unnest(range(0, len(p))) AS INT) AS pos FROM (SELECT page_id, string_split({marked}, chr(1)) AS p FROM pg))),
r1 AS (SELECT page_id, pos, lower(ltrim(x[1], '/')) AS tag, x[1] LIKE '/%' AS closing, x[2] AS attrs, {clean(_TEXT)} AS text FROM r0),
r AS (SELECT *, CAST(coalesce(sum(length(text) + CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars FROM r1),
lv AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) + CASE WHEN closing THEN 1 ELSE 0 END AS level FROM r WHERE tag <> '' AND tag NOT IN ({_VOID})),
nx AS (SELECT *, lead(closing) OVER w AS nc, lead(pos) OVER w AS np, lead(chars) OVER w AS nch FROM lv WINDOW w AS (PARTITION BY page_id, tag, level ORDER BY pos)),
cl AS (SELECT page_id, tag, attrs, pos AS pre, np AS post, nch - chars AS chars FROM nx WHERE NOT closing AND nc),
lo AS (SELECT n.page_id, n.tag, n.attrs, n.pos AS pre, n.chars AS c0, CAST(coalesce(min(cl.post), max(la.last)) AS INT) AS post, max(la.total) AS total FROM nx n JOIN (SELECT page_id, max(pos) + 1 AS last, max(chars + length(text) + CASE WHEN text <> '' THEN 1 ELSE 0 END) AS total FROM r GROUP BY page_id) la ON la.page_id = n.page_id LEFT JOIN cl ON cl.page_id = n.page_id AND cl.pre < n.pos AND n.pos < cl.post WHERE NOT n.closing AND NOT coalesce(n.nc, FALSE) GROUP BY n.page_id, n.tag, n.attrs, n.pos, n.chars),
el AS (SELECT * FROM cl UNION ALL SELECT lo.page_id, lo.tag, lo.attrs, lo.pre, lo.post, coalesce(lv.chars, lo.total) - lo.c0 FROM lo LEFT JOIN lv ON lv.page_id = lo.page_id AND lv.pos = lo.post)"""


def _inside(outer: str, e: str = "e") -> str:
    return f"EXISTS (SELECT 1 FROM ({outer}) o WHERE o.page_id = {e}.page_id AND o.pre < {e}.pre AND {e}.post <= o.post)"


_AROUND = f"SELECT * FROM el WHERE tag IN ({', '.join(f"'{t}'" for t in P.AROUND)})"
_ARTICLE = "SELECT page_id, m.pre AS pre, m.post AS post FROM (SELECT page_id, min({'k': list_position(['article', 'main'], tag), 'pre': pre, 'post': post}) AS m FROM el WHERE tag IN ('article', 'main') GROUP BY page_id)"


def _texts(e: str) -> str:
    return f"SELECT e.page_id, e.tag, e.pre, e.post, string_agg(r.text, ' ' ORDER BY r.pos) AS text FROM ({e}) e JOIN r ON r.page_id = e.page_id AND r.text <> '' AND e.pre <= r.pos AND r.pos < e.post GROUP BY ALL"


def _in_article(where: str) -> str:
    return f"SELECT * FROM el e WHERE {where} AND {_inside(_ARTICLE)} AND NOT {_inside(_AROUND)}"


def _good(x: str) -> str:
    return f"regexp_matches({x}, '祭|フェア|大会') AND NOT regexp_matches({x}, '募集|中止')"


query("EXT-16-elements", f"WITH {_tree('pages')} SELECT page_id, tag, pre, post, chars FROM el")(lambda v: P.parsed(v.pages).select("page_id", F.inline_outer("els")).filter("pre is not null").drop("attrs", "from"))
query("EXT-02-container", f"WITH {_tree('pages')}, t AS ({_texts(_in_article("tag IN ('p', 'li', 'dd', 'td', 'h2', 'h3') AND chars <= 251"))}) SELECT page_id, line_no, text AS line FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pre) AS INT) AS line_no FROM t WHERE length(text) <= 250) WHERE line_no <= 140")(
    lambda v: P.container_lines(v.pages)
)
query(
    "EXT-03-ranked",
    f"""WITH {_tree('event_pages')}, t AS ({_texts(_in_article("tag IN ('h1', 'h2', 'h3', 'h4') AND chars <= 401"))}), b AS (SELECT page_id, min({{'k': list_position(['h1', 'h2', 'h3', 'h4'], tag), 'pre': pre, 'text': text}}).text AS own FROM t WHERE {_good('text')} GROUP BY page_id),
o AS (SELECT page_id, regexp_replace({clean('listed')}, '^(?:(?:EVENT|NEWS|お知らせ|新着情報) +)?(?:20[0-9]{{2}}[年./-][0-9]{{1,2}}[月./-][0-9]{{1,2}}日? *)?', '') AS other FROM pg) SELECT o.page_id, coalesce(own, CASE WHEN {_good('other')} THEN other END, '') AS headline FROM o LEFT JOIN b USING (page_id)""",
)(lambda v: P.headlines(v.event_pages, include="祭|フェア|大会", exclude="募集|中止"))
_HREF = "regexp_extract(e.attrs, 'href=\"([^\"]*)\"', 1)"
_LINK = "CASE WHEN h LIKE '/%' THEN concat(root, h) WHEN h LIKE 'http%' THEN CASE WHEN starts_with(h, concat(root, '/')) THEN h END ELSE concat(root, '/news/', h) END"
query(
    "EXT-16",
    f"""WITH {_tree('event_pages')}, c0 AS ({_texts("SELECT * FROM el WHERE tag IN ('li', 'article', 'tr', 'section', 'div') AND chars BETWEEN 25 AND 651")}),
c1 AS (SELECT *, list_distinct(regexp_extract_all(text, 'Customer#[0-9]{{9}}')) AS names FROM c0 WHERE length(text) BETWEEN 25 AND 650 AND len(regexp_extract_all(text, '{P.DATE}')) = 2),
c2 AS (SELECT *, substring(text, instr(text, names[1]) + length(names[1])) AS rest FROM c1 WHERE len(names) = 1 AND names[1] IN (SELECT c_name FROM customer)),
c3 AS (SELECT *, regexp_extract(rest, '^ *({P.DATE}) *({P.DATE}) *(.{{4,140}})', ['a', 'b', 't']) AS m FROM c2),
c4 AS (SELECT page_id, pre, post, text, names[1] AS road_name, trim(regexp_replace(m.t, '^[ ・]+', '')) AS title, {day_sql('m.a')} AS start_date, {day_sql('m.b')} AS end_date FROM c3),
c5 AS (SELECT * FROM c4 WHERE title <> '' AND end_date >= start_date AND end_date >= DATE '{ERA_AS_OF}' AND date_diff('day', start_date, end_date) <= 366),
a0 AS (SELECT e.page_id, e.pre, e.post, regexp_replace({_HREF}, '#.*$', '') AS h, regexp_extract(pg.url, '^https://[^/]+') AS root FROM el e JOIN pg USING (page_id) WHERE tag = 'a' AND {_HREF} <> ''),
a1 AS (SELECT page_id, pre, post, {_LINK} AS link FROM a0), a2 AS (SELECT a1.*, t.text FROM a1 LEFT JOIN ({_texts("SELECT *, 'a' AS tag FROM a1")}) t USING (page_id, pre, post) WHERE contains(link, '/event/')),
l AS (SELECT c.page_id, c.pre, min({{'at': a.pre, 'link': a.link, 'text': a.text}}) AS l FROM c5 c JOIN a2 a ON a.page_id = c.page_id AND c.pre < a.pre AND a.pre < c.post GROUP BY ALL),
f AS (SELECT c.road_name, start_date, end_date, coalesce(l.link, concat(pg.url, '?dc=', start_date)) AS url, length(text) AS size, c.page_id, c.pre, CASE WHEN length(l.text) BETWEEN 6 AND 100 AND NOT regexp_matches(l.text, '{P.DATE}') AND NOT regexp_matches(l.text, '戻る|詳細を見る|もっと見る') THEN l.text ELSE trim(left(title, 110)) END AS title FROM c5 c LEFT JOIN l USING (page_id, pre) JOIN pg USING (page_id))
SELECT road_name, start_date, end_date, url, min({{'s': size, 'p': page_id, 'pre': pre, 't': title}}).t AS title FROM f GROUP BY ALL""",
)(lambda v: P.event_cards(v.event_pages, v.stations, as_of=ERA_AS_OF))
query("EXT-17", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.。]')) AS s FROM documents) WHERE instr(s, ' of ') > 0 AND instr(s, ' the ') > instr(s, ' of ') AND len(regexp_extract_all(s, ' (is|are) ')) = 1 GROUP BY doc_id")(lambda v: X.ordered_sentences(v.documents, " of ", " the ", " (is|are) "))
query(
    "EXT-18-modes",
    f"WITH {_M}, t AS (SELECT *, lead(day) OVER {_W} AS d1, lead(is_venue, 2) OVER {_W} AS v2 FROM m) SELECT 'triple' AS adapter, article_id, line_text AS title, d1 AS day FROM t WHERE article_id % 3 = 0 AND is_heading AND d1 IS NOT NULL AND v2 UNION ALL SELECT 'agreed', article_id, min(CASE WHEN is_heading THEN line_text END), min(day) FROM m WHERE article_id % 3 = 1 GROUP BY article_id HAVING count(DISTINCT CASE WHEN is_heading THEN line_text END) = 1 AND count(DISTINCT day) = 1 AND count(DISTINCT CASE WHEN is_venue THEN line_text END) = 1 UNION ALL SELECT 'context', article_id, title, day FROM (SELECT article_id, day, lag(line_text) OVER {_W} AS title, max(is_venue) OVER (PARTITION BY article_id ORDER BY line_no, line_text ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS has_venue FROM m) WHERE article_id % 3 = 2 AND day IS NOT NULL AND title IS NOT NULL AND has_venue",
)(lambda v: X.by_adapter(v.article_lines, [("triple", "triple", "article_id % 3 = 0"), ("agreed", "agreed", "article_id % 3 = 1"), ("context", "context", "article_id % 3 = 2")]))
_EVENT, _LABEL = "祭", "^(?:開催日時|期間)"
#: How the 15 sources of the fixture write their events.
RULES = [
    R.Rule(0, "labelled", "^【", "T-?D-?V", _LABEL, need_venue=True),
    R.Rule(1, "monthly", _EVENT, "TD", "^[0-9]+月", offsite="市役所|別会場", scope="^[^D]{0,8}", year="heading"),
    R.Rule(2, "named programs", "【Brand#[1-3]", "B|T.?D", title_part="【([^】]+)】"),
    R.Rule(3, "by publication", "^【", "T[^T]{0,2}D", year="published", max_span=90),
    R.Rule(4, "dated titles", "^【.*20[0-9]{2}年", "B", title_part="】(.*?) ?20[0-9]{2}年"),
    R.Rule(5, "triples", "^【", "TDV", _LABEL, need_venue=True),
    R.Rule(6, "notice blocks", "^【", "T[^T]{0,2}D[^T]{0,17}V", "^[0-9]+月", year="heading", need_venue=True),
    R.Rule(7, "context", "^[^会開]", "[T-]D[^D]{0,8}V", _LABEL, need_venue=True),
    R.Rule(8, "by publication, long", "^【", "T[^T]{0,2}D", year="published", max_span=120, title_part="】(.*)"),
    R.Rule(9, "titles with venue", "^【.*20[0-9]{2}年", "B[^B]{0,3}V", title_part="【([^】]+)】", need_venue=True),
    R.Rule(10, "labelled, on site", "^【", "T-?D", _LABEL, offsite="別会場", scope="^[^TD]{0,4}"),
    R.Rule(11, "monthly, named", "Brand#[24]", "T-?D", "^[0-9]+月", year="heading", title_part="(Brand#[0-9]+)"),
    R.Rule(12, "labelled, last", _EVENT, "D[^D]{0,6}$|T-?D", _LABEL),
    R.Rule(13, "venue first", "^【", "V[^V]{0,3}TD", year="published", need_venue=True),
    R.Rule(14, "short titles", "^【", "B", title_part="【(.{3})", blocked="STEEL|中止"),
]
#: The four kinds of records that must agree with what is known of them.
RECORDS = [
    R.Record(0, "detail", "【Brand#", venue="会場 ?: ?道の駅", date_label="開催日時"),
    R.Record(10, "vendor", "祭", start="【Brand#3", stop="【", venue="道の駅 Supplier", offsite="別会場", date_label="開催日時", max_span=30),
    R.Record(5, "checkpoint", "祭", needs="道の駅 LARGE", venue="道の駅", date_label="日時", max_span=120),
    R.Record(3, "document section", "PROMO", start="PROMO", stop="会場", venue="祭", date_label="祭", year="published"),
]
_NAMED = [(0, "1-URGENT O", "道の駅", "開催"), (0, "1-URGENT F", "道の駅", "開催"), (1, "2-HIGH O", "道の駅", "開催"), (1, "2-HIGH F", "道の駅", "開催"), (2, "5-LOW F", "道の駅", "開催"), (2, "5-LOW O", "道の駅で", "開催")]


def _values(rows: list[tuple], names: str) -> str:
    text = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join(f"({', '.join(map(text, r))})" for r in rows)}) v({names})"


def _rows(rules) -> str:
    from dataclasses import astuple, fields

    return _values([astuple(r) for r in rules], ", ".join(f'"{f.name}"' for f in fields(rules[0])))


_SPAN = "date_diff('day', p.start_date, p.end_date)"
_ROWS_SQL = f"""WITH rl AS (SELECT * FROM {_rows(RULES)}), j AS MATERIALIZED (SELECT l.*, row_number() OVER () AS event_id, {folded('l.text')} AS t, rl.* EXCLUDE (adapter) FROM adapter_lines l JOIN rl ON l.adapter = rl.adapter),
g AS (SELECT article_id, min({{'n': line_no, 'd': TRY_CAST(concat(regexp_extract(t, '{R.PROGRAM}', 1), '-', lpad(regexp_extract(t, '{R.PROGRAM}', 2), 2, '0'), '-01') AS DATE)}}).d AS ground FROM j WHERE regexp_matches(t, '{R.PROGRAM}') GROUP BY article_id),
src AS (SELECT event_id, t AS text, CASE WHEN year = 'published' THEN published WHEN year = 'heading' THEN ground END AS published FROM j LEFT JOIN g USING (article_id) WHERE regexp_matches(t, date)),
p AS ({{period}}), k AS (SELECT j.*, CASE WHEN {_SPAN} <= max_span THEN p.start_date END AS sd, CASE WHEN {_SPAN} <= max_span THEN p.end_date END AS ed FROM j LEFT JOIN p USING (event_id)),
c AS (SELECT *, CASE WHEN regexp_matches(t, offsite) THEN 'X' WHEN ti AND sd IS NOT NULL THEN 'B' WHEN sd IS NOT NULL THEN 'D' WHEN regexp_matches(t, venue) THEN 'V' WHEN ti THEN 'T' ELSE '-' END AS sign FROM (SELECT *, regexp_matches(t, title) AND NOT regexp_matches(t, blocked) AS ti FROM k)),
a AS (SELECT adapter, article_id, core, scope, title_part, venue, need_venue, list({{{{'t': t, 'sign': sign, 'sd': sd, 'ed': ed}}}} ORDER BY line_no, t) AS x, string_agg(sign, '' ORDER BY line_no, t) AS s FROM c GROUP BY ALL),
q AS (SELECT *, string_split(regexp_replace(s, core, concat(chr(1), '\\0', chr(1)), 'g'), chr(1)) AS parts FROM a),
m AS (SELECT *, length(array_to_string(parts[1:i - 1], '')) AS k0, length(parts[i]) AS n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM q) WHERE i % 2 = 0),
y AS (SELECT *, list_filter(x[k0 + 1:k0 + n], lambda e: e.sign IN ('T', 'B'))[1] AS et, list_filter(x[k0 + 1:k0 + n], lambda e: e.sign IN ('D', 'B'))[1] AS de, list_filter(x[k0 + 1:k0 + n], lambda e: e.sign = 'V')[1] AS ev, substring(s, k0 + n + 1) AS rest FROM m)
SELECT DISTINCT adapter, article_id, trim(translate(regexp_extract(et.t, title_part, 1), '『』「」', '')) AS title, trim(regexp_replace(ev.t, venue, '')) AS venue, de.sd AS start_date, de.ed AS end_date FROM y WHERE et IS NOT NULL AND de IS NOT NULL AND NOT contains(regexp_extract(rest, scope), 'X') AND (NOT need_venue OR ev IS NOT NULL)""".replace("{{", "{").replace("}}", "}").replace("{period}", period_sql("src", D.Options(max_span=366)))
query("EXT-18", _ROWS_SQL)(lambda v: R.row_events(v.adapter_lines, R.rules_table(v.spark, RULES)))
query("EXT-09-monthly", f"SELECT * FROM ({_ROWS_SQL}) WHERE adapter IN (1, 11)")(lambda v: R.row_events(v.adapter_lines, R.rules_table(v.spark, [r for r in RULES if r.adapter in (1, 11)])))
query("EXT-12-named", f"SELECT * FROM ({_ROWS_SQL}) WHERE adapter = 2")(lambda v: R.row_events(v.adapter_lines, R.rules_table(v.spark, [r for r in RULES if r.adapter == 2])))
query(
    "EXT-17-events",
    f"""WITH s0 AS (SELECT doc_id, name, venue, verb, published, trim(unnest(string_split_regex({folded('text')}, '[。!?]'))) AS s FROM announcements a JOIN {_values(_NAMED, 'adapter, name, venue, verb')} ON a.adapter = v.adapter),
s1 AS MATERIALIZED (SELECT row_number() OVER () AS event_id, * REPLACE (replace(s, concat(year(published), '年', month(published), '月', day(published), '日'), ' ') AS s) FROM s0 WHERE length(s) <= 230 AND contains(s, name) AND contains(s, venue) AND contains(s, verb)),
s2 AS (SELECT *, list_zip(regexp_extract_all(s, '{D.TOKEN}', 3), regexp_extract_all(s, '{D.TOKEN}', 5)).list_filter(lambda x: x[1] <> '') AS d FROM s1), s3 AS (SELECT * FROM s2 WHERE len(d) = 1 AND d[1][2] <> '' AND instr(s, concat(d[1][1], '月')) > 0 AND instr(s, venue) > instr(s, concat(d[1][1], '月'))),
src AS (SELECT event_id, s AS text, published FROM s3), p AS ({period_sql("src")}) SELECT DISTINCT doc_id, name AS title, venue, start_date, end_date FROM s3 JOIN p USING (event_id) WHERE start_date IS NOT NULL""",
)(lambda v: R.sentence_events(v.announcements, v.spark.createDataFrame(_NAMED, "adapter int, name string, venue string, verb string")))
query(
    "EXT-13",
    f"""WITH rc AS (SELECT * FROM {_rows(RECORDS)}), b AS (SELECT l.adapter, l.article_id, min(l.published) AS published, bool_or(contains({folded('l.text')}, rc.title)) AS named, string_agg({folded('l.text')}, ' ' ORDER BY line_no, {folded('l.text')}) AS body FROM adapter_lines l JOIN rc ON l.adapter = rc.adapter GROUP BY l.adapter, l.article_id),
s AS (SELECT b.*, rc.* EXCLUDE (adapter), regexp_extract(body, concat('((?:', start, ').*)$'), 1) AS begun FROM b JOIN rc ON b.adapter = rc.adapter),
s1 AS (SELECT *, CASE WHEN begun = '' THEN '' ELSE concat(left(begun, 1), CASE WHEN stop = '' THEN substring(begun, 2) ELSE string_split_regex(substring(begun, 2), stop)[1] END) END AS section FROM s),
s2 AS (SELECT *, regexp_extract(section, concat('(?:', date_label, ') ?:? ?(.*)$'), 1) AS dated FROM s1), s3 AS (SELECT *, CASE WHEN regexp_matches(dated, '^(?:令和|R)? ?[0-9元]') THEN left(dated, 60) END AS near FROM s2),
src AS (SELECT article_id AS event_id, near AS text, CASE WHEN year = 'published' THEN published END AS published FROM s3), p AS ({period_sql("src", D.Options(max_span=366))}),
r AS (SELECT *, CASE WHEN NOT named THEN 'title_missing' WHEN len(list_filter(string_split(needs, ' '), lambda w: NOT contains(body, w))) > 0 THEN 'activity_missing' WHEN section = '' THEN 'section_missing' WHEN regexp_matches(section, cancelled) THEN 'cancelled' WHEN NOT regexp_matches(section, venue) THEN 'venue_missing' WHEN regexp_matches(section, offsite) THEN 'offsite' WHEN near IS NULL THEN 'date_missing'
  WHEN start_date IS NULL OR date_diff('day', start_date, end_date) > max_span THEN 'invalid_date' WHEN end_date < DATE '{ERA_AS_OF}' THEN 'past' ELSE 'accepted' END AS reason FROM s3 JOIN p ON s3.article_id = p.event_id)
SELECT adapter, article_id, kind, reason, CASE WHEN reason = 'accepted' THEN title END AS title, CASE WHEN reason = 'accepted' THEN start_date END AS start_date, CASE WHEN reason = 'accepted' THEN end_date END AS end_date FROM r""",
)(lambda v: R.verified_records(v.adapter_lines, R.records_table(v.spark, RECORDS), as_of=ERA_AS_OF))
query("EXT-19", f"WITH {_M}, a AS (SELECT article_id, count(*) FILTER (is_heading) AS h, count(*) FILTER (is_date) AS d, bool_or(is_venue AND line_text = concat('会場：', st)) AS v, min(day) AS day FROM (SELECT m.*, CASE WHEN s.article_id % 2 = 0 THEN station ELSE '道の駅 Supplier#000000001' END AS st FROM m LEFT JOIN ({_STATION}) s ON m.article_id = s.article_id) GROUP BY article_id) SELECT article_id, CASE WHEN h <> 1 THEN 'headline_count' WHEN d <> 1 THEN 'date_count' WHEN day IS NULL THEN 'no_year' WHEN NOT coalesce(v, FALSE) THEN 'no_venue' WHEN NOT date_diff('day', DATE '{ERA_AS_OF}', day) BETWEEN 0 AND 366 THEN 'out_of_range' ELSE 'accepted' END AS reason FROM a")(
    lambda v: X.strict_probe(v.article_lines, v.article_lines.filter("line_text like '会場%'").groupBy("article_id").agg(F.when(F.col("article_id") % 2 == 0, F.concat(F.lit("道の駅 "), F.min(F.substring("line_text", 8, 100)))).otherwise("道の駅 Supplier#000000001").alias("station")), ERA_AS_OF)
)
query("EXT-20", f"SELECT page_id, contains(html, regexp_extract(url, '^https?://([^./]+)', 1)) AS mentions, array_to_string(list_sort(list_distinct(list_filter(list_zip(regexp_extract_all(html, '{_A}', 1), regexp_extract_all(html, '{_A}', 2)), lambda x: regexp_matches(x[2], 'e')).list_transform(lambda x: x[1])))[1:8], ' ') AS hints FROM pages")(
    lambda v: X.site_review(v.pages, F.regexp_extract("url", "^https?://([^./]+)", 1), "e")
)
query("EXT-21", "SELECT l.s_suppkey AS listing_id, s.id FROM supplier l JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT min(id) AS id, prefecture, id % 40 AS k FROM stations GROUP BY prefecture, id % 40 HAVING count(*) = 1) s ON s.prefecture = n_name AND s.k = l.s_suppkey % 40")(
    lambda v: X.directory_matches(
        v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("listing_id"), F.col("n_name").alias("prefecture"), F.concat(F.lit("道の駅 "), (F.col("s_suppkey") % 40).cast("string")).alias("label")), v.stations.select("id", "prefecture", (F.col("id") % 40).cast("string").alias("name"))
    )
)
query("JN-17", f"WITH {_M}, e AS (SELECT l_orderkey AS article_id, p_brand AS subject, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 2), e1 AS (SELECT article_id, min(subject) AS subject, min(make_date(CAST(year(d) + 30 AS BIGINT), month(d), least(day(d), 28))) AS event_day FROM e GROUP BY article_id) SELECT e1.article_id, bool_or(contains(line_text, subject)) AND bool_or(coalesce(day = event_day, FALSE)) AS confirmed FROM e1 JOIN m ON e1.article_id = m.article_id GROUP BY e1.article_id")(
    lambda v: _evidence(v)
)


def _evidence(v):
    d = F.col("l_shipdate").cast("date")
    e = v.lineitem.filter("l_linenumber = 2").join(v.part, F.col("l_partkey") == F.col("p_partkey"))
    e = e.groupBy(F.col("l_orderkey").alias("article_id")).agg(F.min("p_brand").alias("subject"), F.min(F.make_date(F.year(d) + 30, F.month(d), F.least(F.dayofmonth(d), F.lit(28)))).alias("event_day"))
    return X.confirmed(e, v.article_lines)


query("FLT-11", f"SELECT page_id, {part('url', 2)} AS host, CASE WHEN length({part('url', 2)}) % 3 = 0 THEN 'disallowed' WHEN length({part('url', 2)}) % 3 = 1 THEN 'unknown' ELSE 'allowed' END AS robots FROM pages")(lambda v: _robots(v))


def _robots(v):
    pages = v.pages.select("page_id", X.U.part(F.col("url"), 2).alias("host"))
    hosts = pages.select("host").distinct().filter(F.length("host") % 3 != 1).select("host", (F.length("host") % 3 == 0).alias("disallowed"))
    return X.with_robots(pages, hosts)


# Files --------------------------------------------------------------------------------------------------------------
#: Rows of a file in the fixtures.
_FILE_ROWS = 1000


def _feed(v):
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    e = F.struct(F.col("road_name").alias("roadName"), "prefecture", "title", s("start_date").alias("startDate"), s("end_date").alias("endDate"), F.when(F.col("event_id") % 5 == 0, "").otherwise(s("published_at")).alias("publishedAt"), "url", "status")
    path = files.scratch(v.spark)
    v.events_pub.groupBy(F.floor(F.col("event_id") / _FILE_ROWS).alias("part")).agg(F.lit(1).alias("schemaVersion"), F.collect_list(e).alias("events")).write.partitionBy("part").json(path)
    return files.read_feed(v.spark, path)


query("SRC-01", "SELECT road_name AS roadName, prefecture, title, start_date AS startDate, end_date AS endDate, CASE WHEN event_id % 5 > 0 THEN published_at END AS publishedAt, url, status FROM events_pub")(_feed)


def _master(v):
    path = files.scratch(v.spark)
    rows = v.stations.groupBy(F.floor(F.col("id") / _FILE_ROWS).alias("part")).agg(F.collect_list(F.struct("id", "name", "prefecture", "lat", "lng")).alias("stations"))
    rows.select("part", F.concat(F.lit("window.APP_DATA="), F.to_json(F.struct("stations")), F.lit(";")).alias("value")).write.partitionBy("part").text(path)
    return files.read_prefixed(v.spark, path, "window\\.APP_DATA=", "stations array<struct<id:bigint,name:string,prefecture:string,lat:double,lng:double>>", "stations")


query("SRC-02-checks", "SELECT count(*) = (SELECT count(*) FROM customer) AS count_ok, count(id) = count(DISTINCT id) AS unique_ok, TRUE AS identity_ok FROM stations")(lambda v: files.master_problems(_master(v), v.customer.count()))
query("SRC-02", "SELECT id, name, prefecture, lat, lng FROM stations")(_master)


def _relaxed(v):
    path = files.scratch(v.spark)
    item = F.format_string("/* place */ {id: %d, name: '%s', level: \"%s\"}", "id", "name", "level")
    local = v.landmarks.filter("id % 2 = 0").groupBy(F.floor(F.col("id") / _FILE_ROWS).alias("part"))
    local.agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return files.with_precedence(files.read_relaxed(v.spark, path, "id:bigint,name:string,level:string"), v.landmarks.filter("id % 3 = 0").select("id", F.upper("name").alias("name"), "level"))


query("SRC-03", "SELECT id, name, level FROM landmarks WHERE id % 2 = 0 UNION ALL SELECT id, upper(name), level FROM landmarks WHERE id % 3 = 0 AND id % 2 > 0")(_relaxed)
query("SRC-04", "SELECT page_id, length(html) AS size FROM pages WHERE length(html) <= 4000")(lambda v: files.read_pages(v.spark, f"{v.sf_dir}/pages.parquet", 4000).select("page_id", F.length("html").cast("bigint").alias("size")))
query("SRC-05", f"SELECT page, id, CAST(round(y / 6) AS INT) AS band FROM ({_POS}) ORDER BY page, band")(lambda v: files.positioned(_positions(v).withColumn("x", F.col("id"))).select("page", "id", "band"))
query("SRC-06", "WITH r AS (SELECT CASE WHEN id % 50 = 1 THEN id - 1 ELSE id END AS id, id AS o FROM stations), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r) SELECT id, 'missing_name' AS problem FROM n WHERE o % 31 = 0 UNION ALL SELECT id, 'duplicate_id' FROM n WHERE n > 1 UNION ALL SELECT id, 'unsafe_listing' FROM n WHERE o % 37 = 0 UNION ALL SELECT id, 'budget_out_of_range' FROM n WHERE o % 25 NOT BETWEEN 1 AND 20 UNION ALL SELECT id, 'listing_without_hosts' FROM n WHERE o % 2 = 0 AND o % 11 = 0")(
    lambda v: files.rule_problems(
        v.stations.select(
            F.when(F.col("id") % 50 == 1, F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 31 > 0, F.col("name")).alias("road_name"), F.when(F.col("id") % 37 == 0, "http://x").otherwise("https://x").alias("listing_url"), (F.col("id") % 25).alias("budget"), F.when(F.col("id") % 2 == 0, "listing").otherwise("fixed").alias("mode"), F.when(F.col("id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("hosts")
        )
    )
)


def _snapshot(v):
    path = files.scratch(v.spark)
    none = files.read_snapshot(v.spark, path, "source_id bigint, n bigint")
    none.unionByName(v.source_audit.groupBy("source_id").agg(F.count("*").alias("n"))).write.parquet(path)
    return files.read_snapshot(v.spark, path, "source_id bigint, n bigint")


query("SRC-07", "SELECT source_id, count(*) AS n FROM source_audit GROUP BY source_id")(_snapshot)
query("SRC-08", "SELECT event_id, 'decision' AS problem FROM events_pub WHERE event_id % 23 = 0 AND status <> 'cancelled' UNION ALL SELECT event_id, 'link' FROM events_pub WHERE event_id % 29 = 0 UNION ALL SELECT event_id, 'evidence' FROM events_pub WHERE event_id % 19 = 0")(
    lambda v: files.ledger_problems(
        v.events_pub.select(
            "event_id", F.when((F.col("event_id") % 23 == 0) & (F.col("status") != "cancelled"), "maybe").otherwise(F.col("status")).alias("decision"), F.when(F.col("event_id") % 29 == 0, F.replace("url", F.lit("https"), F.lit("http"))).otherwise(F.col("url")).alias("url"), "title", "start_date", "end_date", F.when(F.col("event_id") % 19 > 0, "seen").alias("evidence")
        )
    )
)
query("SRC-09", "SELECT n_name AS name, concat('About ', n_name) AS summary FROM nation")(lambda v: v.nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.concat(F.lit("About "), "n_name")))).alias("m")).select(files.overlay(F.col("m"))))
query("SNK-02", "SELECT prefecture, count(*) AS n, string_agg(concat(id, ':', name), ',' ORDER BY id) AS stations FROM stations GROUP BY prefecture")(lambda v: _report(v))


def _report(v):
    path = files.scratch(v.spark)
    files.nested_report(v.stations, ["prefecture"], ["id", "name"]).write.json(path)
    back = v.spark.read.schema("prefecture string, n bigint, rows array<struct<id:bigint,name:string>>").json(path)
    return back.select("prefecture", "n", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["id"].cast("string"), r["name"])), ",").alias("stations"))


# Functions in Python --------------------------------------------------------------------------------------------------
query("U-01")(lambda v: udfs.nfkc(v.notices.select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("①ｶﾞ"), "title")).otherwise(F.col("title")).alias("title")), "title"))
query("U-02")(lambda v: udfs.html_tokens(v.pages))
query("U-03")(lambda v: v.new_feed.alias("x").join(v.old_feed.alias("y"), (F.col("x.road_name") == F.col("y.road_name")) & (F.col("x.start_date") == F.col("y.start_date"))).select(F.col("x.event_id").alias("a_id"), F.col("y.event_id").alias("b_id"), F.round(udfs.ratcliff(F.col("x.title"), F.col("y.title")), 6).alias("score")))
query("U-04", "SELECT id FROM stations WHERE 12742.0 * atan2(sqrt(power(sin(radians(lat - 35) / 2), 2) + cos(radians(35)) * cos(radians(lat)) * power(sin(radians(lng - 135) / 2), 2)), sqrt(1 - (power(sin(radians(lat - 35) / 2), 2) + cos(radians(35)) * cos(radians(lat)) * power(sin(radians(lng - 135) / 2), 2)))) BETWEEN 250 AND 350")(
    lambda v: S.annulus(v.spark.range(1).select(F.lit(35.0).alias("lat"), F.lit(135.0).alias("lng"), F.lit(300.0).alias("km"), F.lit(50.0).alias("tol")), v.stations).select("id")
)
