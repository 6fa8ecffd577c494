"""Extraction of dated, venue-proven events from pages and article lines (EXT, JN-13, JN-17, FLT-11).

Lines are rows (article_id, line_no, line_text); labels, headings and sections are window functions over them. All
windows are bounded by an article; ties in line_no are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.functions import dates as D
from waystone.functions import text as T
from waystone.functions import urls as U

HEADING = "^【"
DATE_LABEL = "^(?:開催日時|期間|日時)[：:]"
VENUE_LABEL = "^(?:会場|場所)[：:]"
#: Elements that are no article text.
SKIPPED = ("script", "style", "nav", "aside", "footer", "head")
_ORDER = ("line_no", "line_text")
#: Lines that a task sorts, about: its memory must not grow with the table.
TASK_LINES = 500_000


def article() -> Window:
    return Window.partitionBy("article_id").orderBy(*_ORDER)


def rlike(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def marked(lines: DataFrame) -> DataFrame:
    """Lines with their kinds: is_heading, is_date, is_venue, and the date in an era or plain form."""
    t = F.col("line_text")
    got = lines.withColumns({"is_heading": rlike(t, HEADING), "is_date": rlike(t, DATE_LABEL), "is_venue": rlike(t, VENUE_LABEL)})
    return got.withColumn("day", F.when(F.col("is_date"), D.full_date(t)))


def by_article(lines: DataFrame, total: int | None = None) -> DataFrame:
    """Lines in whole articles, sorted, about `TASK_LINES` to a task. `total`: their number, about; counted if it is not given.

    Adaptive execution merges partitions up to a size, but not a named number of them. Columns added later are not held by the sort.
    """
    n = lines.count() if total is None else total
    n = max(lines.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_LINES))
    return lines.repartition(n, "article_id").sortWithinPartitions("article_id", *_ORDER)


def sections(lines: DataFrame, total: int | None = None) -> DataFrame:
    """Lines with `section`: the number of headings so far; 0 before the first. `total` as in `by_article`."""
    heads = F.sum(F.col("is_heading").cast("int")).over(article().rowsBetween(Window.unboundedPreceding, 0))
    return marked(by_article(lines, total)).withColumns({"section": heads.cast("int"), "rn": F.row_number().over(article())})


def links(pages: DataFrame, most: int, cap: int) -> DataFrame:
    """EXT-01: links of each page: raw and resolved address and text of at most `most` characters; the first text of each
    address, at most `cap` addresses."""
    pattern = F.lit('<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("text"))
    rows = pages.select("page_id", "url", F.posexplode(both).alias("pos", "l")).select("page_id", "url", "pos", F.col("l.href").alias("href"), T.clean(F.col("l.text")).alias("text"))
    rows = rows.filter((F.length("text") > 0) & (F.length("text") <= most))
    first = rows.groupBy("page_id", "url", "href").agg(F.min(F.struct("pos", "text")).alias("f"))
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("f.pos")))
    return ranked.filter(F.col("rn") <= cap).select("page_id", "href", "f.text", U.resolve(F.col("href"), F.regexp_replace("url", "^http:", "https:")).alias("resolved"))


def page_lines(pages: DataFrame, least: int = 1, most: int = 5000) -> DataFrame:
    """EXT-02: text lines of each page without scripts, navigation and footers, of `least` to `most` characters."""
    body = F.col("html")
    for tag in SKIPPED:
        body = F.regexp_replace(body, f"(?s)<{tag}[ >].*?</{tag}>", "\n")
    body = F.regexp_replace(body, "(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, "</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|table|article|section|body|html)(?:[ /][^>]*)?>", "\n")
    body = F.regexp_replace(body, "<[^>]*>", "")
    rows = pages.select("page_id", F.posexplode(F.split(body, "\n")).alias("pos", "raw")).withColumn("line", T.clean(F.col("raw")))
    return rows.filter(F.length("line").between(least, most)).select("page_id", "pos", "line")


def headline(html: Column) -> Column:
    """EXT-03: the first filled heading by rank: h1, h2, then the title."""
    found = [F.nullif(T.clean(F.regexp_replace(F.regexp_extract(html, f"(?s)<{t}[^>]*>(.*?)</{t}>", 1), "<[^>]*>", "")), F.lit("")) for t in ("h1", "h2", "title")]
    return F.coalesce(*found)


def labelled(lines: DataFrame, label: str) -> DataFrame:
    """EXT-04: the value after a label, or the next line where the label stands alone."""
    own = F.regexp_extract("line_text", label + "(.*)$", 1)
    got = lines.withColumn("_next", F.lead("line_text").over(article()))
    return got.filter(rlike(F.col("line_text"), label)).select("article_id", "line_no", F.coalesce(F.nullif(F.trim(own), F.lit("")), F.col("_next")).alias("value"))


def on_site(value: Column, station: Column, suffix: str = "") -> Column:
    """Whether a venue text names the station: equal keys, or the station's key followed by an allowed `suffix`."""
    v, s = T.station_key(value), T.station_key(station)
    rest = F.call_function("substring", v, F.length(s) + 1)
    return (v == s) | (F.lit(suffix != "") & (s != "") & F.startswith(v, s) & F.rlike(rest, F.lit(f"^(?:{suffix})$")))


def venue_proof(lines: DataFrame, stations: DataFrame, suffix: str = "", elsewhere: str = "") -> DataFrame:
    """EXT-05: of each article with venue labels: whether any, and whether all, name its station. `suffix`: what may follow
    the station, such as its square; `elsewhere`: a pattern of labels that tell of another place and count against it."""
    v = labelled(lines, VENUE_LABEL).join(stations, "article_id").withColumn("same", on_site(F.col("value"), F.col("station"), suffix))
    if elsewhere:
        v = v.withColumn("same", F.col("same") & ~rlike(F.col("value"), elsewhere))
        off = lines.filter(rlike(F.col("line_text"), elsewhere) & ~rlike(F.col("line_text"), VENUE_LABEL)).select("article_id").distinct()
        v = v.unionByName(off.join(stations, "article_id").withColumn("same", F.lit(False)), allowMissingColumns=True)
    return v.groupBy("article_id").agg(F.bool_or("same").alias("any_on_site"), F.bool_and("same").alias("on_site"))


def with_reasons(lines: DataFrame, as_of: str, stations: DataFrame, suffix: str = "") -> DataFrame:
    """EXT-06: one row for each article: the first reason that rejects it, or accepted, with its title and day.

    `stations` has the station of each article; a venue that is not on its site is `offsite`.
    """
    m = marked(lines)
    a = m.groupBy("article_id").agg(
        F.count_if("is_heading").alias("headings"),
        F.count_if("is_venue").alias("venues"),
        F.min("day").alias("day"),
        F.max("day").alias("last_day"),
        F.min(F.when(F.col("is_heading"), F.struct(*_ORDER)))["line_text"].alias("title"),
        F.bool_or(rlike(F.col("line_text"), "中止|延期")).alias("cancelled"),
    )
    a = a.join(venue_proof(lines, stations, suffix).select("article_id", "on_site"), "article_id", "left")
    reason = (
        F.when(F.col("cancelled"), "cancelled")
        .when(F.col("headings") == 0, "not_event")
        .when(F.col("headings") > 1, "multi_event_overview")
        .when(F.col("venues") == 0, "venue_missing")
        .when(~F.coalesce("on_site", F.lit(False)), "offsite")
        .when(F.col("day").isNull(), "undated")
        .when(F.col("day") != F.col("last_day"), "date_conflict")
        .when(F.col("day") < F.lit(as_of).cast("date"), "past")
        .otherwise("accepted")
    )
    return a.select("article_id", reason.alias("reason"), F.when(reason == "accepted", F.col("title")).alias("title"), F.when(reason == "accepted", F.col("day")).alias("day"))


def listing_conflicts(lines: DataFrame, listing: DataFrame) -> DataFrame:
    """EXT-07: a listing's date is evidence unless the article prints another month and day, or has a heading of another
    title. `listing` has article_id, listed and, if titles are to be compared, title."""
    m = marked(lines)
    days = m.filter("day is not null").groupBy("article_id").agg(F.collect_set("day").alias("days"))
    got = listing.join(days, "article_id", "left")
    bad = F.exists("days", lambda d: (F.month(d) != F.month("listed")) | (F.dayofmonth(d) != F.dayofmonth("listed")))
    state = F.when(bad, "listing_article_date_conflict").when(F.col("days").isNull(), "listing_only").otherwise("agrees")
    if "title" in listing.columns:
        head = T.title_key(F.regexp_replace("line_text", HEADING + "([^】]*)】", "$1"))
        heads = m.filter("is_heading").groupBy("article_id").agg(F.collect_set(head).alias("heads"))
        key = T.title_key(F.col("title"))
        other = ~F.exists("heads", lambda h: F.contains(h, key) | F.contains(key, h))
        return got.join(heads, "article_id", "left").select("article_id", F.when(other, "listing_article_title_conflict").otherwise(state).alias("state"))
    return got.select("article_id", state.alias("state"))


def section_events(lines: DataFrame, reach: int = 9, total: int | None = None) -> DataFrame:
    """EXT-08: events of sections that a heading opens: the first date and venue within the next `reach` lines of it."""
    ahead = article().rowsBetween(0, reach)
    # a heading is its section's first line; what follows the section comes after all of its own lines
    first = lambda c, x: F.first(F.when(c, F.struct("section", x)), ignorenulls=True).over(ahead)
    got = sections(lines, total).withColumns({"d": first(F.col("day").isNotNull(), "day"), "v": first(F.col("is_venue"), "line_text")})
    got = got.filter("is_heading and d.section = section and v.section = section")
    return got.select("article_id", "section", F.col("line_text").alias("title"), F.col("d.day").alias("day"), F.regexp_replace("v.line_text", VENUE_LABEL, "").alias("venue"))


def dated_with_context(lines: DataFrame, reach: int = 8) -> DataFrame:
    """EXT-09: date lines with the line before as title, and whether a venue follows within `reach` lines."""
    m = marked(lines)
    ahead = article().rowsBetween(1, reach)
    got = m.withColumns({"title": F.lag("line_text").over(article()), "has_venue": F.coalesce(F.max("is_venue").over(ahead), F.lit(False))})
    return got.filter("day is not null and title is not null").select("article_id", "line_no", "title", "day", "has_venue")


def triples(lines: DataFrame) -> DataFrame:
    """EXT-10: three lines in a row: heading, date, venue."""
    m = marked(lines)
    w = article()
    got = m.withColumns({"day1": F.lead("day").over(w), "v2": F.when(F.lead("is_venue", 2).over(w), F.lead("line_text", 2).over(w))})
    return got.filter("is_heading and day1 is not null and v2 is not null").select("article_id", "line_no", F.col("line_text").alias("title"), F.col("day1").alias("day"), F.regexp_replace("v2", VENUE_LABEL, "").alias("venue"))


def notice_blocks(lines: DataFrame, near: int = 3, far: int = 18, total: int | None = None) -> DataFrame:
    """EXT-11: heading blocks with a date within `near` lines and a venue within `far`, never from the next block."""
    s = sections(lines, total).filter("section > 0")
    w = Window.partitionBy("article_id", "section")
    s = s.withColumn("gap", F.col("rn") - F.min("rn").over(w))
    got = s.groupBy("article_id", "section").agg(F.min(F.when(F.col("gap") <= near, F.col("day"))).alias("day"), F.bool_or(F.col("is_venue") & (F.col("gap") <= far)).alias("venue"))
    return got.filter("day is not null and venue").select("article_id", "section", "day")


def named_programs(lines: DataFrame, names: DataFrame, reach: int = 2) -> DataFrame:
    """EXT-12: lines that contain a configured name and have a date on them or within `reach` lines."""
    m = marked(lines).withColumn("near", F.min("day").over(article().rowsBetween(0, reach)))
    m = m.filter("near is not null").withColumn("name", F.regexp_extract("line_text", "【([^】]+)】", 1))
    return m.join(names, "name").select("article_id", "line_no", "name", F.col("near").alias("day"))


def agreed(lines: DataFrame) -> DataFrame:
    """EXT-13: articles that name exactly one heading, one day and one venue: all their sections agree."""
    m = marked(lines)
    kinds = [F.collect_set(F.when(c, v)).alias(n) for n, c, v in (("h", F.col("is_heading"), F.col("line_text")), ("d", F.col("is_date"), F.col("day")), ("v", F.col("is_venue"), F.col("line_text")))]
    a = m.groupBy("article_id").agg(*kinds).filter((F.size("h") == 1) & (F.size("d") == 1) & (F.size("v") == 1))
    return a.select("article_id", F.col("h")[0].alias("title"), F.col("d")[0].alias("day"))


def heading_context(lines: DataFrame, most: int, total: int | None = None) -> DataFrame:
    """EXT-14: the text from a heading to the next one, cut to `most` characters."""
    s = sections(lines, total).filter("section > 0")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rn", "line_text"))), lambda x: x["line_text"])
    return s.groupBy("article_id", "section").agg(F.substring(F.array_join(rows, " "), 1, most).alias("context"))


def paired_rows(lines: DataFrame, reach: float) -> DataFrame:
    """EXT-15, JN-13: an event row takes the nearest station row before it on the page and side, within `reach`; else the
    nearest at all on that page and side."""
    w = Window.partitionBy("page", "side").orderBy("y", "id")
    station = F.when(F.col("is_station"), F.struct("y", "id"))
    got = lines.withColumn("s", F.last(station, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = got.withColumn("after", F.first(station, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("y") - F.col("s.y") <= reach, F.col("s.id"))
    closest = F.when(F.col("after").isNull() | (F.col("y") - F.col("s.y") <= F.col("after.y") - F.col("y")), F.col("s.id")).otherwise(F.col("after.id"))
    return got.filter("not is_station").select("page", "id", F.coalesce(near, closest).alias("station_id"))


def smallest_card(cards: DataFrame, key: str, text: str, exactly: dict[str, int] | None = None) -> DataFrame:
    """EXT-16: of nested containers of one key the shortest text. `exactly`: how often a card must show each pattern, such
    as one station and two dates; others are no cards."""
    for pattern, n in (exactly or {}).items():
        cards = cards.filter(F.regexp_count(text, F.lit(pattern)) == n)
    return cards.groupBy(key).agg(F.min(F.struct(F.length(text).alias("n"), F.col(text).alias("t")))["t"].alias(text))


def ordered_sentences(docs: DataFrame, first: str, then: str, dated: str | None = None) -> DataFrame:
    """EXT-17: sentences in which one word (a name) stands before another (a venue), with exactly one match of `dated`."""
    s = docs.select("doc_id", F.explode(F.split("text", "[.。]")).alias("s"))
    a, b = F.instr("s", first), F.instr("s", then)
    s = s.filter((a > 0) & (b > a))
    if dated:
        s = s.filter(F.regexp_count("s", F.lit(dated)) == 1)
    return s.groupBy("doc_id").agg(F.count("*").alias("n"))


def by_adapter(lines: DataFrame, adapters: list[tuple[str, str, str]]) -> DataFrame:
    """EXT-18: one rule-driven pass for all adapters: (name, mode, article filter). Modes are the extractions above."""
    modes = {"section": lambda x: section_events(x).select("article_id", "title", "day"), "triple": lambda x: triples(x).select("article_id", "title", "day"), "context": lambda x: dated_with_context(x).filter("has_venue").select("article_id", "title", "day"), "agreed": agreed}
    out = None
    for name, mode, where in adapters:
        rows = modes[mode](lines.filter(where)).withColumn("adapter", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def strict_probe(lines: DataFrame, stations: DataFrame, as_of: str, most_days: int = 366) -> DataFrame:
    """EXT-19: exactly one heading, one dated label line with a year, a venue label that names the article's station
    (article_id, station), and a start within `most_days`."""
    m = marked(lines)
    a = m.groupBy("article_id").agg(F.count_if("is_heading").alias("h"), F.count_if("is_date").alias("d"), F.min("day").alias("day"))
    proof = venue_proof(lines, stations).select("article_id", "any_on_site")
    ahead = F.datediff("day", F.lit(as_of).cast("date"))
    reason = F.when(F.col("h") != 1, "headline_count").when(F.col("d") != 1, "date_count").when(F.col("day").isNull(), "no_year").when(~F.coalesce("any_on_site", F.lit(False)), "no_venue").when(~ahead.between(0, most_days), "out_of_range").otherwise("accepted")
    return a.join(proof, "article_id", "left").select("article_id", reason.alias("reason"))


def site_review(pages: DataFrame, name: Column, hint: str, most: int = 8) -> DataFrame:
    """EXT-20: whether a page mentions a name, and up to `most` distinct links whose text looks like a hint, sorted."""
    pattern = F.lit('<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("h"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("t"))
    found = F.array_sort(F.array_distinct(F.transform(F.filter(both, lambda x: F.rlike(x["t"], F.lit(hint))), lambda x: x["h"])))
    return pages.select("page_id", F.contains("html", name).alias("mentions"), F.array_join(F.slice(found, 1, most), " ").alias("hints"))


def directory_matches(listing: DataFrame, master: DataFrame) -> DataFrame:
    """EXT-21: listing labels joined with the master by prefecture and station key; kept if unique on the master's side."""
    key = lambda c: T.station_key(F.col(c)).alias("_key")
    m = master.select("id", "prefecture", key("name")).withColumn("_n", F.count("*").over(Window.partitionBy("prefecture", "_key"))).filter("_n = 1")
    return listing.select("listing_id", "prefecture", key("label")).join(m, ["prefecture", "_key"]).select("listing_id", "id")


def confirmed(events: DataFrame, lines: DataFrame) -> DataFrame:
    """JN-17: an event is confirmed if its subject and its exact day both occur in the lines of its page."""
    m = marked(lines).select("article_id", "line_text", F.col("day").alias("line_day"))
    got = events.join(m, "article_id")
    return got.groupBy("article_id").agg((F.bool_or(F.contains("line_text", "subject")) & F.bool_or(F.coalesce(F.col("line_day") == F.col("event_day"), F.lit(False)))).alias("confirmed"))


def with_robots(pages: DataFrame, status: DataFrame) -> DataFrame:
    """FLT-11: pages with the robots status of their host; disallowed ones are kept and marked, unknown hosts too."""
    return pages.join(status, "host", "left").select("page_id", "host", F.when(F.col("disallowed"), "disallowed").when(F.col("disallowed").isNull(), "unknown").otherwise("allowed").alias("robots"))
