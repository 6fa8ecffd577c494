"""Pages as nested sets: elements by the places of their start and end tags, containment as an interval test.

A page is cut at its tags once. Tags are numbered in reading order, each with the text up to the next one. A start tag
belongs to the end tag that closes the last open element of its name, so an element is an interval [pre, post) of tags,
and its text is a stretch of the page's whole text. All of this stays in the page's row: nothing is shuffled or written.
Lists are exploded by the outer forms, as Spark would push "is not empty" below, which makes the lists twice.
"""

from __future__ import annotations

from array import array
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from waystone.functions import dates as D
from waystone.functions import text as T
from waystone.functions import urls as U
from waystone.operators.coverage import containment

#: Neither is markup: comments, scripts, styles.
NO_MARKUP = "(?is)<!--.*?-->|<script[ >].*?</script>|<style[ >].*?</style>"
TAG = "<(/?[a-zA-Z][a-zA-Z0-9]*)([^>]*)>"
#: Elements without content.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Parts of a page that belong to no article.
AROUND = ("nav", "aside", "footer", "head")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
DATE = "20[0-9]{2}年 *[0-9]{1,2}月 *[0-9]{1,2}日"


def tags(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(page_id, pos, tag, closing, attrs, text, chars): each tag with the text after it; row 0 is the text before the first.

    `chars` counts the characters of all texts before the row, with one space for each filled text.
    """
    body = F.translate(F.coalesce(F.col(html), F.lit("")), "\u0001\u0002", "")
    marked = F.regexp_replace(F.regexp_replace(body, NO_MARKUP, ""), TAG, "\u0001$1\u0002$2\u0002")
    rows = pages.select(F.col(key).alias("page_id"), F.posexplode(F.split(marked, "\u0001")).alias("pos", "x")).withColumn("f", F.split("x", "\u0002"))
    head = F.col("pos") == 0
    text = F.when(head, F.col("x")).otherwise(F.get("f", F.lit(2)))
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    name = F.when(head, "").otherwise(F.lower(F.get("f", F.lit(0))))
    rows = rows.select("page_id", "pos", F.regexp_replace(name, "^/", "").alias("tag"), F.startswith(name, F.lit("/")).alias("closing"), F.when(~head, F.get("f", F.lit(1))).alias("attrs"), T.clean(text).alias("text"))
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("chars", F.coalesce(F.sum(F.length("text") + (F.col("text") != "").cast("int")).over(before), F.lit(0)))


_SPANS = ArrayType(StructType([StructField("pre", IntegerType()), StructField("post", IntegerType()), StructField("from", LongType()), StructField("chars", LongType())]))


@F.arrow_udf(_SPANS)
def _spans(names: pa.Array, sizes: pa.Array, only: pa.Array) -> pa.Array:
    """The elements of each page from its tag names (separated by spaces, end tags with a slash) and the lengths of the texts
    before the first tag and after each one; those of the names in `only`, if there are any."""
    offsets, cols = array("i", [0]), [array("i"), array("i"), array("q"), array("q")]
    kept = frozenset(only[0].as_py().split()) if len(only) else frozenset()
    values, counts, done = sizes.flatten().to_pylist(), sizes.value_lengths().to_pylist(), 0
    for page, count in zip(names.to_pylist(), counts, strict=True):
        before = list(accumulate(values[done : done + count], initial=0))
        done += count
        tags = page.split()
        opened: dict[str, list[int]] = {}
        spans = []
        for i, tag in enumerate(tags, 1):
            if tag[0] != "/":
                if tag not in VOID:
                    opened.setdefault(tag, []).append(i)
            elif rest := opened.get(tag[1:]):
                spans.append((rest.pop(), i))
        spans.sort()
        # what nothing closes ends with the smallest closed element around it, or with the page
        around, k, loose = [], 0, []
        for at in sorted(i for rest in opened.values() for i in rest):
            while k < len(spans) and spans[k][0] < at:
                heappush(around, spans[k][1])
                k += 1
            while around and around[0] < at:
                heappop(around)
            loose.append((at, around[0] if around else len(before) - 1))
        if loose:
            spans = sorted(spans + loose)
        if kept:
            spans = [x for x in spans if tags[x[0] - 1] in kept]
        cols[0].extend([pre for pre, _ in spans])
        cols[1].extend([post for _, post in spans])
        cols[2].extend([before[pre] for pre, _ in spans])
        cols[3].extend([before[post] - before[pre] for pre, post in spans])
        offsets.append(len(cols[0]))
    kinds = {"pre": pa.int32(), "post": pa.int32(), "from": pa.int64(), "chars": pa.int64()}
    rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def elements(rows: DataFrame) -> DataFrame:
    """(page_id, tag, attrs, pre, post, chars): the interval of each element and the length of its text, from `tags`.

    An end tag closes the last open element of its name; end tags without one are skipped. An element that nothing
    closes ends with the smallest closed element around it, or with the page. Void elements are none.
    """
    size = F.length("text") + (F.col("text") != "").cast("int")
    row = F.struct("pos", F.concat(F.when(F.col("closing"), "/").otherwise(""), "tag").alias("name"), "attrs", size.alias("size"))
    page = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    got = page.withColumn("e", _spans(F.array_join(F.col("r.name"), " "), F.col("r.size"), F.lit(""))).select("page_id", "r", F.inline("e"))
    return got.select("page_id", F.col("r")[F.col("pre")]["name"].alias("tag"), F.col("r")[F.col("pre")]["attrs"].alias("attrs"), "pre", "post", "chars")


def parsed(pages: DataFrame, *keep: str, html: str = "html", key: str = "page_id", only: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, *keep, whole, els): a row for each page with its whole text and its elements (tag, attrs, pre, post, from,
    chars) in order: the same as `tags` and `elements`, without a row for each tag. `from` is the place in the whole text. Elements of all names or of those in `only`."""
    body = F.regexp_replace(F.translate(F.coalesce(F.col(html), F.lit("")), "\u0001\u0002", ""), NO_MARKUP, "")
    text = F.regexp_replace(F.col("_body"), TAG, "\u0001")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    all = lambda k: F.regexp_extract_all("_body", F.lit(TAG), F.lit(k))
    got = pages.select(F.col(key).alias("page_id"), *keep, body.alias("_body"))
    # lists that are read at a place are columns of their own before the elements, or they would be made for each element
    got = got.select("page_id", *keep, F.split(F.lower(F.array_join(all(1), " ")), " ").alias("_names"), all(2).alias("_attrs"), F.transform(F.split(T.clean(text), "\u0001"), lambda x: F.trim(x)).alias("_texts"))
    spans = _spans(F.array_join("_names", " "), F.transform("_texts", lambda x: F.length(x) + (x != "").cast("int")), F.lit(" ".join(only)))
    got = got.withColumns({"_spans": spans, "whole": F.array_join(F.filter("_texts", lambda x: x != ""), " ")})
    el = lambda e: F.struct(F.get("_names", e["pre"] - 1).alias("tag"), F.get("_attrs", e["pre"] - 1).alias("attrs"), e["pre"].alias("pre"), e["post"].alias("post"), e["from"].alias("from"), e["chars"].alias("chars"))
    return got.select("page_id", *keep, "whole", F.transform("_spans", el).alias("els"))


def text_of(e: Column) -> Column:
    """The text of an element of `parsed`. The whole text has one space between two texts."""
    return F.substring("whole", (e["from"] + 1).cast("int"), (e["chars"] - 1).cast("int"))


def inside(e: Column, o: Column) -> Column:
    """Whether an element lies inside another one."""
    return (o["pre"] < e["pre"]) & (e["post"] <= o["post"])


def in_article(e: Column, most: int, tags: tuple[str, ...]) -> Column:
    """Whether an element is one of `tags`, has a text of at most `most` characters and lies in the page's container, outside
    navigation and footers."""
    fits = e["tag"].isin(*tags) & e["chars"].between(1, most + 1)
    return fits & inside(e, F.col("art")) & ~F.exists("off", lambda o: inside(e, o))


def with_articles(page: DataFrame, kinds: tuple[str, ...] = ("article", "main")) -> DataFrame:
    """Adds `art`, the container of a page: the first element of the first kind that it has, and `off`, the parts around."""
    ranked = F.transform(F.filter("els", lambda e: e["tag"].isin(*kinds)), lambda e: F.struct(_rank(e, kinds).alias("rank"), e["pre"].alias("pre"), e["post"].alias("post")))
    return page.withColumns({"art": F.array_min(ranked), "off": F.filter("els", lambda e: e["tag"].isin(*AROUND))})


def _rank(e: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, kinds)), e["tag"])


def with_text(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Elements with `text`: the texts in them, joined by spaces. Limit `found` by `chars` first: nested elements repeat their texts."""
    t = rows.filter("text <> ''").select(F.col("page_id").alias("_p"), "pos", "text")
    got = found.join(t, (F.col("page_id") == F.col("_p")) & (F.col("pre") <= F.col("pos")) & (F.col("pos") < F.col("post")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return got.groupBy("page_id", "tag", "pre", "post").agg(F.array_join(parts, " ").alias("text"))


def container_lines(pages: DataFrame, *, lines: tuple[str, ...] = ("p", "li", "dd", "td", "h2", "h3"), most: int = 250, cap: int = 140) -> DataFrame:
    """EXT-02: (page_id, line_no, line): texts of the line elements of each page's container, outside navigation and
    footers, of at most `most` characters; the first `cap` of a page."""
    page = with_articles(parsed(pages))
    texts = F.filter(F.transform(F.filter("els", lambda e: in_article(e, most, lines)), text_of), lambda t: F.length(t).between(1, most))
    return page.select("page_id", F.posexplode_outer(F.slice(texts, 1, cap)).alias("pos", "line")).filter("pos is not null").select("page_id", (F.col("pos") + 1).alias("line_no"), "line")


def headlines(pages: DataFrame, *, include: str, exclude: str, listed: str = "listed", kinds: tuple[str, ...] = ("h1", "h2", "h3", "h4"), most: int = 400) -> DataFrame:
    """EXT-03: (page_id, headline): the first heading by kind and place in the page's container, outside navigation, that
    matches `include` and not `exclude`; else the listing's title without its stamp, if that does; else empty."""
    page = with_articles(parsed(pages, listed))
    good = lambda c: F.rlike(c, F.lit(include)) & ~F.rlike(c, F.lit(exclude))
    found = F.transform(F.filter("els", lambda e: in_article(e, most, kinds)), lambda e: F.struct(_rank(e, kinds).alias("rank"), e["pre"].alias("pre"), text_of(e).alias("text")))
    other = F.regexp_replace(T.clean(F.coalesce(F.col(listed), F.lit(""))), "^(?:(?:EVENT|NEWS|お知らせ|新着情報) +)?(?:20[0-9]{2}[年./-][0-9]{1,2}[月./-][0-9]{1,2}日? *)?", "")
    page = page.select("page_id", F.array_min(F.filter(found, lambda x: good(x["text"])))["text"].alias("own"), other.alias("other"))
    return page.select("page_id", F.coalesce("own", F.when(good(F.col("other")), F.col("other")), F.lit("")).alias("headline"))


def event_cards(
    pages: DataFrame,
    stations: DataFrame,
    *,
    as_of: str,
    containers: tuple[str, ...] = ("li", "article", "tr", "section", "div"),
    least: int = 25,
    most: int = 650,
    dates: int = 2,
    detail: str = "/event/",
    no_title: str = "戻る|詳細を見る|もっと見る",
    max_span: int = 366,
) -> DataFrame:
    """EXT-16: (road_name, title, start_date, end_date, url) from the smallest unambiguous cards of (page_id, url, html).

    A card is a container of `least` to `most` characters that names exactly one of the stations (name) and has exactly
    `dates` full dates. After the station come both dates and a title. The first link of the card to the page's own host with `detail` in
    its path gives the address, and the title if its text is one; else the address is the page's with the day. Of cards with
    equal station, period and address the shortest stays, so no outer wrapper is taken. Periods that end before `as_of` are left out.
    """
    page = parsed(pages, "url", only=("a", *containers))
    full = F.regexp_replace("url", "^http:", "https:")
    own = F.filter("els", lambda e: (e["tag"] == "a") & F.rlike(e["attrs"], F.lit("href=\"[^\"]")))
    links = F.transform(own, lambda e: F.struct(e["pre"].alias("at"), U.resolve(F.regexp_extract(e["attrs"], "href=\"([^\"]*)\"", 1), full).alias("url"), F.when(e["chars"] > 0, text_of(e)).alias("text")))
    page = page.withColumn("links", links).withColumn("links", F.filter("links", lambda x: F.contains(x["url"], F.lit(detail))))
    # a card has `dates` dates and what follows its station
    after = f" *({DATE}) *({DATE}) *(.{{4,140}})"
    cards = page.select("page_id", "url", "whole", "links", F.inline_outer(F.filter("els", lambda e: e["tag"].isin(*containers) & e["chars"].between(max(1, least), most + 1)))).filter("pre is not null")
    cards = cards.withColumn("text", text_of({c: F.col(c) for c in ("from", "chars")}))
    cards = cards.filter(F.length("text").between(least, most) & F.rlike("text", F.lit(after)) & (F.regexp_count("text", F.lit(DATE)) == dates))
    link = F.get(F.filter("links", lambda x: (F.col("pre") < x["at"]) & (x["at"] < F.col("post"))), F.lit(0))
    cards = cards.select("page_id", "pre", F.col("url").alias("page_url"), "text", link.alias("link"))
    cards = containment(cards, stations.select("name").distinct(), "text", "name", least=1)
    # a value that a function of an array takes is computed once, however often the function names it
    once = lambda x, f: F.transform(F.array(x), f)[0]
    cards = cards.withColumn("_m", once(F.expr("substring(text, instr(text, name) + length(name))"), lambda r: F.struct(*[F.regexp_extract(r, "^" + after, k).alias(n) for k, n in enumerate(("a", "b", "t"), 1)])))
    cards = cards.withColumns({"start_date": once(F.col("_m.a"), lambda x: D.full_date(x)), "end_date": once(F.col("_m.b"), lambda x: D.full_date(x)), "title": F.trim(F.regexp_replace("_m.t", "^[ ・]+", ""))})
    good = F.length("link.text").between(6, 100) & ~F.rlike("link.text", F.lit(DATE)) & ~F.rlike("link.text", F.lit(no_title))
    url = F.coalesce("link.url", F.concat(F.regexp_replace("page_url", "[?#].*$", ""), F.lit("?dc="), F.col("start_date").cast("string")))
    shown = F.when(good, F.col("link.text")).otherwise(F.trim(F.substring("title", 1, 110)))
    card = F.struct("name", "start_date", "end_date", url.alias("url"), F.length("text").alias("size"), "title", shown.alias("shown"))
    one = cards.groupBy("page_id", "pre").agg(F.count("*").alias("n"), F.min(card).alias("c")).filter("n = 1").select("page_id", "pre", "c.*")
    one = one.filter((F.col("title") != "") & (F.col("end_date") >= F.col("start_date")) & (F.col("end_date") >= F.lit(as_of).cast("date")) & (F.datediff("end_date", "start_date") <= max_span))
    best = one.groupBy(F.col("name").alias("road_name"), "start_date", "end_date", "url").agg(F.min(F.struct("size", "page_id", "pre", "shown"))["shown"].alias("title"))
    return best.select("road_name", "title", "start_date", "end_date", "url")
