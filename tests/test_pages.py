"""Pages as nested sets: elements against a parse with a stack, lines, headlines and cards."""

import datetime as dt
import random
from html.parser import HTMLParser

import pytest

from waystone.operators import pages as P
from waystone.operators.coverage import named_stations


class Parsed(HTMLParser):
    """Numbers all tags; an end tag closes the last open element of its name. Texts as (tag number, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.n, self.open, self.spans, self.texts = 0, [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            return
        self.n += 1
        if tag not in P.VOID:
            self.open.append((tag, self.n))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            return
        self.n += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.spans.append((*self.open.pop(k), self.n))
                break

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not getattr(self, "cdata_elem", None):
            self.texts.append((self.n, text))

    def done(self):
        for tag, at in self.open:
            around = [b for _, a, b in self.spans if a < at < b]
            self.loose = getattr(self, "loose", []) + [(tag, at, min(around, default=self.n + 1))]
        spans = self.spans + getattr(self, "loose", [])
        return {(t, a, b): " ".join(x for k, x in self.texts if a <= k < b) for t, a, b in spans}


def random_page(seed):
    rng = random.Random(seed)
    out = ["<!-- <div> -->", "<script>if (a < b) x = '</div>';</script>"]
    for _ in range(rng.randrange(0, 60)):
        tag = rng.choice(["div", "p", "li", "ul", "b", "br", "DIV", "section"])
        out.append(rng.choice([f"<{tag}>", f"</{tag}>" if tag != "br" else "<br/>", f"<{tag} class='x'>", f"text {rng.randrange(9)} &amp; more", " \n ", f"<{tag}>a</{tag}>" if tag != "br" else "<br>"]))
    return "".join(out)


def test_elements_equal_a_parse_with_a_stack(spark):
    pages = [(k, random_page(k)) for k in range(60)] + [(100, None), (101, ""), (102, "no markup"), (103, "<div><li>open"), (104, "</div></div><div>x</div>")]
    rows = P.tags(spark.createDataFrame(pages, "page_id long, html string"))
    all = P.elements(rows).collect()
    texts = {(r.page_id, r.tag, r.pre, r.post): r.text for r in P.with_text(P.elements(rows), rows).collect()}
    for k, html in pages:
        tree = Parsed()
        tree.feed(html or "")
        want = tree.done()
        assert sorted((r.tag, r.pre, r.post) for r in all if r.page_id == k) == sorted(want), html
        assert {x[1:]: t for x, t in texts.items() if x[0] == k} == {x: t for x, t in want.items() if t}
        assert all and {(r.tag, r.pre, r.post): r.chars for r in all if r.page_id == k} == {x: sum(len(t) + 1 for n, t in tree.texts if x[1] <= n < x[2]) for x in want}


def test_lines_and_headlines_stay_in_the_article(spark):
    html = "<nav><p>menu</p><h1>祭り</h1></nav><h1>別の祭り</h1><main><div><h1>一覧</h1><h3>春の祭り</h3><h2>募集 祭り</h2><p>first <b>line</b><p>second</p></div><aside><p>ad</p><h2>広告祭</h2></aside><li>third</li></main><footer><p>end</p></footer>"
    rows = [(1, html, "x"), (2, "<p>祭り</p>", "EVENT 2026.10.08 夏祭り"), (3, "<main><h1>祭り</h1></main>", None), (4, "<main></main>", "祭り 募集"), (5, None, None)]
    d = spark.createDataFrame(rows, "page_id long, html string, listed string")
    assert {r.page_id: r.headline for r in P.headlines(d, include="祭", exclude="募集").collect()} == {1: "春の祭り", 2: "夏祭り", 3: "祭り", 4: "", 5: ""}
    assert [(r.page_id, r.line_no, r.line) for r in P.container_lines(d).orderBy("page_id", "line_no").collect()] == [(1, 1, "春の祭り"), (1, 2, "募集 祭り"), (1, 3, "first line second"), (1, 4, "second"), (1, 5, "third")]


CARD = "<li><a href='{href}'>{link}</a><p>{name}</p><p>2026年10月24日</p><p>2026年10月25日</p><p>{title}</p></li>".replace("'", '"')


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (CARD.format(href="/contents/event/?article=5", link="大きな秋の祭り", name="氷見", title="・秋の祭り会場案内"), ("大きな秋の祭り", "https://h.jp/contents/event/?article=5")),
        ("<div><section>" + CARD.format(href="/event/1", link="詳細を見る", name="氷見", title="秋の祭り会場案内") + "</section></div>", ("秋の祭り会場案内", "https://h.jp/event/1")),
        (CARD.format(href="https://other.jp/event/1", link="大きな秋の祭り", name="氷見", title="秋の祭り会場案内"), ("秋の祭り会場案内", "https://h.jp/list?dc=2026-10-24")),
        (CARD.format(href="/event/1", link="大きな秋の祭り", name="氷見 親不知", title="秋の祭り会場案内"), None),
        (CARD.format(href="/event/1", link="大きな秋の祭り", name="氷見", title="2026年10月26日 締切のお祭り"), None),
        (CARD.format(href="/event/1", link="大きな秋の祭り", name="知らない駅", title="秋の祭り会場案内"), None),
        (CARD.format(href="/event/1", link="大きな秋の祭り", name="氷見", title="秋の祭り" + "長い" * 400), None),
        (CARD.format(href="/event/1", link="大きな秋の祭り", name="氷見", title="秋の祭り会場案内").replace("2026年10月24日", "2026年10月26日"), None),
        (CARD.format(href="/event/1", link="大きな秋の祭り", name="氷見", title="秋の祭り会場案内").replace("2026年", "2025年"), None),
    ],
)
def test_cards(spark, html, want):
    page = spark.createDataFrame([(1, "https://h.jp/list?x=1", f"<body><ul>{html}</ul></body>")], "page_id long, url string, html string")
    stations = spark.createDataFrame([("氷見",), ("親不知",)], "name string")
    got = P.event_cards(page, stations, as_of="2026-10-10").collect()
    assert [(r.road_name, r.title, r.url) for r in got] == ([("氷見", *want)] if want else [])
    assert all((r.start_date, r.end_date) == (dt.date(2026, 10, 24), dt.date(2026, 10, 25)) for r in got)


def test_labels_that_contain_a_station(spark):
    """A label that says 道の駅 names the station whose key it contains, at any place in it."""
    notices = spark.createDataFrame([(1, "【道の駅 ひみ番屋街の隣】祭り"), (2, "【道の駅 どこか】祭り"), (3, "【祭り】ひみ番屋街")], "event_id long, title string")
    stations = spark.createDataFrame([(7, "ひみ番屋街"), (8, "うみてらす名立")], "id long, name string")
    assert [tuple(r) for r in named_stations(notices, stations).collect()] == [(1, 7)]


def test_pages_are_neither_shuffled_nor_written(spark, monkeypatch):
    """elements, lines and headlines of a page come from its own row."""
    import waystone.sources.files as files

    monkeypatch.setattr(files, "scratch", lambda *_: pytest.fail("a table was written"))
    d = spark.createDataFrame([(1, "<main><h1>祭り</h1><p>a", "x")], "page_id long, html string, listed string")
    rows = P.parsed(d)
    assert [(r.whole, [(e.tag, e.pre, e.post, e["from"], e.chars) for e in r.els]) for r in rows.collect()] == [("祭り a", [("main", 1, 5, 0, 5), ("h1", 2, 3, 0, 3), ("p", 4, 5, 3, 2)])]
    for got in (rows, P.container_lines(d), P.headlines(d, include="祭", exclude="募集")):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_parts_that_begin_as_no_key_do_not_meet_the_keys(spark):
    """of a text's parts only those with a key's beginning are shuffled."""
    from waystone.operators.coverage import containment

    texts = spark.createDataFrame([(1, "xx Customer#000000007 yy"), (2, "nothing"), (3, None)], "id long, text string")
    keys = spark.range(3000).selectExpr("concat('Customer#', lpad(id, 9, '0')) as name")
    got = containment(texts, keys, "text", "name")
    assert [(r.id, r.name) for r in got.collect()] == [(1, "Customer#000000007")]
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()


def test_elements_of_some_names_only(spark):
    """The same elements as without the choice, nested, unclosed and crossing; EXT-16 takes no others."""
    from waystone.operators import pages as P
    from waystone.sources.views import Views

    html = ["<ul><li>a<li>b<b>c</ul></b><a href='x'>d</a>e</li><div>f", "", "no tags", "<A>x<li></a>y</li>", "<br></li><a>"]
    pages = spark.createDataFrame([(k, h) for k, h in enumerate(html)], "page_id int, html string")
    every, some = ({r.page_id: [tuple(e) for e in r.els] for r in P.parsed(pages, only=only).collect()} for only in ((), ("a", "li")))
    assert some == {k: [e for e in els if e[0] in ("a", "li")] for k, els in every.items()} and sum(map(len, some.values())) == 6
    v = Views(spark, "/root/testdata/sf0.001")
    plan = P.event_cards(v.event_pages, v.stations, as_of="2026-01-01")._jdf.queryExecution().optimizedPlan().toString()
    assert "a li article tr section div" in plan
