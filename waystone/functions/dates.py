"""Column functions on dates in text (DAT-01 to DAT-11). All take `as_of` as a parameter, never the clock."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waystone.functions import text as T

#: Weekday signs from Monday, fixed values of the domain.
WEEKDAYS = "月火水木金土日"
ERA = "(?:令和|R)([0-9]+|元)年?"
_SIGN = r"\(([月火水木金土日])[^)]{0,7}\)"
#: What joins the two ends of a range, or a day and the next one.
JOIN = "(?:[~〜▶▷–・、-]|から|より)"
#: A date in a folded text: era or year, month, day and weekday; or what joins, a day and its weekday.
TOKEN = (
    "(?:(?:(?:令和|R) ?([0-9]{1,2}|元)|([0-9]{4})) ?[年./-] ?)?([0-9]{1,2}) ?[月./-] ?([0-9]{1,2})日?(?: ?" + _SIGN + ")?"
    "|" + JOIN + " ?([0-9]{1,2})(?:日? ?" + _SIGN + "|日|[^0-9年月./:時-]|$)"
)
#: A range mark, after bullets, with no date before it.
OPEN_START = "^[●・ ]*[~〜]"
#: Words that tell of a schedule.
SCHEDULED = "開催|実施|開演|日時|日程|から.{0,8}まで"
#: A date with its year.
FULL = "(?:(?:令和|R)([0-9]+|元)|([0-9]{4}))[年/.]([0-9]{1,2})[月/.]([0-9]{1,2})"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _with(c: Column, f) -> Column:
    """f(c) with c computed once."""
    return F.transform(F.array(c), f)[0]


def era_year(c: Column) -> Column:
    """DAT-01: 令和N or R N as 2018 + N, 元 as year one; null without an era."""
    n = F.regexp_extract(c, ERA, 1)
    return F.when(n == "元", 2019).when(n != "", 2018 + _int(n)).cast("int")


def safe_date(y: Column, m: Column, d: Column, weekday: Column | None = None) -> Column:
    """DAT-02: null for impossible dates, and for one whose printed weekday is another."""
    first = F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
    day = F.when(d.between(1, 31), F.date_add(first, d - 1))
    # the day after the month's last one is none of it
    day = _with(day, lambda x: F.when(F.month(x) == m, x))
    if weekday is None:
        return day
    return _with(day, lambda x: F.when(weekday.isNull() | (weekday == "") | (weekday == F.substring(F.lit(WEEKDAYS), F.weekday(x) + 1, F.lit(1))), x))


@dataclass(frozen=True)
class Options:
    """DAT-05: how a source writes its periods."""

    max_span: int = 120
    #: explicit: a year must be printed; published: else the publication's year counts (or that of any day given in its place, as the season's)
    year: str = "published"
    #: optional: a single date is a day; required: a range must be given; ignored: only the start counts; last: the last of all dates
    end: str = "optional"
    #: whether a printed weekday must be the date's
    weekday: bool = True
    #: more dates in a text than this reject it
    most_dates: int | None = None
    #: whether a text may begin with what joins, which leaves its start open
    open_start: bool = True
    #: what must not lie before the publication: nothing, the start or the end
    not_before: str | None = None
    #: only what follows this pattern is read
    label: str | None = None


#: How kinds of sources write their periods, by name.
SOURCES = {
    "station": Options(max_span=90),
    "announcement": Options(max_span=90, not_before="start"),
    "all dates": Options(max_span=100, end="last", not_before="start"),
    "printed range": Options(max_span=9, year="explicit", end="required"),
    "labelled": Options(max_span=90, year="explicit", label="(?:開催)?日時 ?: ?|期間 ?"),
    "bulletin": Options(max_span=31, open_start=False),
    "no weekdays": Options(max_span=100, year="explicit", weekday=False),
    "start": Options(end="ignored"),
}


def folded(c: Column) -> Column:
    """A text as its dates are read: full-width forms folded, white space collapsed."""
    return F.translate(T.clean(c), "\u0001\u0002", "")


def _parts(text: Column) -> Column:
    """A folded text cut at its dates: gap, date, gap, ..., gap. A date is its fields and itself. One pass over the text."""
    fields = "".join(f"${k}\u0002" for k in range(1, 8))
    return F.split(F.regexp_replace(text, TOKEN, f"\u0001{fields}$0\u0001"), "\u0001")


def tokens(text: Column) -> Column:
    """All dates of a folded text: (gap, year, month, day, weekday). `gap` is the text since the date before. The year is
    null where none is printed; a day after what joins it to the date before has no month."""

    def parsed(f: Column, gap: Column) -> Column:
        year = F.when(f[0] == "元", 2019).when(f[0] != "", 2018 + _int(f[0])).otherwise(_int(f[1]))
        return F.struct(gap.alias("gap"), year.alias("year"), _int(f[2]).alias("month"), F.coalesce(_int(f[3]), _int(f[5])).alias("day"), F.concat(f[4], f[6]).alias("weekday"))

    return _with(_parts(text), lambda p: F.transform(F.filter(p, lambda x, i: i % 2 == 1), lambda x, i: _with(F.split(x, "\u0002"), lambda f: parsed(f, F.get(p, 2 * i)))))


def read_part(c: Column, label: str | None) -> Column:
    """What of a text is read for its dates: all of it, or what follows a label; folded."""
    return folded(c if label is None else F.regexp_extract(folded(c), f"(?:{label})(.*)$", 1))


def period(c: Column, published: Column, options: Options = Options(), cut: Column | None = None) -> Column:
    """DAT-03 to DAT-05: (start, end) of the first period in a text, or null.

    The first date with a month is the start. The next one is the end if only what joins stands between them. A date
    without a year takes the publication's, the next one for January and February after a publication in November or
    December; an end in an earlier month than the start lies in the next year. Rejected: impossible dates, printed
    weekdays of other dates, an end before the start, spans above the limit, and what the options demand. `cut`: the `tokens`
    of the part that is read, where they are at hand.
    """
    text = read_part(c, options.label)
    sign = lambda x: x["weekday"] if options.weekday else None

    def year_of(x: Column) -> Column:
        if options.year == "explicit":
            return x["year"]
        return F.coalesce(x["year"], F.year(published) + F.when((F.month(published) >= 11) & (x["month"] <= 2), 1).otherwise(0))

    def judged(days: Column) -> Column:
        start, end = days["s"], days["e"]
        ok = start.isNotNull() & end.isNotNull() & (end >= start) & (F.datediff(end, start) <= options.max_span)
        if options.not_before:
            ok &= (start if options.not_before == "start" else end) >= published
        return F.when(ok, F.struct(start.alias("start_date"), end.alias("end_date")))

    def ended(own: Column, y: Column, first: Column, after: Column) -> Column:
        joined = F.when(after["month"].isNull(), F.trim(after["gap"]) == "").otherwise(F.rlike(after["gap"], F.lit(f"^ ?{JOIN} ?$")))
        month = F.coalesce(after["month"], first["month"])
        end = safe_date(F.coalesce(after["year"], y + F.when(month < first["month"], 1).otherwise(0)), month, after["day"], sign(after))
        single = own if options.end == "optional" else F.lit(None).cast("date")
        return F.when(F.coalesce(joined, F.lit(False)), end).otherwise(single)

    def found(all: Column) -> Column:
        return _with(F.filter(all, lambda x: x["month"].isNotNull()), lambda dated: _with(F.get(dated, F.lit(0)), lambda first: begun(all, dated, first)))

    def begun(all: Column, dated: Column, first: Column) -> Column:
        at = F.array_position(F.transform(all, lambda x: x["month"].isNotNull()), True).cast("int")

        def of(s: Column) -> Column:
            own = safe_date(s["y"], s["f"]["month"], s["f"]["day"], sign(s["f"]))
            if options.end == "ignored":
                end = own
            elif options.end == "last":
                days = F.array_compact(F.transform(dated, lambda x: safe_date(year_of(x), x["month"], x["day"], sign(x))))
                own, end = F.get(days, F.lit(0)), F.try_element_at(days, F.lit(-1))
            else:
                end = ended(own, s["y"], s["f"], s["n"])
            return _with(F.struct(own.alias("s"), end.alias("e")), judged)

        good = F.lit(True) if options.most_dates is None else F.size(all) <= options.most_dates
        return F.when(good, _with(F.struct(first.alias("f"), F.get(all, at).alias("n"), year_of(first).alias("y")), of))

    out = _with(tokens(text) if cut is None else cut, found)
    return out if options.open_start else F.when(~F.rlike(text, F.lit(OPEN_START)), out)


def periods_by_source(rows: DataFrame, text: str, published: str, sources: dict[str, Options]) -> DataFrame:
    """DAT-05: rows with `source` and `p`, the period that each kind of source reads. A text is cut once for each label."""
    labels = list(dict.fromkeys(o.label for o in sources.values()))
    # columns of their own: several sources read them
    rows = rows.withColumns({f"_cut{k}": tokens(read_part(F.col(text), x)) for k, x in enumerate(labels)})
    each = [F.struct(F.lit(n).alias("source"), period(F.col(text), F.col(published), o, F.col(f"_cut{labels.index(o.label)}")).alias("p")) for n, o in sources.items()]
    return rows.select("*", F.inline_outer(F.array(*each))).drop(*[f"_cut{k}" for k in range(len(labels))])


def full_date(c: Column) -> Column:
    """The first date with a printed year (era or four digits) in a text; null if there is none or it is impossible."""
    era, year, month, day = (F.regexp_extract(c, FULL, k) for k in (1, 2, 3, 4))
    y = F.when(era == "元", 2019).when(era != "", 2018 + _int(era)).otherwise(_int(year))
    return safe_date(y.cast("int"), _int(month), _int(day))


#: DAT-04: one or two dates, the start given, over when it is published.
STRICT = Options(most_dates=2, open_start=False, not_before="end")


def strict_period(c: Column, published: Column, max_span: int = 120) -> Column:
    """DAT-04: at most two dates in the text, no open start, not over at its publication, then as DAT-03."""
    return period(c, published, replace(STRICT, max_span=max_span))


def schedule_hint(c: Column, as_of: Column, reach: int = 24) -> Column:
    """DAT-07: future or past, by the first date with a year (of four digits or of an era) that has a schedule word within
    `reach` characters on either side; else unknown."""

    def near(p: Column) -> Column:
        plain = F.transform(p, lambda x, i: F.when(i % 2 == 1, F.element_at(F.split(x, "\u0002"), -1)).otherwise(x))

        def day(x: Column, i: Column) -> Column:
            f = F.split(x, "\u0002")
            year = F.when(f[0] == "元", 2019).when(f[0] != "", 2018 + _int(f[0])).otherwise(_int(f[1]))
            before, after = F.array_join(F.slice(plain, 1, i), ""), F.array_join(F.slice(plain, i + 2, F.size(plain)), "")
            around = F.concat(F.substring(before, -reach, reach), F.get(plain, i), F.substring(after, 1, reach))
            return F.when((i % 2 == 1) & year.isNotNull() & F.rlike(around, F.lit(SCHEDULED)), safe_date(year, _int(f[2]), _int(f[3])))

        return F.get(F.array_compact(F.transform(p, day)), F.lit(0))

    day = _with(_parts(folded(c)), near)
    return F.when(day.isNull(), "unknown").when(day >= as_of, "future").otherwise("past")


#: A month, a day and its printed weekday.
MARKED_DAY = "([0-9]{1,2})月 *([0-9]{1,2})日 *[(（]([月火水木金土日])[)）]"


def review_priority(c: Column, hint: Column, as_of: Column) -> Column:
    """DAT-08: why a notice should be looked at, by the first of: a hint of a future schedule, only older years (of four
    digits or of an era), a day that this year does not have, a weekday that is another this year, a hint of a past
    schedule, nothing of these. It only orders a queue."""
    runs = F.regexp_replace(c, "([0-9]+)", " $1 ")
    years = F.concat(F.transform(F.regexp_extract_all(runs, F.lit(" (20[0-9]{2}) "), F.lit(1)), lambda x: x.cast("int")), F.transform(F.regexp_extract_all(c, F.lit("令和 *([0-9]{1,2})年"), F.lit(1)), lambda x: x.cast("int") + 2018))
    parts = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(MARKED_DAY), F.lit(k)).alias(n) for k, n in ((1, "m"), (2, "d"), (3, "w"))])

    def judged(x: Column) -> Column:
        day = safe_date(F.year(as_of), _int(x["m"]), _int(x["d"]))
        sign = F.substring(F.lit(WEEKDAYS), F.weekday(day) + 1, F.lit(1))
        return F.when(day.isNull(), "date_in_title_needs_verification").when(sign != x["w"], "weekday_year_mismatch_check")

    first = F.try_element_at(F.array_compact(F.transform(parts, judged)), F.lit(1))
    rule = F.when(hint == "future", "future_schedule_hint").when(F.array_max(years) < F.year(as_of), "older_year_mentioned").when(first.isNotNull(), first)
    return rule.when(hint == "past", "past_schedule_hint").otherwise("date_and_venue_verification_needed")


def opening_status(hours: Column, at: Column, manual: Column) -> Column:
    """DAT-10: open, before, closed, holiday or unknown at a time, by a map from day (0 = Monday) to [open, close] pairs.

    A manual status wins. A day that is not in the map is unknown, one without pairs is a holiday.
    """
    minutes = F.hour(at) * 60 + F.minute(at)
    pairs = F.try_element_at(hours, F.weekday(at).cast("string"))
    of = lambda x: F.split(x, ":")[0].cast("int") * 60 + F.split(x, ":")[1].cast("int")
    is_open = F.exists(pairs, lambda p: (of(p[0]) <= minutes) & (minutes < of(p[1])))
    before = F.exists(pairs, lambda p: minutes < of(p[0]))
    return F.when(manual.isNotNull(), manual).when(pairs.isNull(), "unknown").when(F.size(pairs) == 0, "holiday").when(is_open, "open").when(before, "before").otherwise("closed")


def season(day: Column) -> Column:
    """DAT-11: spring from March, summer from June, autumn from September, winter from December."""
    m = F.month(day)
    return F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.between(9, 11), "autumn").otherwise("winter")


def weekend_bucket(day: Column, as_of: Column) -> Column:
    """DAT-11: 0 today, 1 by the coming Sunday, 2 later."""
    sunday = F.date_add(as_of, 6 - F.weekday(as_of))
    return F.when(day <= as_of, 0).when((F.weekday(day) >= 5) & (day <= sunday), 1).otherwise(2)


def title_year_period(title: Column, body: Column) -> Column:
    """DAT-06: (start, end) by the era year of a title and the month and day of its body: the only one, or two that follow
    each other; null if the body names other days."""
    days = F.array_distinct(F.regexp_extract_all(body, F.lit("([0-9]{1,2}月[0-9]{1,2}日)"), F.lit(1)))
    day = lambda k: safe_date(era_year(title), *[_int(F.regexp_extract(F.get(days, F.lit(k)), p, 1)) for p in ("^([0-9]+)", "月([0-9]+)")])
    first, second = day(0), day(1)
    ok = (F.size(days) == 1) & first.isNotNull() | (F.size(days) == 2) & (F.datediff(second, first) == 1)
    return F.when(ok, F.struct(first.alias("start_date"), F.coalesce(second, first).alias("end_date")))


def publication(rows, key: str, order: str, columns: list[str], as_of: str):
    """DAT-09: of each article the first date, by row and then by column, that does not lie in the future."""
    ranked = F.array(*[F.struct((F.col(order) * len(columns) + i).alias("rank"), F.col(c).alias("d")) for i, c in enumerate(columns)])
    return rows.select(key, F.inline(ranked)).filter(F.col("d") <= F.lit(as_of).cast("date")).groupBy(key).agg(F.min(F.struct("rank", "d"))["d"].alias("published"))
