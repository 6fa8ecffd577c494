"""Row patterns: the lines of an article as a word over a small alphabet, matched by regular expressions that are data.

Each source has a row of rules. A line becomes one sign by its source's rules: T a title, D a date, B a title with its date,
V a venue, X a hint of another place, - anything else. The signs of an article are one short string, and the rule `core` is a pattern on it, such as
"T-?D" (a date within two lines of its title). All sources run in one pass: the rules are joined to the lines, and nothing in the plan depends
on their number. Articles bound all windows and groups.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waystone.functions import dates as D

NEVER = "^$"
#: A heading that grounds the year and month of the dates below it.
PROGRAM = "(20[0-9]{2})年 *([0-9]{1,2})月.*のご案内"


@dataclass(frozen=True)
class Rule:
    """How a source writes its events. Patterns hold for folded lines.

    `year`: explicit (a date needs its year), published (else the publication's) or heading (else the program heading's).
    `scope`: what follows a match and must not hold an X. `title_part`: what of a title line is the title.
    """

    adapter: int
    name: str
    title: str
    core: str
    date: str = "[0-9]月"
    venue: str = "^(?:会場|場所) ?: ?"
    offsite: str = NEVER
    blocked: str = "募集|締切|中止|延期"
    scope: str = NEVER
    year: str = "explicit"
    title_part: str = "(.*)"
    max_span: int = 120
    need_venue: bool = False


def _extract(c: Column | str, pattern: Column | str, k: int) -> Column:
    """regexp_extract by a pattern that is a column."""
    return F.call_function("regexp_extract", c, pattern, F.lit(k))


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    kinds = {"int": "int", "str": "string", "bool": "boolean"}
    return spark.createDataFrame([astuple(r) for r in rules], ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Rule)))


def _named(rules: DataFrame) -> DataFrame:
    """Rules under names that no line has, and `_rule`, which tells them apart."""
    return rules.withColumn("_rule", F.xxhash64(*rules.columns)).withColumnsRenamed({"title": "r_title", "date": "r_date", "venue": "r_venue"})


def classified(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(adapter, article_id, line_no, text, published) with the source's rules, the line's sign and its period."""
    r = _named(rules)
    # rules are broadcast: they are few, so a shuffle by source would leave a few tasks with all lines
    j = lines.join(F.broadcast(rules.select("adapter").distinct()), "adapter", "left_semi").withColumn("t", D.folded(F.col("text")))
    head = F.when(F.rlike("t", F.lit(PROGRAM)), F.struct("line_no", D.safe_date(*[F.regexp_extract("t", PROGRAM, k).try_cast("int") for k in (1, 2)], F.lit(1)).alias("d")))
    ground = F.min(head).over(Window.partitionBy("adapter", "article_id"))["d"]
    # lines are shuffled without the columns of their rules
    j = j.withColumn("ground", ground).join(F.broadcast(r), "adapter")
    base = F.when(F.col("year") == "published", F.col("published")).when(F.col("year") == "heading", F.col("ground"))
    j = j.withColumn("p", F.when(F.rlike("t", F.col("r_date")), D.period(F.col("t"), base, D.Options(max_span=366))))
    j = j.withColumn("p", F.when(F.datediff("p.end_date", "p.start_date") <= F.col("max_span"), F.col("p")))
    title, dated = F.rlike("t", F.col("r_title")) & ~F.rlike("t", F.col("blocked")), F.col("p").isNotNull()
    sign = F.when(F.rlike("t", F.col("offsite")), "X").when(title & dated, "B").when(dated, "D").when(F.rlike("t", F.col("r_venue")), "V").when(title, "T").otherwise("-")
    return j.withColumn("sign", sign)


def row_events(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """EXT-09, EXT-12, EXT-18: (adapter, article_id, title, venue, start_date, end_date), an event for each match of its source's pattern.

    The title is the match's first title line, the period its first date's, the venue its first venue's without the
    label; a match that `scope` finds an X after, or without a venue that is needed, is none.
    """
    row = F.struct("line_no", "t", "sign", "p")
    a = classified(lines, rules).groupBy("adapter", "article_id", "_rule").agg(F.array_sort(F.collect_list(row)).alias("x"))
    a = a.join(F.broadcast(_named(rules).select("_rule", "core", "scope", "title_part", "r_venue", "need_venue").distinct()), "_rule")
    a = a.withColumn("s", F.array_join(F.transform("x", lambda x: x["sign"]), ""))
    a = a.withColumn("parts", F.split(F.regexp_replace("s", F.col("core"), F.lit("\u0001$0\u0001")), "\u0001"))
    places = F.filter(F.transform("parts", lambda x, i: F.struct((i % 2 == 1).alias("hit"), F.length(F.array_join(F.slice("parts", 1, i), "")).alias("at"), F.length(x).alias("n"))), lambda x: x["hit"])
    a = a.select("*", F.explode_outer(places).alias("m")).filter("m is not null").withColumn("y", F.slice("x", F.col("m.at") + 1, F.col("m.n")))
    first = lambda signs: F.get(F.filter("y", lambda x: x["sign"].isin(*signs)), F.lit(0))
    a = a.withColumns({"e_t": first("TB"), "e_d": first("DB"), "e_v": first("V"), "rest": F.expr("substring(s, m.at + m.n + 1, length(s))")})
    near = F.contains(_extract("rest", "scope", 0), F.lit("X"))
    a = a.filter(F.col("e_t").isNotNull() & F.col("e_d").isNotNull() & ~near & (~F.col("need_venue") | F.col("e_v").isNotNull()))
    title = F.trim(F.translate(_extract("e_t.t", "title_part", 1), "『』「」", ""))
    venue = F.trim(F.regexp_replace("e_v.t", F.col("r_venue"), F.lit("")))
    return a.select("adapter", "article_id", title.alias("title"), venue.alias("venue"), "e_d.p.start_date", "e_d.p.end_date").distinct()


def sentence_events(docs: DataFrame, rules: DataFrame, *, most: int = 230) -> DataFrame:
    """EXT-17: (doc_id, title, venue, start_date, end_date) from sentences that tell of one event.

    `docs` has (adapter, doc_id, text, published), `rules` (adapter, name, venue, verb). A sentence of at most `most` characters must
    hold the name, the verb and exactly one date with its weekday, besides the day of publication in full; the venue stands after the date.
    """
    s = docs.join(F.broadcast(rules), "adapter").select("doc_id", "name", "venue", "verb", "published", F.explode_outer(F.split(D.folded(F.col("text")), "[。!?]")).alias("s")).withColumn("s", F.trim("s"))
    s = s.filter((F.length("s") <= most) & F.contains("s", F.col("name")) & F.contains("s", F.col("venue")) & F.contains("s", F.col("verb")))
    full = F.struct("published", F.date_format("published", "yyyy'年'M'月'd'日'").alias("t"))
    s = s.withColumn("s", F.replace("s", full["t"], F.lit(" ")))
    # dates and periods are exploded from lists, as Spark would read the text again for each condition on a plain column
    one = F.transform(F.array(F.filter(D.tokens(F.col("s")), lambda x: x["month"].isNotNull())), lambda x: F.when(F.size(x) == 1, x[0]))
    s = s.select("*", F.explode_outer(one).alias("d")).filter("d is not null and d.weekday <> ''")
    after = F.expr("instr(s, venue) > instr(s, concat(d.month, '月')) and instr(s, concat(d.month, '月')) > 0")
    s = s.filter(after).select("*", F.explode_outer(F.array(D.period(F.col("s"), F.col("published")))).alias("p")).filter("p is not null")
    return s.select("doc_id", F.col("name").alias("title"), "venue", "p.start_date", "p.end_date").distinct()


@dataclass(frozen=True)
class Record:
    """What an article must show to be the record of one named event. Patterns hold for the folded text of the article."""

    adapter: int
    kind: str
    title: str
    #: the part of the text that may prove anything: from this pattern to the next one; the whole text by default
    start: str = "^"
    stop: str = ""
    needs: str = ""
    venue: str = ""
    offsite: str = NEVER
    cancelled: str = "中止|延期|終了しました"
    date_label: str = ""
    year: str = "explicit"
    max_span: int = 90


def records_table(spark: SparkSession, rules: list[Record]) -> DataFrame:
    kinds = {"int": "int", "str": "string"}
    return spark.createDataFrame([astuple(r) for r in rules], ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Record)))


def verified_records(lines: DataFrame, rules: DataFrame, *, as_of: str) -> DataFrame:
    """EXT-13: (adapter, article_id, kind, reason, title, start_date, end_date): the first thing that keeps an article from
    being its source's named event, or accepted with its period.

    The title must stand in a line, all words of `needs` (separated by spaces) in the text; the section from `start` to
    `stop` must prove the venue, without a hint of another place or of a cancellation, and print one period after the label.
    """
    j = lines.join(F.broadcast(rules), "adapter").withColumn("t", D.folded(F.col("text")))
    a = j.groupBy("adapter", "article_id", *[f.name for f in fields(Record) if f.name != "adapter"], "published").agg(
        F.bool_or(F.contains("t", F.col("title"))).alias("named"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ").alias("body")
    )
    begun = _extract("body", F.concat(F.lit("((?:"), "start", F.lit(").*)$")), 1)
    part = F.when(F.col("stop") == "", F.expr("substring(begun, 2)")).otherwise(F.expr("split(substring(begun, 2), stop)[0]"))
    a = a.withColumn("begun", begun).withColumn("section", F.when(F.col("begun") != "", F.concat(F.substring("begun", 1, 1), part)).otherwise(""))
    dated = _extract("section", F.concat(F.lit("(?:"), "date_label", F.lit(") ?:? ?(.*)$")), 1)
    # what follows the label at once is the date
    near = F.when(F.rlike(dated, F.lit(r"^(?:令和|R)? ?[0-9元]")), F.substring(dated, 1, 60))
    p = D.period(near, F.when(F.col("year") == "published", F.col("published")), D.Options(max_span=366))
    a = a.withColumns({"near": near, "p": p})
    missing = F.exists(F.filter(F.split("needs", " "), lambda w: w != ""), lambda w: ~F.contains("body", w))
    reason = (
        F.when(~F.col("named"), "title_missing")
        .when(missing, "activity_missing")
        .when(F.col("section") == "", "section_missing")
        .when(F.rlike("section", F.col("cancelled")), "cancelled")
        .when(~F.rlike("section", F.col("venue")), "venue_missing")
        .when(F.rlike("section", F.col("offsite")), "offsite")
        .when(F.col("near").isNull(), "date_missing")
        .when(F.col("p").isNull() | (F.datediff("p.end_date", "p.start_date") > F.col("max_span")), "invalid_date")
        .when(F.col("p.end_date") < F.lit(as_of).cast("date"), "past")
        .otherwise("accepted")
    )
    a = a.withColumn("reason", reason)
    good: Column = F.col("reason") == "accepted"
    return a.select("adapter", "article_id", "kind", "reason", *[F.when(good, c).alias(n) for n, c in (("title", F.col("title")), ("start_date", F.col("p.start_date")), ("end_date", F.col("p.end_date")))])
