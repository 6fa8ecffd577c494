"""Deduplication of notices and reconciliation of a new collection with what is published (FLT, WIN-01 to 04, REC)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.functions import text as T
from waystone.functions import urls as U


def date(x: str) -> Column:
    return F.lit(x).cast("date")


def plausible(events: DataFrame, as_of: str) -> Column:
    """FLT-01: dates in order, not over yet, with url, station and title."""
    filled = (F.col("url") != "") & (F.col("road_name") != "") & (F.col("title") != "")
    return F.coalesce(filled & (F.col("start_date") <= F.col("end_date")) & (F.col("end_date") >= date(as_of)), F.lit(False))


def live(as_of: str) -> Column:
    """FLT-02: not over, not cancelled, not published in the future."""
    return F.coalesce((F.col("end_date") >= date(as_of)) & (F.col("status") != "cancelled") & (F.col("published_at").isNull() | (F.col("published_at") <= date(as_of))), F.lit(False))


def sanitised(events: DataFrame, most: int = 80) -> DataFrame:
    """FLT-03: fields cut to `most` characters and links that are not https blanked; `bad` marks malformed rows.

    A payload with any bad row is refused: every row carries `accepted`, false for all if any row is bad.
    """
    bad = F.col("title").isNull() | F.col("road_name").isNull() | F.col("start_date").isNull() | (F.col("start_date") > F.col("end_date"))
    rows = events.select("event_id", F.substring("title", 1, most).alias("title"), F.when(F.col("url").startswith("https://"), F.col("url")).otherwise("").alias("url"), F.coalesce(bad, F.lit(True)).alias("bad"))
    return rows.crossJoin(F.broadcast(rows.agg((F.count_if("bad") == 0).alias("accepted"))))


def without_future_stamps(events: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """FLT-04: publication dates in the future as null, and a warning for each (url, stamp)."""
    future = F.col("published_at") > date(as_of)
    warnings = events.filter(future).select("url", "published_at").dropDuplicates(["url", "published_at"])
    return events.withColumn("published_at", F.when(F.coalesce(future, F.lit(False)), None).otherwise(F.col("published_at"))), warnings


def open_start(title: Column) -> Column:
    """FLT-09: a bulletin title that begins with a range mark."""
    return F.rlike(F.trim(title), F.lit("^[～〜~]"))


def identity(events: DataFrame) -> DataFrame:
    """Adds `identity`: article id and station, or url, station and title without the station's own label."""
    article = U.article_id(F.col("url"))
    return events.withColumn("identity", F.when(article.isNotNull(), F.concat_ws("|", F.concat(F.lit("article:"), article), "road_name", F.lit(""))).otherwise(F.concat_ws("|", "url", "road_name", T.identity_title(F.col("title"), F.col("road_name")))))


def shortest_title(events: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-01: one row a key, with the shortest title, at the first row's place."""
    w = Window.partitionBy(*keys)
    rows = events.withColumn("_rn", F.row_number().over(w.orderBy(F.length("title"), "seq"))).withColumn("position", F.min("seq").over(w))
    return rows.filter("_rn = 1").drop("_rn")


def first_of(events: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WIN-02: the first row of each key."""
    return events.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def last_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """WIN-03: the row with the largest seq of each key; ties go to the largest row."""
    own = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(seq, *[c for c in own if c != seq])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in own])


def first_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """WIN-04: the row with the smallest seq of each key."""
    own = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(seq, *[c for c in own if c != seq])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in own])


def cleaned(events: DataFrame, as_of: str) -> DataFrame:
    """One side of a reconciliation: stamps cleared, badges stripped, one row for each station, period, url and title."""
    events, _ = without_future_stamps(events, as_of)
    events = events.withColumn("title", T.strip_badges(F.col("title")))
    events = shortest_title(events, ["url", "road_name", "start_date", "end_date"]).drop("position")
    return identity(first_of(events, ["url", "road_name", "prefecture", "title", "start_date", "end_date"], ["seq"]))


OUTPUTS = ("published", "exact_duplicates", "corrected", "not_reconfirmed", "possible_duplicates", "expired_or_invalid", "invalid_new")


def reconcile(old: DataFrame, new: DataFrame, as_of: str, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, DataFrame]:
    """REC-01: the outputs of merging a new collection into the published events.

    New rows are collapsed to the last of each (identity, start) and matched with the kept old rows in one pass: an
    equal key, else the only old row of the identity with an overlapping period (a correction, which replaces it). New
    rows of one identity that overlap each other are resolved in a second pass: if exactly one earlier row of the batch
    overlaps, the later one replaces it. Old rows whose identity is not seen again stay, and are reported; so are new rows that are no plausible events.

    `keep` gets the tables that the outputs read several times, and may write them.
    """
    old, new = cleaned(old, as_of), cleaned(new, as_of)
    good = plausible(old, as_of) & ~open_start(F.col("title"))
    kept, expired = old.filter(good), old.filter(~good)
    fine = plausible(new, as_of) & ~open_start(F.col("title"))
    fresh, invalid = new.filter(fine), new.filter(~F.coalesce(fine, F.lit(False)))
    fresh = fresh.withColumn("_rn", F.row_number().over(Window.partitionBy("identity", "start_date").orderBy(F.desc("seq")))).filter("_rn = 1").drop("_rn")
    kept, fresh = keep(kept), keep(fresh)
    left = kept.select("identity", F.col("start_date").alias("old_start"), F.col("end_date").alias("old_end"), F.col("event_id").alias("old_id"))
    pairs = fresh.join(left, "identity", "left")
    exact = F.col("old_start") == F.col("start_date")
    meets = (F.col("old_start") <= F.col("end_date")) & (F.col("start_date") <= F.col("old_end"))
    by = Window.partitionBy("identity", "start_date")
    marked = pairs.withColumn("_exact", F.max(F.coalesce(exact, F.lit(False))).over(by)).withColumn("_meets", F.sum(F.when(meets, 1).otherwise(0)).over(by))
    hit = F.when(F.col("_exact"), exact).otherwise((F.col("_meets") == 1) & meets)
    matched = marked.withColumn("_hit", F.coalesce(hit, F.lit(False))).groupBy("identity", "start_date").agg(
        F.max(F.when(F.col("_hit"), F.struct("old_id", "old_start", "old_end"))).alias("prev")
    )
    rows = keep(fresh.join(matched, ["identity", "start_date"]))
    same = (F.col("prev.old_start") == F.col("start_date")) & (F.col("prev.old_end") == F.col("end_date"))
    exact_rows, corrected = rows.filter(F.col("prev").isNotNull() & same), rows.filter(F.col("prev").isNotNull() & ~same)
    gone = rows.filter("prev is not null").select(F.col("prev.old_id").alias("event_id"), "identity").distinct()
    # second pass: a batch row gives way to the only later one of its identity that overlaps it
    a, b = rows.alias("a"), rows.select("identity", F.col("start_date").alias("s2"), F.col("end_date").alias("e2"), F.col("seq").alias("q2")).alias("b")
    later = a.join(b, (F.col("a.identity") == F.col("b.identity")) & (F.col("q2") > F.col("a.seq")) & (F.col("s2") <= F.col("a.end_date")) & (F.col("a.start_date") <= F.col("e2")))
    over = later.groupBy(F.col("a.identity").alias("identity"), F.col("a.start_date").alias("start_date")).count().filter("count = 1").select("identity", "start_date")
    stays = rows.drop("prev").join(over, ["identity", "start_date"], "left_anti")
    own = old.columns
    published = kept.join(gone, ["event_id", "identity"], "left_anti").select(*own).unionByName(stays.select(*own))
    unseen = kept.join(fresh.select("identity").distinct(), "identity", "left_anti").select(*own)
    return {
        "published": published,
        "exact_duplicates": exact_rows.select(*own),
        "corrected": corrected.select(*own, "prev.old_start", "prev.old_end"),
        "not_reconfirmed": unseen,
        "possible_duplicates": possible_duplicates(published),
        "expired_or_invalid": expired,
        "invalid_new": invalid.select(*own),
    }


def possible_duplicates(events: DataFrame) -> DataFrame:
    """JN-09: pairs with one station, start and identity title but different urls, the smaller url first."""
    rows = events.select("road_name", "start_date", T.identity_title(F.col("title"), F.col("road_name")).alias("t"), "url", "event_id")
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.road_name") == F.col("b.road_name")) & (F.col("a.start_date") == F.col("b.start_date")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.url") < F.col("b.url"))
    return a.join(b, on).select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"))


def overlapping(a: DataFrame, b: DataFrame, key: str, days: int = 7) -> DataFrame:
    """Rows of a (as x) joined with rows of b (as y) of the same key and an overlapping period.

    The equi-join is on the key and a stretch of `days` that both periods touch, so a busy key is split by time; a pair
    is taken in the first stretch that both touch.
    """
    def cut(rows: DataFrame, at: str) -> DataFrame:
        low, high = (F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / days) for c in ("start_date", "end_date"))
        rows = rows.filter(F.col("start_date") <= F.col("end_date")).withColumn("_low", low)
        return rows.withColumn("_part", F.explode(F.sequence(low, high))).alias(at)

    x, y = cut(a, "x"), cut(b, "y")
    on = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x._part") == F.col("y._part"))
    got = x.join(y, on).filter((F.col("x._part") == F.greatest("x._low", "y._low")))
    return got.filter((F.col("x.start_date") <= F.col("y.end_date")) & (F.col("y.start_date") <= F.col("x.end_date")))


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JN-07: rows of a with the rows of b of the same key and an overlapping period; `corrections` is true if only one."""
    got = overlapping(a, b, key).select(F.col("x.event_id").alias("new_id"), F.col("y.event_id").alias("old_id"))
    return got.withColumn("correction", F.count("*").over(Window.partitionBy("new_id")) == 1)


def merged_stage(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """REC-02: unexpired staged rows and new ones, the latest of each url, station and start."""
    both = old.filter(F.col("end_date") >= date(as_of)).unionByName(new)
    return last_wins(both.withColumn("_side", F.lit(0)).drop("_side"), ["url", "road_name", "start_date"], "seq")


def content_hash(rows: DataFrame) -> DataFrame:
    """SNK-01: an order-free fingerprint of a table: row count and the sum of the rows' hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"))


def write_if_changed(new: DataFrame, path: str) -> bool:
    """SNK-01: writes the table only if its content differs from what the folder holds; true if it wrote."""
    spark = new.sparkSession
    try:
        held = spark.read.schema(new.schema).parquet(path)
        if content_hash(held).first() == content_hash(new).first():
            return False
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("overwrite").parquet(path)
    return True
