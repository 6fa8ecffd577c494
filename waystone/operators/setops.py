"""Unions of feeds and of warnings (SET-01, SET-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_feeds(feeds: dict[int, DataFrame | None]) -> DataFrame | None:
    """SET-01: all feeds with a column `feed`; a feed that failed (None) counts as empty, and a column
    that a feed lacks is null there. Each feed is its own source: one scan each."""
    out = None
    for name, rows in feeds.items():
        if rows is None:
            continue
        rows = rows.withColumn("feed", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def source_warnings(audit: DataFrame, configured: DataFrame, as_of: str, limit: int, stale_days: int = 7, empty_days: int = 3) -> DataFrame:
    """SET-05: (kind, source_id, run_date) of all warnings on the sources' audits.

    `configured` has the source_id and region of each source that should be audited. Warnings without a day have none.
    """
    from waystone.operators.schedule import streaks

    own = warnings(audit, ["source_id", "run_date"], [("fetch_error", F.col("fetch_failed") > 0), ("suspended_evidence", (F.col("candidates") > 0) & (F.col("checked") == 0)), ("at_limit", F.col("candidates") >= limit)])
    last = audit.groupBy("source_id").agg(F.max("run_date").alias("run_date"))
    none = F.lit(None).cast("date")
    stale = last.filter(F.datediff(F.lit(as_of).cast("date"), "run_date") > stale_days).withColumn("kind", F.lit("stale_audit"))
    unknown = last.join(configured, "source_id", "left_anti").withColumn("kind", F.lit("unknown_source"))
    never = configured.join(last, "source_id", "left_anti").select("source_id", none.alias("run_date"), F.lit("not_audited").alias("kind"))
    empty = streaks(audit, F.col("accepted") == 0).filter(F.col("streak") == empty_days).select("source_id", "run_date", F.lit("repeatedly_empty").alias("kind"))
    by_region = audit.join(configured, "source_id").groupBy("region", "run_date").agg(F.bool_and(F.col("fetch_failed") > 0).alias("_all"), F.min("source_id").alias("source_id"))
    unreachable = by_region.filter("_all").select("source_id", "run_date", F.lit("region_unreachable").alias("kind"))
    out = own
    for more in (stale, unknown, never, empty, unreachable):
        out = out.unionByName(more)
    return out


def warnings(rows: DataFrame, key: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """SET-05: a row for each rule that a row breaks. One pass: the rules are an array that is exploded."""
    kinds = F.array_compact(F.array(*[F.when(c, kind) for kind, c in rules]))
    return rows.select(*key, F.explode(kinds).alias("kind"))
