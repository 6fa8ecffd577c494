"""Budgets, rotation, streaks and review orders (WIN-05 to WIN-12, SRT-02 to SRT-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(audit: DataFrame, active: Column, key: str = "source_id", day: str = "run_date", seq: str | None = None) -> DataFrame:
    """WIN-05: the length of the run of active audits that ends at each row; 0 if the row is inactive.

    Runs are counted in audited days, not calendar days: a gap does not end one. Several audits of one day count once.
    """
    order = [day] + ([seq] if seq else [])
    w = Window.partitionBy(key).orderBy(*order)
    marked = audit.withColumn("_active", F.coalesce(active, F.lit(False)))
    marked = marked.withColumn("_island", F.sum(F.when(marked["_active"], 0).otherwise(1)).over(w))
    # a day that was already counted in this island adds nothing
    first = F.lag(day).over(Window.partitionBy(key, "_island", "_active").orderBy(*order))
    marked = marked.withColumn("_new", F.when(F.col("_active") & (first.isNull() | (first != F.col(day))), 1).otherwise(0))
    n = F.sum("_new").over(Window.partitionBy(key, "_island").orderBy(*order))
    return marked.withColumn("streak", F.when(F.col("_active"), n).otherwise(0).cast("bigint")).drop("_active", "_island", "_new")


def budgeted(rows: DataFrame, key: str, order: list, budget: int, slots: int | None, start: Column) -> DataFrame:
    """WIN-06: of each source all rows if they fit the budget; else the first budget - slots by priority and `slots` of
    the rest, from the cursor on, round and round. `next` is the cursor for the next run."""
    n_slots = min(slots or max(1, budget // 4), max(1, budget // 2))
    w = Window.partitionBy(key)
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).withColumn("_start", start)
    top = budget - n_slots
    pool = F.col("_n") - top
    turn = F.pmod(F.col("rn") - top - 1 - F.col("_start"), F.greatest(pool, F.lit(1))) < n_slots
    chosen = ranked.filter((F.col("_n") <= budget) | (F.col("rn") <= top) | turn)
    return chosen.withColumn("next", F.when(F.col("_n") <= budget, 0).otherwise(F.pmod(F.col("_start") + n_slots, F.greatest(pool, F.lit(1)))).cast("bigint")).drop("_n", "_start")


def rechecked(rows: DataFrame, key: str, order: list, limit: int, as_of: str) -> DataFrame:
    """WIN-07: of each group `limit` rows; of larger groups a window that moves on by `limit` each day."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    day = F.unix_date(F.lit(as_of).cast("date")).cast("bigint") + 719163
    start = F.pmod(day * limit, F.col("_n"))
    return ranked.filter((F.col("_n") <= limit) | (F.pmod(F.col("_rn") - start, F.col("_n")) < limit)).drop("_rn", "_n")


def fair_first_pass(rows: DataFrame, station: str, seen: str, rank: list, budget: int) -> DataFrame:
    """WIN-08: one row of each unseen station before any second row, then by seen, priority and id; `budget` rows."""
    rn = F.row_number().over(Window.partitionBy(station).orderBy(*rank))
    return rows.withColumn("rn", rn).orderBy(F.when(~F.col(seen) & (F.col("rn") == 1), 0).otherwise(1), seen, *rank).limit(budget)


def eligible(rows: DataFrame, checks: DataFrame, keys: list[str], as_of: str, days: int = 7) -> DataFrame:
    """WIN-09: rows never checked, or last checked `days` or more days ago."""
    last = checks.groupBy(*keys).agg(F.max("run_date").alias("last_check"))
    joined = rows.join(last, keys, "left")
    return joined.filter(F.col("last_check").isNull() | (F.datediff(F.lit(as_of).cast("date"), "last_check") >= days))


def slot(id: Column, n: int) -> Column:
    """WIN-10: the slot of an id in a cycle of n days, by the first 8 hex digits of its sha256."""
    return F.pmod(F.conv(F.substring(F.sha2(id.cast("string"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def page_batch(rows: DataFrame, page: Column, order: list, page_size: int, cursor: tuple[int, int], budget: int) -> DataFrame:
    """WIN-11: the next `budget` rows after a (page, offset) cursor in page order."""
    numbered = rows.withColumn("page", page).withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy(*order)) - 1)
    after = (F.col("page") > cursor[0]) | ((F.col("page") == cursor[0]) & (F.col("position") >= cursor[1]))
    return numbered.filter(after).orderBy("page", "position").limit(budget)


def capped(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """WIN-12: the first n examples of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def ranked_queue(rows: DataFrame, ranks: dict[str, dict[str, int]], order: list[str], limit: int) -> DataFrame:
    """SRT-02 to SRT-06: rows by the ranks of some columns' values (unknown values last) and then by other columns."""
    by = []
    for c, values in ranks.items():
        table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
        rows = rows.withColumn(f"{c}_rank", F.coalesce(F.try_element_at(table, F.col(c)), F.lit(99)))
        by.append(f"{c}_rank")
    return rows.orderBy(*by, *order).limit(limit)


def shortlist(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """SRT-05: the first `limit` rows, and in `remaining` how many are left out."""
    left = rows.agg(F.greatest(F.lit(0), F.count("*") - limit).alias("remaining"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(left))
