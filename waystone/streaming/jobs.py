"""Structured Streaming forms of the daily state carry-over (STM). Each has a batch twin among the queries.

Jobs read a folder of Parquet files as a stream, keep their state in the checkpoint, and stop when all files that are
there have been read. State is kept per source, so it is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waystone.operators import reconcile as R
from waystone.operators import search as S
from waystone.sources.files import scratch, written


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The file of a name in a folder, or the files in the folder of that name, as a stream, with `ts` as a timestamp of
    the session's zone."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        got = reader.parquet(f"{folder}/{name}")
    else:
        got = reader.option("pathGlobFilter", name).parquet(folder)
    return got.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in got.columns else got


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Runs a stream over what is there now and returns the folder of its output."""
    out = scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return out


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
    held = state.get[0] if state.exists else None
    said = []
    for sha in rows["content_sha"]:
        if sha is None:  # a failed fetch leaves the state as it is
            said.append("failed")
            continue
        said.append("first_seen" if held is None else "unchanged" if held == sha else "changed")
        held = sha
    if held is not None:
        state.update((held,))
    yield pd.DataFrame({"source_id": rows["source_id"], "seq": rows["seq"], "state": said})


def content_changes(snapshots: DataFrame) -> DataFrame:
    """STM-01: first_seen, changed or unchanged for each snapshot, by the hash last seen of its source."""
    return snapshots.groupBy("source_id").applyInPandasWithState(_changes, "source_id bigint, seq bigint, state string", "sha string", "append", GroupStateTimeout.NoTimeout)


def _streaks(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames))
    n, last = state.get if state.exists else (0, None)
    days, streaks = [], []
    for day, active in rows.groupby("day")["active"].any().sort_index().items():
        if day == last:  # another run on a day that was counted
            n = max(1, n) if active else 0
        else:
            n = n + 1 if active else 0
        last = day
        days.append(day)
        streaks.append(n)
    state.update((n, last))
    yield pd.DataFrame({"source_id": key[0], "run_date": days, "streak": streaks})


def day_streaks(audits: DataFrame) -> DataFrame:
    """STM-03: (source_id, run_date, streak) of active days; `audits` has source_id, day (text) and active."""
    return audits.groupBy("source_id").applyInPandasWithState(_streaks, "source_id bigint, run_date string, streak bigint", "n bigint, last string", "append", GroupStateTimeout.NoTimeout)


def _cursor(slots: int, pool: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last = state.get if state.exists else (-slots, None)
        days, starts = [], []
        for day in sorted(set(pd.concat(list(frames))["day"])):
            if day != last:
                start, last = (start + slots) % pool, day
            days.append(day)
            starts.append(start)
        state.update((start, last))
        yield pd.DataFrame({"source_id": key[0], "run_date": days, "start": starts})

    return run


def rotation_cursors(audits: DataFrame, slots: int, pool: int) -> DataFrame:
    """STM-04: the rotation's start of each source and day: a rerun on a day keeps it, the next day moves it on."""
    return audits.groupBy("source_id").applyInPandasWithState(_cursor(slots, pool), "source_id bigint, run_date string, start bigint", "start bigint, last string", "append", GroupStateTimeout.NoTimeout)


def _rechecks(days: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        found = []
        for day in sorted(set(pd.concat(list(frames))["day"])):
            if last is None or (pd.Timestamp(day) - pd.Timestamp(last)).days >= days:
                found.append(day)
                last = day
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"source_id": [key[0]] * len(found), "checked_on": found})

    return run


def due_rechecks(audits: DataFrame, days: int = 7) -> DataFrame:
    """STM-05: the days on which a source is checked if it is left alone for `days` days after each check."""
    return audits.groupBy("source_id").applyInPandasWithState(_rechecks(days), "source_id bigint, checked_on string", "last string", "append", GroupStateTimeout.NoTimeout)


def without_repeats(snapshots: DataFrame, keys: list[str], late: str = "100 days") -> DataFrame:
    """STM-06: the first of exact duplicates; state leaves when the watermark passes, later rows are rejected."""
    return snapshots.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """STM-07: counts of each day and kind. In append mode a day comes once the watermark has passed it, and its state goes."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def merged(stream: DataFrame, published: DataFrame, as_of: str, root: str | None = None) -> DataFrame:
    """STM-02: each batch is reconciled with what is published, as a new version of the table; the last one is returned.

    Batch n reads version n and writes version n + 1, so a batch that is run again, also after a restart on the same
    `root`, finds what it found before; nothing is kept in the driver.
    """
    spark = stream.sparkSession
    root = root or scratch(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{n}/_SUCCESS"))
    if not done(0):
        published.write.mode("overwrite").parquet(f"{root}/v0")

    def each(batch: DataFrame, n: int) -> None:
        held = batch.sparkSession.read.schema(published.schema).parquet(f"{root}/v{n}")
        got = R.reconcile(held, batch, as_of, keep=written)["published"].select(*published.columns)
        got.write.mode("overwrite").parquet(f"{root}/v{n + 1}")

    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(each)
    writer.start().awaitTermination()
    last = 0
    while done(last + 1):
        last += 1
    return spark.read.schema(published.schema).parquet(f"{root}/v{last}")


def snapped_visits(visits: DataFrame, places: DataFrame, most_km: float = 0.3) -> DataFrame:
    """STM-08: each visit with the nearest place within `most_km`, null where there is none: a stream-static join."""
    spark = visits.sparkSession
    out = scratch(spark)

    def each(batch: DataFrame, n: int) -> None:
        S.nearest(batch, places, "visit_id", most_km, 0.05).select("visit_id", "place_id", "distance").write.mode("overwrite").parquet(f"{out}/batch={n}")

    drained(visits, "append", each)
    return spark.read.schema("visit_id bigint, place_id bigint, distance double").parquet(out).select("visit_id", "place_id", "distance")
