"""A bounded sample of labelled texts for fitting classifiers; everything else in this package reads all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; an id of null is in fold 0."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % n, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, id: str = "doc_id", text: str = "text", rows: int = 10_000, folds: int = 5) -> DataFrame:
    """(_text, _label) of at most `rows` labelled ids outside fold 0, those with the smallest hashes.

    An id with several labels takes the largest. At most `rows` ids are broadcast: 16 bytes each.
    """
    some = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & (fold(id, folds) != 0)).groupBy(id).agg(F.max(label).cast("int").alias("_label"))
    some = some.orderBy(F.xxhash64(id), id).limit(rows)
    return docs.select(id, F.col(text).alias("_text")).join(F.broadcast(some), id).select("_text", "_label")
