"""Exact deduplication against an index of known texts: minimal perfect hashes over their digests.

Known (historical) rows are reduced to one entry for each distinct digest, and the entries are dealt into shards by the
digest's first bits. A shard holds a minimal perfect hash: digests alone in their place of a bit array are done, the
others go on to the next, smaller array; the rank of a digest's bit is its slot. A slot holds the full digest and the
place of the group's best row. A perfect hash names a slot for unknown digests too, so each lookup compares all 32
bytes. Members are repeats of known texts; digests that are no members were grouped before and stay groups of their own.

Rows are summed up by digest before they are moved, so a text with very many copies is one entry of each task. What
comes back to the rows are the groups: at most `HOT` large ones by broadcast, the others by a join on the digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from . import blocks as B
from .sampling import fold
from .textarrays import mix

#: Digests of a shard, about; a shard is held in a task.
SHARD_ROWS = 1 << 15
#: Groups of at least one row in HOT are sent to all tasks: there are at most HOT of them.
HOT = 10_000
MADE = ("keep_id", "group_size", "kept", "text_sha256", "known")


class PerfectHash:
    """A minimal perfect hash over rows of four 64-bit words: levels of bit arrays, each for what collided in the one before."""

    def __init__(self, bits: np.ndarray, sizes: list[int]) -> None:
        self.bits, self.sizes = bits, sizes
        self.rank = np.cumsum(bits) - bits

    @staticmethod
    def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        odd = mix(np.arange(4 * level + 1, 4 * level + 5, dtype=np.uint64)) | np.uint64(1)
        return (mix((words * odd).sum(axis=1, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """Rows of `words` must be distinct."""
        bits, sizes = [np.zeros(0, np.uint8)], []
        while len(words):
            size = 2 * len(words) + 1
            at = cls.place(words, len(sizes), size)
            count = np.bincount(at, minlength=size)
            bits.append((count == 1).astype(np.uint8))
            sizes.append(size)
            words = words[count[at] > 1]
        return cls(np.concatenate(bits), sizes)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """A slot for each row, -1 for rows that no level has; rows that were not built in may get any slot."""
        out, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.place(words[left], level, size)
            hit = self.bits[at] == 1
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def _column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name).combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def _one(array: pa.Array) -> pa.Array:
    """All entries as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)


def _build(entries: pa.Table) -> pa.Table:
    words = _words(entries.column("digest"))
    tool = PerfectHash.build(words)
    order = np.argsort(tool.slots(words))
    best, n = _column(entries, "best").take(pa.array(order)), _column(entries, "n").take(pa.array(order))
    return pa.table(
        {
            "shard": entries.column("shard").combine_chunks().slice(0, 1).cast(pa.int32()),
            "bits": pa.array([np.packbits(tool.bits).tobytes()], pa.binary()),
            "sizes": pa.array([tool.sizes], pa.list_(pa.int32())),
            "digests": pa.array([words[order].tobytes()], pa.binary()),
            "best": _one(best),
            "counts": _one(n),
        }
    )


def _merge(asked: pa.Table, index: pa.Table) -> pa.Table:
    """Groups of a shard: its slots with what was asked for, then what no slot holds."""
    digests, best, n, known = _column(asked, "digest"), _column(asked, "best"), _column(asked, "n"), [False] * len(asked)
    if len(index):
        words, row = _words(asked.column("digest")), index.to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])]
        held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        slot = PerfectHash(bits.astype(np.int64), row["sizes"]).slots(words) if len(words) else np.zeros(0, np.int64)
        member = (slot >= 0) & (held[slot] == words).all(axis=1) if len(words) else np.zeros(0, bool)
        first, counts = row["best"], row["counts"]
        key = lambda x: tuple(x.values())
        new, more = best.to_pylist(), n.to_pylist()
        for i in np.flatnonzero(member).tolist():
            s = slot[i]
            first[s] = min(first[s], new[i], key=key)
            counts[s] += more[i]
        other = pa.array(np.flatnonzero(~member))
        raw = row["digests"]
        digests = pa.concat_arrays([pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], digests.type), digests.take(other)])
        best, n = pa.concat_arrays([pa.array(first, best.type), best.take(other)]), pa.concat_arrays([pa.array(counts, n.type), n.take(other)])
        known = [True] * len(first) + [False] * len(other)
    return pa.table({"digest": digests, "best": best, "n": n, "known": pa.array(known, pa.bool_())})


def _entries(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each digest, with its shard: the best row (most code points, smallest id, first row) and the number of rows."""
    best = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    return rows.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("n")).withColumn("shard", F.shiftright(first * shards, 32).cast("int"))


def build_index(entries: DataFrame) -> DataFrame:
    """(shard, bits, sizes, digests, best, counts): one perfect hash for each shard, entries in the order of its slots."""
    best = entries.schema["best"].dataType
    schema = StructType(
        [StructField("shard", IntegerType()), StructField("bits", BinaryType()), StructField("sizes", ArrayType(IntegerType())), StructField("digests", BinaryType()), StructField("best", ArrayType(best)), StructField("counts", ArrayType(LongType()))]
    )
    kind = pa.list_(to_arrow_type(best))

    def run(t: pa.Table) -> pa.Table:
        got = _build(t)
        return got.set_column(4, "best", got.column("best").cast(kind))

    return entries.groupBy("shard").applyInArrow(run, schema)


def find_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text", history: Column | None = None, keep_text: bool = False) -> DataFrame:
    """Docs without their text (with it if `keep_text`), with keep_id, group_size, kept, text_sha256 and known.

    Texts are equal when they are identical without the characters `[\\x20\\x09-\\x0D]`. Of equal texts the row with the
    most code points stays, then the one with the smallest id (null is the largest), then any one: `kept`. `history` marks the rows
    that are indexed (by default those whose crc32(id) is even; null is no); the others are looked up. `known` tells whether
    the index has the text. The result doesn't depend on `history`.

    Null counts as an empty text, and all blank texts are equal. Texts are taken whole. Repeated rows are rows of their
    own, of which one stays. Empty tables give empty results. Other columns of docs stay; own ones with the names of the results give way.
    """
    spark = docs.sparkSession
    history = fold(id, 2) == 0 if history is None else history
    own = [F.col(f"`{c}`") for c in docs.columns if c not in MADE and (keep_text or c != text)]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.struct(*own).alias("own"),
        F.col(f"`{id}`").alias("id"),
        F.coalesce(history, F.lit(False)).alias("old"),
        F.unhex(F.sha2(F.regexp_replace(body, r"[ \t-\r]+", ""), 256)).alias("digest"),
        F.length(body).cast("bigint").alias("chars"),
    )
    with B.Scratch(spark) as s:
        rows = s.written(rows.withColumn("row", F.monotonically_increasing_id()))
        total = rows.count()
        shards = max(B.partitions(spark), -(-total // SHARD_ROWS))
        index = s.written(build_index(_entries(rows.filter("old"), shards)))
        asked = _entries(rows.filter("not old"), shards)
        best = asked.schema["best"].dataType
        schema = StructType([StructField("digest", BinaryType()), StructField("best", best), StructField("n", LongType()), StructField("known", BooleanType())])
        groups = s.written(asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_merge, schema))
        # at most HOT groups have so many rows; of the others each is a small key of the join
        many = max(1000, -(-total // HOT))
        groups = groups.select("digest", F.struct("best", "n", "known").alias("group"))
        hot = rows.join(F.broadcast(groups.filter(F.col("group.n") >= many)), "digest", "left")
        rest = hot.filter("group is null").drop("group").join(groups.filter(F.col("group.n") < many), "digest")
        out = hot.filter("group is not null").unionByName(rest)
        return B.written(
            out.select(
                "own.*", F.col("group.best.id").alias("keep_id"), F.col("group.n").alias("group_size"), (F.col("group.best.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("group.known").alias("known")
            )
        )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """Docs with one row of each group of equal texts, in their own columns (but for those named like the results)."""
    found = find_copies(docs, keep_text=True, **options)
    return found.filter("kept").select(*[f"`{c}`" for c in docs.columns if c not in MADE])
