"""Moving packed arrays between chunks of documents and blocks of hash values.

A chunk is a bounded group of whole documents, chosen by a hash of the row, so it is the same whenever a lost task runs
again. A chunk sends each distinct value once, whatever the number of its occurrences there: that pre-aggregation is
what splits hot values. Blocks see values from all chunks and answer each chunk. Chunks and blocks grow in number, not
in size, with the input: both numbers follow from the bytes of the texts.
"""

from __future__ import annotations

import functools
import inspect
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 4 << 20
#: Records of a block are held in a task at once.
BLOCK_BYTES = 16 << 20
#: Text in a Spark partition of chunks: a partition holds many chunks, one after another.
PARTITION_BYTES = 128 << 20


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set and everything runs in one process, as in tests, one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="waystone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the cluster's shared folder."""
    return f"{shared(spark)}/waystone-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder."""
    path = path or scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for intermediate tables, removed when the block ends, whether it succeeds or not."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.tables = spark, scratch(spark), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def written(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.tables += 1
        return written(df, codec, f"{self.path}/{self.tables}")

    def small(self, df: DataFrame) -> DataFrame:
        """Written in an eighth of the usual partitions: links and labels are a small share of what they come from."""
        return self.written(df.coalesce(max(1, partitions(self.spark) // 8)))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_blocks(spark: SparkSession, size: int = 0, most: int = BLOCK_BYTES) -> int:
    """Blocks of at most about `most` bytes each, for `size` bytes in all; enough of them to keep all tasks busy."""
    return max(2 * partitions(spark), -(-int(size) // most))


def in_chunks(docs: DataFrame, text: str, *keys: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """Docs dealt out by a new column `_chunk`, about `chunk_bytes` of text in each; and the bytes of text."""
    total = int(docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)
    n = max(1, -(-total // chunk_bytes))
    chunk = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.col(text)), F.lit(n)).cast("int")
    dealt = max(partitions(docs.sparkSession), -(-total // PARTITION_BYTES))
    return docs.withColumn("_chunk", chunk).repartition(dealt, "_chunk"), total


def block_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Blocks in the order of the keys: equal shares of the 64-bit range."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def cut(sorted_blocks: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_blocks, np.arange(n + 1))


def rows(chunk: int, blocks: np.ndarray, records: np.ndarray, n: int, kind: int = 0) -> pa.Table:
    """One row for each block that gets records; records are in the order of their blocks."""
    at = cut(blocks, n)
    some = np.flatnonzero(np.diff(at))
    return table([chunk] * len(some), some, [records[at[b] : at[b + 1]].tobytes() for b in some], kind)


SCHEMA = "_chunk int, _block int, _kind int, data binary"
ARROW = pa.schema([("_chunk", pa.int32()), ("_block", pa.int32()), ("_kind", pa.int32()), ("data", pa.binary())])


def table(chunks, blocks, data, kind: int = 0) -> pa.Table:
    return pa.table([pa.array(np.asarray(chunks, np.int32)), pa.array(np.asarray(blocks, np.int32)), pa.array(np.full(len(data), kind, np.int32)), pa.array(data, pa.binary())], schema=ARROW)


def gathered(got: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a table's rows, and the row of each."""
    parts = [np.frombuffer(x.as_buffer(), kind) for c in got.column("data").chunks for x in c]
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def in_order(got: pa.Table, text: str = "_text") -> pa.Table:
    """A chunk's rows by their text. Shuffles hand them over in another order each time; where places in a chunk are
    exchanged, every pass must count the same way. Rows with equal texts have the same words, so their order is free."""
    return got.take(pc.sort_indices(got.column(text)))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def keeps_columns(*made: str, roles: tuple[str, ...] = ("text",), keyed: bool = False):
    """For operators on docs: whatever columns the caller has come back, but for those named like the results `made`.

    The operator sees its `roles` (parameters that name a column, or are one) under their own names and everything else in
    one struct, so no name inside it can meet one of the caller's. `keyed` puts a hash of the whole row (without maps, which
    have none) first, by which equal texts can be dealt out. A role that the operator drops is not returned.
    """

    def wrap(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options):
            given = signature.bind(docs, *args, **options)
            given.apply_defaults()
            read = {r: given.arguments[r] for r in roles}
            named = {c: r for r, c in read.items() if isinstance(c, str)}
            own = [c for c in docs.columns if c not in made]
            field = {c: f"own.f{k}" for k, c in enumerate(own) if c not in named}
            rest = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f.removeprefix("own.")) for c, f in field.items()])
            cells = [(c if isinstance(c, Column) else F.col(f"`{c}`")).alias(r) for r, c in read.items()]
            key = [F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]).alias("key")] if keyed else []
            given.arguments["docs"] = docs.select(*key, *cells, rest.alias("own"))
            given.arguments |= {r: F.col(r) if isinstance(c, Column) else r for r, c in read.items()}
            out = operator(*given.args, **given.kwargs)
            back = [F.col(field.get(c) or named[c]).alias(c) for c in own if c in field or named[c] in out.columns]
            return out.select(*back, *[c for c in out.columns if c in made])

        return run

    return wrap
