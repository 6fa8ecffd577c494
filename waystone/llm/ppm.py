"""Scoring texts by prediction by partial matching (PPM) over bytes, and by word counts.

The model is a trie of byte contexts up to `ORDER` bytes, counted over all training documents. It is not sent to the
tasks: it grows with the corpus. It is split by the last two bytes of the context, so that a context of two bytes or
more lies in one block together with all contexts that it falls back to. Where two bytes are hot (more than one in
HOT_SHARE of all), the trie below them is split by three bytes, and again by four. The counts behind the contexts above
such a split, and behind contexts of one and no bytes, are tables of bounded size which every task gets. A chunk sends
its distinct (context, symbol) pairs with their training counts, gets the log probability of each, and adds them up for
its documents. Words are counted the same way.

Escape estimation is method C: a context seen n times with q distinct symbols escapes with q / (n + q). Symbols of the
longer contexts that were escaped from are excluded. Behind the empty context all bytes are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textarrays as T

ORDER = 4
#: At most so many contexts of a length are hot.
HOT_SHARE = 512
GRAM = np.dtype([("gram", "<u8"), ("count", "<u4")])
WORD = np.dtype([("key", "<u8"), ("count", "<u4")])
#: Kinds of rows: pairs, words, totals of a block of words.
GRAMS, WORDS, TOTALS = 0, 1, 2
END_OF_TEXT = np.uint64(0x5851F42D4C957F2D)
U64 = np.uint64


def grams_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ORDER bytes of context and the symbol, as one number, for each byte and each text's end (a 0 byte); and offsets.

    A text starts in the context of ORDER 0 bytes.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    wide = np.zeros(len(buf) + n * (ORDER + 1), np.uint8)
    wide[np.arange(len(buf)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, lengths)] = buf
    gram = np.zeros(max(0, len(wide) - ORDER), U64)
    for k in range(ORDER + 1):
        gram = (gram << U64(8)) | wide[k : len(wide) - ORDER + k]
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    at = np.arange(first[-1]) + np.repeat(np.arange(n) * ORDER, lengths + 1)
    return gram[at], first


def counted(values: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs where `trained`."""
    both, n = np.unique((values << U64(1)) | trained.astype(U64), return_counts=True)
    key = both >> U64(1)
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(np.where(both & U64(1), n, 0), first) if len(first) else np.zeros(0, np.int64)


def _among(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(key), bool)
    return table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key


def gram_blocks(gram: np.ndarray, n: int, hot: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The block of each pair, by the last two bytes of its context or more of them."""
    context = gram >> U64(8)
    key = context & U64(0xFFFF)
    for k in (2, 3):
        short = context & U64((1 << (8 * k)) - 1)
        longer = _among(hot[k][0], short)
        key[longer] = (context[longer] & U64((1 << (8 * k + 8)) - 1)) | U64(k << 40)
    return B.block_of(T.mix(key + U64(1)), n)


def _sides(got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, offsets = T.utf8(got.column("_text"))
    return buf, offsets, got.column("_trained").to_numpy().astype(bool)


def _chunk_grams(got: pa.Table, n: int, hot):
    buf, offsets, trained = _sides(got)
    values, first = grams_of(buf, offsets)
    gram, count = counted(values, np.repeat(trained, np.diff(first)))
    block = gram_blocks(gram, n, hot)
    order = np.argsort(block, kind="stable")
    return values, first, gram, count, order, block


def _chunk_words(got: pa.Table):
    buf, offsets, trained = _sides(got)
    buf = T.LOWER[buf]
    words = T.words_of(buf, offsets, T.WHITE)
    keys = T.word_hashes(buf, words) >> U64(1)
    each = np.repeat(trained, words.counts)
    ends = np.full(len(trained), END_OF_TEXT >> U64(1))
    key, count = counted(np.concatenate([keys, ends]), np.concatenate([each, trained]))
    return keys, words, key, count


def word_blocks(key: np.ndarray, n: int) -> np.ndarray:
    return B.block_of(key << U64(1), n)


def _sent(n: int, low):
    def run(key: tuple, got: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        _, _, gram, count, order, block = _chunk_grams(got, n, low.value[1])
        out = np.zeros(len(gram), GRAM)
        out["gram"], out["count"] = gram[order], count[order]
        _, _, words, many = _chunk_words(got)
        sent = np.zeros(len(words), WORD)
        sent["key"], sent["count"] = words, many
        return pa.concat_tables([B.rows(chunk, block[order], out, n, GRAMS), B.rows(chunk, word_blocks(words, n), sent, n, WORDS)])

    return run


class Model:
    """PPM over a block's contexts: log10 probability of (context, symbol) pairs."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, low: np.ndarray, hot: dict[int, tuple[np.ndarray, np.ndarray]], asked: np.ndarray) -> None:
        """gram, count: distinct trained pairs of ORDER bytes of context; low: 256 x 256 counts after each byte; hot: by
        length, hot contexts and 256 counts after each; asked: pairs whose probabilities will be wanted."""
        self.level = {}
        key, n = gram, count
        for k in range(ORDER, 1, -1):
            if k in hot and len(hot[k][0]):
                contexts, after = hot[k]
                own = ~_among(contexts, key >> U64(8))
                some = np.flatnonzero(_among(np.unique((asked >> U64(8)) & U64((1 << (8 * k)) - 1)), contexts))
                c, symbol = np.nonzero(after[some])
                key = np.concatenate([key[own], (contexts[some][c] << U64(8)) | symbol.astype(U64)])
                n = np.concatenate([n[own], after[some][c, symbol]])
                order = np.argsort(key)
                key, n = key[order], n[order]
            self.level[k] = self._level(key, n)
            short = key & U64((1 << (8 * k)) - 1)
            key, back = np.unique(short, return_inverse=True)
            n = np.bincount(back, n, minlength=len(key))
        b, s = np.nonzero(low)
        one = (b.astype(U64) << U64(8)) | s.astype(U64)
        self.level[1] = self._level(one, low[b, s].astype(float))
        zero = low.sum(0)
        s = np.flatnonzero(zero)
        self.level[0] = self._level(s.astype(U64), zero[s].astype(float))

    @staticmethod
    def _level(key: np.ndarray, n: np.ndarray):
        """Pairs and counts; contexts with total, distinct symbols and the pairs' context."""
        context, start = np.unique(key >> U64(8), return_index=True)
        size = np.diff(np.append(start, len(key)))
        of = np.repeat(np.arange(len(context)), size)
        return key, n.astype(float), context, np.bincount(of, n, minlength=len(context)), size.astype(float), of

    @staticmethod
    def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return at, table[at] == key

    def log10(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        # of the next longer context that was escaped from: its place, or -1
        above, above_k = np.full(len(gram), -1), -1
        for k in range(ORDER, -1, -1):
            pair, n, context, total, distinct, _ = self.level[k]
            g = gram[open_] & U64((1 << (8 * (k + 1))) - 1)
            at, seen = self._find(context, g >> U64(8))
            gone, out_of = np.zeros(len(g)), np.zeros(len(g))
            if above_k == k + 1:
                has = above >= 0
                x, q = self._excluded(k + 1)
                gone[has], out_of[has] = x[above[has]], q[above[has]]
            if len(context):
                left, types = total[at] - gone, distinct[at] - out_of
            else:
                left = types = np.zeros(len(g))
            to, found = self._find(pair, g)
            found &= seen
            some = seen & (left + types > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.flatnonzero(found)
                out[open_[hit]] += np.log10(n[to[hit]] / (left[hit] + types[hit])) if len(hit) else 0
                miss = np.flatnonzero(some & ~found)
                out[open_[miss]] += np.log10(types[miss] / (left[miss] + types[miss]))
            stay = ~found
            above = np.where(seen, at, -1)[stay]
            above_k = k
            open_ = open_[stay]
        if len(open_):
            symbols = self.level[0][4]
            known = symbols[0] if len(symbols) else 0
            out[open_] -= np.log10(256 - known) if known < 256 else 0
        return out

    def _excluded(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each context of k bytes: counts in the next shorter context of its symbols, and their number."""
        pair, _, context, _, distinct, of = self.level[k]
        shorter, n = self.level[k - 1][0], self.level[k - 1][1]
        at, found = self._find(shorter, pair & U64((1 << (8 * k)) - 1))
        return np.bincount(of, np.where(found, n[at] if len(n) else 0, 0), minlength=len(context)), distinct


def _answered(low):
    def run(key: tuple, got: pa.Table) -> pa.Table:
        block = key[0].as_py()
        kinds, chunks = got.column("_kind").to_numpy(), got.column("_chunk").to_numpy()
        made = []
        mine = got.filter(pa.array(kinds == GRAMS))
        if mine.num_rows:
            found, row = B.gathered(mine, GRAM)
            gram, back = np.unique(found["gram"], return_inverse=True)
            n = np.bincount(back, found["count"], minlength=len(gram))
            prob = Model(gram[n > 0], n[n > 0], *low.value, gram).log10(gram).astype(np.float32)[back]
            at = np.searchsorted(row, np.arange(mine.num_rows + 1))
            made.append(B.table(chunks[kinds == GRAMS], [block] * mine.num_rows, [prob[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], GRAMS))
        mine = got.filter(pa.array(kinds == WORDS))
        if mine.num_rows:
            found, row = B.gathered(mine, WORD)
            key_, back = np.unique(found["key"], return_inverse=True)
            n = np.bincount(back, found["count"], minlength=len(key_)).astype("<u8")
            at = np.searchsorted(row, np.arange(mine.num_rows + 1))
            each = n[back]
            made.append(B.table(chunks[kinds == WORDS], [block] * mine.num_rows, [each[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], WORDS))
            made.append(B.table([-1], [block], [f"{n.sum()},{np.count_nonzero(n)}".encode()], TOTALS))
        return pa.concat_tables(made) if made else B.ARROW.empty_table()

    return run


def _joined(got: pa.Table, kind: int, dtype: str) -> np.ndarray:
    """A chunk's answers in the order of blocks, which is the order in which it sent its values."""
    mine = got.filter(pa.array(got.column("_kind").to_numpy() == kind)).sort_by("_block")
    return B.gathered(mine, np.dtype(dtype))[0]


def _scored(n: int, low, schema: pa.Schema):
    def run(key: tuple, answers: pa.Table, got: pa.Table) -> pa.Table:
        if not got.num_rows:
            return schema.empty_table()
        values, first, gram, _, order, _ = _chunk_grams(got, n, low.value[1])
        prob = np.empty(len(gram))
        prob[order] = _joined(answers, GRAMS, "<f4")
        score = np.add.reduceat(prob[np.searchsorted(gram, values)], first[:-1])
        keys, words, distinct, _ = _chunk_words(got)
        count = _joined(answers, WORDS, "<u8")
        each = count[np.searchsorted(distinct, keys)]
        end = count[np.searchsorted(distinct, END_OF_TEXT >> U64(1))]
        both = np.cumsum(np.concatenate([[0.0], np.log10(each + 1.0)]))
        known = np.cumsum(np.concatenate([[0], each > 0]))
        a, b = words.first[:-1], words.first[1:]
        made = {"n_tokens": b - a + 1, "n_known": known[b] - known[a] + int(end > 0), "_counts": both[b] - both[a] + np.log10(end + 1.0), "score": score}
        return pa.table([pa.array(made[f.name]).cast(f.type) if f.name in made else got.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def _bytes_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.zeros(65536, np.int64)
    for batch in batches:
        buf, offsets = T.utf8(batch.column(0))
        for a, b in T.pieces(offsets):
            values, _ = grams_of(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            low += np.bincount((values & U64(0xFFFF)).astype(np.int64), minlength=65536)
    some = np.flatnonzero(low)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(low[some])], ["pair", "n"])


def _symbols_after(contexts: np.ndarray, k: int):
    """Counts of each symbol after the given contexts of k bytes, as (place of the context, symbol)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256 * len(contexts), np.int64)
        for batch in batches:
            buf, offsets = T.utf8(batch.column(0))
            for a, b in T.pieces(offsets):
                values, _ = grams_of(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                context = (values >> U64(8)) & U64((1 << (8 * k)) - 1)
                some = np.flatnonzero(_among(contexts, context))
                n += np.bincount(256 * np.searchsorted(contexts, context[some]) + (values[some] & U64(255)).astype(np.int64), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["pair", "n"])

    return run


def _summed(texts: DataFrame, counted) -> tuple[np.ndarray, np.ndarray]:
    got = texts.mapInArrow(counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return got["pair"].to_numpy(), got["n"].to_numpy()


def shared_counts(texts: DataFrame) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Counts after contexts of one byte, and after the hot contexts of two and three; all of bounded size."""
    after = np.zeros((256, 256))
    pair, n = _summed(texts, _bytes_after)
    after[pair >> 8, pair & 255] = n
    least = max(1, after.sum() // HOT_SHARE)
    hot = {k: (np.zeros(0, U64), np.zeros((0, 256))) for k in (2, 3)}
    # a context of k bytes is a shorter context and its symbol
    known, table = np.arange(256, dtype=U64), after
    for k in (2, 3):
        c, symbol = np.nonzero(table >= least)
        known = np.sort((known[c] << U64(8)) | symbol.astype(U64))
        if not len(known):
            break
        table = np.zeros((len(known), 256))
        pair, n = _summed(texts, _symbols_after(known, k))
        table[pair >> 8, pair & 255] = n
        hot[k] = known, table
    return after, hot


@B.keeps_columns("n_tokens", "n_known", "score", "train_tokens", "base_score", roles=("text", "trained"), keyed=True)
def score_texts(docs: DataFrame, trained, *, text: str = "text", chunk_bytes: int = B.CHUNK_BYTES) -> DataFrame:
    """Docs without the text column, with `score`, `base_score`, `n_tokens`, `n_known` and `train_tokens`.

    `trained` is a boolean column: the rows to learn from; null counts as true. `score` is the log10 probability of the
    text's bytes and its end. Null and empty texts have only the end. Without any training row every byte is equally
    likely. Repeated rows each count. Other columns stay; own ones with the names of the results give way.
    """
    spark = docs.sparkSession
    taken = ("score", "base_score", "n_tokens", "n_known", "train_tokens", "_counts", "_text", "_trained", "_chunk", text)
    names = [c for c in docs.columns if c not in taken]
    rows = docs.select(*[f"`{c}`" for c in names], F.col(text).alias("_text"), F.coalesce(trained, F.lit(True)).alias("_trained"))
    low = spark.sparkContext.broadcast(shared_counts(rows.filter("_trained").select("_text")))
    dealt, size = B.in_chunks(rows, "_text", *names[:1], chunk_bytes=chunk_bytes)
    n = B.n_blocks(spark, size)
    answers = dealt.groupBy("_chunk").applyInArrow(_sent(n, low), B.SCHEMA).groupBy("_block").applyInArrow(_answered(low), B.SCHEMA)
    both = F.split(F.col("data").cast("string"), ",")
    totals = answers.filter(F.col("_kind") == TOTALS).agg(F.coalesce(F.sum(both[0].cast("bigint")), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum(both[1].cast("bigint")), F.lit(0)).alias("_types"))
    from pyspark.sql.pandas.types import to_arrow_schema

    result = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name in names), "n_tokens bigint, n_known bigint, _counts double, score double"])
    schema = to_arrow_schema(spark.createDataFrame([], result).schema)
    scored = answers.filter(F.col("_kind") != TOTALS).groupBy("_chunk").cogroup(dealt.groupBy("_chunk")).applyInArrow(_scored(n, low, schema), result)
    return scored.crossJoin(F.broadcast(totals)).withColumn("base_score", F.col("_counts") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("_types") + 1)).drop("_counts", "_types")
