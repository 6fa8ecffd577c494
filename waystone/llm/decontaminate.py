"""Benchmark decontamination over suffix arrays of the training texts.

Documents are read in shards of bounded size. Each shard gets a word-level suffix array (prefix doubling); every suffix
of every benchmark item is binary-searched in it, for all suffixes at once, one word deeper at each step. That gives
the longest verbatim match of each test suffix and its places. Documents never leave their task: there is no shuffle.

The benchmark is sent to the tasks in blocks of at most `block_words` words (an item is not cut), one block at a time:
each is a further pass over the rows, and all but the last write their result before the next block is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textarrays as T

SHARD_BYTES = 4 << 20
MATCHES = "array<struct<item_id:string,start:int,item_start:int,length:int>>"


class Suites:
    """A block of benchmark items as word hashes. `need` is the window: `window` words, or all of a shorter item's."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int) -> None:
        buf, offsets = T.utf8(pa.array(texts, pa.large_string()))
        buf = T.LOWER[buf]
        words = T.words_of(buf, offsets, T.NOT_ALNUM)
        self.ids, self.hashes, self.first = ids, T.word_hashes(buf, words), words.first
        counts = words.counts
        self.end = np.repeat(words.first[1:], counts)
        self.item = words.owner()
        self.need = np.minimum(window, counts)[self.item] if len(counts) else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(np.arange(len(self.hashes)) + self.need <= self.end)


def suffix_array(keys: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of `keys` by their first `depth` or more entries."""
    _, rank = np.unique(keys, return_inverse=True)
    rank, step = rank.astype(np.uint64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        follow = np.zeros_like(rank)
        follow[:-step] = rank[step:] + np.uint64(1)
        both = (rank << np.uint64(32)) | follow
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(np.uint64)
        if new[-1] + 1 == len(keys):
            return order
        rank = np.empty_like(rank)
        rank[order] = new
        step *= 2
    return order


def search(suites: Suites, keys: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix in `suites.starts` the range of the suffix array that shares its first `need` words."""
    s = suites.starts
    first = keys[order]
    lo, hi = np.searchsorted(first, suites.hashes[s], "left"), np.searchsorted(first, suites.hashes[s], "right")
    padded = np.concatenate([keys, np.zeros(most + 1, keys.dtype)])
    for d in range(1, most):
        live = np.flatnonzero((lo < hi) & (suites.need[s] > d))
        if not len(live):
            break
        want = suites.hashes[s[live] + d]
        for side, edge in (("left", lo), ("right", hi)):
            a, b = lo[live].copy(), hi[live].copy()
            if side == "right":
                a, b = left.copy(), hi[live].copy()
            while True:
                going = a < b
                if not going.any():
                    break
                mid = (a + b) >> 1
                got = padded[order[np.minimum(mid, len(order) - 1)] + d]
                up = going & ((got < want) if side == "left" else (got <= want))
                a = np.where(up, mid + 1, a)
                b = np.where(going & ~up, mid, b)
            if side == "left":
                left = a
            else:
                right = a
        lo[live], hi[live] = left, right
    return s, lo, hi


def matches(suites: Suites, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal verbatim matches (document, start in it, item, start in it, words) of at least an item's window."""
    n_docs = len(first) - 1
    # one entry of value 0 after each document, which equals no word: matches end there
    at = np.arange(len(hashes)) + np.repeat(np.arange(n_docs), np.diff(first))
    keys = np.zeros(len(hashes) + n_docs, np.uint64)
    keys[at] = np.maximum(hashes, 1)
    if not len(hashes) or not len(suites.starts):
        return (np.zeros(0, np.int64),) * 5
    most = int(suites.need.max())
    order = suffix_array(keys, most)
    s, lo, hi = search(suites, keys, order, most)
    size = np.maximum(hi - lo, 0)
    test = np.repeat(s, size)
    train = order[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    # only matches that can't be extended to the left; their extension to the right is the longest match
    before = np.where(train > 0, keys[train - 1], 0)
    inner = test > suites.first[suites.item[test]]
    same = inner & (before == np.maximum(suites.hashes[test - 1], 1))
    test, train = test[~same], train[~same]
    length = suites.need[test].copy()
    live = np.arange(len(test))
    while len(live):
        i, j = test[live] + length[live], train[live] + length[live]
        live = live[(i < suites.end[test[live]]) & (j < len(keys))]
        i, j = test[live] + length[live], train[live] + length[live]
        live = live[np.maximum(suites.hashes[i], 1) == keys[j]]
        length[live] += 1
    doc = np.searchsorted(first + np.arange(n_docs + 1), train, "right") - 1
    item = suites.item[test]
    return doc, train - (first + np.arange(n_docs + 1))[doc], item, test - suites.first[item], length


def _pass(suites, text: str, last: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = suites.value
        for batch in batches:
            buf, offsets = T.utf8(batch.column(text))
            for a, b in T.pieces(offsets, SHARD_BYTES):
                part = T.LOWER[buf[offsets[a] : offsets[b]]]
                words = T.words_of(part, offsets[a : b + 1] - offsets[a], T.NOT_ALNUM)
                doc, start, item, item_start, length = matches(block, T.word_hashes(part, words), words.first)
                found: list[list] = [[] for _ in range(b - a)]
                for d, i, j, k, m in zip(doc.tolist(), start.tolist(), item.tolist(), item_start.tolist(), length.tolist(), strict=True):
                    found[d].append({"item_id": block.ids[j], "start": i, "item_start": k, "length": m})
                shard = batch.slice(a, b - a)
                if last in names:
                    found = [(x or []) + y for x, y in zip(shard.column(last).to_pylist(), found, strict=True)]
                hit = np.zeros(b - a, np.int64)
                for d, spans in enumerate(found):
                    if spans:
                        mask = np.zeros(words.counts[d] + 1, np.int64)
                        for x in spans:
                            mask[x["start"]] += 1
                            mask[x["start"] + x["length"]] -= 1
                        hit[d] = np.count_nonzero(np.cumsum(mask)[:-1])
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
                columns = [shard.column(c) for c in names if c not in (last, "_n_words", "_n_hit")]
                keep = [c for c in names if c not in (last, "_n_words", "_n_hit")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind), pa.array(words.counts.astype(np.int64)), pa.array(hit)], [*keep, last, "_n_words", "_n_hit"])

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[tuple[list[str], list[str]]]:
    ids, texts, size = [], [], 0
    for x in benchmark.select(F.col(item).cast("string"), F.col(text)).filter(F.col(text).isNotNull()).toLocalIterator():
        n = len(x[1]) // 2 + 1
        if ids and size + n > block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append("" if x[0] is None else x[0])
        texts.append(x[1])
        size += n
    yield ids, texts


@B.keeps_columns("matches", "n_words", "n_hit")
def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 4_000_000) -> DataFrame:
    """Docs with `matches` (maximal verbatim matches of at least a window), `n_words` and `n_hit` (words inside any).

    A window is `window` consecutive words of an item, or all words of a shorter one. Null and empty texts have no
    words and no matches; an item without words matches nothing; repeated documents are each reported; an item id of
    null reads as the empty string. Other columns of `docs` stay; own ones named `matches`, `n_words`, `n_hit` give way.
    """
    docs = docs.drop("matches", "n_words", "n_hit")
    out, held = docs, None
    for ids, texts in _blocks(benchmark, item, item_text, block_words):
        if held is not None:
            out = B.written(out)
            held.destroy()
        held = suites = docs.sparkSession.sparkContext.broadcast(Suites(ids, texts, window))
        names = out.columns
        keep = [f for f in out.schema.fields if f.name not in ("_matches", "_n_words", "_n_hit")]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"_matches {MATCHES}", "_n_words bigint", "_n_hit bigint"])
        out = out.mapInArrow(_pass(suites, text, "_matches", names), schema)
    return out.withColumnsRenamed({"_matches": "matches", "_n_words": "n_words", "_n_hit": "n_hit"})


def contaminated(n_hit, n_words, one_in: int = 20):
    """The rule: at least one word in `one_in` lies in a match."""
    return (n_hit > 0) & (F.lit(one_in) * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Docs without the contaminated ones, in their own columns. Documents without words stay."""
    found = find_contamination(docs, benchmark, **options)
    return found.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select(*[f"`{c}`" for c in docs.columns if c in found.columns])
