"""Substring dedup by relative Lempel-Ziv parsing.

Texts are factored against every reference block that can hold a part of them. A window (a run of `window` words) has a
minimiser, the smallest hash of SEED_WORDS words in it; equal windows have equal minimisers. A segment is a maximal run
of windows with one minimiser in one place. All segments with one minimiser go to one block, so each repeat of a window
lies in the block of its own segment.

Round one counts minimisers alone: segments whose minimiser occurs once in the corpus repeat nowhere and stay at home.
In round two a block's reference is the words of all its segments, indexed by a suffix array. Each segment is parsed
greedily: the longest match elsewhere in the reference is the next factor. Factors shorter than a window are literals.
After each factor the windows that straddle its end are looked up as well, so a repeat split by the greedy parse is not
lost. Factors go back to the texts and cover the words to remove.

A chunk sends each distinct segment once (with a mark if it has it more than once), so a hot passage costs each chunk
one segment. Places in a chunk count its texts in their own order, whatever the order in which a shuffle brings them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textarrays as T
from .decontaminate import suffix_array

U64 = np.uint64
SEED_WORDS = 8
SEED = np.dtype([("key", "<u8"), ("many", "u1")])
#: A segment in a message: its first occurrence in the chunk (a word), its words, and whether the chunk repeats it.
SEGMENT = np.dtype([("at", "<u4"), ("size", "<u2"), ("many", "<u2")])
#: A factor: the segment it lies in (`at`), first word and length in it, and the chunk and word of the reference.
FACTOR = np.dtype([("at", "<u4"), ("start", "<u2"), ("size", "<u2"), ("chunk", "<i4"), ("ref", "<u4")])
#: Kinds of answers to a chunk.
SEEDS, FACTORS = 0, 1
RESULT = "n_words bigint, n_removed bigint, kept_text string, factors array<struct<start:int,length:int,block:int,chunk:int,position:bigint>>"


class Chunk:
    """Words of a chunk and the minimiser of each window (`low`: its value, `at`: its place)."""

    def __init__(self, text: pa.ChunkedArray, window: int) -> None:
        self.buf, self.offsets = T.utf8(text)
        self.words = T.words_of(self.buf, self.offsets, T.WHITE)
        self.hashes = T.word_hashes(self.buf, self.words)
        self.starts = np.flatnonzero(T.ngram_starts(self.words.first, window, len(self.words)))
        self.window = window

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        k = min(SEED_WORDS, self.window)
        low = T.ngram_hashes(self.hashes, k)
        at = np.arange(len(low), dtype=np.int32)
        span, width = self.window - k + 1, 1
        while width < span:
            step = min(width, span - width)
            less = low[step:] < low[:-step]
            low, at = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step])
            width += step
        return low[self.starts], at[self.starts]

    def segments(self, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """Segments with a known minimiser: first word, words, minimiser, and the distinct segment of each; and of each
        distinct one its first occurrence among the segments and whether there are more."""
        low, at = self.minimisers()
        maybe = np.flatnonzero(known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low) if len(known) else np.zeros(0, np.int64)
        start, at, low = self.starts[maybe], at[maybe], low[maybe]
        new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(at) != 0)]) if len(start) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(start))) + self.window - 1
        key = T.span_hashes(self.hashes, start[first], start[first] + size)
        _, lead, kind, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return start[first], size, low[first], kind, lead, count > 1


def _seed_records(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, `many` if one occurs more than once, in the order of their blocks; and the blocks."""
    key, count = np.unique(keys, return_counts=True)
    block = B.block_of(T.mix(key), n)
    order = np.argsort(block, kind="stable")
    out = np.zeros(len(key), SEED)
    out["key"], out["many"] = key[order], count[order] > 1
    return out, block[order]


def _seeds(window: int, n: int):
    def run(key: tuple, got: pa.Table) -> pa.Table:
        low, at = Chunk(got.column("_text"), window).minimisers()
        _, first = np.unique(at, return_index=True)
        found, block = _seed_records(low[first], n)
        return B.rows(key[0].as_py(), block, found, n)

    return run


def _to_chunks(block: int, to: np.ndarray, records: np.ndarray) -> pa.Table:
    """One row for each chunk that gets records."""
    order = np.argsort(to, kind="stable")
    to, records = to[order], records[order]
    some, at = np.unique(to, return_index=True)
    ends = np.append(at, len(to))[1:]
    return B.table(some, [block] * len(some), [records[i:j].tobytes() for i, j in zip(at, ends, strict=True)])


def _repeated(key: tuple, got: pa.Table) -> pa.Table:
    """Minimisers that occur in two chunks or twice in one, sent back to their chunks."""
    found, row = B.gathered(got, SEED)
    chunk = got.column("_chunk").to_numpy()[row]
    distinct, kind, count = np.unique(found["key"], return_inverse=True, return_counts=True)
    many = (count > 1) | (np.bincount(kind, found["many"], minlength=len(distinct)) > 0)
    keep = many[kind] if len(found) else np.zeros(0, bool)
    return _to_chunks(key[0].as_py(), chunk[keep], found["key"][keep])


def _sent(window: int, n: int):
    """A chunk's distinct segments with a repeated minimiser, to their blocks."""

    def run(key: tuple, seeds: pa.Table, got: pa.Table) -> pa.Table:
        known = np.sort(B.gathered(seeds, np.dtype("<u8"))[0])
        if not len(known) or not got.num_rows:
            return B.ARROW.empty_table()
        chunk = Chunk(B.in_order(got).column("_text"), window)
        start, size, low, _, lead, many = chunk.segments(known)
        block = B.block_of(T.mix(low[lead]), n)
        order = np.argsort(block, kind="stable")
        lead, many, block = lead[order], many[order], block[order]
        head = np.zeros(len(lead), SEGMENT)
        head["at"], head["size"], head["many"] = start[lead], size[lead], many
        at = B.cut(block, n)
        some = np.flatnonzero(np.diff(at))
        data = []
        for b in some.tolist():
            mine = head[at[b] : at[b + 1]]
            words = np.repeat(mine["at"].astype(np.int64) - np.cumsum(mine["size"], dtype=np.int64) + mine["size"], mine["size"]) + np.arange(int(mine["size"].sum(dtype=np.int64)))
            data.append(np.array([len(mine)], "<u4").tobytes() + mine.tobytes() + chunk.hashes[words].tobytes())
        return B.table([key[0].as_py()] * len(some), some, data)

    return run


class Reference:
    """A block's segments, indexed: for each word the longest match that starts elsewhere, and where, if it is at least
    a window."""

    def __init__(self, heads: np.ndarray, words: np.ndarray, window: int) -> None:
        self.heads, self.window = heads, window
        size = heads["size"].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], size)
        self.left = np.repeat(size, size) - inside
        self.longest = np.zeros(len(words), np.int64)
        self.where = np.arange(len(words))
        # a separator behind each segment, different from all words and from one another, ends every match
        at = np.arange(len(words)) + np.repeat(np.arange(len(size)), size)
        keys = np.zeros(len(words) + len(size), U64)
        names, keys[at] = np.unique(words, return_inverse=True)
        keys[self.first[1:] + np.arange(len(size))] = len(names) + np.arange(len(size), dtype=U64)
        back = np.full(len(keys), -1)
        back[at] = np.arange(len(words))
        order = suffix_array(keys, 2 * window)
        for p, q in ((order[1:], order[:-1]), (order[:-1], order[1:])):
            some = (back[p] >= 0) & (back[q] >= 0)
            some[some] = np.minimum(self.left[back[p[some]]], self.left[back[q[some]]]) >= window
            p, q = p[some], q[some]
            length = np.zeros(len(p), np.int64)
            live = np.arange(len(p))
            while len(live):
                live = live[keys[p[live] + length[live]] == keys[q[live] + length[live]]]
                length[live] += 1
            better = (length >= window) & (length > self.longest[back[p]])
            self.longest[back[p[better]]], self.where[back[p[better]]] = length[better], back[q[better]]
        # what the chunk itself repeats matches to its end
        twice = np.repeat(heads["many"] > 0, size) & (self.left >= window)
        self.longest[twice], self.where[twice] = self.left[twice], np.flatnonzero(twice)

    def parse(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and length of all factors of at least a window, for all segments at once, one factor at a step;
        among them those that straddle the end of a greedy factor."""
        hits = np.flatnonzero(self.longest)
        at, end = self.first[:-1].copy(), self.first[1:]
        live = np.arange(len(at))
        out = []
        while len(live):
            place = np.searchsorted(hits, at[live])
            to = hits[np.minimum(place, len(hits) - 1)] if len(hits) else end[live]
            some = (place < len(hits)) & (to < end[live])
            live, to = live[some], to[some]
            stop = to + self.longest[to]
            out.append(to)
            # boundary windows: every start in the last window - 1 words of the factor
            low, high = np.searchsorted(hits, np.maximum(to + 1, stop - self.window + 1)), np.searchsorted(hits, stop)
            n = np.maximum(high - low, 0)
            out.append(hits[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)])
            at[live] = stop
        start = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return start, self.longest[start]


def _factored(window: int):
    """Factors of all segments of a block against all of them, sent back to their chunks."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        heads, words = [], []
        for x in got.column("data").to_pylist():
            m = int(np.frombuffer(x, "<u4", 1)[0])
            heads.append(np.frombuffer(x, SEGMENT, m, 4))
            words.append(np.frombuffer(x, "<u8", -1, 4 + m * SEGMENT.itemsize))
        chunk = np.repeat(got.column("_chunk").to_numpy(), [len(h) for h in heads])
        reference = Reference(np.concatenate(heads), np.concatenate(words), window)
        start, size = reference.parse()
        mine, other = (np.searchsorted(reference.first, x, "right") - 1 for x in (start, reference.where[start]))
        out = np.zeros(len(start), FACTOR)
        out["at"], out["start"], out["size"] = reference.heads["at"][mine], start - reference.first[mine], size
        out["chunk"], out["ref"] = chunk[other], reference.heads["at"][other] + reference.where[start] - reference.first[other]
        return _to_chunks(key[0].as_py(), chunk[mine], out)

    return run


def _removed(window: int, names: list[str], schema: pa.Schema):
    def run(key: tuple, answers: pa.Table, got: pa.Table) -> pa.Table:
        if not got.num_rows:
            return schema.empty_table()
        got = B.in_order(got)
        chunk = Chunk(got.column("_text"), window)
        kinds = answers.column("_kind").to_numpy()
        known = np.sort(B.gathered(answers.filter(pa.array(kinds == SEEDS)), np.dtype("<u8"))[0])
        found, row = B.gathered(answers.filter(pa.array(kinds == FACTORS)), FACTOR)
        block = answers.column("_block").to_numpy()[kinds == FACTORS][row] if len(found) else np.zeros(0, np.int32)
        first, n_docs = chunk.words.first, len(chunk.words.first) - 1
        cover = np.zeros(len(chunk.words) + 1, np.int64)
        spans: list[list[dict]] = [[] for _ in range(n_docs)]
        if len(found):
            start, _, _, kind, lead, _ = chunk.segments(known)
            # the factors of a distinct segment hold for each of its occurrences
            by = np.argsort(found["at"], kind="stable")
            found, block = found[by], block[by]
            at = start[lead][kind]
            low, high = np.searchsorted(found["at"], at, "left"), np.searchsorted(found["at"], at, "right")
            n = high - low
            take = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            at = np.repeat(start, n) + found["start"][take]
            length = found["size"][take].astype(np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            doc = np.searchsorted(first, at, "right") - 1
            for d, s, m, b, c, p in zip(doc.tolist(), (at - first[doc]).tolist(), length.tolist(), block[take].tolist(), found["chunk"][take].tolist(), found["ref"][take].tolist(), strict=True):
                spans[d].append({"start": s, "length": m, "block": b, "chunk": c, "position": p})
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) if n_docs else np.zeros(0, np.int64)
        removed[np.diff(first) == 0] = 0
        kept = []
        raw = chunk.buf.tobytes()
        for d in range(n_docs):
            words = raw[chunk.offsets[d] : chunk.offsets[d + 1]].split()
            if removed[d]:
                words = [words[i] for i in np.flatnonzero(~gone[first[d] : first[d + 1]])]
            kept.append(b" ".join(words))
        made = {"n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "factors": pa.array(spans, schema.field("factors").type)}
        return pa.table([made[f.name] if f.name in made else got.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


@B.keeps_columns("n_words", "n_removed", "kept_text", "factors", keyed=True)
def remove_repeats(docs: DataFrame, *, text: str = "text", window: int = 35, chunk_bytes: int = B.CHUNK_BYTES, keep_text: bool = False) -> DataFrame:
    """Docs without the text column (with it if `keep_text`), with `kept_text`, `n_words`, `n_removed` and `factors`.

    A word is removed if a run of `window` words that covers it starts anywhere else too, in the same document or in
    another. Judged on the input: of two copies both lose the passage. Null and empty texts have no words and keep an
    empty text; a text shorter than a window keeps all its words. Repeated rows are copies of each other. Words are
    joined by one space. Other columns stay; own ones with the names of the results give way.

    A factor has its first word in the document and its length, the block that found it, and a chunk and a word there
    where the same words stand (a copy inside one chunk refers to the first).
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "factors", "_chunk", "_text", text)]
    back = [*names, "_text"] if keep_text else names
    dealt, size = B.in_chunks(docs.select(*[f"`{c}`" for c in names], F.col(text).alias("_text")), "_text", *names[:1], chunk_bytes=chunk_bytes)
    n = B.n_blocks(spark, size)
    seeds = dealt.groupBy("_chunk").applyInArrow(_seeds(window, n), B.SCHEMA).groupBy("_block").applyInArrow(_repeated, B.SCHEMA)
    found = seeds.groupBy("_chunk").cogroup(dealt.groupBy("_chunk")).applyInArrow(_sent(window, n), B.SCHEMA)
    factors = found.groupBy("_block").applyInArrow(_factored(window), B.SCHEMA).withColumn("_kind", F.lit(FACTORS))
    matched = seeds.withColumn("_kind", F.lit(SEEDS)).unionByName(factors)
    from pyspark.sql.pandas.types import to_arrow_schema

    result = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name in back), RESULT])
    schema = to_arrow_schema(spark.createDataFrame([], result).schema)
    return matched.groupBy("_chunk").cogroup(dealt.groupBy("_chunk")).applyInArrow(_removed(window, back, schema), result).withColumnRenamed("_text", "text")
