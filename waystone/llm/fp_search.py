"""Ranked lexical search over document FP-trees.

Two passes over the texts. The first counts, for the terms of the queries, how many documents have them. The second
reduces each document to those terms, most frequent first, so that documents with the same terms share a path of a trie. A
task builds one trie for each bounded group of documents and runs all queries over it, depth first: every node knows the largest
count of each term below it and the smallest length norm, which bounds the scores below it; branches whose bound is under the
query's current k-th score are not entered. Documents at the leaves are scored exactly.

Nothing but each task's best rows is moved. Queries are sent in blocks of bounded size; each block is two passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import blocks as B
from . import textarrays as T

#: Bytes of query texts that are sent at once, about.
QUERY_BYTES = 4 << 20
#: (document, term) entries of a trie, about; and documents that a leaf holds.
TREE_ENTRIES = 1 << 20
LEAF_DOCS = 16


@dataclass
class Queries:
    """A block of queries over a vocabulary of sorted term hashes. `rank` orders terms by falling document frequency."""

    ids: pa.Array
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray
    vocab: np.ndarray
    rank: np.ndarray
    weight: np.ndarray
    n_docs: int = 0
    n_terms: int = 0

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Queries:
        owner, hashes, _ = _terms(*T.utf8(texts))
        vocab, term = np.unique(hashes, return_inverse=True)
        key, times = np.unique(owner * max(len(vocab), 1) + term, return_counts=True)
        first = np.searchsorted(key, np.arange(len(ids) + 1) * max(len(vocab), 1))
        return cls(ids, first, key % max(len(vocab), 1), times, vocab, np.arange(len(vocab)), np.zeros(len(vocab), np.int64))

    def weighted(self, df: np.ndarray, n_docs: int, n_terms: int) -> Queries:
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weight = np.empty(len(df), np.int64)
        weight[rank] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()]
        return Queries(self.ids, self.first, rank[self.term], self.times, self.vocab, rank, weight, n_docs, n_terms)

    def looked_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the vocabulary, and the ranks of those."""
        if not len(self.vocab):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        known = self.vocab[at] == hashes
        return known, self.rank[at[known]]


def _terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of each term, and terms of each document."""
    low = T.LOWER[buf]
    words = T.words_of(low, offsets, T.NOT_ALNUM)
    return words.owner(), T.word_hashes(low, words), words.counts


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = T.utf8(batch.column("text"))
    for a, b in T.pieces(offsets, 4 << 20):
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        df, docs, terms = np.zeros(len(q.vocab), np.int64), 0, 0
        for batch in batches:
            for _, _, buf, offsets in _pieces(batch):
                owner, hashes, counts = _terms(buf, offsets)
                known, rank = q.looked_up(hashes)
                docs, terms = docs + int((counts > 0).sum()), terms + int(counts.sum())
                if len(rank):
                    df += np.bincount(np.unique(owner[known] * len(q.vocab) + rank) % len(q.vocab), minlength=len(q.vocab))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[docs, terms], df[some]]))], ["term", "n"])

    return run


class Tree:
    """A compressed trie over documents' term vectors. Nodes are numbered level by level, so a node's children are neighbours.

    Documents are sorted by their vectors; a node is a range of them. A child that has more than half of its parent's documents gives
    its place to its own children, which bounds the depth by the logarithm of the documents; small neighbours share a leaf.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int) -> None:
        n = len(m)
        big = term.astype(">u4").tobytes()
        edge = (first * 4).tolist()
        vectors = [big[edge[i] : edge[i + 1]] for i in range(n)]
        self.order = np.asarray(sorted(range(n), key=vectors.__getitem__), np.int64)
        size = np.diff(first)[self.order]
        self.first = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first[self.order] - self.first[:-1], size) + np.arange(self.first[-1])
        self.term, self.tf, self.m = term[at], tf[at], m[self.order]
        self._nodes(self._common(size), size)
        self._bounds(n_terms)

    def _common(self, size: np.ndarray) -> np.ndarray:
        """Terms that each vector shares with the one before it."""
        lcp = np.zeros(len(size), np.int64)
        live = np.arange(1, len(size))
        depth = 0
        while len(live):
            live = live[(size[live] > depth) & (size[live - 1] > depth)]
            live = live[self.term[self.first[live] + depth] == self.term[self.first[live - 1] + depth]]
            depth += 1
            lcp[live] = depth
        return lcp

    def _children(self, lo: int, hi: int, lcp: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
        least = lcp[lo + 1 : hi].min()
        cuts = [lo, *(np.flatnonzero(lcp[lo + 1 : hi] == least) + lo + 1).tolist(), hi]
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if 2 * (b - a) > hi - lo and not self._leaf(a, b, lcp, size):
                out += self._children(a, b, lcp, size)
            elif out and b - out[-1][0] <= LEAF_DOCS:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def _leaf(self, lo: int, hi: int, lcp: np.ndarray, size: np.ndarray) -> bool:
        return hi - lo <= LEAF_DOCS or lcp[lo + 1 : hi].min() == size[lo:hi].max()

    def _nodes(self, lcp: np.ndarray, size: np.ndarray) -> None:
        ranges, kids, levels, parent = [(0, len(size))], [], [0, 1], [0]
        while len(kids) < len(ranges):
            for k in range(levels[-2], levels[-1]):
                lo, hi = ranges[k]
                if self._leaf(lo, hi, lcp, size):
                    kids.append((0, 0))
                    continue
                below = self._children(lo, hi, lcp, size)
                kids.append((len(ranges), len(ranges) + len(below)))
                ranges += below
                parent += [k] * len(below)
            levels.append(len(ranges))
        self.ranges, self.kids, self.levels, self.parent = np.asarray(ranges), np.asarray(kids), levels[:-1], np.asarray(parent)

    def _bounds(self, n_terms: int) -> None:
        """For each node: the terms below it with their largest tf, and the smallest m."""
        leaves = np.flatnonzero(self.kids[:, 1] == 0)
        leaf_of = np.empty(len(self.m), np.int64)
        for k in leaves.tolist():
            leaf_of[self.ranges[k, 0] : self.ranges[k, 1]] = k
        node, term, tf = _merged(np.repeat(leaf_of, np.diff(self.first)), self.term, self.tf, n_terms)
        self.low = np.full(len(self.ranges), np.iinfo(np.int64).max)
        np.minimum.at(self.low, leaf_of, self.m)
        parts = []
        for a, b in reversed(list(zip(self.levels, self.levels[1:], strict=False))):
            here = (node >= a) & (node < b)
            parts.append((node[here], term[here], tf[here]))
            if a == 0:
                break
            up, term_up, tf_up = _merged(self.parent[node[here]], term[here], tf[here], n_terms)
            node, term, tf = np.concatenate([node[~here], up]), np.concatenate([term[~here], term_up]), np.concatenate([tf[~here], tf_up])
            np.minimum.at(self.low, self.parent[a:b], self.low[a:b])
        node, self.node_term, self.node_tf = (np.concatenate(x) for x in zip(*reversed(parts), strict=True))
        order = np.argsort(node, kind="stable")
        self.node_term, self.node_tf, self.entry_node = self.node_term[order], self.node_tf[order], node[order]
        self.node_first = np.searchsorted(self.entry_node, np.arange(len(self.ranges) + 1))

    def bounds(self, a: int, b: int, weight: np.ndarray) -> np.ndarray:
        """For each of the nodes a to b a score that no document below it exceeds."""
        e = slice(self.node_first[a], self.node_first[b])
        return _sums(self.entry_node[e] - a, self.node_term[e], self.node_tf[e], self.low[a:b], weight)

    def scores(self, lo: int, hi: int, weight: np.ndarray) -> np.ndarray:
        e = slice(self.first[lo], self.first[hi])
        return _sums(np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1])), self.term[e], self.tf[e], self.m[lo:hi], weight)


def _merged(node: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = node * n_terms + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at] // n_terms, key[at] % n_terms, np.maximum.reduceat(tf[order], at) if len(at) else tf[:0]


def _sums(owner: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of w * ((10**9 * tf) div (1000 * tf + 8 * m)) in 64-bit integers; owners ascend."""
    out = np.zeros(len(m), np.int64)
    w = weight[term]
    some = np.flatnonzero(w)
    if len(some):
        owner, tf = owner[some], tf[some]
        part = w[some] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[at]] = np.add.reduceat(part, at)
    return out


class Best:
    """The `top` rows of each query so far: (-score, id is null, id)."""

    def __init__(self, n: int, top: int) -> None:
        self.rows: list[list[tuple]] = [[] for _ in range(n)]
        self.least, self.top = [1] * n, top

    def offer(self, q: int, scores: np.ndarray, ids: list) -> None:
        good = np.flatnonzero(scores >= self.least[q])
        self.rows[q] += [(-s, ids[i] is None, ids[i]) for i, s in zip(good.tolist(), scores[good].tolist(), strict=True)]
        if len(self.rows[q]) >= self.top:
            self.rows[q] = sorted(self.rows[q])[: self.top]
            self.least[q] = -self.rows[q][-1][0]


def _visit(tree: Tree, ids: list, q: Queries, best: Best, weight: np.ndarray) -> None:
    """All queries over one tree; `weight` is all zero before and after."""
    for k in range(len(q.ids)):
        own = q.term[q.first[k] : q.first[k + 1]]
        weight[own] = q.times[q.first[k] : q.first[k + 1]] * q.weight[own]
        stack = [(int(tree.bounds(0, 1, weight)[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < best.least[k]:
                continue
            a, b = tree.kids[node].tolist()
            if a == b:
                lo, hi = tree.ranges[node].tolist()
                best.offer(k, tree.scores(lo, hi, weight), ids[lo:hi])
                continue
            bounds = tree.bounds(a, b, weight)
            some = np.flatnonzero(bounds >= best.least[k])
            some = some[np.argsort(bounds[some], kind="stable")]
            stack += zip(bounds[some].tolist(), (some + a).tolist(), strict=True)
        weight[own] = 0


def _search(shared, top: int, id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        best, weight = Best(len(q.ids), top), np.zeros(len(q.vocab), np.int64)
        held: list[tuple] = []

        def visit() -> None:
            sizes, term, tf, m = (np.concatenate([h[k] for h in held]) for k in range(4))
            ids = [i for h in held for i in h[4]]
            tree = Tree(np.concatenate([[0], np.cumsum(sizes)]), term, tf, m, len(q.vocab))
            _visit(tree, [ids[i] for i in tree.order.tolist()], q, best, weight)
            held.clear()

        for batch in batches if len(q.vocab) else ():
            for a, b, buf, offsets in _pieces(batch):
                owner, hashes, counts = _terms(buf, offsets)
                known, rank = q.looked_up(hashes)
                key, tf = np.unique(owner[known] * len(q.vocab) + rank, return_counts=True)
                if not len(key):
                    continue
                docs, sizes = np.unique(key // len(q.vocab), return_counts=True)
                m = 25 + (75 * counts[docs] * q.n_docs) // q.n_terms
                held.append((sizes, key % len(q.vocab), tf, m, batch.column("id").slice(a, b - a).take(pa.array(docs)).to_pylist()))
                if sum(len(h[2]) for h in held) >= TREE_ENTRIES:
                    visit()
        if held:
            visit()
        rows = [(k, *r) for k, some in enumerate(best.rows) for r in some]
        number = np.asarray([r[0] for r in rows], np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), q.ids.take(pa.array(number)).cast(item_type), pa.array([r[3] for r in rows], id_type), pa.array([-r[1] for r in rows], pa.int64())], ["number", "item", "id", "score"]
        )

    return run


def _blocks(items: DataFrame, item: str, text: str, query_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    rows = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // query_bytes))
    for k in range(n):
        got = rows.filter(F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(n)) == k).toArrow()
        item_ids, texts = (got.column(c).combine_chunks() for c in ("item", "text"))
        yield tuple(pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (item_ids, texts))


def _reduced(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each query, first in shares of its candidates, then of what is left."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    shares = F.pmod(F.hash("id"), F.lit(B.partitions(found.sparkSession)))
    found = found.withColumn("share", shares)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("number", "share").orderBy(*order))).filter(F.col("rank") <= top)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= top)


def best_documents(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item, rank, id, score): the `top` documents with the highest scores above 0 for each item, in the columns' own names.

    Terms are `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of whole texts, with A-Z lower-cased. N documents have terms, L in all. A
    term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); an item's term, each time it occurs, adds
    weight * ((10**9 tf) div (1000 tf + 8 m)), with m = 25 + (75 n N) div L for a document of n terms.

    Equal scores rank by ascending id, null last. Null and empty texts have no terms: such documents are never found,
    such items find nothing. Repeated documents are ranked each, repeated items each have their rows. Texts of any
    length are whole; terms are told apart by 64-bit hashes. Other columns are not read; id and item must have different names.
    """
    sc = docs.sparkSession.sparkContext
    read = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_type, item_type = docs.schema[id].dataType, items.schema[item].dataType
    schema = StructType([StructField("number", IntegerType()), StructField("item", item_type), StructField("id", id_type), StructField("score", LongType())])
    out = None
    for ids, texts in _blocks(items, item, item_text, query_bytes):
        q = Queries.of(ids, texts)
        asked = sc.broadcast(q)
        stats = read.select("text").mapInArrow(_count(asked), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        counts = dict(zip(stats.column("term").to_pylist(), stats.column("n").to_pylist(), strict=True))
        asked.destroy()
        df = np.asarray([counts.get(k, 0) for k in range(len(q.vocab))], np.int64)
        ready = sc.broadcast(q.weighted(df, counts.get(-2, 0), counts.get(-1, 0)))
        found = _reduced(read.mapInArrow(_search(ready, top, to_arrow_type(id_type), to_arrow_type(item_type)), schema), top)
        found = found.select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")
        out = found if out is None else out.unionByName(found)
    return out
