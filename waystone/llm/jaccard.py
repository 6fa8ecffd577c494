"""N-gram Jaccard join with several global orders.

For one global order of all tokens (here: shingles), two sets with Jaccard similarity of t or more share a token among
the first n - ceil(t n) + 1 tokens of each, n being that set's size. That holds for every order, so a candidate must
pass the test under each of them. The first order puts frequent shingles last and makes the index; two more orders, by
hashes, are intersected with it before any pair is verified on its full sets. There the prefixes also bound what two
sets share: as much as their prefixes do, and at most the smaller of the rests behind them.

Before the sets themselves are compared, a bitmap filter bounds their difference from below: each set has the parities
of its tokens' hashes in BITS bits, and sets differ in at least as many tokens as their bitmaps do in bits. As that says
little of large sets, those have a second bitmap of about a bit a token, and pairs must pass it before prefixes move.

Texts are turned into sets twice: once to count frequent shingles, once to write each row's set and its index entries.
Sets that share an index entry with another one are read again for their bitmaps and their prefixes under the other
orders; only sets of pairs that pass all filters move with their texts.

Equal sets are one class from the start. A bucket (the sets with one prefix shingle) is not expanded into all its pairs.
A round offers candidates between sets that no link joins so far: all of a bucket's passing pairs if they are few for
its members, else a spanning forest of them by nearest bitmaps. The first round takes only the leading shingles of each
set, and in a bucket of more than SMALL members tries each member with the one nearest to the majority of the bitmaps,
so a large group of copies takes one pair for each. A bucket that offered all its passing pairs is done; what counts as
few grows until all are, in the fourth round at the latest, so each link between components is found.

Blocks of the index hold a bounded number of bytes, and very frequent shingles are dealt to blocks of their own by set.
Buckets of more than TILE sets are compared in tiles: the members of their largest component each in few, as they are
not compared with each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textarrays as T
from .graph import components

U64 = np.uint64
ENTRY = np.dtype([("token", "<u8"), ("set", "<i8"), ("size", "<u4"), ("at", "<u2")])
BITS, SMALL, TILE = 512, 64, 2048
#: Entries that a task gathers before it sends them to their blocks.
SENT_AT_ONCE = 400_000
#: A shingle that the corpus has so often is dealt to blocks by set.
HOT = 200_000
#: Prefix shingles that the first round looks at: near copies mostly share the first.
LEADING = 2
#: Bits of the filter that picks the texts to be read again, in maps of 32,768: 8 MB however large the corpus is.
FILTER_MAPS, MAP_BITS = 2048, 32768
#: Keys of the second and third order: tokens multiplied by these and mixed.
ORDERS = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))


class Sets:
    """The distinct shingles of several texts: `token` sorted within each text, `first` offsets, `name` of each set."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, n: int) -> None:
        buf = T.LOWER[buf]
        words = T.words_of(buf, offsets, T.WHITE)
        hashes = T.word_hashes(buf, words)
        docs = len(offsets) - 1
        owner = words.owner()
        good = T.ngram_starts(words.first, n, len(words))
        token, doc = T.ngram_hashes(hashes, n)[good], owner[: len(good)][good]
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        if len(short):
            extra = np.array([T.ngram_hashes(hashes[words.first[d] : words.first[d + 1]], words.counts[d])[0] ^ U64(words.counts[d]) for d in short], U64)
            token, doc = np.concatenate([token, extra]), np.concatenate([doc, short])
        token = token >> U64(1)
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        self.token, self.doc = token[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(docs + 1))
        self.size = np.diff(self.first)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(T.mix(self.token + U64(1)), dtype=U64)])
        self.name = T.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(U64)).astype(np.int64)


def prefix(size: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(size > 0, size + (num * size) // -den + 1, 0)


def first_by(sets: Sets, key: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each set's prefix tokens under the order of `key`, set by set, and their places in the order."""
    order = np.lexsort((key, sets.doc))
    rank = np.arange(len(order)) - np.repeat(sets.first[:-1], sets.size)
    some = rank < np.repeat(prefix(sets.size, num, den), sets.size)
    return order[some], rank[some]


def rare_first(sets: Sets, common: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """As first_by, for the first order: by token, frequent ones (those in `common`) last and by `rank`.

    Tokens are sorted already, so only the frequent ones are moved.
    """
    token, doc = sets.token, sets.doc
    often = np.zeros(len(token), bool)
    if len(common) and len(token):
        at = np.minimum(np.searchsorted(common, token), len(common) - 1)
        often = common[at] == token
    seen = np.concatenate([[0], np.cumsum(~often)])
    place = seen[:-1] - seen[sets.first[:-1]][doc]
    moved = np.flatnonzero(often)
    if len(moved):
        moved = moved[np.lexsort((rank[at[moved]], doc[moved]))]
        order = np.arange(len(moved)) - np.searchsorted(doc[moved], doc[moved])
        place[moved] = (seen[sets.first[1:]] - seen[sets.first[:-1]])[doc[moved]] + order
    some = np.flatnonzero(place < prefix(sets.size, num, den)[doc])
    return some, place[some]


def bitmaps(sets: Sets) -> np.ndarray:
    """A row of BITS / 64 words for each set: the parities of its tokens by hash."""
    odd = np.bincount(sets.doc * BITS + _bit(sets) % BITS, minlength=len(sets.size) * BITS).reshape(-1, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(U64)


def _bit(sets: Sets) -> np.ndarray:
    return (T.mix(sets.token ^ U64(0x2545F4914F6CDD1D)) >> U64(40)).astype(np.int64)


def wide_bitmaps(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of sets of more than BITS tokens, one after another, and the ends of all sets' words: as many bits as the
    least power of two that is no less than the set's size."""
    width = np.where(sets.size > BITS, 1 << np.ceil(np.log2(np.maximum(sets.size, 1))).astype(np.int64), 0)
    ends = np.concatenate([[0], np.cumsum(width)])
    large = width[sets.doc] > 0
    doc = sets.doc[large]
    odd = np.bincount(ends[doc] + _bit(sets)[large] % width[doc], minlength=ends[-1]) & 1
    return np.packbits(odd.astype(np.uint8)).view(U64), ends // 64


def _texts(batches: Iterator[pa.RecordBatch], column: str, n: int):
    for batch in batches:
        buf, offsets = T.utf8(batch.column(column))
        for a, b in T.pieces(offsets):
            yield batch.slice(a, b - a), Sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)


def _often(n: int, at_once: int, least: int):
    """Shingles that `least` or more of about at_once shingles are; a row of token -1 has the number of all shingles."""

    def flush(parts):
        token, count = np.unique(np.concatenate(parts), return_counts=True)
        some = count >= least
        return pa.RecordBatch.from_arrays([pa.array(np.append(token[some].astype(np.int64), -1)), pa.array(np.append(count[some], count.sum()))], ["token", "n"])

    def run(batches):
        parts, size = [], 0
        for _, sets in _texts(batches, "_text", n):
            parts.append(sets.token)
            size += len(sets.token)
            if size >= at_once:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def _indexed(n: int, num: int, den: int, blocks: int, often, names: list[str]):
    """A row for each text, with its number, its set's name and size; and rows of packed entries for each block.

    Blocks from `blocks` on take the shingles that are hot, dealt by set.
    """

    def flush(parts):
        out, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        block = np.where(hot, blocks + (T.mix(out["set"].astype(U64)) % U64(blocks)).astype(np.int64), B.block_of(T.mix(out["token"]), blocks))
        order = np.argsort(block, kind="stable")
        return B.rows(0, block[order], out[order], 2 * blocks)

    def run(batches):
        from pyspark import TaskContext

        common, rank, count = often.value
        parts, size, kinds, made = [], 0, None, [*names, "_row", "_set", "_size", "_block", "data"]
        row = TaskContext.get().partitionId() << 40

        def sent():
            got = flush(parts)
            none = [pa.nulls(len(got), k) for k in [*kinds, *[pa.int64()] * 3]]
            return pa.RecordBatch.from_arrays([*none, *(got.column(c).combine_chunks() for c in ("_block", "data"))], made)

        for part, sets in _texts(batches, "_text", n):
            own = [part.column(c) for c in names]
            kinds = [c.type for c in own]
            m = len(part)
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(row, row + m)), pa.array(sets.name, mask=sets.size == 0), pa.array(sets.size.astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], made)
            row += m
            at, place = rare_first(sets, common, rank, num, den)
            # copies among these texts send their tokens once
            lead = np.zeros(len(sets.size), bool)
            lead[np.unique(sets.name, return_index=True)[1]] = True
            some = lead[sets.doc[at]]
            at, place = at[some], place[some]
            out = np.zeros(len(at), ENTRY)
            out["token"], out["set"], out["size"] = sets.token[at], sets.name[sets.doc[at]], sets.size[sets.doc[at]]
            out["at"] = np.minimum(place, 65535)
            hot = np.zeros(len(at), bool)
            if len(common):
                to = np.minimum(np.searchsorted(common, out["token"]), len(common) - 1)
                hot = (common[to] == out["token"]) & (count[to] >= HOT)
            parts.append((out, hot))
            size += len(out)
            if size >= SENT_AT_ONCE:
                yield sent()
                parts, size = [], 0
        if size:
            yield sent()

    return run


BUCKET = "token bigint, set bigint, size int, at int"


def fits(size_a, at_a, size_b, at_b, num: int, den: int) -> np.ndarray:
    """Whether two sets can be similar if this token, at these places of their orders, is their first common one.

    Similar sets share at least num / (num + den) of their sizes' sum, all of it from the first common token on.
    """
    least = -(-num * (size_a + size_b) // (num + den))
    return (den * np.minimum(size_a, size_b) >= num * np.maximum(size_a, size_b)) & (size_a - at_a >= least) & (size_b - at_b >= least)


def _runs(starts: np.ndarray, ends: np.ndarray, pairs: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j inside each run, in batches of about so many."""
    if not len(starts):
        return
    split = np.flatnonzero(np.diff(np.cumsum((ends - starts) ** 2) // pairs)) + 1
    for s, e in zip(np.split(starts, split), np.split(ends, split), strict=True):
        first = np.cumsum(e - s) - (e - s)
        member = np.arange((e - s).sum()) + np.repeat(s - first, e - s)
        n = np.repeat(e, e - s) - member - 1
        i = np.repeat(member, n)
        yield i, i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _with_partner(found: np.ndarray, num: int, den: int) -> np.ndarray:
    """Entries (in the order of token and size) that can be the first common token of a similar pair. Buckets of more
    than 64 are only judged by the next sizes."""
    token, size, at = found["token"], found["size"].astype(np.int64), found["at"].astype(np.int64)
    near = (token[1:] == token[:-1]) & (den * size[:-1] >= num * size[1:])
    keep = np.concatenate([near, [False]]) | np.concatenate([[False], near]) if len(found) else np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(found) else np.zeros(0, np.int64)
    ends = np.append(starts, len(found))[1:]
    small = ends - starts <= 64
    some = np.zeros(len(found), bool)
    for i, j in _runs(starts[small], ends[small]):
        good = fits(size[i], at[i], size[j], at[j], num, den)
        some[i[good]] = some[j[good]] = True
    large = np.repeat(~small, ends - starts)
    return np.where(large, keep, some)


def _buckets(num: int, den: int, blocks: int):
    """Members of buckets that have others near their size. A block of hot shingles has only part of their sets, so all
    of those stay."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        found, _ = B.gathered(got, ENTRY)
        token = found["token"]
        whole = key[0].as_py() < blocks
        if len(found) and whole:
            order = np.argsort(token)
            near = token[order][1:] == token[order][:-1]
            found = found[order[np.concatenate([near, [False]]) | np.concatenate([[False], near])]]
        found = found[np.lexsort((found["set"], found["size"], found["token"]))]
        if len(found):
            found = found[np.concatenate([[True], (found["token"][1:] != found["token"][:-1]) | (found["set"][1:] != found["set"][:-1])])]
        if whole:
            found = found[_with_partner(found, num, den)]
        return pa.table([pa.array(found["token"].astype(np.int64)), pa.array(found["set"]), pa.array(found["size"].astype(np.int32)), pa.array(found["at"].astype(np.int32))], names=["token", "set", "size", "at"])

    return run


PROFILE = "_set bigint, _size int, _bits array<bigint>, _wide array<bigint>, _second array<int>, _third array<int>"


def _profiled(n: int, num: int, den: int):
    """Sizes, both bitmaps, and prefixes under the further orders: the tokens' keys cut to 31 bits, ascending."""

    def run(batches):
        for _, sets in _texts(batches, "_text", n):
            made = []
            for odd in ORDERS:
                key = T.mix(sets.token * odd)
                at, _ = first_by(sets, key, num, den)
                ends = np.concatenate([[0], np.cumsum(prefix(sets.size, num, den))])
                made.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((key[at] >> U64(33)).astype(np.int32))))
            bits = bitmaps(sets)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits.reshape(-1).view(np.int64)))
            wide, ends = wide_bitmaps(sets)
            wide = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(wide.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sets.name), pa.array(sets.size.astype(np.int32)), bits, wide, *made], ["_set", "_size", "_bits", "_wide", "_second", "_third"])

    return run


def forest(i: np.ndarray, j: np.ndarray, gap: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of pairs that join all labels which the pairs join, the nearest ones (Boruvka's rounds)."""
    order = np.argsort(gap, kind="stable")
    _, both = np.unique(np.concatenate([label[i], label[j]]), return_inverse=True)
    a, b = both[: len(i)][order], both[len(i) :][order]
    chosen = []
    while len(order):
        n = int(max(a.max(), b.max())) + 1
        first = np.full(n, len(order))
        place = np.arange(len(order))
        np.minimum.at(first, a, place)
        np.minimum.at(first, b, place)
        seen = np.flatnonzero(first < len(order))
        pick = first[seen]
        chosen.append(order[np.unique(pick)])
        to = np.arange(n)
        to[seen] = a[pick] + b[pick] - seen
        mutual = (to[to] == np.arange(n)) & (to > np.arange(n))
        to[mutual] = np.flatnonzero(mutual)
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        left = a != b
        order, a, b = order[left], a[left], b[left]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def central(size: np.ndarray, bits: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each member (sorted by size) and the one nearest to the majority of bitmaps, by bands of size."""
    out_i, out_j, s = [], [], 0
    while s < len(size):
        e = int(np.searchsorted(num * size, den * size[s], "right"))
        shown = np.unpackbits(bits[s:e].view(np.uint8), axis=1)
        most = np.packbits(2 * shown.sum(0, dtype=np.int64) > e - s).view(U64)
        hub = s + int(np.bitwise_count(bits[s:e] ^ most).sum(1, dtype=np.int64).argmin())
        rest = np.delete(np.arange(s, e), hub - s)
        out_i.append(np.full(len(rest), hub))
        out_j.append(rest)
        s = e
    return np.concatenate(out_i), np.concatenate(out_j)


def _compared(num: int, den: int, first: bool, most: float):
    """Candidates of each bucket or tile: pairs of different components that pass the filters.

    All of them if they are at most `most` for each member, else a forest of them, marked with their bucket. `first`:
    nothing is joined yet, and large buckets only give pairs with central members.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        order = np.lexsort((got["set"].to_numpy(), got["size"].to_numpy(), got["token"].to_numpy(), got["_tile"].to_numpy()))
        col = lambda c: got[c].to_numpy()[order].astype(np.int64)
        token, tile, name, size, at, root, side = (col(c) for c in ("token", "_tile", "set", "size", "at", "root", "_side"))
        words = got["_bits"].combine_chunks()
        bits = words.flatten().to_numpy().reshape(-1, BITS // 64)[order].view(U64)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(token) != 0) | (np.diff(tile) != 0)]))
        ends = np.append(starts[1:], len(token))
        run_of = np.repeat(np.arange(len(starts)), ends - starts)
        crossed = (tile >= 0) & (tile >> 20 != tile & ((1 << 20) - 1))
        none = np.zeros(0, np.int64)
        out = []

        def sent():
            i, j, whole = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, np.zeros(0, bool))
            out.clear()
            a, b = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
            # a pair that several buckets have is sent once, and once more for each bucket that it thins
            thin = np.where(whole, 0, token[i])
            order = np.lexsort((thin, b, a))
            a, b, whole, thin = a[order], b[order], whole[order], thin[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (thin[1:] != thin[:-1])]) if len(a) else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(thin[new], mask=whole[new])], ["a", "b", "thin"])

        def good(i, j):
            some = (root[i] != root[j]) & fits(size[i], at[i], size[j], at[j], num, den) & (~crossed[i] | (side[i] != side[j]))
            i, j = i[some], j[some]
            gap = np.concatenate([np.bitwise_count(bits[i[k : k + 100_000]] ^ bits[j[k : k + 100_000]]).sum(1, dtype=np.int64) for k in range(0, len(i), 100_000)] or [i])
            some = (num + den) * gap <= (den - num) * (size[i] + size[j])
            return i[some], j[some], gap[some]

        def thinned(i, j, gap, members):
            if len(i) <= most * members:
                return i, j, np.ones(len(i), bool)
            some = forest(i, j, gap, root)
            return i[some], j[some], np.zeros(len(some), bool)

        count = ends - starts
        small = count <= SMALL
        # buckets of few members together, in batches of bounded size
        for i, j in _runs(starts[small], ends[small]):
            i, j, gap = good(i, j)
            many = np.bincount(run_of[i], minlength=len(starts)) > most * count
            few = ~many[run_of[i]]
            out.append((i[few], j[few], np.ones(int(few.sum()), bool)))
            for r in np.flatnonzero(many).tolist():
                mine = np.flatnonzero(run_of[i] == r)
                out.append(thinned(i[mine], j[mine], gap[mine], count[r]))
        for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
            if first:
                i, j = central(size[s:e], bits[s:e], num, den)
                i, j, _ = good(s + i, s + j)
                out.append((i, j, np.zeros(len(i), bool)))
                continue
            # members of the largest component are only compared with the others
            labels, of, n = np.unique(root[s:e], return_inverse=True, return_counts=True)
            top = of == n.argmax()
            rows = s + np.concatenate([np.flatnonzero(~top), np.flatnonzero(top)])
            held, whole, n_rest = (none, none, none), True, int((~top).sum())
            for x in range(0, n_rest, SMALL):
                a, b = np.meshgrid(np.arange(x, min(n_rest, x + SMALL)), np.arange(x, e - s), indexing="ij")
                later = b > a
                i, j, gap = good(rows[a[later]], rows[b[later]])
                if np.isinf(most):  # every pair is wanted, so none is held back
                    out.append((i, j, np.ones(len(i), bool)))
                    if sum(len(x[0]) for x in out) >= SENT_AT_ONCE:
                        yield sent()
                    continue
                held = tuple(np.concatenate(p) for p in zip(held, (i, j, gap), strict=True))
                if len(held[0]) > max(most, 4.0) * (e - s):
                    some = forest(*held, root)
                    held, whole = tuple(p[some] for p in held), False
            if whole:
                out.append(thinned(*held, e - s))
            else:
                out.append((held[0], held[1], np.zeros(len(held[0]), bool)))
        yield sent()

    return run


def _verified(n: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            rows = len(batch)
            sides = [T.utf8(batch.column(c)) for c in ("_text_a", "_text_b")]
            both = sides[0][1] + sides[1][1]
            good = np.zeros(rows, bool)
            for i, j in T.pieces(both):
                a, b = (Sets(buf[o[i] : o[j]], o[i : j + 1] - o[i], n) for buf, o in sides)
                token, doc = np.concatenate([a.token, b.token]), np.concatenate([a.doc, b.doc])
                order = np.lexsort((token, doc))
                token, doc = token[order], doc[order]
                same = np.flatnonzero((token[1:] == token[:-1]) & (doc[1:] == doc[:-1]))
                shared = np.bincount(doc[same], minlength=j - i)
                good[i:j] = (shared > 0) & (den * shared >= num * (a.size + b.size - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], ["a", "b", "linked"])

    return run


def near_bits(a: Column, b: Column, size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """Whether two sets can be similar, by their wide bitmaps; true if one has none.

    The halves of a bitmap, one over the other, are the bitmap of half the width. Where widths differ by more, nothing
    is said: true.
    """
    narrow = F.least(F.size(a), F.size(b))
    folded = lambda x: F.when(F.size(x) == narrow, x).otherwise(F.zip_with(F.slice(x, F.lit(1), narrow), F.slice(x, narrow + 1, narrow), lambda p, q: p.bitwiseXOR(q)))
    gap = F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    close = (num + den) * gap.cast("bigint") <= (den - num) * (size_a.cast("bigint") + size_b)
    return (narrow == 0) | (F.greatest(F.size(a), F.size(b)) > 2 * narrow) | close


def may_link(a: Column, b: Column, size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """Whether two sets can be similar, by their prefixes under one order: ascending keys, equal for equal tokens.

    Below the smaller of the two last keys both sets are known in full. They share what the prefixes share there, and at
    most the smaller of the two rests beyond. Two tokens of a set with one key count as shared, both, if the key is.
    """
    last = F.least(F.try_element_at(a, F.lit(-1)), F.try_element_at(b, F.lit(-1)))
    known_a, known_b = (F.filter(x, lambda v: v < last) for x in (a, b))
    common = F.size(F.array_intersect(known_a, known_b)) + F.size(known_a) - F.size(F.array_distinct(known_a))
    most = common + F.least(size_a - F.size(known_a), size_b - F.size(known_b))
    return F.arrays_overlap(a, b) & ((num + den) * most.cast("bigint") >= num * (size_a.cast("bigint") + size_b))


def picked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among `keys`, and a few others: those whose hashes meet a bit that a key has set.

    At most FILTER_MAPS maps of MAP_BITS bits are broadcast.
    """
    h = F.pmod(F.xxhash64(key), F.lit(FILTER_MAPS * MAP_BITS))
    maps = keys.select(h.alias("h")).groupBy((F.col("h") / MAP_BITS).cast("int").alias("_map")).agg(F.bitmap_construct_agg(F.col("h") % MAP_BITS).alias("_bits"))
    at = h % MAP_BITS
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_map", (h / MAP_BITS).cast("int")).join(F.broadcast(maps), "_map")
    return met.filter((byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1).select(*rows.columns)


class Join:
    """Finds the links between classes of equal sets of the texts in column `_text`.

    `rows`: docs with a number `_row` for each row, `_set` (null without words) and `_size`.
    """

    def __init__(self, docs: DataFrame, scratch: B.Scratch, n: int, num: int, den: int, order_size: int = 1 << 16, at_once: int = 1_000_000, least: int = 4) -> None:
        self.spark, self.scratch, self.n, self.num, self.den = docs.sparkSession, scratch, n, num, den
        words = docs.select("_text").filter("_text is not null")
        counts = words.mapInArrow(_often(n, at_once, least), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
        top = counts.orderBy(F.desc("n"), "token").limit(order_size).toArrow()
        token, count = top["token"].to_numpy(), top["n"].to_numpy()
        shingles = int(count[token == -1].sum())
        token, count = token[token != -1].astype(U64), count[token != -1]
        rank = np.arange(len(token), 0, -1).astype(U64)  # the most frequent last
        by = np.argsort(token)
        often = self.spark.sparkContext.broadcast((token[by], rank[by], count[by]))
        self.blocks = B.n_blocks(self.spark, shingles * (den - num) // den * ENTRY.itemsize)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "_row bigint, _set bigint, _size bigint, _block int, data binary"])
        made = docs.mapInArrow(_indexed(n, num, den, self.blocks, often, docs.columns), schema)
        both = scratch.written(made)
        often.unpersist()
        self.rows = both.filter("_block is null").drop("_block", "data")
        packed = both.filter("_block is not null").select("_block", "data")
        self.buckets = scratch.written(packed.groupBy("_block").applyInArrow(_buckets(num, den, self.blocks), BUCKET))
        # one text of each set that shares a bucket; a filter of fixed size spares moving the others
        inside = self.buckets.select(F.col("set").alias("_set")).distinct()
        self.chosen = scratch.small(self.rows.select("_set", "_row").join(inside, "_set", "left_semi").groupBy("_set").agg(F.min("_row").alias("_row")))
        held = picked(self.rows.select("_row", "_text"), self.chosen, "_row").select("_text")
        # bucketed by set, so that the joins below move pairs and not texts
        self.table = f"waystone_{uuid.uuid4().hex}"
        profiled = held.mapInArrow(_profiled(n, num, den), PROFILE).dropDuplicates(["_set"])
        profiled.write.format("parquet").option("compression", "zstd").option("path", f"{scratch.path}/profiles").bucketBy(B.partitions(self.spark), "_set").saveAsTable(self.table)
        self.profiles = self.spark.table(self.table)
        self.entries = self.buckets

    def __enter__(self) -> Join:
        return self

    def __exit__(self, *error) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) for those candidate pairs that pass the wide bitmaps and the prefix tests under the other orders."""
        p = self.profiles
        side = lambda x, *own: p.select(F.col("_set").alias(x), *[F.col(f"_{c}").alias(f"_{c}_{x}") for c in own])
        # prefixes of large sets are ten times their wide bitmaps, so only pairs that these leave move with them
        both = pairs.join(side("a", "size", "wide"), "a").join(side("b", "size", "wide"), "b")
        both = both.filter(near_bits(*[F.col(f"_{c}_{x}") for c in ("wide", "size") for x in "ab"], self.num, self.den)).drop("_wide_a", "_wide_b")
        both = both.join(side("b", "second", "third"), "b").join(side("a", "second", "third"), "a")
        passes = [may_link(F.col(f"_{c}_a"), F.col(f"_{c}_b"), F.col("_size_a"), F.col("_size_b"), self.num, self.den) for c in ("second", "third")]
        left = self.scratch.small(both.filter(passes[0] & passes[1]).select("a", "b"))
        wanted = left.select(F.col("a").alias("_set")).union(left.select(F.col("b").alias("_set"))).distinct()
        wanted = self.scratch.small(self.chosen.join(wanted, "_set", "left_semi"))
        texts = picked(self.rows.select("_row", "_set", "_text"), wanted, "_row")  # a few others too, which the joins drop
        full = lambda x: texts.select(F.col("_set").alias(x), F.col("_text").alias(f"_text_{x}"))
        return left.join(full("a"), "a").join(full("b"), "b").mapInArrow(_verified(self.n, self.num, self.den), "a bigint, b bigint, linked boolean")

    def candidates(self, root: DataFrame | None, most: float) -> DataFrame:
        """(a, b, thin): pairs of different components that share a bucket and pass the filters. `thin` is the bucket, if it
        has more of them than it offers here."""
        h = F.pmod(F.xxhash64("set"), F.lit(1 << 30))
        deal = lambda n: F.ceil(F.col(n) / TILE).cast("bigint")
        whole, own = F.lit(-1).cast("bigint"), ["token", "set", "size", "at"]
        if root is None:
            rows = self.entries.filter(F.col("at") < LEADING)
            rows = rows.join(rows.groupBy("token").agg(F.count("*").alias("_n")).filter("_n > 1"), "token").withColumn("root", F.col("set"))
            rows = rows.withColumn("_side", h % deal("_n")).withColumn("_tile", F.when(F.col("_n") <= TILE, whole).otherwise(F.col("_side") * ((1 << 20) + 1)))
        else:
            rows = self.entries.join(root, self.entries["set"] == root["node"], "left").select(*own, F.coalesce("root", "set").alias("root"))
            each = rows.groupBy("token", "root").agg(F.count("*").alias("n"))
            each = each.groupBy("token").agg(F.sum("n").alias("_n"), F.max(F.struct("n", "root")).alias("_top"), F.count("*").alias("_roots")).filter("_roots > 1")
            each = each.select("token", "_n", F.col("_top.root").alias("_top"), (F.col("_n") - F.col("_top.n")).alias("_rest"))
            # components only grow, so a bucket of one component has nothing to offer any more
            rows = self.scratch.written(rows.join(each, "token"))
            self.entries = rows.select(*own)
            # members of the largest component are dealt to the first sides, the others to the sides behind them; a tile
            # has a side of others and one more side
            k, o = deal("_n"), deal("_rest")
            side = F.when(F.col("root") == F.col("_top"), h % k).otherwise(k + h % o)
            rows = rows.withColumn("_k", k).withColumn("_o", o).withColumn("_side", F.when(k == 1, F.lit(0)).otherwise(side))
            others = F.transform(F.sequence(F.lit(0), F.col("_k") + F.col("_o") - 1), lambda x: F.least(x, F.col("_side")) * (1 << 20) + F.greatest(x, F.col("_side")))
            tops = F.transform(F.sequence(F.col("_k"), F.col("_k") + F.col("_o") - 1), lambda x: F.col("_side") * (1 << 20) + x)
            rows = rows.withColumn("_tile", F.explode(F.when(F.col("_k") == 1, F.array(whole)).when(F.col("_side") < F.col("_k"), tops).otherwise(others)))
        rows = rows.join(self.profiles.select(F.col("_set").alias("set"), "_bits"), "set")
        key = F.pmod(F.xxhash64("token", "_tile"), F.lit(2 * self.blocks))
        rows = rows.select(*own, "root", "_bits", F.col("_side").cast("bigint"), F.col("_tile").cast("bigint"), key.alias("_block"))
        return rows.groupBy("_block").applyInArrow(_compared(self.num, self.den, root is None, most), "a bigint, b bigint, thin bigint")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links that join every pair of sets that are in one component, and the components' (node, root)."""
        keep, root, tried = self.scratch, None, None
        for most in (1.0, 1.0, 16.0, float("inf")):
            found = keep.small(self.candidates(root, most))
            pairs = found.select("a", "b").distinct()
            more = keep.written(self.verify(pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")))
            tried = more if tried is None else tried.unionByName(more)
            first = root is None
            if first or not more.filter("linked").isEmpty():
                root = components(tried.filter("linked").select("a", "b"), keep)
            if not first:
                # buckets that offered every pair are done, and so is the search when all are
                thin = keep.small(found.filter("thin is not null").select(F.col("thin").alias("token")).distinct())
                if thin.isEmpty():
                    break
                self.entries = keep.written(self.entries.join(thin, "token", "left_semi"))
        return tried.filter("linked").select("a", "b"), root


def near_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, **options) -> DataFrame:
    """Docs without the text column, with `n_shingles` and `component_id`.

    Two texts link when their sets of n-word shingles (lower-cased A-Z, words apart by white space) have a Jaccard
    similarity of num / den or more. A text of fewer than n words is one shingle; null, empty and blank texts have none
    and link with nothing. `component_id` is the smallest id reachable by links; null ids never are the smallest unless
    there is no other. Copies and repeated rows share a component. Shingles are compared as 63-bit hashes.

    Options `order_size`, `at_once` and `least` (a shingle is frequent if `least` of `at_once` are equal to it) only
    shape the first order, hence speed. Other columns stay; own ones with the names of the results give way.
    """
    taken = ("n_shingles", "component_id", text)
    names = [c for c in docs.columns if c not in taken]
    hidden = {c: f"_{k}" for k, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()], F.col(f"`{text}`").alias("_text"), F.col(f"`{id}`").alias("_id"))
    with B.Scratch(docs.sparkSession) as scratch, Join(rows, scratch, n, num, den, **options) as join:
        _, root = join.links()
        named = join.rows.drop("_text").join(root, join.rows["_set"] == root["node"], "left").withColumn("_group", F.coalesce("root", "_set"))
        # documents without a copy are their own smallest id
        low = named.filter("_group is not null").groupBy("_group").agg(F.min("_id").alias("_low"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        out = named.join(low, "_group", "left")
        return B.written(out.select(*[F.col(h).alias(c) for c, h in hidden.items()], F.col("_size").alias("n_shingles"), F.coalesce("_low", "_id").alias("component_id")))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, **options) -> DataFrame:
    """Docs with one row of each component: the one with the smallest id, nulls last; among rows of that id the one with
    the smallest hash of its columns. Different texts with one id are judged by their own components.

    Documents without words are no copies of anything and all stay, whatever their ids.
    """
    own = {c: f"_{k}" for k, c in enumerate(docs.columns)} | {text: "_text"}
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in own.items()], F.col(f"`{id}`").alias("_id"), hashed.alias("_hash"))
    with B.Scratch(docs.sparkSession) as scratch, Join(rows, scratch, n, num, den, **options) as join:
        _, root = join.links()
        named = join.rows.select("_row", "_id", "_hash", "_set").filter("_set is not null")
        named = named.join(root, named["_set"] == root["node"], "left").withColumn("_group", F.coalesce("root", "_set"))
        best = named.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "_row"))["_row"].alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
        copies = scratch.small(named.join(best, "_group").filter("_row <> _best").select("_row"))
        return B.written(join.rows.join(copies, "_row", "left_anti").select(*[F.col(h).alias(c) for c, h in own.items()]))
