"""Packing token sequences by non-negative least squares.

A task packs the documents of its partition in shards of bounded size, so nothing is shuffled and no count goes through
the driver. A document gives windows' worth of ids as they are; what is left of each document is packed. Lengths are put
in `BINS` classes, all combinations of up to `DEPTH` classes that fill a window are enumerated, and the repeat counts
that reproduce the shard's histogram best are solved by non-negative least squares and rounded. What is left of short
pieces is strung together to bundles, and these are planned in the same way. The rest is packed greedily: cut where needed, it fills the small gaps of the combinations and then
windows of its own. The end of that stream is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BINS, DEPTH = 64, 3
SHARD_TOKENS = 8_000_000
#: Words whose ids a worker keeps; about 250 bytes each.
CACHED_WORDS = 500_000
END_ID = 0


#: Words that a byte-level file splits into their letters and the signs behind them, if at all.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary, for str.translate: bytes that print stand for
    themselves, the others for the letters from 256 on, in their order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts by a tokenizer file.

    Where the file's splits never join what a single space separates, each word is encoded once and kept while there is
    room: plain words go straight to the file's model, others through its splits first.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer")
        self.special = [x["content"] for x in made.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.space = chr(self.letters[32])

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before each."""
        tokenize, split, letters = self.whole.model.tokenize, self.whole.pre_tokenizer.pre_tokenize_str, self.letters
        out, tails = [], {"": []}
        for w in words:
            m = _SIMPLE.fullmatch(w)
            if m:
                body, signs = m.groups()
                if signs not in tails:
                    tails[signs] = [t.id for t in tokenize(signs)]
                ids = [t.id for t in tokenize(self.space + (body if body.isascii() else body.encode().decode("latin-1").translate(letters)))] + tails[signs]
            else:
                ids = [t.id for part, _ in split(" " + w) for t in tokenize(part)]
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._each(texts)
        # two spaces in a row, or a space at the end, are split differently from single spaces
        odd = [i for i, t in enumerate(texts) if "  " in t or t.endswith(" ") or any(x in t for x in self.special)]
        parts = [t.split(" ") for t in texts]
        for i in odd:
            parts[i] = [""]
        known = self.known
        new = [w for w in set().union(*(p[1:] for p in parts)) if w not in known]
        known.update(zip(new, self._words(new), strict=True))
        heads = self._each([p[0] for p in parts])
        get = known.__getitem__
        out = [h + b"".join(map(get, p[1:])) for h, p in zip(heads, parts, strict=True)]
        for i, x in zip(odd, self._each([texts[i] for i in odd]), strict=True):
            out[i] = x
        if len(known) > CACHED_WORDS:
            for w in new:
                del known[w]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |a x - b|: the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    for _ in range(3 * n):
        w = np.where(used, -np.inf, atb - ata @ x)
        if used.all() or w.max() <= 1e-9 * max(1.0, np.abs(atb).max()):
            break
        used[int(w.argmax())] = True
        while True:
            p = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[p] = s
                break
            low = s <= 0
            step = np.min(x[p][low] / np.maximum(x[p][low] - s[low], 1e-300))
            x[p] += step * (s - x[p])
            used[p[x[p] <= 1e-12]] = False
            x[~used] = 0
    return x


def combinations(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Up to `depth` classes (1 to bins) that sum to `bins`."""
    return [c for k in range(1, depth + 1) for c in itertools.combinations_with_replacement(range(1, bins + 1), k) if sum(c) == bins]


def bundles(lengths: np.ndarray, pieces: list[int], window: int) -> list[list[int]]:
    """Pieces of a third of a window or more alone; shorter ones, longest first, strung together until a bundle has its
    share of the window. Shares differ from bundle to bundle (evenly from a quarter to a half), so that they combine."""
    out, open_, size = [], [], 0
    for i in sorted(pieces, key=lambda i: (-int(lengths[i]), i)):
        if 3 * lengths[i] >= window:
            out.append([i])
            continue
        open_.append(i)
        size += int(lengths[i])
        if size >= window * (0.25 + 0.25 * (len(out) * 0.618034 % 1)):
            out.append(open_)
            open_, size = [], 0
    return [*out, open_] if open_ else out


def solved(items: list[list[int]], lengths: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Windows from items by NNLS over the histogram of their lengths, and the pieces of the items left over."""
    bins = min(BINS, window)
    total = np.array([lengths[b].sum() for b in items], np.int64)
    kind = -(-total * bins // window)
    have: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(total, kind="stable").tolist():
        have[int(kind[i])].append(i)
    ways = [c for c in combinations(bins) if all(have.get(k) for k in c)]
    windows: list[list[int]] = []
    if ways:
        a = np.zeros((bins + 1, len(ways)))
        for j, c in enumerate(ways):
            for k in c:
                a[k, j] += 1
        x = nnls(a, np.bincount(kind, minlength=bins + 1).astype(float))
        for j in np.argsort(-x, kind="stable").tolist():
            need = {k: ways[j].count(k) for k in ways[j]}
            for _ in range(int(round(x[j]))):
                if any(len(have[k]) < n for k, n in need.items()):
                    break
                windows.append([i for k in ways[j] for i in items[have[k].pop()]])
    return windows, [i for v in have.values() for b in v for i in items[b]]


def plan(lengths: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Windows as lists of pieces by NNLS, and the pieces left over. Pieces are shorter than the window.

    First the pieces themselves are combined, then, three times, what is left in bundles.
    """
    left, windows, items = list(range(len(lengths))), [], [[i] for i in range(len(lengths))]
    for _ in range(4):
        more, left = solved(items, lengths, window)
        windows += more
        items = bundles(lengths, left, window)
    return windows, sorted(left, key=lambda i: (-int(lengths[i]), i))


def pack(sizes: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of the given sizes."""
    out, sequence = [], 0
    rest, base = [], []
    for d, n in enumerate(sizes):
        for k in range(n // window):
            out.append((d, k * window, window, sequence, 0))
            sequence += 1
        if n % window:
            rest.append(d)
            base.append(n - n % window)
    lengths = np.array([sizes[d] % window for d in rest], np.int64)
    windows, left = plan(lengths, window) if rest else ([], [])
    gaps = sum(window - sum(int(lengths[i]) for i in w) for w in windows)
    stream = sum(int(lengths[i]) for i in left)
    while windows and stream < gaps:  # not enough to fill the gaps: give up windows
        w = windows.pop()
        full = sum(int(lengths[i]) for i in w)
        gaps, stream = gaps - (window - full), stream + full
        left += w
    at, inside = 0, 0

    def take(n: int, sequence: int, offset: int) -> None:
        nonlocal at, inside
        while n:
            i = left[at]
            m = min(n, int(lengths[i]) - inside)
            out.append((rest[i], base[i] + inside, m, sequence, offset))
            n, offset, inside = n - m, offset + m, inside + m
            if inside == lengths[i]:
                at, inside = at + 1, 0

    for w in windows:
        offset = 0
        for i in w:
            out.append((rest[i], base[i], int(lengths[i]), sequence, offset))
            offset += int(lengths[i])
        take(window - offset, sequence, offset)
        sequence += 1
    stream -= gaps
    while stream:
        n = min(window, 1 << (stream.bit_length() - 1)) if stream < window else window
        take(n, sequence, 0)
        stream -= n
        sequence += 1
    return out


def _packed(path: str, window: int, names: list[str], end: int):
    def flush(rows, ids, sequence):
        pieces = pack([len(x) // 4 for x in ids], window)
        doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        table = pa.Table.from_batches(rows).combine_chunks()
        raw = pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)], pa.binary())
        took = table.take(pa.array(doc))
        total = np.array([len(x) // 4 for x in ids], np.int64)[doc]
        made = pa.table([*took.columns, pa.array(start), pa.array(length), raw, pa.array(total), pa.array(seq + sequence), pa.array(offset)], [*names, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        yield from made.to_batches(max_chunksize=2000)
        return int(seq.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, tail = encoder(path), np.array([end], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        rows, ids, size = [], [], 0
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                got = [x + tail for x in tool.encode([t or "" for t in part.column("_text").to_pylist()])]
                rows.append(part.select(names) if names else part)
                ids += got
                size += sum(map(len, got)) // 4
                if size >= SHARD_TOKENS:
                    sequence += yield from flush(rows, ids, sequence)
                    rows, ids, size = [], [], 0
        if ids:
            yield from flush(rows, ids, sequence)

    return run


@B.keeps_columns("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
def pack_sequences(docs: DataFrame, tokenizer: str, *, text: str = "text", window: int = 1024, end: int = END_ID) -> DataFrame:
    """A row for each piece: the document's other columns, `start`, `length`, `ids` (little-endian 32-bit), `doc_tokens`,
    `sequence_id` and `offset`.

    A document is its ids and then the id `end`; null and empty texts are that id alone. Pieces of a sequence lie one
    after another from 0. Sequences are full, but for some whose lengths are powers of two. Repeated rows are packed
    each. An empty table gives no rows. Columns of docs with the names of the results give way. `tokenizer` is a file
    that every task can read.
    """
    taken = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "_text", text)
    fields = [f for f in docs.schema.fields if f.name not in taken]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"])
    return docs.select(*[f"`{c}`" for c in names], F.col(text).alias("_text")).mapInArrow(_packed(tokenizer, window, names, end), schema)
