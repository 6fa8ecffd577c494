"""Language identification by interpolated Kneser-Ney language models over the characters of words.

Each language has its own model of up to `ORDER` characters, learned from a bounded sample and kept as sorted arrays of
n-gram hashes with discounted probabilities, and of context hashes with back-off weights. A text's language has the
lowest cross-entropy per character. Half of the sample sets the sharpness of the scores and the limit beyond which a
text fits no language well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import textarrays as T

U64 = np.uint64
ORDER, DISCOUNT = 5, 0.75
#: Texts of each language that models are learned from and calibrated on, at most.
FIT_ROWS = 600
_EDGE = 32
#: Unicode code points: behind the shortest context all are equally likely.
_CHARACTERS = 0x110000
#: Odd factors of the last, the last but one ... character in a hash.
_PLACES = T.mix(np.arange(1, ORDER + 1, dtype=U64)) | U64(1)


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of UTF-8 bytes, and the number of characters that begin before each byte (and the end)."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = buf[at].astype(np.int64)
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    out = first & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[size]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] = (out[more] << 6) | (buf[np.minimum(at[more] + k, len(buf) - 1)] & 0x3F)
    return out, np.concatenate([[0], np.cumsum(lead)])


def word_grams(buf: np.ndarray, words: T.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each picked word's n-grams of ORDER characters as rows, one for each character and the end; and offsets.

    A word begins in the context of ORDER - 1 edges and ends with an edge.
    """
    character, before = code_points(buf)
    start, size = before[words.start[pick]], before[words.end[pick]] - before[words.start[pick]]
    n, pad = len(pick), ORDER - 1
    wide = np.full(int(size.sum()) + n * (pad + 1), _EDGE, np.int64)
    inner = np.cumsum(size) - size
    each = np.arange(size.sum())
    wide[each + np.repeat(np.arange(n) * (pad + 1) + pad, size)] = character[each + np.repeat(start - inner, size)]
    first = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(first[-1]) + np.repeat(np.arange(n) * pad, size + 1)
    return np.stack([wide[at + k] for k in range(ORDER)], 1) if len(at) else np.zeros((0, ORDER), np.int64), first


def _key(gram: np.ndarray, k: int) -> np.ndarray:
    """Hash of the last k characters of each row."""
    total = np.full(len(gram), k, U64)
    for j in range(min(k, gram.shape[1])):
        total += (gram[:, -1 - j].astype(U64) + U64(1)) * _PLACES[j]
    return T.mix(total)


def _context(gram: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters before the last one."""
    return _key(gram[:, :-1], k)


class Counts:
    """An interpolated Kneser-Ney model of one language, from distinct n-grams and their counts."""

    def __init__(self, gram: np.ndarray, count: np.ndarray) -> None:
        self.grams, self.contexts = {}, {}
        for k in range(ORDER, 0, -1):
            key, context = _key(gram, k), _context(gram, k - 1)
            contexts, back = np.unique(context, return_inverse=True)
            total = np.bincount(back, count, minlength=len(contexts))
            kinds = np.bincount(back, minlength=len(contexts))
            prob = np.maximum(count - DISCOUNT, 0) / total[back]
            order = np.argsort(key)
            self.grams[k] = key[order], prob[order].astype(np.float32)
            self.contexts[k] = contexts, (DISCOUNT * np.minimum(kinds, total) / total).astype(np.float32)
            # below, a gram counts as often as it has different characters before it
            _, lead, back = np.unique(_key(gram, k - 1), return_index=True, return_inverse=True)
            gram, count = gram[lead], np.bincount(back, minlength=len(lead)).astype(float)

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, other: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full(len(key), other)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], other)

    def log2(self, keys: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """keys[k - 1]: hashes of the last k characters, contexts[k - 1]: of the k - 1 before the last."""
        p = np.full(len(keys[0]), 1 / _CHARACTERS)
        for k in range(1, ORDER + 1):
            p = self._get(self.grams[k], keys[k - 1], 0.0) + self._get(self.contexts[k], contexts[k - 1], 1.0) * p
        return np.log2(p)


def hashed(gram: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [_key(gram, k) for k in range(1, ORDER + 1)], [_context(gram, k - 1) for k in range(1, ORDER + 1)]


def distinct_grams(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the place of each row among them, and their counts."""
    _, lead, place, count = np.unique(_key(gram, ORDER), return_index=True, return_inverse=True, return_counts=True)
    return gram[lead], place, count


class Identifier:
    def __init__(self, models: dict[str, Counts]) -> None:
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]
        self.sharp, self.limit = 20.0, {x: np.inf for x in self.languages}

    def entropies(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and the texts' lengths (characters of words, and their ends)."""
        buf = T.LOWER[buf]
        words = T.words_of(buf, offsets, T.NOT_ALNUM)
        n = len(offsets) - 1
        if not len(words):
            return np.zeros((n, len(self.models))), np.zeros(n)
        _, pick, back = np.unique(T.word_hashes(buf, words), return_index=True, return_inverse=True)
        gram, first = word_grams(buf, words, pick)
        gram, place, _ = distinct_grams(gram)
        keys = hashed(gram)
        doc = words.owner()
        size = np.bincount(doc, np.diff(first)[back], minlength=n)
        out = np.zeros((n, len(self.models)))
        for j, m in enumerate(self.models):
            word = np.add.reduceat(m.log2(*keys)[place], first[:-1])
            out[:, j] = -np.bincount(doc, word[back], minlength=n) / np.maximum(size, 1)
        return out, size

    def calibrate(self, bits: np.ndarray, lang: list[str]) -> None:
        """Sharpness by likelihood over a grid; the limit: mean plus four deviations of a language's own texts."""
        right = np.array([self.languages.index(x) for x in lang], np.int64)
        if not len(right):
            return
        gap = bits - bits.min(1, keepdims=True)
        loss = {s: float(np.mean(np.log(np.exp(-s * gap).sum(1)) + s * gap[np.arange(len(right)), right])) for s in (2.0, 5.0, 10.0, 20.0, 40.0, 80.0)}
        self.sharp = min(loss, key=lambda s: (loss[s], s))
        for j, x in enumerate(self.languages):
            own = bits[right == j, j]
            if len(own) > 1:
                self.limit[x] = float(own.mean() + 4 * own.std() + 0.05)


_SAMPLE = "_lang string, _rank int, _text string"


def _learned(key: tuple, got: pa.Table) -> pa.Table:
    import pickle

    buf, offsets = T.utf8(got.column("_text"))
    buf = T.LOWER[buf]
    words = T.words_of(buf, offsets, T.NOT_ALNUM)
    gram, _, count = distinct_grams(word_grams(buf, words, np.arange(len(words)))[0])
    return pa.table({"_lang": [key[0].as_py()], "model": pa.array([pickle.dumps(Counts(gram, count.astype(float)))], pa.binary())})


def _measured(tool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, size = tool.value.entropies(*T.utf8(batch.column("_text")))
            some = pa.array(size > 0)
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), pa.array(list(bits), pa.list_(pa.float64()))], ["_lang", "bits"]).filter(some)

    return run


def fit(docs: DataFrame, learn, *, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS, id: str = "doc_id") -> Identifier:
    """Learns from rows with a language and `learn` true: of each language at most `rows`, those with the smallest hashes
    of their ids. The sample's size is bounded by `rows` and the number of languages."""
    import pickle

    good = F.col(lang).isNotNull() & learn & F.col(text).isNotNull()
    known = docs.filter(good).select(F.col(lang).alias("_lang"), F.xxhash64(F.col(id)).alias("_hash"), F.col(text).alias("_text"))
    # a limit on the hash leaves about twice as many as are wanted before any row moves
    share = known.groupBy("_lang").agg((F.lit(2.0 * rows + 100) / F.count("*")).alias("_share"))
    some = known.select("_lang", "_hash").join(share, "_lang").filter(F.pmod("_hash", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    ranked = some.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash"))).filter(F.col("_rank") <= rows)
    chosen = F.broadcast(ranked.groupBy("_lang", "_hash").agg(F.min("_rank").alias("_rank")))
    sample = known.join(chosen, ["_lang", "_hash"]).select("_lang", "_rank", "_text")
    even = sample.filter((F.col("_rank") % 2 == 1) | F.lit(rows < 2))
    got = even.groupBy("_lang").applyInArrow(_learned, "_lang string, model binary").toArrow()
    tool = Identifier({a: pickle.loads(b) for a, b in zip(got["_lang"].to_pylist(), got["model"].to_pylist(), strict=True)})
    if tool.models:
        send = docs.sparkSession.sparkContext.broadcast(tool)
        odd = sample.filter((F.col("_rank") % 2 == 0) & F.col("_lang").isin(tool.languages))
        seen = odd.mapInArrow(_measured(send), "_lang string, bits array<double>").toArrow()
        if seen.num_rows:
            tool.calibrate(np.array(seen["bits"].to_pylist()), seen["_lang"].to_pylist())
    return tool


_ASCII = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII.search(text)) or any(c.isalpha() for c in text if c > "\x7f"))


def _named(tool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tool.value
        for batch in batches:
            buf, offsets = T.utf8(batch.column("_text"))
            for a, b in T.pieces(offsets, 4 << 20):
                part = batch.slice(a, b - a)
                letters = np.array([has_letter(x) for x in part.column("_text").to_pylist()], bool)
                best, score, fits, low = np.full(b - a, -1), np.zeros(b - a), np.zeros(b - a, bool), np.zeros(b - a)
                if t.models:
                    bits, _ = t.entropies(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best = np.where(letters, bits.argmin(1), -1)
                    low = bits.min(1)
                    score = np.where(letters, 1 / np.exp(-t.sharp * (bits - low[:, None])).sum(1), 0.0)
                    fits = letters & (low <= np.array([t.limit[x] for x in t.languages])[best])
                said = [t.languages[i] if i >= 0 else "und" for i in best.tolist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(said), pa.array(score), pa.array(low), pa.array(fits)], [*names, "lang_pred", "score", "bits", "accepted"])

    return run


@B.keeps_columns("lang_pred", "score", "bits", "accepted")
def identify(docs: DataFrame, tool: Identifier, *, text: str = "text") -> DataFrame:
    """Docs with `lang_pred`, `score`, `bits` (per character) and `accepted` (false: no learned language fits well).

    Null texts, and those without a letter, are `und` with score 0; so is every text if no language was learned.
    Ties go to the first language by name. Columns of docs with these names give way.
    """
    send = docs.sparkSession.sparkContext.broadcast(tool)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double, bits double, accepted boolean"])
    return docs.withColumn("_text", F.col(text)).mapInArrow(_named(send, docs.columns), schema)
