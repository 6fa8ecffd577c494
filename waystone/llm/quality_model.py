"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages (runs of `PASSAGE` words). A passage is encoded from its bytes and words alone: shares of
kinds of bytes, lengths, repeats, and embeddings of its words and word pairs, each a mean of SKETCH signs that a hash
gives to every word or pair. A gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weights the encoded passages; the weighted sum is scored. Only
documents have labels: the attention learns which passages matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textarrays as T
from .sampling import labelled

PASSAGE, SKETCH, HIDDEN, GATE = 64, 32, 16, 8
#: Labelled texts that the model is fitted on, at most.
FIT_ROWS = 5_000

_CLASS = np.full(256, 5, np.uint8)  # other printable
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b"#*$%&|<>")] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[128:] = 6
_CLASS[T.WHITE] = 7
_CLASS[10] = 8
_CLASSES = 9
WIDTH = _CLASSES + 9 + 2 * SKETCH


def passages(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and n+1 offsets of the texts; a text without words has one passage of zeros."""
    n = len(offsets) - 1
    words = T.words_of(buf, offsets, T.WHITE)
    counts = np.maximum(1, -(-words.counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((first[-1], WIDTH), np.float32)
    if not len(words):
        return out, first
    doc = words.owner()
    inside = np.arange(len(words)) - words.first[doc]
    of = first[doc] + inside // PASSAGE
    m = first[-1]
    size = np.bincount(of, minlength=m).astype(np.float32)
    has = np.maximum(size, 1)
    # every byte from a passage's first word to the next one's
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    begin = words.start[head]
    end = np.append(begin[1:], len(buf))
    end = np.minimum(end, offsets[1:][doc[head]])
    span = end - begin
    place = np.repeat(of[head], span)
    kind = _CLASS[buf[np.arange(span.sum()) + np.repeat(begin - np.cumsum(span) + span, span)]]
    byte = np.bincount(place * _CLASSES + kind, minlength=m * _CLASSES).reshape(m, _CLASSES)
    out[:, :_CLASSES] = byte / np.maximum(byte.sum(1, keepdims=True), 1)
    length = words.end - words.start
    upper = np.concatenate([[0], np.cumsum((buf > 64) & (buf < 91))])
    lower = np.concatenate([[0], np.cumsum((buf > 96) & (buf < 123))])
    up = upper[words.end] - upper[words.start]
    low = lower[words.end] - lower[words.start]
    mark = np.isin(buf[words.end - 1], np.frombuffer(b"!#*$%&|", np.uint8))
    hashes = T.word_hashes(buf, words)
    near = np.zeros(len(words), bool)
    near[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(words), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    sums = lambda x: np.bincount(of, x, minlength=m)
    k = _CLASSES
    mean = sums(length) / has
    out[:, k] = mean / 10
    out[:, k + 1] = np.sqrt(np.maximum(sums(length.astype(float) ** 2) / has - mean**2, 0)) / 10
    out[:, k + 2] = sums((up > 1) & (low == 0)) / has
    out[:, k + 3] = sums(mark) / has
    out[:, k + 4] = sums(near) / has
    out[:, k + 5] = np.bincount(of[order][new], minlength=m) / has
    out[:, k + 6] = sums(length == 1) / has
    out[:, k + 7] = np.log1p(size) / 5
    out[:, k + 8] = np.log1p(words.counts)[np.repeat(np.arange(n), counts)] / 10
    place = of[head]
    pair = T.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    pair = np.append(pair, np.uint64(0))  # a passage's last pair reaches into the next one
    for j, key in enumerate((T.mix(hashes), pair)):
        signs = np.unpackbits(key.view(np.uint8).reshape(-1, 8)[:, : SKETCH // 8], axis=1)
        mean = np.add.reduceat(signs, head, axis=0, dtype=np.float32) / size[place][:, None]
        out[place, k + 9 + j * SKETCH : k + 9 + (j + 1) * SKETCH] = 2 * mean - 1
    return out, first


def _softmax(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    size = np.diff(first)
    top = np.maximum.reduceat(x, first[:-1])
    e = np.exp(x - np.repeat(top, size))
    return e / np.repeat(np.add.reduceat(e, first[:-1]), size)


class Model:
    def __init__(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        self.mean, self.std = x.mean(0) if len(x) else np.zeros(WIDTH), x.std(0) + 1e-3 if len(x) else np.ones(WIDTH)
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.theta = [draw(WIDTH, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE, 1)[:, 0], draw(HIDDEN, 1)[:, 0] * 0.1, np.array([np.log(rate / (1 - rate))])]
        if 0 < y.sum() < len(y):
            self._fit((x - self.mean) / self.std, first, y, rng)

    def _forward(self, x: np.ndarray, first: np.ndarray):
        w1, b1, v, u, w, w2, b2 = self.theta
        h = np.tanh(x @ w1 + b1)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -30, 30)))
        a = _softmax((tv * su) @ w, first)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return h, tv, su, a, z, 1 / (1 + np.exp(-np.clip(z @ w2 + b2[0], -30, 30)))

    def _fit(self, x, first, y, rng, epochs: int = 30, batch: int = 128, rate: float = 0.01, shrink: float = 1e-4) -> None:
        one, two, t = [np.zeros_like(p) for p in self.theta], [np.zeros_like(p) for p in self.theta], 0
        size = np.diff(first)
        for _ in range(epochs if len(y) > 1500 else 3 * epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                i = order[at : at + batch]
                f = np.concatenate([[0], np.cumsum(size[i])])
                s = x[np.arange(f[-1]) + np.repeat(first[i] - f[:-1], size[i])]
                _, _, v, u, w, w2, _ = self.theta
                h, tv, su, a, z, p = self._forward(s, f)
                err = (p - y[i]) / len(i)
                dz = np.repeat(err[:, None] * w2, size[i], 0)
                da = (dz * h).sum(1)
                de = a * (da - np.repeat(np.add.reduceat(a * da, f[:-1]), size[i]))
                dg = de[:, None] * w
                dtv, dsu = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
                dh = (a[:, None] * dz + dtv @ v.T + dsu @ u.T) * (1 - h**2)
                grads = [s.T @ dh, dh.sum(0), h.T @ dtv, h.T @ dsu, (tv * su).T @ de, z.T @ err, np.array([err.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    g = g + shrink * self.theta[k]
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.theta[k] = self.theta[k] - rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, the attention of each passage and the passages' offsets."""
        x, first = passages(buf, offsets)
        *_, a, _, p = self._forward((x - self.mean) / self.std, first)
        return p, a, first


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = T.utf8(batch.column(0))
        for a, b in T.pieces(offsets):
            x, first = passages(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            x = x.astype("<f2")
            yield pa.RecordBatch.from_arrays([pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()), batch.column(1).slice(a, b - a)], ["bag", "label"])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = FIT_ROWS, **columns) -> Model:
    """Fits on at most `rows` labelled texts outside fold 0; without both labels the model only knows the base rate."""
    got = labelled(docs, labels, label, rows=rows, **columns).mapInArrow(_encoded, "bag binary, label int").toArrow()
    bags = [np.frombuffer(x.as_buffer(), "<f2").reshape(-1, WIDTH).astype(np.float32) for x in got["bag"]]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return Model(np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32), first, got["label"].to_numpy().astype(float))


def _scored(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.utf8(batch.column("_text"))
            score, focus = np.zeros(len(batch)), np.zeros(len(batch), np.int32)
            for i, j in T.pieces(offsets):
                p, a, first = model.value.scores(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score[i:j] = p
                top = np.lexsort((-a, np.repeat(np.arange(j - i), np.diff(first))))[first[:-1]]
                focus[i:j] = top - first[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score), pa.array(focus)], [*names, "score", "focus"])

    return run


@B.keeps_columns("score", "focus")
def score_quality(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Docs with `score` from 0 to 1 and `focus`, the passage with the most attention (the first of several).

    Null and empty texts are one empty passage. Columns `score` and `focus` of docs give way.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double, focus int"])
    return docs.withColumn("_text", F.col(text)).mapInArrow(_scored(send, docs.columns), schema)
