"""Toxicity by a factorization machine over hashed terms.

The score of a text is sigmoid(bias + sum of its terms' weights + sum over pairs of terms of the product of their
vectors): pairs such as an insult and a group's name count for more, or less, than their sum. Terms are distinct
lower-cased words and their first bytes (so the forms of one stem share terms), hashed to 2**HASH_BITS buckets. Every
bucket that LEAST or more of the fitted texts have is a feature, whatever its own association with the label: terms that
are harmless alone still have vectors. Values are scaled by frequency, so that one penalty holds rare terms back.
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

HASH_BITS, FACTORS, LEAST, START, PATIENCE = 20, 4, 3, 0.1, 20
#: Bytes at the start of a word that are terms of their own.
STEMS = (4, 5, 6, 8)
#: Labelled texts that the model is fitted on, at most.
FIT_ROWS = 8_000


def _buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each term."""
    buf = T.LOWER[buf]
    words = T.words_of(buf, offsets, T.NOT_ALNUM)
    doc, size = words.owner(), words.end - words.start
    docs, keys = [doc], [T.word_hashes(buf, words)]
    for n in STEMS:
        long = np.flatnonzero(size > n)
        stems = T.Words(words.start[long], words.start[long] + n, words.first)
        docs.append(doc[long])
        keys.append(T.mix(T.word_hashes(buf, stems) + np.uint64(n)))
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = T.utf8(batch.column(0))
        for a, b in T.pieces(offsets):
            doc, bucket = _buckets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            both = np.unique((doc << HASH_BITS) | bucket)
            at = np.searchsorted(both >> HASH_BITS, np.arange(b - a + 1))
            low = (both & ((1 << HASH_BITS) - 1)).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([low[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()), batch.column(1).slice(a, b - a)], ["terms", "label"])


class Sparse:
    """Texts by features, by rows and by columns; a text has a feature or not. `scale` is a feature's value for the
    weights, `pull` for the vectors."""

    def __init__(self, row: np.ndarray, col: np.ndarray, scale: np.ndarray, pull: np.ndarray, n: int) -> None:
        """row: sorted."""
        self.n, self.scale, self.pull = n, scale, pull
        self.col, by = col.astype(np.int32), np.argsort(col, kind="stable")
        self.row = row[by].astype(np.int32)
        self.some = np.flatnonzero(np.bincount(row, minlength=n))
        self.start = np.searchsorted(row, self.some)
        self.features = np.flatnonzero(np.bincount(col, minlength=len(scale)))
        self.at = np.searchsorted(col[by], self.features)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """For each text the sum of its features' x."""
        out = np.zeros(self.n, np.float32)
        if len(self.some):
            out[self.some] = np.add.reduceat(x.astype(np.float32)[self.col], self.start)
        return out

    def columns(self, x: np.ndarray) -> np.ndarray:
        """For each feature the sum of its texts' x."""
        out = np.zeros(len(self.scale), np.float32)
        if len(self.features):
            out[self.features] = np.add.reduceat(x.astype(np.float32)[self.row], self.at)
        return out


def _lowered(loss, x: np.ndarray, rounds: int, sparse: np.ndarray, stop=None, memory: int = 8) -> np.ndarray:
    """A minimum of `loss` (value and gradient) plus the sum of `sparse` times the absolute values of x, by
    limited-memory BFGS that keeps to an orthant in each step; ends where `stop` of a point is true."""

    def total(at):
        value, g = loss(at)
        return value + float(sparse.dot(np.abs(at))), g

    value, g = total(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        # the gradient of the sum; where x is 0 the one of the side that goes down, if any
        slope = np.where(x != 0, g + sparse * np.sign(x), np.sign(g) * np.maximum(np.abs(g) - sparse, 0))
        d, kept = slope.copy(), []
        for s, y, r in reversed(steps):
            kept.append(a := r * s.dot(d))
            d -= a * y
        if steps:
            s, y, r = steps[-1]
            d *= s.dot(y) / max(y.dot(y), 1e-12)
        else:
            d /= max(1.0, float(np.abs(d).sum()) / 10)
        for (s, y, r), a in zip(steps, reversed(kept), strict=True):
            d += (a - r * y.dot(d)) * s
        d[d * slope <= 0] = 0
        side = np.where(x != 0, np.sign(x), -np.sign(slope))
        size, gain = 1.0, float(slope.dot(d))
        while size > 1e-4:
            to = x - size * d
            to[(to * side < 0) & (sparse > 0)] = 0
            new, h = total(to)
            if new <= value - 1e-4 * size * gain:
                break
            size /= 2
        else:
            break
        s, y = to - x, h - g
        if s.dot(y) > 1e-10:
            steps = [*steps[1 - memory :], (s, y, 1 / float(s.dot(y)))]
        done = value - new < 1e-5 * abs(value)
        x, value, g = to, new, h
        if done or stop and stop(x):
            break
    return x


def calibrated(z: np.ndarray, y: np.ndarray, prior: float = 2.0) -> tuple[float, float]:
    """Slope (a half to four) and shift of logits that fit the labels best, held near 1 and 0 as by `prior` texts:
    penalties make logits too small, and the texts that judge are not those that were fitted."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h = p * (1 - p)
        grad = np.array([((p - y) * z).sum() + prior * (a - 1), (p - y).sum() + prior * b])
        hess = np.array([[(h * z * z).sum() + prior, (h * z).sum()], [(h * z).sum(), h.sum() + prior]])
        step = np.linalg.solve(hess, grad)
        a, b = float(np.clip(a - step[0], 0.5, 4)), float(np.clip(b - step[1], -5, 5))
    return a, b


class Machine:
    """Weights w, vectors v and bias over features; `place` has each bucket's feature or -1.

    The weights are fitted first, then all together. One text in five only judges: fitting ends when it no longer helps
    those, and they set the scale of the scores. `sparse` is the penalty of absolute values for 2,500 texts (it grows with the root of their number): it lets
    most weights and vectors become 0, by what they do in the whole model. `ridge` is that of squares.
    """

    def __init__(self, terms: list[np.ndarray], label: np.ndarray, seed: int = 7, sparse: float = 1.0, ridge: float = 0.1, rounds: int = 60) -> None:
        self.place = np.full(1 << HASH_BITS, -1, np.int32)
        self.w, self.v = np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32)
        rate = (label.sum() + 0.5) / (len(label) + 1)
        self.bias = float(np.log(rate / (1 - rate)))
        if not 0 < label.sum() < len(label):
            return
        bucket = np.concatenate(terms)
        often = np.bincount(bucket, minlength=1 << HASH_BITS)  # terms are distinct in a text
        kept = np.flatnonzero(often >= LEAST)
        if not len(kept):
            return
        self.place[kept] = np.arange(len(kept))
        row = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
        col = self.place[bucket]
        row, col = row[col >= 0], col[col >= 0]
        del bucket
        judge = np.arange(len(terms)) % 5 == 4
        if not 0 < label[~judge].sum() < (~judge).sum() or not judge.any():
            judge[:] = False
        share = often[kept] / len(terms)
        scale = (np.sqrt(often[kept] / (often[kept] + 30)) / np.sqrt(10 * share + 0.2)).astype(np.float32)
        # a pair of terms is seen only where both are: rare ones tell little
        pull = np.sqrt(often[kept] / (often[kept] + 200)).astype(np.float32)
        parts = []
        for some in (~judge, judge):
            new = np.cumsum(some) - 1
            mine = some[row]
            parts.append((Sparse(new[row[mine]], col[mine], scale, pull, int(some.sum())), label[some].astype(np.float32)))
        del row, col
        self._fit(parts, np.random.default_rng(seed), sparse * np.sqrt(len(terms) / 2500), ridge, rounds)

    @staticmethod
    def _logits(x: Sparse, theta: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """theta: bias, weights, then the vectors factor by factor (or none)."""
        m = len(x.scale)
        out = theta[0] + x.rows(theta[1 : m + 1] * x.scale)
        sums = []
        for k in range(m + 1, len(theta), m):
            v = theta[k : k + m] * x.pull
            sums.append(x.rows(v))
            out = out + 0.5 * (sums[-1] ** 2 - x.rows(v * v))
        return out, sums

    def _loss(self, x: Sparse, y: np.ndarray, penalty: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
        m = len(x.scale)
        z, sums = self._logits(x, theta)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = penalty * theta
        value = float(np.logaddexp(0, np.where(y > 0, -z, z)).sum()) + 0.5 * float(theta.dot(grad))
        each = x.columns(err)
        grad[0] += err.sum()
        grad[1 : m + 1] += each * x.scale
        for k, s in zip(range(m + 1, len(theta), m), sums, strict=True):
            grad[k : k + m] += (x.columns(err * s) - each * theta[k : k + m] * x.pull) * x.pull
        return value, grad

    def _fit(self, parts, rng, sparse: float, ridge: float, rounds: int) -> None:
        (x, y), (held, truth) = parts
        m = len(x.scale)
        theta = np.concatenate([[self.bias], np.zeros(m)]).astype(np.float32)
        penalties = lambda n: [np.concatenate([[0], np.full(n - 1, p)]).astype(np.float32) for p in (ridge, sparse)]
        square, absolute = penalties(len(theta))
        best: list = [np.inf, theta, 0]

        def judged(t: np.ndarray) -> bool:
            """Keeps the point that is best on the judging texts; true after PATIENCE that are no better."""
            z, _ = self._logits(held, t)
            loss = float(np.logaddexp(0, np.where(truth > 0, -z, z)).sum()) if len(truth) else 0.0
            if loss < best[0] - 1e-3 or not len(truth):
                best[:] = [loss, t, 0]
            else:
                best[2] += 1
            return best[2] >= PATIENCE

        _lowered(lambda t: self._loss(x, y, square, t), theta, rounds, absolute, judged)
        # vectors start as noise; most of it is shrunk to 0 again
        theta = np.concatenate([best[1], rng.normal(0, START, m * FACTORS).astype(np.float32)])
        square, absolute = penalties(len(theta))
        best[2] = 0
        _lowered(lambda t: self._loss(x, y, square, t), theta, rounds, absolute, judged)
        theta = best[1]
        slope, shift = calibrated(self._logits(held, theta)[0], truth) if len(truth) else (1.0, 0.0)
        self.bias, self.w = slope * float(theta[0]) + shift, slope * theta[1 : m + 1] * x.scale
        self.v = np.zeros((m, FACTORS), np.float32)
        if len(theta) > m + 1:
            self.v = np.sqrt(slope) * theta[m + 1 :].reshape(FACTORS, m).T * x.pull[:, None]

    def scores(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        feature = self.place[bucket]
        both = np.unique(doc[feature >= 0] << HASH_BITS | feature[feature >= 0])
        d, f = both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)
        out = self.bias + np.bincount(d, self.w[f], minlength=n) if len(f) else np.full(n, self.bias)
        for k in range(FACTORS if len(f) and self.v.any() else 0):
            v = self.v[f, k]
            out = out + 0.5 * (np.bincount(d, v, minlength=n) ** 2 - np.bincount(d, v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = FIT_ROWS, **columns) -> Machine:
    """Fits on at most `rows` labelled texts outside fold 0; without both labels the model only knows the base rate."""
    got = labelled(docs, labels, label, rows=rows, **columns).mapInArrow(_terms, "terms binary, label int").toArrow()
    return Machine([np.frombuffer(x.as_buffer(), "<i4") for x in got["terms"]], got["label"].to_numpy().astype(np.int64))


def _scored(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.utf8(batch.column("_text"))
            score = np.zeros(len(batch))
            for a, b in T.pieces(offsets):
                score[a:b] = model.value.scores(*_buckets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    return run


@B.keeps_columns("score")
def score_toxicity(docs: DataFrame, model: Machine, *, text: str = "text") -> DataFrame:
    """Docs with `score` from 0 to 1. Null and empty texts get the model's bias. A column `score` of docs gives way."""
    send = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])
    return docs.withColumn("_text", F.col(text)).mapInArrow(_scored(send, docs.columns), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **columns) -> DataFrame:
    """Docs that score below `least`, in their own columns."""
    model = fit(docs, labels, **columns)
    own = {c: c if c != "score" else B.unused(docs, "own_score") for c in docs.columns}
    scored = score_toxicity(docs.withColumnsRenamed(own), model, text=columns.get("text", "text"))
    return scored.filter(F.col("score") < least).select(*[F.col(f"`{h}`").alias(c) for c, h in own.items()])
