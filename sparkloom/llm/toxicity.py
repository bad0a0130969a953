"""Operator 9: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's characters are lowered, ASCII signs and white space become one kind of
blank, and every run of 4 to 8 characters within the text counts once. On at most
``most`` labelled documents, a first pass counts documents by class in hashed
buckets, a second counts the n-grams of telling buckets themselves by their 64-bit
hash; the most telling become features. A feature's value is its log-count ratio
log((1 + p) / |1 + p|) - log((1 + q) / |1 + q|), p and q the labelled documents of
either class with it, and a logistic regression weighs the values: its loss and
gradient are sums over tasks, and the driver holds vectors of the features' length.

Defined cases: a null or empty text has no features and so the score of the
intercept; with labels of one class only, or none, every text gets a score near
that class's (0.5 for none); repeated rows get a score each; a null doc_id is never
learnt from; equally telling n-grams are taken by hash; a text of any length is
walked in pieces of ``PIECE`` bytes that overlap by an n-gram, so it needs no more
memory than its own bytes and its features; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkloom.llm.folds import labelled_sample
from sparkloom.llm.lsa import column_sum, spread
from sparkloom.llm.terms import distinct, text_bytes
from sparkloom.storage import written

SIZES = (4, 5, 6, 7, 8)
BUCKETS = 1 << 20
#: A bucket or n-gram counts if so many labelled documents have it.
LEAST = 3
#: Bytes of text whose n-grams are in memory at once.
PIECE = 1 << 18
#: Features that are kept at most.
FEATURES = 1 << 14

_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[:] = [ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)]
#: Lower case of the characters up to here that have one character for it.
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x600)], np.uint32)


class Model(NamedTuple):
    hashes: np.ndarray
    slots: np.ndarray  # by bucket: the first feature of it, plus one
    following: np.ndarray  # by feature: the next one of its bucket, plus one
    weights: np.ndarray
    intercept: float


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered code points of UTF-8 bytes, ASCII signs and white space as blanks, and the byte at which each begins."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts]
    out = _PLAIN[lead & 0x7F]
    wide = np.flatnonzero(lead > 0x7F)
    if len(wide):
        x = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        at, first = starts[wide], lead[wide].astype(np.uint32)
        second, third, fourth = x[at + 1] & 0x3F, x[at + 2] & 0x3F, x[at + 3] & 0x3F
        code = (first & 0x1F) << 6 | second
        code = np.where(first >= 0xE0, (first & 0x0F) << 12 | second << 6 | third, code)
        code = np.where(first >= 0xF0, (first & 0x07) << 18 | second << 12 | third << 6 | fourth, code)
        out[wide] = np.where(code < len(_LOWER), _LOWER[np.minimum(code, len(_LOWER) - 1)], code)
    return out, starts


def hashed(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size: the size and the 64-bit hash of the n-gram that begins at each character."""
    x = codes.astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for i in range(max(SIZES)):
        if len(x) <= i:
            return
        h = h[: len(x) - i] * np.uint64(0x100000001B3)
        h += x[i:]
        h += np.uint64(1)
        if i + 1 in SIZES:
            mixed = h >> np.uint64(29)
            mixed ^= h
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            yield i + 1, mixed


def _groups(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most PIECE bytes together, or of one text."""
    i = 0
    while i + 1 < len(bounds):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PIECE, side="right")) - 1)
        yield i, j
        i = j


def ngrams(texts: pa.Array, pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different pairs of a text's row and a number below ``limit``, both as arrays, for a group of texts at once.

    ``pick`` takes the hashes of n-grams and gives the places of those that count and their numbers.
    """
    data, bounds = text_bytes(texts)
    for i, j in _groups(bounds):
        parts = [np.zeros(0, np.int64)]
        begin, stop = int(bounds[i]), int(bounds[j])
        while begin < stop:
            end = min(begin + PIECE, stop)
            while end < stop and (data[end] & 0xC0) == 0x80:  # pieces end between characters
                end += 1
            codes, starts = characters(data[begin : min(stop, end + 4 * max(SIZES))])
            own = int(np.searchsorted(starts, end - begin))
            inner = bounds[i : j + 1] - begin
            edges = np.searchsorted(starts, inner[(inner > 0) & (inner <= starts[-1])]) if len(starts) else np.zeros(0, np.int64)
            for size, h in hashed(codes):
                h = h[:own]
                at, value = pick(h)
                across = np.zeros(len(h), bool)  # n-grams of two texts
                for back in range(1, size):
                    place = edges - back
                    across[place[(place >= 0) & (place < len(h))]] = True
                inside = ~across[at]
                at, value = at[inside], value[inside]
                row = np.searchsorted(bounds, begin + starts[at], side="right") - 1
                parts.append(row * limit + value)
            if len(parts) > 8 * len(SIZES):
                parts = [distinct(np.concatenate(parts))]
            begin = end
        both = distinct(np.concatenate(parts))
        yield both // limit, both % limit


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _ratio(p: np.ndarray, q: np.ndarray, total_p: float, total_q: float) -> np.ndarray:
    return np.log((1 + p) / total_p) - np.log((1 + q) / total_q)


def _telling(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int) -> np.ndarray:
    """How far the shares of the two classes lie apart, in standard errors."""
    share = (p + q + 1) / (n_p + n_q + 2)
    return np.abs(p / max(n_p, 1) - q / max(n_q, 1)) / np.sqrt(share * (1 - share) * (1 / max(n_p, 1) + 1 / max(n_q, 1)))


def present(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each feature that a text has, once."""

    def pick(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = model.slots[h >> np.uint64(44)]
        at = np.flatnonzero(slot)
        slot, h = slot[at], h[at]
        places, values = [], []
        while len(slot):
            same = model.hashes[slot - 1] == h
            places.append(at[same])
            values.append(slot[same].astype(np.int64) - 1)
            slot = model.following[slot - 1]
            more = slot > 0
            slot, h, at = slot[more], h[more], at[more]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *values])

    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *ngrams(texts, pick, max(1, len(model.hashes)))]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def regression(gradient: Callable[[np.ndarray], np.ndarray], n: int, positive: int, size: int, penalty: float = 1e-4, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression with a quadratic penalty, by limited-memory BFGS.

    ``gradient`` gives, for weights and intercept, the gradient and the loss, last, summed over ``n`` rows.
    """
    rate = min(max(positive / n, 1e-3), 1 - 1e-3) if n else 0.5
    w = np.zeros(size + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not n or not size or positive in (0, n):
        return w

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = gradient(w) / n
        own = np.append(w[:-1], 0.0)
        return total[-1] + penalty / 2 * own @ own, total[:-1] + penalty * own

    loss, g = at(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-5:
            break
        d, scales = g.copy(), []
        for s, y in reversed(steps):
            scales.append(s @ d / (s @ y))
            d -= scales[-1] * y
        if steps:
            s, y = steps[-1]
            d *= s @ y / (y @ y)
        else:
            d /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), scale in zip(steps, reversed(scales), strict=True):
            d += (scale - y @ d / (s @ y)) * s
        length = 1.0
        while True:
            new, (new_loss, new_g) = w - length * d, at(w - length * d)
            if new_loss <= loss - 1e-4 * length * (g @ d) or length < 1e-6:
                break
            length /= 2
        if new_loss > loss:
            break
        if (new - w) @ (new_g - g) > 1e-12:
            steps = [*steps, (new - w, new_g - g)][-memory:]
        w, loss, g = new, new_loss, new_g
    return w


def loss_of(rows: np.ndarray, features: np.ndarray, values: np.ndarray, labels: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gradient by weight and intercept of the logistic loss of some rows, and the loss, last."""
    n, size = len(labels), len(values)
    z = np.bincount(rows, (values * w[:-1])[features], n) + w[-1]
    error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels
    by_feature = np.bincount(features, error[rows], size) * values
    return np.concatenate([by_feature, [error.sum(), np.logaddexp(0, np.where(labels > 0, -z, z)).sum()]])


def train(sample: DataFrame) -> Model:
    """The classifier of a bounded table doc_id, text, label."""

    def by_bucket(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((2, BUCKETS + 1), np.float32)
        label = batch.column("label").to_numpy()
        for row, bucket in ngrams(batch.column("text"), lambda h: (np.arange(len(h)), _bucket(h)), BUCKETS):
            for y in (0, 1):
                out[y, :BUCKETS] += np.bincount(bucket[label[row] == y], minlength=BUCKETS)
        out[:, BUCKETS] += (label == 0).sum(), (label == 1).sum()
        return out.ravel()

    q, p = column_sum(sample, by_bucket, 2 * (BUCKETS + 1)).reshape(2, -1)
    n_p, n_q = int(p[-1]), int(q[-1])
    p, q = p[:-1], q[:-1]
    total_p, total_q = p.sum() + BUCKETS, q.sum() + BUCKETS
    score = _telling(p, q, n_p, n_q) * (p + q >= LEAST)
    chosen = np.zeros(BUCKETS, bool)
    chosen[np.argsort(-score, kind="stable")[: 2 * FEATURES]] = True
    chosen &= score > 0
    del p, q, score

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            grams: list[np.ndarray] = []

            def pick(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = np.flatnonzero(chosen[h >> np.uint64(44)])
                grams.append(h[at])
                return at, np.arange(len(at))

            for i in range(batch.num_rows):  # a text's own n-grams; the sample is bounded
                grams.clear()
                for _ in ngrams(batch.column("text").slice(i, 1), pick, 1 << 40):
                    pass
                own = distinct(np.concatenate([np.zeros(0, np.uint64), *grams]))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), label[i], np.int64))], ["h", "label"])

    counted = sample.mapInArrow(exact, "h long, label long").groupBy("h").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    grams = counted.select("h", "p", (F.col("n") - F.col("p")).alias("q")).where(F.col("p") + F.col("q") >= LEAST)
    telling = F.abs(F.col("p") / max(n_p, 1) - F.col("q") / max(n_q, 1)) / F.sqrt((F.col("p") + F.col("q") + 1) * (n_p + n_q + 1 - F.col("p") - F.col("q")))
    best = sorted(grams.orderBy(F.desc(telling), "h").limit(FEATURES).collect())
    hashes = np.array([r.h for r in best], np.int64).view(np.uint64)
    values = _ratio(np.array([r.p for r in best], float), np.array([r.q for r in best], float), total_p, total_q)
    slots, following = np.zeros(BUCKETS, np.int32), np.zeros(len(hashes), np.int32)
    for i, b in enumerate(_bucket(hashes)):
        following[i], slots[b] = slots[b], i + 1
    model = Model(hashes, slots, following, np.zeros(len(hashes)), 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = present(batch.column("text"), model)
            lists = np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x.tobytes() for x in lists], pa.binary())], ["label", "features"])

    rows = written(sample.mapInArrow(features, "label int, features binary"), "features")

    def gradient(w: np.ndarray) -> np.ndarray:
        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            lists = [np.frombuffer(x.as_py(), np.int32) for x in batch.column("features")]
            row = np.repeat(np.arange(len(lists)), list(map(len, lists)))
            return loss_of(row, np.concatenate([np.zeros(0, np.int32), *lists]), values, batch.column("label").to_numpy().astype(float), w)

        return task_sum(rows, of_batch, len(w) + 1)

    w = regression(gradient, n_p + n_q, n_p, len(hashes))
    return model._replace(weights=w[:-1] * values, intercept=float(w[-1]))


def task_sum(df: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of_batch`` over a bounded table: each task sends one array of ``size`` numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(map(of_batch, batches), np.zeros(size))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["value"])

    return sum((np.frombuffer(r.value) for r in df.mapInArrow(partial, "value binary").collect()), np.zeros(size))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    row, feature = present(texts, model)
    z = np.bincount(row, model.weights[feature], len(texts)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def toxicity(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int = 12_288, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted and the columns ``keep`` of every document; ``may_learn`` is on the labels' doc_id."""
    model = train(written(spread(labelled_sample(docs, labels, label, may_learn, most), most, 2048), "labelled"))

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, model), pa.float64())

    others = [c for c in dict.fromkeys(keep) if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *others, score(F.col("text")).alias("score"))  # only scores come back from Python
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
