"""Operator 3 against context-tree weighting done one decision at a time."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ctw


class Tree:
    """One decision's tree, updated in sequence: the textbook form."""

    def __init__(self):
        self.counts = defaultdict(lambda: [0, 0])
        self.own = defaultdict(float)
        self.mixed = defaultdict(float)

    def _path(self, context):
        return [context[len(context) - d :] for d in range(len(context) + 1)]

    def probability(self, context, bit):
        """Of the bit, as the quotient of block probabilities after and before it."""
        saved = {s: ([*self.counts[s]], self.own[s], self.mixed[s]) for s in self._path(context)}
        before = self.mixed[b""]
        self.update(context, bit)
        after = self.mixed[b""]
        for s, (c, o, m) in saved.items():
            self.counts[s], self.own[s], self.mixed[s] = c, o, m
        return math.exp(after - before)

    def update(self, context, bit):
        path = self._path(context)
        for s in reversed(path):
            a, b = self.counts[s]
            self.own[s] += math.log(((b if bit else a) + 0.5) / (a + b + 1))
            self.counts[s][bit] += 1
            if len(s) == len(context):
                self.mixed[s] = self.own[s]
            else:
                below = sum(self.mixed[bytes([c]) + s] for c in range(256) if bytes([c]) + s in self.mixed)
                x, y = math.log(0.5) + self.own[s], math.log(0.5) + below
                self.mixed[s] = max(x, y) + math.log1p(math.exp(-abs(x - y)))


def decisions(text):
    data = b"\0" * ctw.DEPTH + ctw.lowered(text)
    for i in range(ctw.DEPTH, len(data)):
        node = 1
        for k in range(8):
            bit = data[i] >> (7 - k) & 1
            yield node, data[i - ctw.DEPTH : i], bit
            node = node * 2 + bit


TEXTS = [(1, "The cat sat on the mat.", True), (2, "the CAT sat\ton the cat", True), (3, "a dog sat on été", False), (4, None, True), (5, "", False), (6, "mat " * 30, True), (6, "mat " * 30, True), (None, "zz", True)]


@pytest.mark.parametrize("block_bytes", [20, 1 << 20])
def test_scores_equal_the_sequential_form(spark, block_bytes):
    docs = spark.createDataFrame([(d, t, own, 7, b"x") for d, t, own in TEXTS], "doc_id long, text string, own boolean, block long, word binary")
    got = ctw.score(docs, F.col("own"), block_bytes, block_bytes).collect()
    trees = defaultdict(Tree)
    for _, text, own in TEXTS:
        for node, context, bit in decisions(text) if own else ():
            trees[node].update(context, bit)
    words, n = Counter(), 0
    for _, text, own in TEXTS:
        tokens = [*ctw.lowered(text).split(), b""]
        words.update(tokens if own else ())
        n += len(tokens) * own
    want = []
    for doc, text, _ in TEXTS:
        tokens = [*ctw.lowered(text).split(), b""]
        base = sum(math.log10((words[t] + 1) / (n + len(words) + 1)) for t in tokens)
        model = sum(math.log10(trees[node].probability(c, bit)) for node, c, bit in decisions(text))
        want.append((doc, len(tokens), sum(words[t] > 0 for t in tokens), n, base, model))
    key = lambda r: (r[0] is None, r[0] or 0)
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert [r[:4] for r in rows] == [w[:4] for w in sorted(want, key=key)]
    for r, w in zip(rows, sorted(want, key=key), strict=True):
        assert r[4] == pytest.approx(w[4], abs=1e-9) and r[5] == pytest.approx(w[5], abs=1e-6)


def test_empty_table_and_no_training(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score(docs, F.lit(True)).collect() == []
    one = ctw.score(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).collect()[0]
    assert one.bits_per_byte == pytest.approx(8) and one.train_tokens == 0


def test_log_gamma():
    x = np.array([0, 1, 7, 1023, 1024, 10**6, 10**12])
    for half in (True, False):
        want = [math.lgamma(v + (0.5 if half else 1)) for v in x.tolist()]
        assert ctw._log_gamma(x, half) == pytest.approx(want, rel=1e-11, abs=1e-9)


def test_grams_in_pieces_are_those_of_whole_texts(monkeypatch):
    texts = [b"", b"a", b"abcdefghijkl", b"", b"xy" * 20, b"\x00\xff", b"z"]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = []
    for t in texts:
        padded = b"\0" * ctw.DEPTH + t
        want += [int.from_bytes(padded[i : i + ctw.DEPTH][::-1] + padded[i + ctw.DEPTH : i + ctw.DEPTH + 1], "big") for i in range(len(t))]
    for size in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(ctw, "PIECE", size)
        pieces = list(ctw.grams(data, bounds))
        assert np.concatenate([g for _, _, g in pieces]).tolist() == want
        assert [(a, b) for a, b, _ in pieces] == [(i, min(i + size, len(data))) for i in range(0, len(data), size)]


def test_texts_of_several_pieces_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 5, 6)) for _ in range(200_000))  # more than a piece
    docs = spark.createDataFrame([(1, long), (2, long), (2, long), (3, "short")], "doc_id long, text string")
    rows = ctw.score(docs, F.col("doc_id") < 3, 1 << 18, 1 << 18).collect()
    assert len({(r.score, r.base_score) for r in rows if r.doc_id < 3}) == 1 and sum(r.doc_id == 2 for r in rows) == 2
    one = next(r for r in rows if r.doc_id == 1)
    assert one.n_bytes == len(long) and one.n_tokens == one.n_known == 200_001 and one.train_tokens == 3 * 200_001
