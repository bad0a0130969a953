"""Operators 2 and 9 against plain Python: terms, n-grams, weights, vectors, votes and the fit."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lsa, quality, shingles, terms, toxicity

TEXTS = ["Plain words, and MORE words.", "", None, "été ÑANDÚ naïve日本 x", "abc", "a\tb  c\n", "idiot! You IDIOT you", "x" * 30 + " " + "yz " * 20, "日本語" * 9]


def plain(text):
    return "".join(c.lower() if ord(c) > 127 and len(c.lower()) == 1 else c.lower() if c.isalnum() else " " if ord(c) < 128 else c for c in text or "")


def grams_of(text):
    x = plain(text)
    return {x[i : i + n] for n in toxicity.SIZES for i in range(len(x) - n + 1)}


def hash_of(gram):
    codes = np.array([ord(c) for c in gram], np.uint32)
    return int(dict(toxicity.hashed(codes))[len(gram)][0])


@pytest.mark.parametrize("piece", [5, 16, 1 << 18])
def test_ngrams_are_those_of_each_text(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    known: dict[int, int] = {}
    found = set()

    def pick(h):
        return np.arange(len(h)), np.array([known.setdefault(int(x), len(known)) for x in h], np.int64)

    for row, value in toxicity.ngrams(pa.array(TEXTS, pa.string()), pick, 1 << 30):
        assert len(set(zip(row.tolist(), value.tolist(), strict=True))) == len(row)
        found |= set(zip(row.tolist(), value.tolist(), strict=True))
    want = {(i, known[hash_of(g)]) for i, t in enumerate(TEXTS) for g in grams_of(t)}
    assert found == want


def test_features_ratios_and_scores(spark):
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "amet", "été"]
    rows = [(i, " ".join(rng.choices(words, k=8)) + (" moron" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    model = toxicity.train(sample)
    p, q = Counter(), Counter()
    for _, t, y in rows:
        (p if y else q).update({hash_of(g) for g in grams_of(t)})
    own = {h for h in {*p, *q} if p[h] + q[h] >= toxicity.LEAST and abs(p[h] / 20 - q[h] / 40) > 0}
    assert set(model.hashes.tolist()) >= {h for h in own if p[h] >= 3 and not q[h]} and set(model.hashes.tolist()) <= {h for h in {*p, *q} if p[h] + q[h] >= toxicity.LEAST}
    total_p, total_q = (sum(c.values()) + toxicity.BUCKETS for c in (p, q))  # no two of so few n-grams share a bucket
    values = [math.log((1 + p[h]) / total_p) - math.log((1 + q[h]) / total_q) for h in model.hashes.tolist()]
    kept = model.weights != 0
    assert (np.sign(model.weights[kept]) == np.sign(np.array(values)[kept])).mean() > 0.5
    # the fit is at the optimum of the penalised loss
    x = np.array([[hash_in * v for hash_in, v in zip([h in {hash_of(g) for g in grams_of(t)} for h in model.hashes.tolist()], values, strict=True)] for _, t, _ in rows])
    y, w = np.array([r[2] for r in rows], float), model.weights / np.array(values)
    error = 1 / (1 + np.exp(-(x @ w + model.intercept))) - y
    assert np.abs(x.T @ error / len(y) + 1e-4 * w).max() < 1e-3 and abs(error.mean()) < 1e-3
    got = toxicity.scores(pa.array([r[1] for r in rows], pa.string()), model)
    assert got == pytest.approx(1 / (1 + np.exp(-(x @ w + model.intercept))), abs=1e-9) and ((got > 0.5) == (y > 0)).all()


def test_regression_finds_a_known_optimum():
    rng = np.random.default_rng(0)
    x, true = rng.normal(size=(400, 3)), np.array([1.0, -2.0, 0.5])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ true + 0.3)))).astype(float)

    def gradient(w):
        z = x @ w[:-1] + w[-1]
        error = 1 / (1 + np.exp(-z)) - y
        return np.concatenate([x.T @ error, [error.sum(), np.logaddexp(0, np.where(y > 0, -z, z)).sum()]])

    w = toxicity.regression(gradient, 400, int(y.sum()), 3)
    step = np.zeros(4)
    for _ in range(50):  # Newton's method
        z = x @ step[:-1] + step[-1]
        s = 1 / (1 + np.exp(-z))
        full = np.hstack([x, np.ones((400, 1))])
        slope = full.T @ (s - y) / 400 + 1e-4 * np.append(step[:-1], 0)
        step -= np.linalg.solve((full * (s * (1 - s))[:, None]).T @ full / 400 + 1e-4 * np.diag([1, 1, 1, 0]), slope)
    assert w == pytest.approx(step, abs=1e-4)


def brute_terms(text):
    data = (text or "").encode()
    tri = Counter(int(terms.trigrams(np.frombuffer(data[i : i + 3], np.uint8))[0]) for i in range(len(data) - 2))
    words, out = re.findall(rb"[^\t\n\x0b\x0c\r ]+", data), Counter(tri)
    shape = [int(np.bitwise_or.reduce(terms._KIND[np.frombuffer(w, np.uint8)])) for w in words]
    out.update(terms.TRIGRAMS + (words[i] == words[i - 1]) * 1024 + shape[i - 1] * 32 + shape[i] for i in range(1, len(words)))
    return out


@pytest.mark.parametrize("piece", [4, 9, 1 << 20])
def test_term_counts(monkeypatch, piece):
    monkeypatch.setattr(terms, "PIECE", piece)
    texts = [*TEXTS, "  aa bb bb  c1 Dd é  " * 5, "one", " ", "ab cd"]
    got = terms.term_counts(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == brute_terms(text)


@pytest.mark.parametrize("window", [3, 16, 1 << 20])
def test_word_hashes_do_not_depend_on_windows(monkeypatch, window):
    texts = pa.array([*TEXTS, "word" * 2000 + " and more", "a,b", "", "ab", "cd"], pa.string())
    want, bounds = shingles.hashed_words(texts)
    monkeypatch.setattr(shingles, "WINDOW", window)
    got, own = shingles.hashed_words(texts)
    assert got.tolist() == want.tolist() and own.tolist() == bounds.tolist()
    words = [re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower()) for t in texts.to_pylist()]
    assert np.diff(bounds).tolist() == list(map(len, words))
    flat = [w for own in words for w in own]
    assert len({(w, int(h)) for w, h in zip(flat, want, strict=True)}) == len(set(flat)) == len(set(want.tolist()))


def test_inverse_frequencies_and_basis(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 40))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)

    def rows(batch):
        yield np.array(batch.column("x").to_pylist(), np.float32).reshape(-1, 40)

    found = lsa.inverse_frequencies(df, lambda b: (a > 0 for a in rows(b)), 40)
    assert found == pytest.approx(np.log(61 / (1 + (x > 0).sum(0))) + 1, rel=1e-5)
    v = lsa.basis(df, rows, 40, 4)
    exact = np.linalg.svd(x)[2][:4].T
    assert np.abs(np.abs(np.linalg.svd(v.T @ exact)[1]) - 1).max() < 1e-3  # the same space


def test_votes_are_those_of_a_plain_loop():
    rng = np.random.default_rng(3)
    known = lsa.unit(rng.normal(size=(50, 6))).astype(np.float32)
    known[10:14] = known[10]  # equal ones: the first vote
    labels = rng.integers(0, 2, 50).astype(float)
    asked = np.concatenate([lsa.unit(rng.normal(size=(20, 6))), known[10:11], np.zeros((1, 6))]).astype(np.float32)
    for k in (2, 3, 7, 50, 80):
        got = quality.vote(asked, known, labels, k)
        for v, score in zip(asked, got, strict=True):
            cosine = [round(float(v @ x), quality.DIGITS) for x in known]
            near = sorted(range(50), key=lambda i: (-cosine[i], i))[:k]
            weight = [max(0.0, min(1.0, cosine[i])) ** quality.SHARPNESS for i in near]
            want = (sum(w * labels[i] for w, i in zip(weight, near, strict=True)) + quality.PRIOR_WEIGHT * labels.mean()) / (sum(weight) + quality.PRIOR_WEIGHT)
            assert score == pytest.approx(want, abs=1e-3)
    assert quality.vote(asked, known[:0], labels[:0], 3).tolist() == [0.5] * 22


def test_held_out_recall_of_toxic_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = toxicity.toxicity(docs, labels, "toxic", rest != 0).join(labels, "doc_id").where(rest == 0).select("toxic", "predicted").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert len(caught) >= 90 and np.mean(caught) >= 0.85 and np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.01


def test_empty_tables_and_a_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality(none, labels, "quality", F.lit(True)).collect() == [] and toxicity.toxicity(none, labels, "toxic", F.lit(True)).collect() == []
    long = "some words that go on " * 100_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, "x"), (4, None)], "doc_id long, text string")
    for scored in (quality.quality(docs, labels, "quality", F.lit(True)), toxicity.toxicity(docs, labels, "toxic", F.lit(True))):
        got = {r.doc_id: r.score for r in scored.collect()}
        assert got[1] == got[2] and all(0 <= x <= 1 for x in got.values()) and len(got) == 4
