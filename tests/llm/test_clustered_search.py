"""Operator 13 against its SQL and plain Python."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import clustered_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    found = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in queries:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in found:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(120)] + ["É", "é", "ÀB", "a_b", "x-y", "長い"]
    docs = [(i // 2, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(700)]  # numbers repeat
    docs += [(900 + i, "the same text again w1 w2") for i in range(350)] + [(None, "w1 É w2"), (5000, None), (5001, ""), (5002, "-- __"), (5003, "w1 " * 5000 + "only")]
    queries = [(1, "w1 W2 w2 w3"), (2, "only É"), (3, "zzz"), (4, None), (5, "the same text again"), (6, " ".join(words)), (1, "w9 only"), (None, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "text", "1 as cluster", "2 as term")
    q = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "3 as w", "text as doc_id")
    for options in ({}, {"sample": 512, "depth": 3, "cluster_docs": 32, "group_bytes": 4000}):
        index = S.clustered_index(d, **options)
        assert index.table.where("term is null").agg({"docs": "sum"}).first()[0] == index.documents == 1052
        got = sorted((tuple(r) for r in S.ranked(index, q, 10, first_wave=1, growth=2).collect()), key=str)
        assert [(i, r, s) for i, r, _, s in got] == [(i, r, s) for i, r, _, s in brute(docs, queries, 10)]
        assert sorted(got, key=str) == brute(docs, queries, 10)


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = sorted(con.sql(S.search_sql()).fetchall())
    got = sorted(tuple(r) for r in S.search(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect())
    assert got == want and len(got) > 100


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search(none, q).count() == 0
    assert S.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), q).count() == 0
    assert S.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), q.limit(0)).count() == 0


def test_bisection_brings_like_documents_together():
    """Two vocabularies, mixed: after one level each half has one of them, and routing agrees."""
    rng = np.random.default_rng(2)
    kind = rng.integers(0, 2, 400)
    texts = [" ".join(f"{'ab'[k]}{i}" for i in rng.integers(0, 50, 20)) for k in kind]
    x = S.term_counts(pa.array(texts))
    order, says = S.bisected(x.of, x.codes, 400, len(x.names), 1, rounds=20)
    half = S.routed(x.of, x.codes, 400, says)
    assert abs(np.corrcoef(half, kind)[0, 1]) > 0.95
    assert sorted(order.tolist()) == list(range(400))


@pytest.mark.parametrize("texts", [[], [None], ["", "a"], ["A a B", None, "é É b_b"]])
def test_terms_of_a_slice(texts):
    x = S.term_counts(pa.array(texts, pa.string()))
    names = [n.decode().rstrip(" ") for n in x.names.to_pylist()]
    got = Counter({(int(d), names[c]): int(t) for d, c, t in zip(x.of, x.codes, x.times, strict=True)})
    assert got == Counter((i, t) for i, text in enumerate(texts) for t in terms(text))
