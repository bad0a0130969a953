"""Operator 5: planted leaks are found, clean documents are left alone, and the search agrees with all pairs."""

import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import decontaminate as d
from sparkloom.llm.shingles import hashed_words


def words_of(text):
    return hashed_words(pa.array([text], pa.large_string()))[0]


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randrange(90))]) for _ in range(2))
        assert d.lcs(a, b) == slow_lcs(a.tolist(), b.tolist())


def test_answers():
    assert d.answer_of("Who was it? A tall man | a short man | It was the tall man.") == "It was the tall man."
    assert d.answer_of(None) == "" and d.answer_of(" ... ") == ""


def corpus():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, f"{text(rng.randint(25, 60))}. {text(6)}.") for i in range(30)]
    docs = [(i, text(rng.randint(1, 400))) for i in range(120)]
    planted = {}
    for i in range(120, 150):
        item = items[i - 120][1].split()
        if i % 3 == 1:  # a paraphrase: one word in six is another
            item = [rng.choice(words) if rng.random() < 1 / 6 else w for w in item]
        if i % 3 == 2:  # words left out
            item = [w for w in item if rng.random() > 1 / 8]
        docs.append((i, f"{text(rng.randint(0, 300))} {' '.join(item)} {text(rng.randint(0, 300))}".strip()))
        planted[i] = i - 120
    docs += [(200, None), (201, ""), (202, "?!"), (130, docs[130][1]), (None, items[0][1])]
    return docs, items, planted


def test_planted_leaks(spark):
    docs, items, planted = corpus()
    frame = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, weight double, item_id string")
    bench = spark.createDataFrame([*items, (99, None), (98, "...")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in d.leaks(frame, bench).collect()]
    want = [*planted.items(), (130, planted[130]), (None, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    brute = set()
    for doc, text in docs:
        own = words_of(text or "")
        for item, q in items:
            if len(own) and slow_lcs(words_of(q).tolist(), own.tolist()) >= 0.6 * len(words_of(q)):
                brute.add((doc, item))
    assert len(brute & set(got)) >= 0.9 * len(brute)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(docs, none).collect() == []
    assert d.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
    assert [tuple(r)[:2] for r in d.leaks(docs, spark.createDataFrame([(7, "Some words, here!")], "item_id long, text string")).collect()] in ([(1, 7)], [])


def test_verbatim_items_are_found_among_thousands(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(4000)]
    weights = [1 / (i + 3) for i in range(4000)]
    docs = [rng.choices(words, weights, k=rng.randint(60, 300)) for _ in range(300)]
    items, source = [], {}
    for i in range(3000):
        doc, n = rng.randrange(300), rng.randint(15, 30)
        start = rng.randrange(len(docs[doc]) - n)
        items.append((i, " ".join(docs[doc][start : start + n])))
        source[i] = doc
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {(r.item_id, r.doc_id): r.lcs_share for r in d.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [pair for pair in source.items() if got.get(pair) != 1.0] == []
