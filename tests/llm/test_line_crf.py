"""Operator 12 against plain Python: counts, all labellings, gradients, held-out labels."""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import line_crf as C
from sparkloom.llm.folds import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed)


TEXTS = [
    None, "", "\n\n", " ", "a", "a b c a b c", "x\ny\nx\n x\nx \n\n\n", "é ü　ß\n ", "a a a a a a", "| # * $ %\x0b&\x0c<\r>\x1c\x85", "one two three\none two three\nfour",
    "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 25}" for i in range(60)), "tail", "\ntail", "tail\n", "WORD!! " * 51, "長い 文\n" * 20,
]


def test_counts_equal_plain_python(spark):
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "doc_id int, text string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.doc_id: r for r in C.line_rules(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t
        assert r.kept == (not r.base_failed)  # without labels every line is content
    assert C.line_rules(docs.where("doc_id < 0"), labels).count() == 0


def test_counts_do_not_depend_on_the_slice():
    whole = C.taken_apart(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        one = C.taken_apart(pa.array([t], pa.string()))
        assert (one.signs == whole.signs[whole.owner == i]).all()
        assert one.n_repeat_words[0] == whole.n_repeat_words[i]


def _field(rng):
    return C.Field(rng.normal(size=(len(C.SIGNS), C.BINS)), rng.normal(size=(2, 2)), rng.normal(size=2))


def test_labellings_equal_all_tried():
    rng = np.random.default_rng(5)
    lengths = np.array([4, 0, 1, 6, 3])
    signs = rng.integers(0, C.BINS, (lengths.sum(), len(C.SIGNS))).astype(np.int8)
    field = _field(rng)
    x = field.potentials(signs)
    got = C.viterbi(field, x, lengths)
    total, line, pair = C.expected(field, x, lengths)
    order = np.argsort(-lengths, kind="stable")
    a = 0
    for k, n in enumerate(lengths):
        own = x[a : a + n]
        score = {y: sum(own[i, y[i]] for i in range(n)) + (field.first[y[0]] if n else 0) + sum(field.pairs[y[i], y[i + 1]] for i in range(n - 1)) for y in itertools.product((0, 1), repeat=int(n))}
        if n:
            assert tuple(got[a : a + n]) == max(score, key=score.get)
            z = np.logaddexp.reduce(list(score.values()))
            assert np.isclose(total[list(order).index(k)], z)
            for i in range(n):
                assert np.isclose(line[a + i, 1], sum(np.exp(s - z) for y, s in score.items() if y[i]))
                if i:
                    assert np.isclose(pair[a + i, 1, 0], sum(np.exp(s - z) for y, s in score.items() if y[i - 1] and not y[i]))
        a += n


def test_held_out_labels(spark):
    """Learnt from three quarters of the labelled documents; the rest tell."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fold = remainder(F.col("doc_id"), 4)
    rows = C.line_rules(docs, labels, may_learn=fold != 2).join(labels, "doc_id").where(fold == 2).where("not base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 50 and len(bad) > 2
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_long_text_and_many_lines(spark):
    text = "A line of plain words.\n" * 20_000 + "x" * 1_000_000
    r = C.line_rules(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(r) == 2 and r[0] == r[1] and r[0].n_words == 100_001 and r[0].n_dup_lines == 19_999 and r[0].base_failed
