"""Operator 6 against all pairs of small tables."""

import random
import re

import numpy as np
import pytest

from sparkloom.llm import graph, jaccard


def shingles(text):
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    if not words:
        return words, set()
    return words, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    rows = [(d, t) for d, t in rows if d is not None]
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (wi, si), (wj, sj) = sets[i], sets[j]
            same = wi == wj if wi or wj else (rows[i][1] or "") == (rows[j][1] or "")
            if same or (si and sj and len(si & sj) >= 0.8 * len(si | sj) - 1e-12):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, b"clash", 1) for d, t in rows], "doc_id long, text string, key binary, n int")
    got = jaccard.jaccard_join(docs).collect()
    assert len(got) == len(rows) and all((r.class_id, r.n_links) == (None, 0) for r in got if r.doc_id is None)
    return sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    base = rng.choices(words, k=120)
    for i in range(60, 130):  # a large group of near copies, with copies in it
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(200, rows[70][1]), (201, rows[70][1].upper() + "!"), (202, None), (203, ""), (204, " ?! "), (205, "one two"), (206, "One, two."), (206, "other words here"), (None, base[0])]
    return rows


@pytest.mark.parametrize("chunk", [384, 16])
def test_links_and_groups_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def pairs_at(similarity, number, seed):
    """Pairs of texts of 100 words that share about so many of their shingles."""
    rng, rows = random.Random(seed), []
    for i in range(number):
        words = [f"{rng.randrange(10**6)}" for _ in range(100)]
        other = list(words)
        last = round(96 * (1 - similarity) / (1 + similarity))
        other[-last:] = [f"{rng.randrange(10**6)}" for _ in range(last)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return rows


def test_prefixes_are_shortened_until_the_recall_is_reached(spark, monkeypatch):
    depths = []
    links = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda docs, classes, depth, *rest: depths.append(depth) or links(docs, classes, depth, *rest))
    rows = pairs_at(0.84, 150, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    true = sum(n > 0 for _, _, n in brute(rows))

    def found(threshold, recall):
        depths.clear()
        return sum(r.n_links > 0 for r in jaccard.jaccard_join(docs, threshold, recall, trees=4).collect())  # few trees, so that the full depth misses pairs

    assert true >= 290 and found(0.8, 0.5) < true and depths == [6]
    assert found(0.8, 0.99) >= 0.98 * true and depths[-1] < 6
    monkeypatch.setattr(jaccard, "FEW", 1)  # with no sample to go by, the threshold says where to begin
    assert found(0.8, 0.99) >= 0.98 * true and depths[0] == next(d for d in (6, 5, 4, 3, 2, 1) if d == 1 or jaccard.chance(0.8, d, 4) >= 0.995)
    same = spark.createDataFrame(pairs_at(0.97, 60, 2), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "FEW", 16)
    depths.clear()
    assert sum(r.n_links > 0 for r in jaccard.jaccard_join(same, 0.8, 0.99, trees=4).collect()) == 120 and depths == [6]


def test_a_large_sparse_component_is_checked_leaf_by_leaf(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rng = random.Random(4)
    words, rows = [f"{rng.randrange(10**6)}" for _ in range(400)], []
    for i in range(60):  # a chain: each text is like its neighbours only
        rows.append((i, " ".join(words[4 * i : 4 * i + 100])))
    tables, written = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, tag: tables.setdefault(tag, written(df, tag)) if tag == "sparse" else written(df, tag))
    assert run(spark, rows) == brute(rows)
    assert tables["sparse"].count() == 1


def test_signatures_estimate_similarity():
    a, b = np.arange(1, 101, dtype=np.uint64) << np.uint64(40), np.arange(11, 111, dtype=np.uint64) << np.uint64(40)
    x, y = (np.frombuffer(jaccard.signature(s), "<u4") for s in (a, b))
    assert abs((x == y).mean() - 90 / 110) < 0.15


def test_overlaps_count_shared_elements():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, 5000).astype(np.uint64)) for _ in range(4)] + [np.array([99999], np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert jaccard.overlaps(sets).tolist() == want


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)]
    for one_task in (graph.ONE_TASK, 0):
        found = graph.components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()
        assert len(found) == 91 and {r.node: r.root for r in found} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(edges, "a long, b long"), rounds=1).collect()
