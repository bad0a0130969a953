"""Operators on many keys at once against the same one by one: intervals, neighbours, names, resolution."""

import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import documents as D
from sparkloom.operators import graph as G
from sparkloom.operators import name_index as N
from sparkloom.operators import resolve


def test_intervals_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    chunks = [(int(d), f"{d}_{i}", int(a), int(a + n)) for d in range(6) for i, (a, n) in enumerate(zip(rng.integers(0, 200, 15), rng.integers(0, 60, 15), strict=True))]
    chunks += [(None, "none", 0, 50)]
    offsets = [(int(d), int(o)) for d in range(7) for o in rng.integers(-5, 280, 40)] + [(None, 3), (0, 0), (0, 0)]
    c = spark.createDataFrame(chunks, "doc_id long, vector_id string, start int, end int")
    got = {(r.doc_id, r.offset): r.vector_id for r in D.located(spark.createDataFrame(offsets, "doc_id long, offset int"), c).collect()}
    want = {(d, o): min(((a, v) for k, v, a, b in chunks if k == d and d is not None and a <= o < b), default=(0, ""))[1] for d, o in offsets}
    assert got == want
    plan = D.located(spark.createDataFrame(offsets, "doc_id long, offset int"), c)._jdf.queryExecution().toString()
    assert "Join" not in plan


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{i:03}", f"n{a}", f"n{b}", float(rng.integers(70, 100)) / 100, "positive" if i % 9 else "negative") for i, (a, b) in enumerate(rng.integers(0, 40, (150, 2)))]
    rows += [(f"h{i:03}", "hub", f"n{i % 40}", 0.9, "positive") for i in range(120)]
    return spark.createDataFrame(rows, "id string, source_id string, target_id string, confidence double, polarity string").cache()


def test_neighbours_of_each_equal_single_runs(spark, edges):
    starts = ["n0", "n7", "hub", "nowhere"]
    adjacent = G.adjacency(edges, most=60)
    for depth, limit in ((1, 10), (3, 25)):
        nodes, found = G.neighbours_of_each(adjacent, spark.createDataFrame([(s,) for s in starts], "id string"), depth, limit)
        nodes, found = nodes.collect(), found.collect()
        for s in starts:
            one_nodes, one_found = G.neighbours(edges, spark.createDataFrame([(s,)], "id string"), depth, limit)
            assert {(r.id, r.distance) for r in nodes if r.start == s} == {(r.id, r.distance) for r in one_nodes.collect()}
            want = {(r.id, r.hop, r["rank"], r.truncated) for r in one_found.collect()}
            assert {(r.id, r.hop, r["rank"], r.truncated) for r in found if r.start == s} == want


def test_names_by_grams(spark):
    rng = np.random.default_rng(9)
    rows = [(f"e{i}", "".join(rng.choice(list("abc é"), rng.integers(1, 9))).strip(), int(rng.integers(1, 9))) for i in range(300)]
    nodes = spark.createDataFrame(rows, "id string, canonical_name string, mentions_count int").withColumn("display_name", F.initcap("canonical_name"))
    index = N.built(nodes, buckets=8)
    terms = [(1, "ab"), (2, "ABC"), (3, "a"), (4, "é b"), (5, "zz"), (6, ""), (7, None), (8, "%")]
    found = N.search(index, spark.createDataFrame(terms, "query_id long, term string"), 20).collect()
    for q, term in terms:
        got = [r.id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        assert got == ([r.id for r in G.search(nodes, term, 20).collect()] if term else []), term
    read = N.candidates(index, spark.createDataFrame([(1, "abc")], "query_id long, term string"))
    assert read.count() < 0.5 * nodes.count()  # the rarest gram's list only


def quadratic(names, threshold):
    """Every name against all that are known."""
    known, out = {}, []
    for kind, name in names:
        if (kind, name) not in known:
            others = sorted({v for (k, _), v in known.items() if k == kind})
            if len(name) <= 5 and " " not in name:
                fit = [o for o in others if "".join(w[0] for w in o.split()) == name]
                best = fit[0] if len(fit) == 1 else None
            else:
                scored = [(resolve.sorted_ratio(name, o), o) for o in others]
                top = max((s for s, _ in scored), default=0.0)
                best = next((o for s, o in scored if s == top), None) if top >= threshold else None
            known[kind, name] = best or name
        out.append(known[kind, name])
    return out


def test_resolution_with_filters_equals_all_compared():
    rng = np.random.default_rng(10)
    words = ["acme", "global", "northern", "systems", "holding", "a", "of", "river", "rivers", "trading", "tradings", "supply", ""]
    names = []
    for _ in range(900):
        name = " ".join(rng.choice(words, rng.integers(1, 5)))
        for _ in range(rng.integers(0, 3)):  # a character goes or comes
            at = int(rng.integers(0, len(name) + 1))
            name = name[:at] + ("x" if rng.random() < 0.5 else "") + name[at + int(rng.random() < 0.5) :]
        names.append((str(rng.choice(["ORG", "PERSON"])), name))
    names += [("ORG", "an"), ("ORG", "gs"), ("ORG", "")]
    for threshold in (92.0, 80.0, 60.0):
        assert resolve.resolve_names(names, threshold) == quadratic(names, threshold)


def test_a_document_of_many_names():
    """Many names derived from the tables, in one document."""
    folder = "/root/testdata/sf0.1"
    parts = sorted({x.lower() for x in pq.read_table(f"{folder}/part.parquet", columns=["p_name"]).column(0).to_pylist()})
    people = [x.lower().split("#")[1] for x in pq.read_table(f"{folder}/customer.parquet", columns=["c_name"]).column(0).to_pylist()]
    names = [f"{b} {a}" for a in people for b in parts[:7]][:20_000]
    began = time.time()
    out = resolve.resolve_names([("ORG", n) for n in names], 92.0)
    assert len(out) == len(names) and time.time() - began < 240
