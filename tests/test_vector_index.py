"""The inverted file against exact search."""

import numpy as np
import pytest

from sparkloom.operators import retrieval as R
from sparkloom.operators import vector_index as V


def recall(found, exact):
    key = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    want = key(exact)
    return len(key(found) & want) / len(want)


def test_recall_over_the_tables_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0")
    index = V.built(vectors)
    assert index.table().count() == vectors.count() == index.vectors
    found = V.nearest(index, queries, 10)
    assert recall(found, R.nearest(vectors, queries, 10)) >= 0.9
    assert V.share_read(index, queries) < 0.8  # these have hardly any clusters
    # the scores are those of exact search
    want = {(r.query_id, r.vec_id): r.score for r in R.nearest(vectors, queries, 10).collect()}
    assert all(abs(want[r.query_id, r.vec_id] - r.score) < 1e-6 for r in found.collect() if (r.query_id, r.vec_id) in want)


def test_clustered_vectors_few_lists(spark):
    """Vectors around many centres, and a third of all rows equal."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)), np.repeat(centres[:1], 1000, 0)]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    queries = vectors.where("vec_id % 100 = 1 and vec_id < 2000")
    index = V.built(vectors, lists=48)
    found = V.nearest(index, queries, 10)
    exact = {q: [] for q in range(1, 2000, 100)}
    for r in R.nearest(vectors, queries, 10).collect():
        exact[r.query_id].append(r.score)
    got = {q: [] for q in exact}
    for r in found.collect():
        got[r.query_id].append(r.score)
    hits = sum(s >= min(exact[q]) - 1e-5 for q in exact for s in got[q])
    assert hits >= 0.9 * sum(map(len, exact.values())) and all(len(s) == 10 for s in got.values())
    assert V.share_read(index, queries) < 0.5


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]])
def test_small_tables(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = V.nearest(V.built(vectors), vectors, 3).collect()
    n = len([r for r in rows if r[1]])
    assert len(found) == n * min(3, n)
    assert all(r.score == 1.0 and r.vec_id == r["rank"] - (n > 1) for r in found)
