"""The latent space of operator 5 comes from all passages."""

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import decontaminate as O


def batch(texts, weights):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(weights)], ["text", "weight"])


def test_product_of_all_rows_equals_that_of_dense_ones():
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in draw.zipf(1.5, n) % 400) for n in (1, 5, 31, 32, 33, 64, 65, 300)] + ["", None, "same " * 70]
    rows = batch(texts, draw.choice([1.0, O.ITEM_WEIGHT], len(texts)))
    idf = draw.random(O.TERMS).astype(np.float32) + 0.1
    q = draw.normal(size=(O.TERMS, 5)).astype(np.float32)
    a = np.concatenate(list(O._rows(rows, idf)))
    assert np.allclose(O._product(rows, q, idf).reshape(q.shape), a.T @ (a @ q), atol=1e-3)


def test_every_document_is_read_for_the_space(spark, monkeypatch):
    """Of a corpus much larger than the sample all texts come to the last round."""
    asked, column_sum = [], O.column_sum
    monkeypatch.setattr(O, "column_sum", lambda df, f, size: asked.append((size, df.count())) or column_sum(df, f, size))
    docs = spark.createDataFrame([(i, " ".join(f"t{i}x{k % 7}" for k in range(80))) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, docs.first().text)], "item_id long, text string")
    assert [(r.doc_id, r.lcs_share) for r in O.leaks(docs, items, sample=2).collect()] == [(0, pytest.approx(1.0))]
    assert (O.TERMS * O.RANK, 61) in asked
