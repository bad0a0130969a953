"""Operator 2: document quality by votes of the nearest labelled documents.

Terms are byte trigrams and pairs of word shapes (``terms``), weighted by logarithm
of the count and inverse document frequency over all documents; each of the two
groups has length one, shapes weigh ``SHAPE_WEIGHT`` times as much. A randomised
SVD of at most ``most_labelled`` labelled documents gives the latent space. Their
vectors (most_labelled x rank numbers) go to every task; each document's cosine
with all of them is one product a block, exactly, and the ``neighbours`` nearest
vote with their similarity to the power ``SHARPNESS``.

Defined cases: a text with no terms is like nothing, so it gets the mean label, as
every text does where no label is known (then 0.5); repeated rows get a score
each; of labelled texts at equal distance those with the least doc_id vote; a null
doc_id is never learnt from; a long text's terms are counted in pieces; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.folds import labelled_sample
from sparkloom.llm.lsa import basis, inverse_frequencies, spread, unit
from sparkloom.llm.terms import TERMS, TRIGRAMS, term_counts
from sparkloom.storage import written

SHAPE_WEIGHT, SHARPNESS, PRIOR_WEIGHT = 2.0, 4, 1e-3
ROWS = 256
#: Decimals that cosines count with, so that equal texts tie whatever batch they are in.
DIGITS = 5


def _counts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for i in range(0, batch.num_rows, ROWS):
        yield term_counts(batch.column("text").slice(i, ROWS))


def _vectors(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[np.ndarray]:
    for counts in _counts(batch):
        x = np.log1p(counts) * idf
        yield unit(np.concatenate([unit(x[:, :TRIGRAMS]), SHAPE_WEIGHT * unit(x[:, TRIGRAMS:])], axis=1)).astype(np.float32)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Scores of rows of length one (or zero) by the labels of their nearest known rows."""
    if not len(known):
        return np.full(len(vectors), 0.5)
    cosine = np.round(vectors @ known.T, DIGITS)
    k = min(neighbours, len(known))
    edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    chosen = cosine >= edge
    for row in np.flatnonzero(chosen.sum(1) > k):  # of equal cosines at the edge the first known rows vote
        ties = np.flatnonzero(cosine[row] == edge[row])
        chosen[row, ties[k - np.count_nonzero(cosine[row] > edge[row]) :]] = False
    nearest = np.nonzero(chosen)[1].reshape(-1, k)
    weight = np.clip(np.take_along_axis(cosine, nearest, 1), 0, 1).astype(float) ** SHARPNESS
    return ((weight * labels[nearest]).sum(1) + PRIOR_WEIGHT * labels.mean()) / (weight.sum(1) + PRIOR_WEIGHT)


def quality(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most_labelled: int = 4096, rank: int = 64, neighbours: int = 15, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for every document; ``may_learn`` is on the labels' doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = spread(written(labelled_sample(docs, labels, label, may_learn, most_labelled), "labelled"), most_labelled)
    idf = inverse_frequencies(texts.select("text"), _counts, TERMS)
    v = basis(sample, lambda batch: _vectors(batch, idf), TERMS, rank)

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros((0, rank), np.float32), *(unit(a @ v) for a in _vectors(batch, idf))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in project(batch)], pa.binary())], ["doc_id", "label", "vector"])

    rows = sorted(sample.mapInArrow(vectors, "doc_id long, label int, vector binary").collect())  # at most most_labelled
    known = np.array([np.frombuffer(r.vector, np.float32) for r in rows]).reshape(-1, rank)
    votes = np.array([r.label for r in rows], float)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = vote(project(batch), known, votes, neighbours)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts.mapInArrow(score, "doc_id long, score double, predicted int")
