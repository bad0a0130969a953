"""Latent semantic vectors: TF-IDF and a randomised SVD whose products are sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts in which tasks send a sum, so that no task adds up a whole one.
PARTS = 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def column_sum(df: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of_batch`` (a flat array of ``size`` numbers) over all batches: by task in single precision (exact for counts below 2^24), then by part in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size, np.float32), False
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
                any_rows = True
        if not any_rows:
            return
        parts = [p.tobytes() for p in np.array_split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "value"])

    def whole(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": parts["part"][:1], "value": [sum(np.frombuffer(v, np.float32).astype(float) for v in parts["value"]).tobytes()]})

    summed = df.mapInArrow(partial, "part int, value binary").groupBy("part").applyInPandas(whole, "part int, value binary")
    rows = sorted(summed.collect())  # at most ``size`` numbers
    return np.concatenate([np.frombuffer(v) for _, v in rows]) if rows else np.zeros(size)


def inverse_frequencies(df: DataFrame, counts: Callable[[pa.RecordBatch], Iterator[np.ndarray]], terms: int) -> np.ndarray:
    """Smoothed inverse document frequencies over all rows."""

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(terms + 1)
        for block in counts(batch):
            out[:terms] += np.count_nonzero(block, axis=0)
            out[terms] += len(block)
        return out

    found = column_sum(df, of_batch, terms + 1)
    return (np.log((1 + found[-1]) / (1 + found[:-1])) + 1).astype(np.float32)


def basis(df: DataFrame, vectors: Callable[[pa.RecordBatch], Iterator[np.ndarray]], terms: int, rank: int, rounds: int = 3, over: int = 8, seed: int = 7) -> np.ndarray:
    """``terms`` x ``rank``: the leading right singular vectors of the rows' matrix A, by randomised subspace iteration.

    A round sends Q to the tasks and adds up A'(AQ) of their rows; the driver holds
    matrices of terms x (rank + over) only.
    """
    width = rank + over
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0].astype(np.float32)
    for i in range(rounds):

        def of_batch(batch: pa.RecordBatch, q: np.ndarray = q) -> np.ndarray:
            return sum((a.T @ (a @ q) for a in vectors(batch)), np.zeros((terms, width), np.float32)).ravel()

        z = column_sum(df, of_batch, terms * width).reshape(terms, width)
        if i < rounds - 1:
            q = np.linalg.qr(z)[0].astype(np.float32)
    _, turn = np.linalg.eigh(q.T @ z)  # of Q'A'AQ
    return np.ascontiguousarray((q @ turn[:, ::-1][:, :rank]).astype(np.float32))


def spread(df: DataFrame, rows: int, rows_each: int = 512) -> DataFrame:
    """A bounded sample over so few tasks that their sums stay small."""
    return df.repartition(max(1, -(-rows // rows_each)))
