"""Approximate nearest vectors: an inverted file of product-quantised residuals.

``built`` finds ``lists`` centres by k-means whose rounds are sums over tasks, learns
one codebook for each slice of the residuals, and writes every vector with its code
under the list of its nearest centre (one folder a list, a list dealt over ``salts``
tasks). How many lists a search visits (``probes``) is measured when the index is built:
as many as hold the share ``recall`` of the neighbours of some vectors of the sample.
``nearest`` reads the codes of a query's ``probes`` nearest lists only, adds up
distances from tables of query and codebook, and ranks the ``candidates`` best of them
anew by their whole vectors. Centres and codebooks are learnt on at most ``sample``
vectors; all vectors are indexed.

Defined cases: a null vector is in no list; fewer vectors than lists give a list for
each different one; repeated keys are vectors each; of equal scores the least key
comes first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.storage import new_folder, written

#: Queries whose vectors are in a task at once.
BLOCK = 1024
ROUNDS, SEED = 8, 11


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    key: str
    kind: str  # the key's type
    vectors: int
    centres: np.ndarray  # lists x size
    books: np.ndarray  # slices x codes x size of a slice
    probes: int

    def table(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.kind}, code binary, embedding array<float>, list int").parquet(self.path)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows, -1) if rows else np.zeros((0, 1), np.float32)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each chosen with chances that grow with the squared distance from those chosen."""
    chosen = [x[rng.integers(len(x))]]
    far = _squared(x, chosen[0][None])[:, 0]
    while len(chosen) < k and far.sum() > 0:
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, _squared(x, chosen[-1][None])[:, 0])
    return np.array(chosen, np.float32)


def _moved(x: np.ndarray, centres: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centres after some rounds of k-means over bounded rows; one without rows stays."""
    for _ in range(rounds):
        own = _squared(x, centres).argmin(1)
        many = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres).astype(np.float32)
    return centres


def centres_of(vectors: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """k-means over a table's ``embedding``: a task sends the sums of its vectors by list, Spark adds them up, the driver holds the centres."""
    centres = start
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, many = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
            for batch in batches:
                x = _matrix(batch.column("embedding"))
                own = _squared(x, centres).argmin(1) if len(x) else np.zeros(0, int)
                np.add.at(total, own, x) if len(x) else None
                many += np.bincount(own, minlength=len(centres))
            some = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(many[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["list", "n", "total"])

        size = centres.shape[1]
        added = vectors.mapInArrow(sums, "list int, n long, total array<double>").groupBy("list").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))
        moved = centres.copy()
        for r in added.collect():  # a row for each list
            moved[r.list] = np.array(r.total) / r.n
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def built(vectors: DataFrame, key: str = "vec_id", lists: int | None = None, slices: int = 16, codes: int = 256, sample: int = 65_536, salts: int = 4, recall: float = 0.95) -> VectorIndex:
    """An index of (key, embedding); ``lists`` is by default the square root of the number of vectors, 4096 at most."""
    spark, rng = vectors.sparkSession, np.random.default_rng(SEED)
    rows = vectors.where("embedding is not null").select(key, F.col("embedding").cast("array<float>").alias("embedding"))
    n = rows.count()
    path, kind = new_folder(spark, "vectors"), vectors.schema[key].dataType.simpleString()
    chosen = written(rows.select("embedding").sample(fraction=min(1.0, sample / max(n, 1)), seed=SEED).limit(2 * sample), "sample") if n > sample else rows.select("embedding")
    few = np.array([r.embedding for r in chosen.limit(min(sample, 16_384)).collect()], np.float32)  # to begin with, and for the codebooks
    if not n:
        return VectorIndex(spark, path, key, kind, 0, np.zeros((0, 1), np.float32), np.zeros((0, 0, 1), np.float32), 0)
    lists = lists or max(1, min(4096, round(n**0.5)))
    centres = centres_of(chosen, _spread_out(few, lists, rng))
    size = few.shape[1]
    slices = next(s for s in range(min(slices, size), 0, -1) if size % s == 0)
    rest = few - centres[_squared(few, centres).argmin(1)]
    books = [_spread_out(rest[:, i : i + size // slices], codes, rng) for i in range(0, size, size // slices)]
    books = [_moved(rest[:, i * (size // slices) : (i + 1) * (size // slices)], b) for i, b in enumerate(books)]
    most = max(map(len, books))
    books = np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in books])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            own = _squared(x, centres).argmin(1) if len(x) else np.zeros(0, int)
            left = (x - centres[own]).reshape(len(x), slices, -1) if len(x) else np.zeros((0, slices, 1))
            code = np.stack([_squared(left[:, s], books[s]).argmin(1) for s in range(slices)], 1).astype(np.uint8) if len(x) else np.zeros((0, slices), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("embedding"), pa.array(own, pa.int32())], [key, "code", "embedding", "list"])

    coded = rows.mapInArrow(encode, f"{key} {kind}, code binary, embedding array<float>, list int")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded.repartition(tasks, "list", F.pmod(F.xxhash64(key), F.lit(salts))).write.partitionBy("list").option("compression", "zstd").parquet(path)
    return VectorIndex(spark, path, key, kind, n, centres, books, _enough(few, centres, recall))


def _enough(x: np.ndarray, centres: np.ndarray, recall: float, neighbours: int = 10, queries: int = 256) -> int:
    """How many lists hold so large a share of the nearest rows of some rows of a bounded sample."""
    x = np.unique(x, axis=0)  # copies would have their neighbours for certain
    q = x[:: max(1, len(x) // queries)]
    near = np.argsort(_squared(q, x), axis=1)[:, 1 : neighbours + 1]
    if not near.size:
        return len(centres)
    place = _squared(q, centres).argsort(1, kind="stable").argsort(1, kind="stable")
    needed = np.take_along_axis(place, _squared(x, centres).argmin(1)[near], 1)
    return int(np.quantile(needed, recall, method="higher")) + 1


def _probed(index: VectorIndex, q: np.ndarray, probes: int) -> np.ndarray:
    """queries x lists: which lists each query visits."""
    far = _squared(q, index.centres)
    place = far.argsort(1, kind="stable").argsort(1, kind="stable")
    return place < probes


def nearest(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, candidates: int = 100, query_key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """query_id, the key, score, rank of about the k nearest vectors of each query (query_key, embedding): score is 1 / (1 + squared distance), of whole vectors."""
    key, kind = index.key, index.kind
    query_kind = queries.schema[query_key].dataType.simpleString()
    schema = f"query_id {query_kind}, {key} {kind}, score double"
    out = index.spark.createDataFrame([], schema)
    asked = written(queries.where("embedding is not null").select(F.col(query_key).alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")), "queries")
    blocks = -(-asked.count() // block) if index.vectors else 0
    found = []
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()  # about ``block`` vectors
        if own:
            found.append(written(_block(index, own, k, probes or index.probes, candidates, schema), "nearest"))
    for part in found:
        out = out.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(index: VectorIndex, own: list, k: int, probes: int, candidates: int, schema: str) -> DataFrame:
    key, centres, books = index.key, index.centres, index.books
    ids, q = [r.query_id for r in own], np.array([r.embedding for r in own], np.float32)
    visits = _probed(index, q, probes)
    lists = np.flatnonzero(visits.any(0)).tolist()  # at most index.centres
    rows = index.table().where(F.col("list").isin(lists))
    slices = len(books)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, slices)
            of, keys, out = batch.column("list").to_numpy(), batch.column(key), []
            for one in np.unique(of):
                at, asks = np.flatnonzero(of == one), np.flatnonzero(visits[:, one])
                rest = (q[asks] - centres[one]).reshape(len(asks), slices, -1)
                tables = np.stack([_squared(rest[:, s], books[s]) for s in range(slices)], 1)  # queries x slices x codes
                far = sum(tables[:, s][:, code[at, s]] for s in range(slices))
                m = min(candidates, len(at))
                near = np.argpartition(far, m - 1, axis=1)[:, :m]
                row = np.repeat(np.arange(len(asks)), m)
                out.append(pa.RecordBatch.from_arrays([pa.array(asks[row], pa.int32()), keys.take(pa.array(at[near.ravel()])), pa.array(np.full(len(row), one), pa.int32()), pa.array(far[row, near.ravel()], pa.float64())], ["place", key, "list", "far"]))
            yield from out

    near = rows.select(key, "code", "list").mapInArrow(approximate, f"place int, {key} {index.kind}, list int, far double")
    order = Window.partitionBy("place").orderBy("far", key)
    best = written(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= candidates).select("place", key, "list").distinct(), "candidates")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            x = _matrix(batch.column("embedding"))
            far = ((q[place].astype(float) - x) ** 2).sum(1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array([ids[p] for p in place], schema_type), batch.column(key), pa.array(1 / (1 + far))], ["query_id", key, "score"])

    schema_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[schema.split(",")[0].split()[1]]
    scored = best.join(rows.select(key, "list", "embedding"), ["list", key]).select("place", key, "embedding").mapInArrow(exact, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def share_read(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> float:
    """What share of all codes the queries (embedding), each on its own, read on the average."""
    own = np.array([r.embedding for r in queries.where("embedding is not null").select("embedding").limit(BLOCK).collect()], np.float32)
    sizes = np.zeros(len(index.centres))
    for r in index.table().groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    return float((_probed(index, own, probes or index.probes) * sizes).sum(1).mean() / max(sizes.sum(), 1))
