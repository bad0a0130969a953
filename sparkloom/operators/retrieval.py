"""Sparse, dense and fused retrieval for a batch of queries.

Queries are a stated set: a DataFrame query_id, query. Statistics are over all
chunks; only rows with a query's terms are grouped, and the best rows of a query
are kept by a ranked window, which Spark limits before its shuffle.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.filters import predicate
from sparkloom.storage import written

#: A query's terms are sent to every task if there are so few; else joined.
FEW_TERMS = 10_000


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank from 1; ties by the chunk's key."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "vector_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times: how often each query has each term."""
    return queries.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def index_rows(chunks: DataFrame) -> DataFrame:
    """The chunks with their terms, how many there are, and their vector: what an index holds."""
    rows = chunks.withColumn("terms", T.terms(F.col("text"))).withColumn("embedding", _embedding(chunks))
    return rows.withColumn("dl", F.size("terms"))


def indexed(chunks: DataFrame) -> DataFrame:
    """An index, written once for all that reads it; see ``operators.documents.upserted`` for changing one."""
    return written(index_rows(chunks), "index")


def updated(index: DataFrame, chunks: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The index with the chunks of some documents (document_id, vector_id, text, ...) in place of all that these had, and without the documents of ``removed``; only the new chunks are taken apart."""
    gone = chunks.select("document_id") if removed is None else chunks.select("document_id").union(removed.select("document_id"))
    return written(index.join(gone.distinct(), "document_id", "left_anti").unionByName(index_rows(chunks), allowMissingColumns=True), "index")


def _terms(chunks: DataFrame) -> Column:
    return F.col("terms") if "terms" in chunks.columns else T.terms(F.col("text"))


def _length(chunks: DataFrame) -> Column:
    return F.col("dl") if "dl" in chunks.columns else F.size(_terms(chunks))


def _hits(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """vector_id, dl, term, tf of the terms that any query has."""
    rows = chunks.select("vector_id", _terms(chunks).alias("terms"), _length(chunks).alias("dl"))
    few = [r.term for r in wanted.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        rows = rows.withColumn("terms", F.filter("terms", lambda t: t.isin(few)))
        return rows.select("vector_id", "dl", F.explode("terms").alias("term")).groupBy("vector_id", "dl", "term").agg(F.count("*").alias("tf"))
    return rows.select("vector_id", "dl", F.explode("terms").alias("term")).groupBy("vector_id", "dl", "term").agg(F.count("*").alias("tf")).join(wanted.select("term").distinct(), "term", "left_semi")


def overlap_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct shared terms plus the share of the chunk's terms that the query has; rows above 0."""
    wanted = query_terms(queries)
    joined = _hits(chunks, wanted).join(wanted, "term")
    return joined.groupBy("query_id", "vector_id").agg(F.round(F.count("*") + F.sum("tf") / F.first("dl"), 9).alias("score"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """BM25 over all chunks: query terms count as often as they occur; a negative idf becomes ``floor`` times the mean idf. Rows above 0."""
    wanted = query_terms(queries)
    lengths = chunks.select(_length(chunks).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, average = lengths.n, lengths.avgdl or 1.0
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    hits = written(_hits(chunks, wanted), "hits")
    found = hits.groupBy("term").agg(F.count("*").alias("df"))
    mean = 0.0
    if found.where(idf < 0).limit(1).count():  # only then: the mean over every term of the corpus, by its document frequency
        every = chunks.select(F.explode(F.array_distinct(_terms(chunks))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        mean = every.groupBy("df").agg(F.count("*").alias("m")).agg((F.sum(F.col("m") * idf) / F.sum("m"))).first()[0] or 0.0
    of_term = found.select("term", F.when(idf < 0, F.lit(floor * mean)).otherwise(idf).alias("idf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(average)))
    joined = hits.join(F.broadcast(wanted.join(of_term, "term")) if wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS else wanted.join(of_term, "term"), "term")
    return joined.groupBy("query_id", "vector_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")  # sums in another order still tie


def filtered(scored: DataFrame, chunks: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """Scores of the chunks that pass; after scoring, since statistics are the whole corpus's."""
    return scored.join(chunks.where(predicate(chunks, filters)).select("vector_id"), "vector_id", "left_semi")


def char_embedding(text: Column, size: int = 16) -> Column:
    """Counts of lowered characters by code point modulo ``size``, of length one."""

    @F.arrow_udf("array<double>")
    def counts(texts: pa.Array) -> pa.Array:
        own = pc.fill_null(texts, "").to_pylist()
        rows = np.repeat(np.arange(len(own)), list(map(len, own)))
        codes = np.frombuffer("".join(own).encode("utf-32-le"), "<u4") % size
        v = np.bincount(rows * size + codes, minlength=len(own) * size).reshape(-1, size).astype(float)
        v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * size, pa.int32()), pa.array(v.ravel()))

    return counts(F.lower(text))


def similarity(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    squared = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.greatest(squared, F.lit(0.0)))


def dense_top(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k chunks most similar to each query, with score and rank; a task sends k rows a query and batch, not every pair."""
    own = chunks.select("vector_id", _embedding(chunks).alias("embedding"))
    asked = queries.select("query_id", char_embedding(F.col("query")).alias("embedding"))
    return nearest(own, asked, k, key="vector_id", query_key="query_id").withColumn("score", F.round("score", 9))


def _embedding(chunks: DataFrame) -> Column:
    return F.col("embedding") if "embedding" in chunks.columns else char_embedding(F.col("text"))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of one length; 0 where either is all zeros."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)

    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048, key: str = "vec_id", query_key: str = "vec_id", same: str | None = None) -> DataFrame:
    """query_id, the vector's key, score, rank: exact nearest vectors (key, embedding) of each query vector (query_key, embedding), by matrix products a block of queries at a time; with ``same`` only those that agree in that column."""
    number = queries.count()
    blocks = max(1, -(-number // block))
    types = f"query_id {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    out = None
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == i).select(query_key, "embedding", *([same] if same else [])).collect()  # about ``block`` vectors
        ids, q = np.array([r[0] for r in own]), np.array([r.embedding for r in own], float)
        marks = np.array([r[same] for r in own]) if same else None

        def run(batches, ids=ids, q=q, marks=marks):
            for batch in batches:
                found = []
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                    if len(q) and len(x):
                        d = np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0)
                        if same:
                            d[marks[:, None] != part.column(same).to_numpy(zero_copy_only=False)[None, :]] = np.inf
                        m = min(k, len(x))
                        # keep ties at the edge: the window breaks them
                        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
                        row, col = np.nonzero((d <= edge[:, None] + 1e-9) & np.isfinite(d))
                        exact = ((q[row] - x[col]) ** 2).sum(1)
                        found.append(pa.RecordBatch.from_arrays([pa.array(ids[row]), part.column(key).take(pa.array(col)), pa.array(1 / (1 + exact))], ["query_id", key, "score"]))
                yield from found

        part = vectors.select(key, "embedding", *([same] if same else [])).mapInArrow(run, types)
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fused(lists: list[tuple[str, DataFrame]], limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, vector_id, score, rank from 1), named by source: query_id, vector_id, score, source, scores, rank."""
    every = None
    for place, (name, ranked) in enumerate(lists):
        rows = ranked.select("query_id", "vector_id", F.lit(name).alias("source"), F.lit(place).alias("place"), F.col("rank").alias("own_rank"), F.col("score").alias("own"))
        every = rows if every is None else every.union(rows)
    grouped = every.groupBy("query_id", "vector_id").agg(
        F.sum(1 / (k + F.col("own_rank"))).alias("score"),
        F.when(F.count_distinct("source") > 1, F.lit("hybrid")).otherwise(F.min("source")).alias("source"),
        F.min(F.struct("place", "own_rank")).alias("first"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "own")))).alias("scores"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("first")


def reranked(matches: DataFrame, limit: int) -> DataFrame:
    """Adds to each match's score the share of its query's terms in its text; matches have query, text and a rank for ties."""
    asked = T.term_set(F.col("query"))
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.term_set(F.col("text")))) / F.size(asked)).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    rows = matches.withColumn("rerank_score", F.col("score") + share).withColumn("rerank_rank", F.row_number().over(w))
    return rows.where(F.col("rerank_rank") <= limit)


