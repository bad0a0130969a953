"""Retrieval and answers as one plan over a batch of queries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS, Config
from sparkloom.functions.filters import predicate
from sparkloom.operators import questions as Q
from sparkloom.operators import retrieval as R
from sparkloom.operators.postings import KeywordIndex, best
from sparkloom.operators.vector_index import VectorIndex, nearest


def retrieve(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", limit: int = DEFAULTS.top_k, filters: dict[str, Any] | None = None, config: Config = DEFAULTS, keywords: KeywordIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """query_id, vector_id, score, source, scores, rank: keyword, semantic, or both lists (each cut to ``limit``) fused. Blank queries find nothing.

    With an index of the same chunks a list comes from that: of ``keywords`` the same
    rows, of ``vectors`` about the same; filtered semantic lists are always exact.
    """
    asked = queries.where(F.length(F.trim("query")) > 0)
    lists = []
    if mode in ("semantic", "hybrid"):
        allowed = chunks.where(predicate(chunks, filters))  # pushed into the scan
        if vectors is not None and not filters:
            own = asked.select("query_id", R.char_embedding(F.col("query")).alias("embedding"))
            lists.append(("semantic", nearest(vectors, own, limit, query_key="query_id").withColumn("score", F.round("score", 9))))
        else:
            lists.append(("semantic", R.dense_top(allowed, asked, limit)))
    if mode in ("keyword", "hybrid") and keywords is not None:
        lists.append(("keyword", best(keywords, asked, limit, allowed=chunks.where(predicate(chunks, filters)) if filters else None)))
    elif mode in ("keyword", "hybrid"):
        scores = R.bm25_scores(chunks, asked)
        lists.append(("keyword", R.top(R.filtered(scores, chunks, filters) if filters else scores, limit)))
    if not lists:
        raise ValueError(f"mode {mode!r}: keyword, semantic or hybrid is expected")
    if len(lists) == 1:
        name, rows = lists[0]
        return rows.select("query_id", "vector_id", "score", F.lit(name).alias("source"), F.create_map(F.lit(name), F.col("score")).alias("scores"), "rank")
    return R.fused(lists, limit, config.rrf_k)


def matches(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", filters: dict[str, Any] | None = None, config: Config = DEFAULTS) -> DataFrame:
    """The reranked best chunks of each query with their text and metadata (a struct of all columns of theirs that are no part of an index); score and rank are the reranker's."""
    found = retrieve(chunks, queries, mode, config.top_k, filters, config)
    marks = [c for c in chunks.columns if c not in ("vector_id", "text", "terms", "dl", "embedding")]
    metadata = F.struct(*marks) if marks else F.lit(None).cast("struct<none:string>")
    rows = found.join(chunks.select("vector_id", "text", metadata.alias("metadata")), "vector_id").join(queries.select("query_id", "query"), "query_id")
    best = R.reranked(rows, config.rerank_top_k)
    return best.select("query_id", "vector_id", "text", "metadata", "source", "scores", F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("rank"))


def answer(chunks: DataFrame, queries: DataFrame, rewrite: bool = False, mode: str = "hybrid", filters: dict[str, Any] | None = None, config: Config = DEFAULTS) -> DataFrame:
    """query_id, intent, complexity, route, confidence, answer, context for each query; with ``rewrite`` the first variant is retrieved with."""
    asked = queries.where(F.length(F.trim("query")) > 0)
    used = Q.rewritten(asked).where("variant_no = 0").select("query_id", F.col("rewrite").alias("query")) if rewrite else queries
    found = retrieve(chunks, used, mode, config.top_k, filters, config)
    rows = found.join(chunks.select("vector_id", "text"), "vector_id").join(queries.select("query_id", "query"), "query_id")
    best = R.reranked(rows, config.rerank_top_k)
    selected = Q.context(best.select("query_id", "vector_id", "text", F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("rank")), config)
    known = Q.understood(queries)
    out = known.select("query_id", "query", "intent", "complexity").join(Q.routed(known, selected, config), "query_id")
    return out.join(Q.extractive_answers(queries, selected), "query_id").join(Q.context_text(selected), "query_id", "left")
