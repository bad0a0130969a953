"""What may be plugged in: callables from DataFrame to DataFrame."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Parser(Protocol):
    def __call__(self, sentences: DataFrame) -> DataFrame:
        """document_id, sent_id, text to the token table of ``operators.relations``."""


class Embedder(Protocol):
    def __call__(self, chunks: DataFrame) -> DataFrame:
        """vector_id, text to vector_id, embedding of length one."""


class Rewriter(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """query_id, query to query_id, variant_no, strategy, rewrite, confidence."""


class Generator(Protocol):
    def __call__(self, contexts: DataFrame) -> DataFrame:
        """query_id, query, context to query_id, reply."""


def parsed_rewrites(replies: DataFrame, fallback: DataFrame) -> DataFrame:
    """Variants from a model's JSON replies (query_id, reply); queries whose reply isn't three variants with confidences from 0 to 1 get the fallback's."""
    schema = "queries array<struct<query:string,strategy:string,confidence:double>>"
    rows = replies.select("query_id", F.from_json("reply", schema)["queries"].alias("q"))
    good = (F.size("q") == 3) & F.forall("q", lambda x: x["query"].isNotNull() & x["confidence"].between(0, 1))
    kept = rows.where(F.coalesce(good, F.lit(False))).select("query_id", F.posexplode("q").alias("variant_no", "v"))
    own = kept.select("query_id", "variant_no", F.col("v.strategy").alias("strategy"), F.col("v.query").alias("rewrite"), F.col("v.confidence").alias("confidence"))
    return own.union(fallback.join(own.select("query_id").distinct(), "query_id", "left_anti").select(*own.columns))


def parsed_answers(replies: DataFrame) -> DataFrame:
    """query_id, answer, key_points (5 at most), related_questions (4 at most); a reply that isn't JSON is the answer itself, and no reply is none."""
    parsed = F.from_json("reply", "answer string, key_points array<string>, related_questions array<string>")
    rows = replies.where("trim(reply) <> ''").select("query_id", "reply", parsed.alias("p"))
    none = F.array().cast("array<string>")
    return rows.select("query_id", F.coalesce("p.answer", "reply").alias("answer"), F.slice(F.coalesce("p.key_points", none), 1, 5).alias("key_points"), F.slice(F.coalesce("p.related_questions", none), 1, 4).alias("related_questions"))


def resilient_answers(replies: DataFrame, fallback: DataFrame, name: str = "model") -> DataFrame:
    """Answers from replies, and the fallback's (query_id, answer) for queries without a usable one; ``generator`` names whose each is."""
    none = F.array().cast("array<string>")
    own = parsed_answers(replies).withColumn("generator", F.lit(name))
    rest = fallback.join(own.select("query_id"), "query_id", "left_anti")
    return own.unionByName(rest.select("query_id", "answer", none.alias("key_points"), none.alias("related_questions"), F.lit("extractive").alias("generator")))


def by_route(routes: DataFrame, generators: dict[str, Generator], default: Generator) -> DataFrame:
    """query_id, reply of each query's context (query_id, query, context, route), by the generator of its route or else the default."""
    parts = [g(routes.where(F.col("route") == route)) for route, g in generators.items()]
    parts.append(default(routes.where(~F.coalesce(F.col("route").isin(*generators), F.lit(False))) if generators else routes))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
