"""Folds of documents by the checksum of their number, and bounded labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the number as text, by the modulus; -1 for a null number, which is in no fold of its own."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents that may be learnt from, chosen by hash.

    Only labels are sorted; the chosen numbers, bounded by ``most``, go to every
    task, and of rows with one doc_id the least text stays, so no text is shuffled
    but the sample's.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    chosen = known.where(may_learn).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
