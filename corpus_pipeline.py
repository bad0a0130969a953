"""A corpus from raw documents to packed sequences.

Stages, each written as Parquet and read by the next: toxic documents go; of each
group of near copies one row stays, the one with the least doc_id; documents that
leak a benchmark item go; secrets are redacted; what is left is packed. A row without
a doc_id comes after the numbered ones of its group and is otherwise treated as they
are; rows that repeat a doc_id are copies of each other for the second stage only if
their texts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.storage import new_folder, written

TOKENIZER, END_ID = "word_bpe_49k.json", 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from sparkloom.llm.toxicity import toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, "toxic", F.lit(True), keep=tuple(docs.columns)).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from sparkloom.llm.jaccard import jaccard_join

    # by text, so that rows that share a number or have none count too; each different text has a number of its own
    rows = docs.withColumn("text_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    texts = written(rows.select("text_key", "text").dropDuplicates(["text_key"]).withColumn("doc_id", F.monotonically_increasing_id()), "texts")
    classes = jaccard_join(texts.select("doc_id", "text")).join(texts.select("doc_id", "text_key"), "doc_id").select("text_key", "class_id")
    first = rows.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "text_key")).alias("first"))
    stays = first.join(classes, "text_key").groupBy("class_id").agg(F.min("first").alias("first"))
    stays = written(stays.select(F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key")), "stays")
    kept = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left_semi")
    # of rows with one number and text the least stays
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = kept.groupBy("doc_id", "text_key").agg(F.any_value("text").alias("text"), F.min(F.struct(F.lit(0), *others)).alias("others"))
    return least.select("doc_id", "text", *[F.col(f"others.{c}").alias(c) for c in others]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from sparkloom.llm.decontaminate import leaks

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # by text, so that rows without a number count too
    leaked = leaks(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("text_hash")).distinct()
    kept = docs.withColumn("text_hash", F.xxhash64("text")).join(written(leaked, "leaked"), "text_hash", "left_anti")
    return kept.select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from sparkloom.llm.secret_scan import redacted, scan_blobs

    findings = scan_blobs(docs.select(F.col("doc_id").alias("path"), "text"), new_folder(spark, "ledger")).withColumnRenamed("blob", "text_name")
    joined = docs.withColumn("text_name", F.sha2("text", 256)).join(findings, "text_name", "left")
    clean = F.when(F.col("spans").isNotNull(), redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    changed = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from sparkloom.llm.packing import pack
    from sparkloom.llm.tokenize import public_tokenizer

    return pack(docs, public_tokenizer(TOKENIZER), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark leaks", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: The stages' classifiers, hashes and tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
