"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.clustered_search import search_sql
from sparkloom.llm.secret_scan import spans_sql
from sparkloom.storage import new_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.media import documents_as_media

    return documents_as_media(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.folds import remainder
    from sparkloom.llm.quality import quality

    fold = remainder(F.col("doc_id"), 4)
    scored = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", fold != 2)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", "predicted")


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.ctw import score
    from sparkloom.llm.folds import remainder

    fold = remainder(F.col("doc_id"), 7)
    scored = score(_table(spark, sf_dir, "documents"), fold != 2)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.secret_scan import report, scan

    versions = _table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) path", "text")
    return report(scan(versions, new_folder(spark, "ledger"))).withColumnRenamed("path", "doc_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.jaccard import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.packing import pack
    from sparkloom.llm.tokenize import public_tokenizer

    return pack(_table(spark, sf_dir, "documents"), public_tokenizer(TOKENIZER), END_ID)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.warc import read_archives, write_archives

    manifest = write_archives(_table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_archives(manifest).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "offset", "length")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.folds import remainder
    from sparkloom.llm.toxicity import toxicity

    fold = remainder(F.col("doc_id"), 5)
    scored = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "toxic", fold != 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.tokenids import documents_through_files
    from sparkloom.llm.tokenize import public_tokenizer

    return documents_through_files(spark, _table(spark, sf_dir, "documents"), new_folder(spark, "ids"), public_tokenizer(TOKENIZER), END_ID)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.token_alignment import alignment
    from sparkloom.llm.tokenize import public_tokenizer

    return alignment(_table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))


def op12_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.line_crf import line_rules

    return line_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_clustered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.clustered_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_quality": op2_quality,
    "op3_ctw": op3_ctw,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard": op6_jaccard,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_token_ids": op10_token_ids,
    "op11_alignment": op11_alignment,
    "op12_line_crf": op12_line_crf,
    "op13_clustered_search": op13_clustered_search,
}

SQL: dict[str, str] = {
    "op4_secrets": spans_sql(),
    "op13_clustered_search": search_sql(),
}
