"""The text side of the indexes: what is made for a search, and cleaning by signs against the rules as patterns."""

import os

from pyspark.sql import functions as F

from sparkloom import catalog, catalog_index, storage
from sparkloom.functions import text as T

ROWS = [(i, f"token password {'alpha' if i % 2 else 'beta'} word{i} and the stupid clown", "en" if i % 3 else "de", "s") for i in range(30)]


def test_searches_by_vectors_and_postings_make_no_index_of_terms(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    key = storage.content_key(spark, [f"{tmp_path}/documents.parquet"])
    found = {f.__name__: f(spark, str(tmp_path)).count() for f in (catalog.dense_filtered_topk, catalog_index.bm25_postings_filtered_topk, catalog_index.hybrid_postings_topk)}
    assert all(found.values())
    kept = {n.split("-")[1] for n in os.listdir(f"{storage.shared_root(spark).removeprefix('file://')}/sparkloom") if n.startswith("kept-") and n.endswith(key)}
    assert kept == {"chunks", "postings"}  # one cleaning and cutting of each text for both
    assert "terms" not in catalog.chunks_of(spark, str(tmp_path)).columns


def test_stop_words_are_looked_up_in_a_set(spark):
    plan = spark.range(1).select(T.terms(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan


def test_cleaning_by_signs_equals_the_patterns(spark):
    steps = ((r"\r\n?", "\n"), ("[​-‏﻿]", ""), (r"\t", " "), (r" {2,}", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))
    parts = ["a", "\r", "\n", "\r\n", "\t", " ", "  ", "​", "‏", "﻿", "\xa0", "é", "\U0001f600"]
    texts = [(None,), ("",), *((x + y + z + "b" + z + y,) for x in parts for y in parts for z in parts)]
    df = spark.createDataFrame(texts, "text string")
    want = F.coalesce("text", F.lit(""))
    for pattern, new in steps:
        want = F.regexp_replace(want, pattern, new)
    assert df.where(T.clean(F.col("text")) != T.strip(want)).count() == 0


def test_a_file_of_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    rows = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"), F.sha2((-F.col("id")).cast("string"), 512).alias("more"))
    rows.coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/one")
    read = spark.read.parquet(f"{tmp_path}/one").where("id >= 0")
    cores = spark.sparkContext.defaultParallelism
    filled = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert read.rdd.getNumPartitions() >= cores > filled(read)
    assert filled(storage.spread(read)) >= cores and storage.spread(read).count() == 60_000
