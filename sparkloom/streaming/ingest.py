"""An extension: files that arrive in a folder become chunks, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.documents import chunks
from sparkloom.sources.formats import extracted


def run(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Takes all files of ``source`` that earlier runs have not taken and appends their chunks to ``target``.

    A document's id is the hash of its path; a batch is written under its number, so
    one that is repeated after a failure replaces itself. The stream knows files by their
    paths: one that changes is taken again only under another name.
    """

    def append(batch: DataFrame, number: int) -> None:
        docs = extracted(batch).where("text is not null").select(F.sha1(F.col("path").cast("binary")).alias("doc_id"), "text")
        chunks(docs).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
