"""Documents to sections, chunks, terms and listings; no stage but the listings shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS, Config
from sparkloom.functions import text as T


def cleaned(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, further columns and ``clean_text``; documents left empty are dropped (see ``rejected``), by a look at the raw text, so that a text is cleaned once."""
    return docs.where(F.rlike(F.col("text"), F.lit(T.VISIBLE))).withColumn("clean_text", T.clean(F.col("text")))


def rejected(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without text."""
    return docs.where(~F.coalesce(F.rlike(F.col("text"), F.lit(T.VISIBLE)), F.lit(False))).select(key, F.lit("no text").alias("reason"))


def metadata(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, columns to keep, char_count, word_count and content_id of each document with text."""
    text = F.col("clean_text")
    return cleaned(docs).select(key, *keep, F.length(text).alias("char_count"), F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)).alias("word_count"), F.sha1(text.cast("binary")).alias("content_id"))


def file_metadata(files: DataFrame) -> DataFrame:
    """What is known of each extracted file (path, modificationTime, length, text, page_count): document_id, filename, file_type, file_size, pages, char_count, word_count, content_id, uploaded_at."""
    name = F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([^/]*)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    own = files.select(F.sha1(F.col("path").cast("binary")).alias("document_id"), name.alias("filename"), kind.alias("file_type"), F.col("length").alias("file_size"), F.col("page_count").alias("pages"), F.col("modificationTime").alias("uploaded_at"), "text")
    return metadata(own, "document_id", ("filename", "file_type", "file_size", "pages", "uploaded_at"))


def lookup(store: DataFrame, ids: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """The rows of some documents, and the ids that are unknown."""
    asked = ids.select(key).distinct()
    return store.join(asked, key, "left_semi"), asked.join(store.select(key), key, "left_anti")


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each section of each cleaned document."""
    return cleaned(docs).select(key, F.inline(T.sections(F.col("clean_text"))))


def chunks(docs: DataFrame, key: str = "doc_id", config: Config = DEFAULTS, structural: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks numbered from 0 in a document, across its sections: key, chunk_id, vector_id, section_id, section_title, text, start, end, entities."""
    text = F.col("clean_text")
    whole = F.array(F.struct(F.lit(0).alias("section_id"), T.title(text, F.lit(0)).alias("title"), text.alias("content"), F.lit(0).alias("start")))

    def of_section(s: Column) -> Column:
        return F.transform(
            T.windows(s["content"], s["start"], config.chunk_size, config.chunk_overlap),
            lambda w: F.struct(s["section_id"].alias("section_id"), s["title"].alias("section_title"), w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end")),
        )

    parts = F.flatten(F.transform(T.sections(text) if structural else whole, of_section))
    rows = cleaned(docs).select(key, *keep, F.posexplode(parts).alias("chunk_id", "c")).select(key, *keep, "chunk_id", "c.*")
    return rows.withColumn("vector_id", F.concat_ws("_", F.col(key), F.col("chunk_id"))).withColumn("entities", F.array_sort(F.array_distinct(T.phrases(F.col("text"), 2))))


def flat_metadata(chunked: DataFrame, key: str = "doc_id") -> DataFrame:
    """A chunk's scalar metadata, with -1 and '' where there is none; filename, file_type and indexed_at are its document's, so that a store of chunks can name and list what it holds."""
    of_file = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in chunked.columns else F.lit("")).alias(c) for c in ("filename", "file_type", "indexed_at")]
    own = F.coalesce("section_id", F.lit(-1)).alias("section_id"), F.coalesce("section_title", F.lit("")).alias("section_title"), F.array_join("entities", ", ").alias("entities")
    return chunked.select("vector_id", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("document_id"), "chunk_id", *own, *of_file)


def listing(indexed: DataFrame) -> DataFrame:
    """Indexed documents from their chunks (document_id, filename, indexed_at): blank ids skipped, newest first."""
    first = F.min_by(F.struct("filename", "indexed_at"), "chunk_id")
    rows = indexed.where(F.coalesce("document_id", F.lit("")) != "").groupBy("document_id").agg(F.count("*").alias("chunk_count"), first.alias("f"))
    named = rows.select("document_id", F.coalesce(F.nullif(F.col("f.filename"), F.lit("")), "document_id").alias("display_name"), F.col("f.indexed_at").alias("indexed_at"), "chunk_count")
    return named.orderBy(F.desc("indexed_at"), F.desc("display_name"), "document_id")


def upserted(store: DataFrame, rows: DataFrame, key: str = "vector_id") -> DataFrame:
    """The store with ``rows`` in place of what has their keys."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def deleted(store: DataFrame, tombstones: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """The store without the documents of ``tombstones``, and how many rows each of those lost (0 for unknown ones)."""
    asked = tombstones.select(key).distinct()
    counts = store.join(asked, key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    return store.join(asked, key, "left_anti"), asked.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("chunks_removed"))


def emptied(store: DataFrame) -> DataFrame:
    """The store after a reset: its columns and no rows."""
    return store.limit(0)


def located(offsets: DataFrame, chunked: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each different row (key, offset): the chunk that holds it, the earliest to start, else ''.

    Offsets and the chunks' last places are put in one order, from the end: of all
    chunks that end behind an offset the one that starts first holds it, if any does.
    No offset meets more than one row.
    """
    ends = chunked.where(F.col(key).isNotNull()).select(key, (F.col("end") - 1).cast("long").alias("at"), F.lit(0).alias("kind"), F.struct("start", "vector_id").alias("chunk"))
    asked = offsets.select(key, F.col("offset").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(ends.schema["chunk"].dataType).alias("chunk"))
    first = F.min("chunk").over(Window.partitionBy(key).orderBy(F.desc("at"), "kind"))
    rows = ends.unionByName(asked).withColumn("first", first).where("kind = 1")
    held = F.when((F.col("first.start") <= F.col("at")) & F.col(key).isNotNull(), F.col("first.vector_id")).otherwise("")
    return rows.groupBy(key, F.col("at").cast(offsets.schema["offset"].dataType).alias("offset")).agg(F.first(held).alias("vector_id"))
