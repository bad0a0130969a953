"""Operator 10: token ids on disk, ranked by frequency, in a byte-aligned variable-length code.

File: the magic ``FRV1``, five little-endian unsigned 64-bit integers (shard, first
position in the shard, documents, ids, control bytes), doc_ids as signed 64-bit
integers, one byte for each doc_id that is 1 if it is null, document lengths as
unsigned 32-bit integers, the control bytes, the data bytes. A control byte has the
byte lengths, less one, of four numbers, two bits each from the lowest; a number is
an id's rank by falling frequency in the corpus, then by id, least byte first.
``ranks.bin`` beside the files has the id of each rank as unsigned 32-bit integers.

Texts are sorted by doc_id first and tokenised once, and each task counts its ids as
it goes; ids then stay in their place: a shard is a partition of that sort, and a
file is a run of its rows. Only counts by id (at most the vocabulary) and totals by
shard are gathered.

Defined cases: a null or empty text has the end id only; rows with one doc_id stay
separate, by text; null doc_ids come first; an empty table gives no files and no
rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.blobs import read_blob, spread_files, write_blob
from sparkloom.llm.tokenize import encoder, slices
from sparkloom.storage import written

MAGIC = b"FRV1"
#: Ids of a file: it is closed after the row that reaches them.
IDS_IN_FILE = 1 << 22
#: Byte lengths of the four numbers that a control byte stands for.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes; zeros fill the last four."""
    numbers = np.concatenate([numbers, np.zeros(-len(numbers) % 4, np.uint32)]).astype("<u4")
    more = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    four = more.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_numbers(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` numbers, their byte lengths looked up by control byte."""
    lengths = LENGTHS[control].ravel()
    out = np.zeros((len(lengths), 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = data
    return out.view("<u4").ravel()[:count]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The table shard, position, doc_id, ids (unsigned 32-bit integers as bytes), sorted by doc_id across and within shards.

    Each shard ends with a row at position -1 whose column ``counts`` has how often each id occurs in it, as 64-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, position, total = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        names = ["shard", "position", "doc_id", "ids", "counts"]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = encode(part.column("text"))
                data = np.insert(ids, starts[1:], end_id).astype("<u4", copy=False)
                counts = np.bincount(data, minlength=len(total))
                counts[: len(total)] += total
                total, ends, n = counts, starts + np.arange(len(starts)), part.num_rows
                data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * 4), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(position, position + n)), part.column("doc_id"), data.cast(pa.binary()), pa.nulls(n, pa.binary())], names)
                position += n
        if position:
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([-1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    # rows of one number, and equal rows, may be more than a task should hold
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    return ordered.mapInArrow(run, "shard long, position long, doc_id long, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, from the shards' own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("counts"):
                counts = np.frombuffer(data.as_py(), np.int64).copy()
                short, total = sorted((counts, total), key=len)
                total[: len(short)] += short
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    return tokens.where("position < 0").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _flat(ids: pa.Array) -> np.ndarray:
    """All ids of a column, without copying."""
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    data = ids.buffers()[2]
    return np.frombuffer(data, "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if data and len(ids) else np.zeros(0, "<u4")


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, ids_in_file: int = IDS_IN_FILE) -> DataFrame:
    """Writes the files; the manifest: shard, position, n_docs, n_ids, n_bytes, start (ids before the file), path."""
    tokens = written(tokenized(docs, tokenizer, end_id), "tokens")
    counted = sorted((-n, i) for i, n in id_counts(tokens).collect())  # at most the vocabulary
    of_rank = np.array([i for _, i in counted], "<u4")
    rank = np.zeros(int(of_rank.max(initial=0)) + 1, np.uint32)
    rank[of_rank] = np.arange(len(of_rank))
    write_blob(f"{folder}/ranks.bin", of_rank.tobytes())

    def file(shard: int, position: int, docs: list[int | None], parts: list[np.ndarray]) -> tuple:
        control, data = encode_numbers(rank[np.concatenate(parts)])
        path, n = f"{folder}/ids-{shard:08d}-{position:012d}.frv", sum(map(len, parts))
        head = MAGIC + struct.pack("<5Q", shard, position, len(docs), n, len(control))
        ids = np.array([d or 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs) + np.array([len(p) for p in parts], "<u4").tobytes()
        return shard, position, len(docs), n, write_blob(path, head, ids, control, data), path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, parts, held = None, [], [], 0
        for batch in batches:
            flat, rows = _flat(batch.column("ids")), batch.select(["shard", "position", "doc_id"]).to_pydict()
            begin = 0
            for shard, position, doc, size in zip(rows["shard"], rows["position"], rows["doc_id"], _sizes(batch.column("ids")), strict=True):
                if docs and (held >= ids_in_file or shard != at[0] or position != at[1] + len(docs)):
                    yield _row(file(*at, docs, parts))
                    docs, parts, held = [], [], 0
                if not docs:
                    at = shard, position
                docs.append(doc)
                parts.append(flat[begin : begin + size])
                begin, held = begin + size, held + size
        if docs:
            yield _row(file(*at, docs, parts))

    manifest = written(tokens.where("position >= 0").drop("counts").mapInArrow(run, "shard long, position long, n_docs long, n_ids long, n_bytes long, path string"), "manifest")
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("in_shard"))
    before = F.sum("in_shard").over(Window.orderBy("shard")) - F.col("in_shard")  # a row for each shard only
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("position")) - F.col("n_ids")
    return manifest.join(shards.select("shard", before.alias("before")), "shard").withColumn("start", F.col("before") + within).drop("before")


def _sizes(ids: pa.Array) -> list[int]:
    return (np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]) // 4).tolist()


def _row(values: tuple) -> pa.RecordBatch:
    names = ["shard", "position", "n_docs", "n_ids", "n_bytes", "path"]
    return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, values, strict=True)})


def read_ids(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and file position of every document in the manifest's files; with ``keep_ids`` also the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_rank = None
        for batch in batches:
            for path, start in zip(*(batch.column(c).to_pylist() for c in ("path", "start")), strict=True):
                if of_rank is None:
                    of_rank = np.frombuffer(read_blob(path.rpartition("/")[0] + "/ranks.bin"), "<u4")
                docs, lengths, ids = parse(read_blob(path), of_rank)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(start + ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return spread_files(manifest).select("path", "start").mapInArrow(run, schema)


def parse(data: bytes, of_rank: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids, lengths and ids of one file."""
    if data[:4] != MAGIC:
        raise ValueError("not a file of ranked ids")
    _, _, n_docs, n_ids, n_control = struct.unpack_from("<5Q", data, 4)
    at = 44
    docs = np.frombuffer(data, "<i8", n_docs, at).tolist()
    null = data[at + 8 * n_docs : at + 9 * n_docs]
    lengths = np.frombuffer(data, "<u4", n_docs, at := at + 9 * n_docs).astype(np.int64)
    control = np.frombuffer(data, np.uint8, n_control, at := at + 4 * n_docs)
    ranks = decode_numbers(control, np.frombuffer(data, np.uint8, -1, at + n_control), n_ids)
    return [None if z else d for d, z in zip(docs, null, strict=True)], lengths, np.ascontiguousarray(of_rank[ranks])


def documents_through_files(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Every document as read back from the files that this writes."""
    return read_ids(written(write_ids(docs, folder, tokenizer, end_id), "manifest"))
