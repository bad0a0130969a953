"""Operator 11: alignment of two tokenizers' tokens, by relational plans.

Tokens are exploded with their positions; windowed sums of their lengths give the
bytes where each ends; where both sides have a token with one end, matched by a window
over both sides' ends, both tokenizers cut; running counts of cuts give the groups. Between
two neighbouring ends of either side the tokens that end next on each overlap: a link.
(An equal join in place of the window needs each side twice, sorted anew: see the
README's figures.)

Neither tokenizer ever joins characters across a blank between a character that is
none and a printed one (``segments``), so a text's alignment is that of its segments, one
after the other. The plan above runs once for each different segment of the corpus.
Documents are kept as numbers of segments, in blocks of about ``block_bytes``; a
block meets the alignments of its own segments, and then the counts of its own id
pairs, by co-grouping.

Defined cases: a null or empty text, or one that the tokens of either tokenizer don't
give back byte by byte, has no tokens: zeros and ''; repeated rows are documents
each, which count each; a null doc_id stays null; an empty table gives no rows;
further columns are ignored. A task holds a block, or one longer text with about 60
bytes for each of its words.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.terms import text_bytes
from sparkloom.llm.tokenize import slices
from sparkloom.storage import written

#: First bytes of characters that are surely printed: no white space of any script begins with one.
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_PRINTED[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
_CODERS: dict[tuple[str, str], tuple] = {}
CUT = "block long, run int, segments array<string>, doc_id long, codes binary, sizes binary"
#: Different segments of a block that are aligned as one text.
RUN = 64
#: Runs that a task encodes at once.
TOGETHER = 256
#: Bits of a token's number where it shares 31 of them with its length.
ID_BITS = 20
#: Stands for a token in segments that are not given back.
NONE = (1 << ID_BITS) - 1
#: Segments whose tokens are counted at once when a block is put together.
PIECE = 1 << 16


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts with a blank put before each that isn't empty: numbers of segments, where each text's begin, and the different segments."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    blank = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, bounds = text_bytes(pc.binary_join_element_wise(blank, texts, pa.scalar("", pa.large_string())))
    first = np.zeros(len(data), bool)
    if len(data) > 2:
        first[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & _PRINTED[data[2:]]
    first[bounds[1:-1][bounds[1:-1] > 0] - 1] = False  # the next text is no context
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(first)
    offsets = np.append(starts, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, bounds), coded.dictionary


def _byte_level(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


def _ranked(head: dict, table: list[bytes]) -> Callable[[str], list[int]] | None:
    """The same tokenizer by the faster library of ranks, where its merges make its ids in order and nothing but its pattern precedes them."""
    model, cut = head["model"], head["pre_tokenizer"] or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    in_order = all(model["vocab"].get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges)) and len(model["vocab"]) == 256 + len(merges)
    if head["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or model["byte_fallback"] or model["ignore_merges"] or not in_order:
        return None
    import tiktoken

    # Fixed value: the pattern of byte-level pieces.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={table[i]: i for i in range(len(model["vocab"]))}, special_tokens={}).encode_ordinary


def _coders(a: str, b: str) -> tuple:
    """Both tokenizers' ids of a text that begins with a blank, and the bytes of each of their ids; one for each worker."""
    if (a, b) not in _CODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor

        second = SentencePieceProcessor(model_file=b)
        # the byte-level alphabet: printed Latin-1 as itself, the other bytes from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
        with open(a, encoding="utf-8") as f:
            head = json.load(f)
        words = head["model"]["vocab"] | {t["content"]: t["id"] for t in head["added_tokens"]}
        of_a = [b""] * (max(words.values()) + 1)
        for t, i in words.items():
            of_a[i] = bytes(map(byte_of.get, t)) if all(c in byte_of for c in t) else t.encode()
        of_b = [bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in range(len(second)) for p in (second.id_to_piece(i),)]
        if max(len(of_a), len(of_b)) >= 1 << ID_BITS or max(map(len, of_a + of_b)) >= 1 << 31 - ID_BITS:
            raise ValueError("a token's number or length is too large for one whole number of 32 bits")
        encode_a = _ranked(head, of_a) or _byte_level(a)
        _CODERS[a, b] = encode_a, lambda text: second.encode(text[1:]), of_a, of_b
    return _CODERS[a, b]


def _split(texts: pa.Array, encode: Callable[[str], list[int]], table: list[bytes], sizes: np.ndarray, together: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some segments, and where each segment's begin; one that they don't give back has none. Plain segments are encoded many at once, the others one by one."""
    data, bounds = text_bytes(texts)
    n = len(texts)
    second = np.minimum(bounds[:-1] + 1, len(data) - 1)
    # neither tokenizer joins these to a neighbour
    plain = (np.diff(bounds) > 1) & _PRINTED[data[second]] & (data[bounds[1:] - 1] != 32)
    whole = texts.filter(pa.array(plain)).to_pylist()
    some = [np.array(encode("".join(whole[i : i + together])), np.int32) for i in range(0, len(whole), together)]
    ids = np.concatenate([np.zeros(0, np.int32), *some])
    if b"".join(map(table.__getitem__, ids.tolist())) != "".join(whole).encode():
        plain[:], ids = False, ids[:0]
    cuts = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(np.diff(bounds)[plain])) + 1
    counts = np.zeros(n, np.int64)
    counts[plain] = np.diff(np.concatenate([[0], cuts]))
    odd = np.flatnonzero(~plain).tolist()
    out = []
    for i, text in zip(odd, texts.take(pa.array(odd, pa.int64())).to_pylist(), strict=True):
        own = encode(text)
        out.append(np.array(own if b"".join(map(table.__getitem__, own)) == text.encode() else [], np.int32))
        counts[i] = len(out[-1])
    starts = np.concatenate([[0], np.cumsum(counts)])
    every = np.zeros(starts[-1], np.int32)
    every[np.repeat(plain, counts)] = ids
    for i, own in zip(odd, out, strict=True):
        every[starts[i] : starts[i + 1]] = own
    return every, starts


def tokens_of(run: Column, a: str, b: str) -> Column:
    """Both tokenizers' tokens of a run of segments, as one array of two: each token's id and, above ``ID_BITS``, its length in bytes. A segment that either doesn't give back is ``NONE`` on both sides."""

    def of_some(runs: pa.Array) -> pa.Array:
        *coders, of_a, of_b = _coders(a, b)
        texts = runs.flatten().cast(pa.large_string())
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))])
        tables = [np.array(list(map(len, table)), np.int64) for table in (of_a, of_b)]
        sides = [_split(texts, encode, table, sizes) for encode, table, sizes in zip(coders, (of_a, of_b), tables, strict=True)]
        lost = np.flatnonzero(np.logical_or.reduce([np.diff(starts) == 0 for _, starts in sides]))
        lengths = pc.binary_length(texts).to_numpy()
        lists = []
        for (ids, starts), sizes in zip(sides, tables, strict=True):
            packed = (sizes[ids] << ID_BITS | ids).astype(np.int32)
            if len(lost):
                parts = [packed[x:y] for x, y in zip(starts[:-1], starts[1:], strict=True)]
                for i in lost.tolist():
                    most = (1 << 31 - ID_BITS) - 1
                    steps = [min(most, lengths[i] - x) for x in range(0, lengths[i], most)]
                    parts[i] = np.array([x << ID_BITS | NONE for x in steps], np.int32)
                packed, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
            lists.append(pa.ListArray.from_arrays(pa.array(starts[bounds], pa.int32()), pa.array(packed, pa.int32())))
        n = len(runs)
        in_turn = pa.concat_arrays(lists).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2), pa.int32()), in_turn)

    @F.arrow_udf("array<array<int>>")
    def tokens(runs: pa.Array) -> pa.Array:
        return pa.concat_arrays([of_some(runs.slice(i, TOGETHER)) for i in range(0, max(len(runs), 1), TOGETHER)])

    return tokens(run)


def aligned(tokens: DataFrame, *key: str) -> DataFrame:
    """The key and its links, in no order, of rows with ``tokens`` (see ``tokens_of``): ``end`` in bytes of the shared range, ``pair`` (ids of a and b in one number), whether each ends there (``of_a``, ``of_b``), and ``group``, counted from the last.

    Between two neighbouring ends of either side lies one token of each: one link. Where the
    key is dealt out by a part of it, the plan has no exchange; name first what differs most, as sorts compare that first.
    """
    sides = tokens.select(*key, F.posexplode_outer("tokens").alias("side", "list"))
    exploded = sides.select(*key, "side", F.posexplode("list").alias("pos", "t"))
    size = F.shiftrightunsigned("t", ID_BITS)
    so_far = Window.partitionBy(*key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = exploded.select(*key, "side", F.sum(size).over(so_far).alias("end"), F.col("t").bitwiseAND((1 << ID_BITS) - 1).alias("id"))
    # from the last end on, so that the next token of a side is the latest seen; both tokens at one end see each other
    from_last = Window.partitionBy(*key).orderBy(F.desc("end"))

    def following(side: int) -> Column:
        return F.last(F.when(F.col("side") == side, F.shiftleft("end", ID_BITS) + F.col("id")), ignorenulls=True).over(from_last)

    met = placed.select(*key, "side", "end", following(0).alias("a"), following(1).alias("b"))
    of_a, of_b = (F.shiftright(c, ID_BITS) == F.col("end") for c in "ab")
    # a cut's two tokens tell of the same link
    links = met.select(*key, "side", "end", "a", "b", of_a.alias("of_a"), of_b.alias("of_b")).where("side = 0 or not of_a")
    cuts = F.sum((F.col("of_a") & F.col("of_b")).cast("int")).over(from_last.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a, b = (F.col(c).bitwiseAND((1 << ID_BITS) - 1) for c in "ab")
    return links.select(*key, "end", (F.shiftleft(a, 32) + b).alias("pair"), "of_a", "of_b", cuts.alias("group"))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32: all first bytes, then all second ones and so on, compressed."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _cut(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of documents: a row for each document with its segments' numbers, and one for each different segment of the block."""

    def cut(part: pa.RecordBatch, block: int) -> pa.RecordBatch:
        codes, starts, different = segments(part.column("text"))
        # the more frequent, the smaller its number
        order = np.argsort(-np.bincount(codes, minlength=len(different)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        codes, different = number[codes], different.take(pa.array(order))
        own = [_packed(codes[x:y]) for x, y in zip(starts[:-1], starts[1:], strict=True)]
        n, cuts = part.num_rows, [*range(0, len(different), RUN), len(different)]
        m = len(cuts) - 1
        runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), different.cast(pa.utf8()))
        sizes = pc.binary_length(different).to_numpy().astype("<u4").tobytes()
        columns = {
            "block": pa.array(np.full(n + m, block)), "run": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m), pa.int32())]),
            "segments": pa.concat_arrays([pa.nulls(n, runs.type), runs]),
            "doc_id": pa.concat_arrays([part.column("doc_id"), pa.nulls(m, pa.int64())]), "codes": pa.concat_arrays([pa.array(own, pa.binary()), pa.nulls(m, pa.binary())]),
            "sizes": pa.concat_arrays([pa.array([sizes], pa.binary()), pa.nulls(n + m - 1, pa.binary())]),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                own = int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                if waiting and size + own > block_bytes:
                    yield cut(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], block)
                    block, waiting, size = block + 1, [], 0
                waiting.append(part)
                size += own
        if waiting and (last := pa.Table.from_batches(waiting).combine_chunks()).num_rows:
            yield cut(last.to_batches()[0], block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CUT)


COUNTED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, pair int, a int, b int, docs long"


def _joined(values: pa.Array, bounds: np.ndarray, sign: str) -> pa.Array:
    """The texts between each two bounds as one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), sign)


def _counted(key: tuple, docs: pa.Table, known: pa.Table) -> Iterator[pa.RecordBatch]:
    """A block's documents put together from their segments' alignments: a row for each, and one for each id pair of the block with its number of documents."""
    _CODERS.clear()  # a worker that has encoded before has no use for them here
    block, n = key[0].as_py(), docs.num_rows
    sizes = np.frombuffer(next(x for x in docs.column("sizes").to_pylist() if x is not None), "<u4").astype(np.int64)
    m, ends = len(sizes), np.cumsum(sizes)
    # a link lies in the segment in which it ends; ends count from the beginning of a run
    at, kind = (known.column(c).to_numpy() for c in ("at", "kind"))
    order = np.argsort(at)
    at, kind = at[order], kind[order]
    of = np.searchsorted(ends, (ends - sizes)[RUN * (at >> 32)] + (at & 0xFFFFFFFF))
    coded = pa.concat_arrays(known.column("pair").chunks or [pa.array([], pa.int64())]).dictionary_encode()
    pairs, local = coded.dictionary.to_numpy(), coded.indices.to_numpy()[order]
    in_group, ends_there = (at >> 32) << 32 | kind >> 2, [(kind & x) > 0 for x in (1, 2)]
    begins = np.flatnonzero(np.diff(in_group, prepend=-1))
    last = np.append(begins[1:], len(at))[: len(begins)] - 1
    shown = [_joined(pc.take(pc.cast(pa.array(x), pa.utf8()), pa.array(local[y])), np.searchsorted(np.flatnonzero(y), np.append(begins, len(at))), ",") for x, y in zip((pairs >> 32, pairs & 0xFFFFFFFF), ends_there, strict=True)]
    counts = {c: np.bincount(of[x], minlength=m).astype(np.int32) for c, x in zip(("n_a", "n_b", "n_groups"), (*ends_there, last), strict=True)}
    groups = _joined(pc.binary_join_element_wise(*shown, "|"), np.searchsorted(of[last], np.arange(m + 1)), ";").cast(pa.binary()).to_pylist()
    begin = np.searchsorted(of, np.arange(m + 1))
    begin, many = begin[:-1], np.diff(begin)
    counts["n_a"][of[pairs[local] >> 32 == NONE]] = 0
    del at, kind, order, of, coded, in_group, ends_there, begins, last, shown
    whole, p = counts["n_a"] > 0, len(pairs)
    held = np.zeros(p, np.int64)  # of pairs of segments that are given back; others have none in a document
    own = [_unpacked(x) for x in docs.column("codes").to_pylist()]
    cuts = np.searchsorted(np.cumsum([len(x) for x in own]) // PIECE, np.arange(sum(map(len, own)) // PIECE + 2)) if n else [0]
    numbers = pa.concat_arrays(docs.column("doc_id").chunks)

    def batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {f.split()[0]: {"long": pa.int64(), "int": pa.int32(), "string": pa.utf8(), "binary": pa.binary()}[f.split()[1]] for f in COUNTED.split(", ")}
        columns["block"] = pa.array(np.full(rows, block), pa.int64())
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, kinds[c])).cast(kinds[c]) for c in kinds], list(kinds))

    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        if x == y:
            continue
        part = [c if len(c) and whole[c].all() else c[:0] for c in own[x:y]]
        lengths = np.array(list(map(len, part)))
        codes, owner = np.concatenate(part).astype(np.int64), np.repeat(np.arange(y - x), lengths)
        sums = {c: np.bincount(owner, v[codes], minlength=y - x) for c, v in (*counts.items(), ("n_links", many))}
        digests = [hashlib.sha256(b";".join(map(groups.__getitem__, c.tolist()))).hexdigest() if len(c) else "" for c in part]
        reps = many[codes]
        place = np.repeat(begin[codes] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        cells = np.sort(np.repeat(owner, reps) * max(p, 1) + local[place])
        new = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])[: len(cells)])
        of, pair = np.divmod(cells[new], max(p, 1))
        seen = np.diff(np.append(new, len(cells)))
        held += np.bincount(pair, minlength=p)
        spans = np.searchsorted(of, np.arange(y - x + 1)).tolist()
        steps = [_packed(np.diff(pair[i:j], prepend=0)) for i, j in zip(spans[:-1], spans[1:], strict=True)]
        times = [_packed(seen[i:j]) for i, j in zip(spans[:-1], spans[1:], strict=True)]
        yield batch(y - x, doc_id=numbers.slice(x, y - x), groups_sha256=pa.array(digests, pa.utf8()), pairs=pa.array(steps, pa.binary()), times=pa.array(times, pa.binary()), **{c: pa.array(v.astype(np.int64)) for c, v in sums.items()})
    yield batch(p, pair=pa.array(np.arange(p), pa.int32()), a=pa.array(pairs >> 32), b=pa.array(pairs & 0xFFFFFFFF), docs=pa.array(held))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    pairs = pairs.sort_by("pair")
    count, best = pairs.column("count").to_numpy().astype(np.int64), pairs.column("best").to_numpy().astype(np.int64)
    sums, bests = [], []
    for own, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at, n = np.cumsum(_unpacked(own)), _unpacked(times).astype(np.int64)
        sums.append(int((n * count[at]).sum()))
        bests.append(int((n * best[at]).sum()))
    out = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    return pa.table({f.split()[0]: out[f.split()[0]] for f in RESULT.split(", ")})


def alignment(docs: DataFrame, a: str, b: str, block_bytes: int = 1 << 22) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document; ``a`` is a byte-level tokenizer's file, ``b`` a sentence-piece model that puts a blank before a text."""
    spark = docs.sparkSession
    cut = written(_cut(docs, block_bytes), "segments")
    used = cut.where("run is not null").select(F.col("block").alias("place"), "run", "segments")
    # a task sorts one block's tokens, seldom two
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cut.select("block").distinct().count())
    links = aligned(used.select("place", "run", tokens_of(F.col("segments"), a, b).alias("tokens")).repartition(tasks, "place"), "run", "place")
    kind = F.shiftleft("group", 2) + F.col("of_b").cast("int") * 2 + F.col("of_a").cast("int")
    known = links.select("place", (F.shiftleft(F.col("run").cast("long"), 32) + F.col("end")).alias("at"), "pair", kind.alias("kind"))
    rows = cut.where("run is null").select("block", "doc_id", "codes", "sizes").groupBy("block")
    counted = written(rows.cogroup(known.groupBy("place")).applyInArrow(_as_table, COUNTED), "counted")
    pairs = counted.where("pair is not null").select("block", "pair", "a", "b", "docs")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("long"))
    rows = counted.where("pair is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    found = pairs.select("block", "pair", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("place"), "pair", "count", "best")
    return rows.groupBy("block").cogroup(found.groupBy("place")).applyInArrow(_summed, RESULT)


def _as_table(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_counted(key, docs, known)))
