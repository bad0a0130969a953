"""Operator 13: exact ranked search through a clustered index of bisected documents.

Documents are put in order by recursive graph bisection: halves swap documents as
long as that lowers the logarithmic gaps between postings. The first levels are
learnt on a bounded ``sample`` and route every document down to a leaf; a leaf's
documents, dealt into groups of about ``group_bytes`` of terms, are then all bisected
in their group, and every ``cluster_docs`` of the new order form a cluster. The index
is a table of (cluster, term): how many documents, the best impact, the postings. A
row without a term maps a cluster's places back to doc_ids.

A search adds up each cluster's bound from the best impacts of the query's terms,
visits clusters in waves by falling bound, and stops for a query when no bound left
reaches its k-th score, so results are exact, ties by doc_id among them.

Impact and weight are whole numbers: an occurrence count's impact is
(10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, a term's weight
floor(1000 ln((2N + 2) / (2 df + 1))); a score is the sum of their products.

Defined cases: a null or empty text has no terms and is in no result; repeated
rows are documents each; a null doc_id comes after all others in ties; query rows
that repeat an item_id are one query of all their terms; an empty table gives no
rows; further columns are ignored. A task holds ``slices`` of text, or one longer
text, or one group: about ``group_bytes`` (or one document) and its postings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.terms import text_bytes
from sparkloom.llm.tokenize import slices
from sparkloom.storage import written

#: Terms of the sample are told by so many numbers.
FEATURES = 1 << 15
#: Leaves have no fewer documents of the sample, and bisection within a group stops at so many.
LEAST = 64
ROUNDS = 5
#: Rows of query terms that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Queries that meet a cluster in one task.
BLOCK = 1024

_BLANK, _NOTHING = pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary())
_FOLD = np.zeros(256, np.uint8)  # what a byte of a term is in the index; 0 is no byte of a term
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


@dataclass
class Terms:
    """A slice's documents by their different terms: postings sorted by document, and the terms, each followed by a blank."""

    of: np.ndarray
    codes: np.ndarray
    times: np.ndarray
    lengths: np.ndarray
    names: pa.LargeBinaryArray


def _coded(kept: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    offsets = np.append(starts, len(kept)).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _term_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, whether a term begins at each, and the texts' bounds."""
    data, bounds = text_bytes(texts)
    x = _FOLD[data]
    inside = x > 0
    first = inside & ~np.concatenate([[False], inside[:-1]])[: len(x)]
    begins = bounds[:-1][np.diff(bounds) > 0]
    first[begins] = inside[begins]
    return x, first, bounds


def term_counts(texts: pa.Array) -> Terms:
    x, first, bounds = _term_starts(texts)
    at, inside = np.flatnonzero(first), x > 0
    codes, names = _coded(x[inside], np.flatnonzero(first[inside]))
    owner = np.searchsorted(bounds, at, side="right") - 1
    keys = np.sort(owner * max(len(names), 1) + codes)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    of, own = np.divmod(keys[new], max(len(names), 1))
    return Terms(of, own, np.diff(np.append(new, len(keys))), np.bincount(owner, minlength=len(texts)), pc.binary_join_element_wise(names, _NOTHING, _BLANK))


def _features(names: pa.LargeBinaryArray) -> np.ndarray:
    return np.fromiter((zlib.crc32(x) for x in names.to_pylist()), np.int64, len(names)) % FEATURES


def bisected(of: np.ndarray, codes: np.ndarray, n: int, terms: int, levels: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of ``n`` documents (postings ``of``, ``codes``) after so many levels of bisection, and by level and node what each term says for the left half."""
    node, place, says = np.zeros(n, np.int64), np.arange(n), []
    for level in range(levels):
        nodes = 1 << level
        order = np.lexsort([place, node])
        starts = np.searchsorted(node[order], np.arange(nodes + 1))
        sizes = np.diff(starts)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(starts[:-1], sizes)
        half = (rank >= (sizes[node] + 1) // 2).astype(np.int64)
        left, right = np.maximum((sizes + 1) // 2, 1)[:, None], np.maximum(sizes // 2, 1)[:, None]

        def cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
            return np.where(degree > 0, degree * np.log2(size / np.maximum(degree + 1.0, 1.0)), 0.0)

        for _ in range(rounds):
            degree = np.bincount((node * 2 + half)[of] * terms + codes, minlength=nodes * 2 * terms).reshape(nodes, 2, terms)
            a, b = degree[:, 0], degree[:, 1]
            now = cost(a, left) + cost(b, right)
            gain = np.stack([now - cost(a - 1, left) - cost(b + 1, right), now - cost(a + 1, left) - cost(b - 1, right)], 1)
            own = np.bincount(of, gain[node[of], half[of], codes], minlength=n)
            order = np.lexsort([place, -own, half, node])
            at = np.searchsorted((node * 2 + half)[order], np.arange(2 * nodes + 1)).reshape(-1)
            pairs = np.minimum(np.diff(at)[::2], np.diff(at)[1::2])
            step = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            x, y = order[np.repeat(at[:-1:2], pairs) + step], order[np.repeat(at[1::2], pairs) + step]
            swap = own[x] + own[y] > 1e-9
            half[x[swap]], half[y[swap]] = 1, 0
            if not swap.any():
                break
        degree = np.bincount((node * 2 + half)[of] * terms + codes, minlength=nodes * 2 * terms).reshape(nodes, 2, terms)
        a, b = degree[:, 0], degree[:, 1]
        says.append(((cost(b + 1, right) - cost(b, right)) - (cost(a + 1, left) - cost(a, left))).astype(np.float32))
        node = node * 2 + half
    return np.lexsort([place, node]), says


def routed(of: np.ndarray, codes: np.ndarray, n: int, says: list[np.ndarray]) -> np.ndarray:
    """The leaf of each document."""
    node = np.zeros(n, np.int64)
    for level in says:
        node = node * 2 + (np.bincount(of, level[node[of], codes], minlength=n) < 0)
    return node


@dataclass
class Index:
    """``table``: cluster, term, docs, top, body; documents with a term, and all their terms."""

    table: DataFrame
    documents: int
    terms: int


POSTINGS = "cluster long, term string, docs long, top long, body binary"


def _postings(group: pa.Table, number: int, documents: int, total: int, cluster_docs: int) -> Iterator[pa.RecordBatch]:
    """The clusters of one group of documents."""
    group = group.combine_chunks()
    blobs = group.column("terms").cast(pa.large_binary())
    blob, bounds = _bytes_of(blobs)
    first = np.concatenate([[True], blob[:-1] == 32])[: len(blob)]
    kept = blob != 32
    codes, names = _coded(blob[kept], np.flatnonzero(first[kept]))
    of = np.searchsorted(bounds, np.flatnonzero(first), side="right") - 1
    times, _ = _bytes_of(group.column("times").cast(pa.large_binary()))
    times = times.view("<i4").astype(np.int64)
    n = group.num_rows
    levels = max(0, int(np.ceil(np.log2(max(n / LEAST, 1)))))
    order, _ = bisected(of, codes, n, len(names), levels)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lengths = np.array(group.column("n").to_pylist(), object)  # 75 n N may pass 64 bits for a very long text of a very large corpus
    m = np.array([25 + 75 * int(x) * documents // total for x in lengths], np.int64)
    impact = 1_000_000_000 * times // (1000 * times + 8 * m[of])
    ids = np.array(group.column("doc_id").to_pylist(), object)[order]
    for a in range(0, n, cluster_docs):
        cluster = number << 24 | a // cluster_docs
        own = np.flatnonzero((place[of] >= a) & (place[of] < a + cluster_docs))
        own = own[np.lexsort([place[of[own]], codes[own]])]
        starts = np.flatnonzero(np.concatenate([[True], codes[own][1:] != codes[own][:-1]]))
        body = np.stack([place[of[own]] - a, impact[own]], 1).astype("<i4").tobytes()
        cuts = [*(8 * starts).tolist(), 8 * len(own)]
        known = ids[a : a + cluster_docs]
        there = b"".join(np.array([x is not None, x or 0], "<i8").tobytes() for x in known)
        used = names.take(pa.array(codes[own][starts])).cast(pa.large_utf8())
        bodies = [body[c:d] for c, d in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(starts) + 1, cluster)), pa.concat_arrays([pa.array([None], pa.large_utf8()), used]).cast(pa.utf8()),
                pa.array([len(known), *np.diff(np.append(starts, len(own))).tolist()], pa.int64()),
                pa.array([0, *np.maximum.reduceat(impact[own], starts).tolist()], pa.int64()), pa.array([there, *bodies], pa.binary()),
            ],
            ["cluster", "term", "docs", "top", "body"],
        )


def _bytes_of(values: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def clustered_index(docs: DataFrame, sample: int = 4096, depth: int = 6, group_bytes: int = 4 << 20, cluster_docs: int = 512) -> Index:
    """Indexes every document that has a term."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found = total = volume = 0
        for batch in batches:
            for part in slices(batch, "text"):
                _, first, bounds = _term_starts(part.column("text"))
                many = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])[bounds]
                rows, found, total, volume = rows + part.num_rows, found + int((np.diff(many) > 0).sum()), total + int(many[-1]), volume + int(bounds[-1])
        yield pa.RecordBatch.from_pylist([{"rows": rows, "found": found, "total": total, "volume": volume}])

    summed = texts.select("text").mapInArrow(sizes, "rows long, found long, total long, volume long").agg(*[F.sum(c).alias(c) for c in ("rows", "found", "total", "volume")]).first()
    rows, found, total, volume = (int(x or 0) for x in summed)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = term_counts(part.column("text"))
                own = _features(x.names)[x.codes].astype("<i4")
                cuts = np.searchsorted(x.of, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array([own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["terms"])

    chosen = texts.select("text").sample(fraction=min(1.0, sample / max(rows, 1)), seed=13).limit(2 * sample)
    known = [np.unique(np.frombuffer(r.terms, "<i4")) for r in chosen.mapInArrow(features, "terms binary").collect()]  # at most 2 x sample documents
    known = [x for x in known if len(x)]
    levels = min(depth, max(0, int(np.log2(max(len(known) / LEAST, 1)))))
    of = np.repeat(np.arange(len(known)), list(map(len, known)))
    codes = np.concatenate(known).astype(np.int64) if known else np.zeros(0, np.int64)
    _, says = bisected(of, codes, len(known), FEATURES, levels)
    # how many groups each leaf is dealt into: its share of the sample of all there should be
    shares = np.bincount(routed(of, codes, len(known), says), minlength=1 << levels) / max(len(known), 1)
    parts = np.maximum(1, np.ceil(shares * max(1 << levels, volume / group_bytes))).astype(np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = (TaskContext.get().partitionId() * 0x9E3779B1 + np.arange(len(parts)) * 40_503) % parts  # tasks begin at different groups
        for batch in batches:
            for part in slices(batch, "text"):
                x = term_counts(part.column("text"))
                n = part.num_rows
                leaf = routed(x.of, _features(x.names)[x.codes], n, says)
                order = np.argsort(leaf, kind="stable")
                starts = np.searchsorted(leaf[order], np.arange(len(parts)))
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n) - starts[leaf[order]]
                salt = (turn[leaf] + rank) % parts[leaf]  # documents of a leaf are dealt in turn
                turn += np.bincount(leaf, minlength=len(parts))
                names = x.names.take(pa.array(x.codes)) if len(x.codes) else pa.array([], pa.large_binary())
                cuts = np.searchsorted(x.of, np.arange(n + 1))
                data, at = _bytes_of(names)
                terms = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at[cuts].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                times = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((4 * cuts).astype(np.int64)), pa.py_buffer(x.times.astype("<i4"))])
                out = pa.RecordBatch.from_arrays(
                    [pa.array(leaf << 24 | salt), part.column("doc_id"), pa.array(x.lengths), terms.cast(pa.binary()), times.cast(pa.binary())], ["part", "doc_id", "n", "terms", "times"]
                )
                yield out.filter(pa.array(x.lengths > 0))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        own = list(_postings(group, key[0].as_py(), found, total, cluster_docs))
        return pa.Table.from_batches(own)

    dealt = texts.mapInArrow(route, "part long, doc_id long, n long, terms binary, times binary")
    return Index(written(dealt.groupBy("part").applyInArrow(build, POSTINGS), "clusters"), found, total)


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term, times."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = queries.where("item_id is not null").select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))).alias("term"))
    return words.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def weight(documents: int, df: Column) -> Column:
    return F.floor(1000 * F.log((2.0 * documents + 2) / (2 * df + 1))).cast("long")


def ranked(index: Index, queries: DataFrame, k: int = 10, first_wave: int = 8, growth: int = 4) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents. Waves take ``first_wave`` clusters a query, then ``growth`` times as many as before; only a cluster whose bound reaches the k-th score so far is visited."""
    spark: SparkSession = queries.sparkSession
    wanted = written(query_terms(queries), "wanted")
    rows = wanted.count()
    blocks = -(-wanted.select("item_id").distinct().count() // BLOCK) or 1
    names = wanted.select("term").distinct()
    near = written(index.table.where("term is not null").select("cluster", "term", "docs", "top").join(_few(names, rows), "term"), "near")
    weights = near.groupBy("term").agg(F.sum("docs").alias("df")).select("term", weight(index.documents, F.col("df")).alias("w"))
    asked = written(wanted.join(weights, "term").select("item_id", "term", (F.col("w") * F.col("times")).alias("w")), "weights")
    reach = near.join(_few(asked, rows), "term").groupBy("item_id", "cluster").agg(F.sum(F.col("w") * F.col("top")).alias("bound")).where("bound > 0")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "cluster"))
    reach = written(reach.withColumn("place", place), "bounds")
    packed = asked.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind = queries.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, doc_id long, score long"
    best, done, until = spark.createDataFrame([], schema), 0, first_wave
    while True:
        floor = best.groupBy("item_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(1)).alias("least"))
        left = reach.where(F.col("place") > done).join(floor, "item_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(1)))
        visits = written(left.where(F.col("place") <= until).select("item_id", "cluster", "place"), "visits")
        if visits.limit(1).count():
            asks = visits.join(packed, "item_id").withColumn("block", block).drop("place")
            there = visits.select("cluster", block.alias("block")).distinct()
            bodies = index.table.select("cluster", "term", "body").join(there.select("cluster").distinct(), "cluster", "left_semi")
            bodies = bodies.join(_few(names.withColumn("asked", F.lit(True)), rows), "term", "left").where("asked or term is null").drop("asked").join(there, "cluster")
            found = asks.groupBy("cluster", "block").cogroup(bodies.groupBy("cluster", "block")).applyInArrow(_scorer(k), schema)
            order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = written(best.union(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        elif not left.limit(1).count():
            break
        done, until = until, until + (until - done) * growth
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score")


def _scorer(k: int):
    def score(key: tuple, asks: pa.Table, bodies: pa.Table) -> pa.Table:
        postings, ids = {}, np.zeros((0, 2), np.int64)
        for term, body in zip(bodies.column("term").to_pylist(), bodies.column("body").to_pylist(), strict=True):
            if term is None:
                ids = np.frombuffer(body, "<i8").reshape(-1, 2)
            else:
                postings[term] = np.frombuffer(body, "<i4").reshape(-1, 2)
        order = np.where(ids[:, 0] == 1, ids[:, 1], np.iinfo(np.int64).max)
        items, docs, scores = [], [], []
        for item, terms, ws in zip(asks.column("item_id").to_pylist(), asks.column("terms").to_pylist(), asks.column("ws").to_pylist(), strict=True):
            total = np.zeros(len(ids), np.int64)
            for term, w in zip(terms, ws, strict=True):
                own = postings.get(term)
                if own is not None:
                    total[own[:, 0]] += w * own[:, 1].astype(np.int64)
            some = np.flatnonzero(total > 0)
            some = some[np.lexsort([order[some], -total[some]])[:k]]
            items += [item] * len(some)
            docs += [int(ids[i, 1]) if ids[i, 0] else None for i in some]
            scores += total[some].tolist()
        return pa.table({"item_id": pa.array(items, asks.schema.field("item_id").type), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return score


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each query."""
    return ranked(clustered_index(docs), queries, k)


def search_sql(k: int = 10) -> str:
    """The same for the tables documents and benchmark, as DuckDB SQL."""
    terms = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS no, doc_id, text FROM documents),
tf AS (SELECT no, doc_id, term, count(*) AS tf FROM (SELECT no, doc_id, {terms} AS term FROM d) GROUP BY ALL),
n AS (SELECT no, doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, nn),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, no, n.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (no), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= {k}"""
