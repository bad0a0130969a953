"""Operator 6: a Jaccard join on five-word shingles by a MinHash LSH forest, then exact sets.

Texts of the same words are one class; each class has a signature of ``TREES``
labels of ``DEPTH`` minima, and a tree is the trie of its sorted labels. Two classes
are candidates if they share a prefix of their labels in some tree. Prefixes begin
at full depth: a bounded sample of the trie's leaves (``PILOT`` of at most ``FEW``
classes) is checked exactly, and each pair found there, weighed by the chance of
finding it, says what recall each depth would have; the prefixes are shortened to
the deepest that reaches ``recall``. Then all leaves of that depth are checked, the
recall is measured in the same way on all links found, and while it is short the
prefixes are shortened again.

Leaves of the same classes, as near copies have them in many trees, are one. Classes
of a leaf are linked to its least class, a star and not all pairs, and the stars'
components are what is checked exactly, all pairs of one: small ones many in a task,
large ones dealt into chunks, a task for each pair of chunks. A large component
whose leaves have fewer pairs than it has itself (many texts that hang together
by a few) is checked leaf by leaf instead, each pair in the first tree that joins
it. A task sends for each class the documents it links to and a spanning link, so
pairs never become rows. Components of the exact links are the groups.

Defined cases: texts without words (null, empty, signs only) are classes of equal
texts with no other links; repeated rows count as documents of their class; rows
with a null doc_id get class_id null and no links; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.graph import components
from sparkloom.llm.shingles import class_key, shingle_sets
from sparkloom.llm.tokenize import slices
from sparkloom.storage import written

TREES, DEPTH = 24, 6
THRESHOLD, RECALL = 0.8, 0.9999
#: Classes of a chunk, and of what small components a task checks at once.
CHUNK, TOGETHER = 384, 2048
#: Leaves of the sample that says how far to shorten prefixes, the most classes of one, and prefixes that it is drawn from, about.
PILOT, FEW, SAMPLED = 1024, 16, 400_000
MEMBER = "part string, size long, tree int, key binary, n long, signature binary"
LINKS = "key binary, links long, low binary, pairs long, weights array<double>"
_RNG = np.random.default_rng(5)
_A = _RNG.integers(0, 2**31, (TREES * DEPTH, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, (TREES * DEPTH, 1)).astype(np.uint32)


def signature(shingles: np.ndarray) -> bytes | None:
    """The minima of TREES x DEPTH hash functions, a tree's together; None for an empty set."""
    if not len(shingles):
        return None
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        least = np.minimum(least, (x[None, i : i + 1024] * _A + _B).min(1))
    return least.astype("<u4").tobytes()


def chance(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The probability that a pair shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - np.asarray(similarity) ** depth) ** trees


def prefix_depth(weights: list[float], recall: float, most: int = DEPTH) -> int:
    """The deepest prefix, ``most`` at most, that reaches the recall; ``weights[d]``: pairs that depth d would find, ``weights[0]``: all there are."""
    return next((d for d in range(most, 1, -1) if weights[d] >= recall * weights[0]), 1)


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                texts = part.column("text")
                keys, signatures = [], []
                for i, (words, shingles) in enumerate(shingle_sets(texts)):
                    keys.append(class_key(words, None if len(words) else texts[i].as_py()))
                    signatures.append(signature(shingles))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "key", "signature"])

    return docs.mapInArrow(run, "doc_id long, key binary, signature binary")


def _sets(docs: DataFrame, members: DataFrame, repeated: bool) -> DataFrame:
    """The member classes (columns MEMBER and rep), each with the shingles of its representative's text; ``repeated`` tells that a representative's row may be there several times."""
    names = [f.split()[0] for f in MEMBER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                keys, kept, sets = part.column("key").to_pylist(), [], []
                for i, (words, shingles) in enumerate(shingle_sets(part.column("text"))):
                    if class_key(words, "") == keys[i]:  # another row may repeat the representative's number
                        kept.append(i)
                        sets.append(shingles.tobytes())
                kept = part.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    joined = docs.join(members.withColumnRenamed("rep", "doc_id"), "doc_id")
    sets = joined.select("text", *names).mapInArrow(run, MEMBER + ", shingles binary")
    return sets.groupBy(*names).agg(F.any_value("shingles").alias("shingles")) if repeated else sets  # of a hot row each task sends one


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    lengths = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), lengths)
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.diag(np.array(lengths, np.float32))
    own = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        own += x @ x.T
    np.fill_diagonal(own, np.diag(out))
    return own


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row that each row reaches."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _first_shared(signatures: list[bytes], tree: int, depth: int) -> np.ndarray:
    """Which two classes share a prefix in this tree and in none before it."""
    labels = np.array([np.frombuffer(x, "<u4") for x in signatures]).reshape(-1, TREES, DEPTH)[:, :, :depth]
    shared = np.ones((len(labels), len(labels)), bool)
    for t in range(tree):
        _, at = np.unique(np.ascontiguousarray(labels[:, t]).view(f"V{4 * depth}").ravel(), return_inverse=True)
        shared &= at[:, None] != at[None, :]
    return shared


def _check(rows: pd.DataFrame, threshold: float, depth: int, trees: int) -> pd.DataFrame:
    """Exact links among the classes of one block: all of them, or only those between its two chunks."""
    out = []
    for _, part in rows.groupby("part", sort=False):
        part = part.drop_duplicates("key").sort_values("key").reset_index(drop=True)
        if len(part) < 2:
            continue
        sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
        shared, size = overlaps(sets), np.array([len(s) for s in sets], np.float32)
        similarity = shared / (size[:, None] + size[None, :] - shared)
        linked = similarity >= threshold - 1e-9
        np.fill_diagonal(linked, False)
        if part["two"].iloc[0]:
            chunk = part["chunk"].to_numpy()
            linked &= chunk[:, None] != chunk[None, :]
        if (tree := int(part["tree"].iloc[0])) >= 0:
            linked &= _first_shared(list(part["signature"]), tree, depth)
        at = np.flatnonzero(linked.any(1))
        if len(at):
            n, keys = part["n"].to_numpy(), part["key"].to_numpy()
            found, root = linked[at], _roots(linked)
            one = np.where(found, 1 / chance(similarity[at], depth, trees), 0)
            weights = [one.sum(1), *((one * chance(similarity[at], d, trees)).sum(1) for d in range(1, DEPTH + 1))]
            out.append(pd.DataFrame({"key": keys[at], "links": found @ n, "low": keys[root[at]], "pairs": found.sum(1), "weights": list(np.array(weights).T)}))
    names = [f.split()[0] for f in LINKS.split(", ")]
    return pd.concat(out)[names] if out else pd.DataFrame({k: pd.Series([], dtype=object) for k in names})


def _leaves(classes: DataFrame, depth: int, trees: int, rate: int = 1) -> tuple[DataFrame, DataFrame]:
    """The prefixes of every class (key, tree, prefix), or of them one in ``rate``, and, of the prefixes that several share, one for each set of classes: tree, prefix, first, n."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    labelled = classes.where("signature is not null").select("key", "signature", tree.alias("tree"))
    prefix = F.expr(f"substring(signature, tree * {4 * DEPTH} + 1, {4 * depth})")
    leaves = labelled.select("key", "tree", F.xxhash64("tree", prefix).alias("prefix"))
    if rate > 1:
        leaves = leaves.where(F.pmod(F.xxhash64("prefix"), F.lit(rate)) == 0)
    several = leaves.groupBy("prefix").agg(F.min("key").alias("first"), F.count("*").alias("n"), F.min("tree").alias("tree"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("n > 1")
    one = several.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "prefix", "first")).alias("leaf"))
    return leaves, written(one.select("leaf.*", "n"), "leaves")


def _totals(links: DataFrame) -> tuple[int, list[float]]:
    """The pairs found, and the weights of ``prefix_depth``."""
    sums = [F.coalesce(F.sum(F.col("weights")[d]), F.lit(0.0)) for d in range(DEPTH + 1)]
    pairs, *weights = links.agg(F.coalesce(F.sum("pairs"), F.lit(0)), *sums).first()
    return pairs, weights


def _pilot(docs: DataFrame, classes: DataFrame, threshold: float, recall: float, trees: int, repeated: bool) -> int:
    """The depth to begin with, from exact checks of a bounded sample of small leaves at full depth; it misses half of what it may, as a second run costs more than a deeper prefix saves."""
    leaves, several = _leaves(classes, DEPTH, trees, max(1, classes.count() * trees // SAMPLED))
    some = several.where(F.col("n") <= FEW).orderBy(F.xxhash64("prefix"), "prefix").limit(PILOT)
    chosen = leaves.join(F.broadcast(some.select("prefix", F.col("n").alias("size"))), "prefix")  # at most PILOT x FEW classes
    members = written(chosen.join(classes.select("key", "rep", "n", "signature"), "key").select("rep", F.col("prefix").cast("string").alias("part"), "size", "tree", "key", "n", "signature"), "pilot")
    sets = _sets(docs, F.broadcast(members), repeated).withColumn("two", F.lit(False)).withColumn("chunk", F.lit(0).cast("long"))
    links = sets.groupBy(F.pmod(F.xxhash64("part"), F.lit(16))).applyInPandas(lambda rows: _check(rows, threshold, DEPTH, trees), LINKS)
    _, weights = _totals(links)
    return prefix_depth(weights if weights[0] else [1.0, *(chance(threshold, d, trees) for d in range(1, DEPTH + 1))], 1 - (1 - recall) / 2)


def _links(docs: DataFrame, classes: DataFrame, depth: int, threshold: float, trees: int, repeated: bool) -> DataFrame:
    """The table LINKS: key, links (documents of linked classes), low (a linked class), pairs, weights; a row for each block of a class."""
    leaves, several = _leaves(classes, depth, trees)
    stars = leaves.join(several.select("prefix", "first"), "prefix").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    found = written(components(stars), "candidates")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    large = written(sizes.where(F.col("size") > CHUNK), "large")
    whole = found.join(sizes, "root").select(F.col("node").alias("key"), F.hex("root").alias("part"), "size", F.lit(-1).alias("tree"), "root")
    own = classes.select("key", "rep", "n")
    members = whole.join(own, "key").withColumn("signature", F.lit(None).cast("binary"))
    if not large.isEmpty():
        of_leaf = several.join(found.select(F.col("node").alias("first"), "root"), "first")
        fewer = of_leaf.join(large, "root").groupBy("root", "size").agg(F.sum(F.col("n") * (F.col("n") - 1.0)).alias("pairs")).where(F.col("pairs") < F.col("size") * (F.col("size") - 1.0))
        fewer = written(fewer.select("root"), "sparse")
        by_leaf = leaves.join(of_leaf.join(fewer, "root", "left_semi").select("prefix", "root", F.col("n").alias("size")), "prefix")
        by_leaf = by_leaf.select("key", F.col("prefix").cast("string").alias("part"), "size", "tree", "root").join(classes.select("key", "rep", "n", "signature"), "key")
        members = members.join(fewer, "root", "left_anti").unionByName(by_leaf)
    sets = _sets(docs, members.drop("root"), repeated)
    chunks = F.ceil(F.col("size") / CHUNK)
    groups = max(1, -(-found.count() // TOGETHER))
    chunked = sets.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")))
    every = chunked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    of_small = F.pmod(F.xxhash64("part"), F.lit(groups)).cast("string")
    block = F.when(F.col("chunks") == 1, of_small).otherwise(F.concat_ws("-", "part", F.least("chunk", "other"), F.greatest("chunk", "other")))
    blocks = every.withColumn("block", block).withColumn("two", F.col("chunk") != F.col("other"))
    blocks = written(blocks.select("block", "two", "part", "tree", "chunk", "key", "n", "signature", "shingles"), "blocks")
    return blocks.groupBy("block").applyInPandas(lambda rows: _check(rows, threshold, depth, trees), LINKS)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """doc_id, class_id (least doc_id of its group), copy_id (least doc_id of its class), n_links (documents at the threshold or above) for every document; at most TREES trees."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = texts.where("doc_id is not null")
    signed = written(_signed(numbered), "signatures")
    classes = written(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.any_value("signature").alias("signature")), "classes")
    repeated = not signed.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    depth = _pilot(numbered, classes, threshold, recall, trees, repeated)
    while True:
        links = written(_links(numbered, classes, depth, threshold, trees, repeated), "links")
        pairs, weights = _totals(links)
        if depth == 1 or pairs >= recall * weights[0]:
            break
        depth = prefix_depth(weights, recall, depth - 1)
    groups = components(links.select(F.col("key").alias("a"), F.col("low").alias("b")))
    least = groups.join(classes.select(F.col("key").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id"))
    of_class = groups.join(least, "root").select(F.col("node").alias("key"), "class_id")
    partners = links.groupBy("key").agg(F.sum("links").alias("links"))
    facts = classes.select("key", "rep", "n").join(partners, "key", "left").join(of_class, "key", "left")
    facts = written(facts.select("key", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "groups")
    known = signed.select("doc_id", "key").join(facts, "key").select("doc_id", "class_id", "copy_id", "n_links")
    null = F.lit(None).cast("long")
    return known.union(texts.where("doc_id is null").select("doc_id", null.alias("class_id"), null.alias("copy_id"), F.lit(0).cast("long").alias("n_links")))
