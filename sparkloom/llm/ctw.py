"""Operator 3: language-model scores by context-tree weighting of bytes.

A byte is eight binary decisions; each has context trees of its own over the
``DEPTH`` bytes before it (zeros before a text), and every node an estimate by
Krichevsky and Trofimov. The block probability of a node is half its own estimate's
plus half the product of its children's; a decision's probability mixes the
estimates along its path by the weights that follow from these. So a text's
probability is a sum over its runs of DEPTH + 1 bytes ("grams"), whose probabilities
are fixed once the training counts are.

Texts are dealt into blocks of about ``block_bytes``. A block's task counts its
different grams and words and sends them, packed and in order, to parts: a gram by
the last two bytes of its context, a word by its hash. A part sums up the counts of
all blocks. It holds all of a tree below its two-byte contexts, so it folds them up
on its own; what they come to for contexts of one byte and none (at most 65,280
nodes) is summed by Spark and folded in the driver, and the parts, told the weights
from there, fold down to the probability of each gram and send every block the
values of what it asked for, in its own order. The texts of a block meet their values
in a co-grouped join. Nothing that grows with the corpus is broadcast or collected,
and a gram or word goes to its part once a block, however often it occurs.

Defined cases: a null text is empty (its end token is scored, its model score is 0);
repeated rows get equal scores; a null doc_id is trained on (it has no fold) and kept;
an empty table gives no rows; a text longer than a block is walked in pieces; rows that
repeat a doc_id and a text, or a text without a doc_id, share a block; further columns
are ignored. Without training data every decision has
probability one half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.terms import text_bytes
from sparkloom.llm.tokenize import cut
from sparkloom.storage import written

#: Bytes of context, and how many of them name a part.
DEPTH, NAMED = 5, 2
BLOCK_BYTES = 1 << 24
#: Bytes of text of which a part holds the grams and words, or less if they repeat.
PART_BYTES = 1 << 23
#: Grams that a block's task makes at once.
PIECE = 1 << 20
ENTRIES = "part int, block int, grams binary, words array<string>, n binary"
VALUES = "block int, part int, worth binary, n binary, total long, different long"
_HALF = math.log(0.5)
_PLACES = np.random.default_rng(21).integers(1, 2**63, 4096).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered."""
    return (text or "").encode().lower()


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For pieces of the texts' bytes, begin and end of each and the gram at every byte: the context from the last byte back, then the byte."""
    for a in range(0, len(data), PIECE):
        b, lead = min(a + PIECE, len(data)), min(a, DEPTH)
        x = data[a - lead : b].astype(np.int64)
        out = x[lead:].copy()
        first, last = np.searchsorted(bounds, [a - lead, b])
        begins = bounds[first:last] - a
        for j in range(1, DEPTH + 1):
            before = np.zeros(b - a, np.int64)
            before[max(0, j - lead) :] = x[max(0, lead - j) : max(0, len(x) - j)]
            for k in range(j):  # nothing precedes a text
                at = begins + k
                before[at[(at >= 0) & (at < b - a)]] = 0
            out |= before << 8 * (DEPTH + 1 - j)
        yield a, b, out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sum of each one's numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = _runs(keys)
    return keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n[:0]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _counted(data: np.ndarray, bounds: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' different grams, sorted, and how often each occurs in training texts."""
    learnt = np.repeat(train, np.diff(bounds))
    found, times, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for a, b, g in grams(data, bounds):
        both = np.sort(g << 1 | learnt[a:b])
        starts = _runs(both >> 1)
        found.append(both[starts] >> 1)
        times.append(np.add.reduceat(both & 1, starts))
        held += len(starts)
        if held > 2 * PIECE:
            one, n = summed(np.concatenate(found), np.concatenate(times))
            found, times, held = [one], [n], 0
    return summed(np.concatenate(found), np.concatenate(times))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts' different words in order, each word's place among them, and how many words come before each text."""
    values, starts, own = cut(data, bounds, False)
    offsets = np.append(starts, len(values)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)], own


def _texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


def _part_of_grams(g: np.ndarray, parts: int) -> np.ndarray:
    """By the last NAMED bytes of the context."""
    named = (g >> 8 * (DEPTH + 1 - NAMED)).astype(np.uint64) + np.uint64(1)
    return (named * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts


def _part_of_words(words: pa.Array, parts: int) -> np.ndarray:
    data, bounds = text_bytes(words)
    if not len(words):
        return np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    return (np.add.reduceat(data * _PLACES[place & 4095], bounds[:-1]) >> np.uint64(33)).astype(np.int64) % parts


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and its places in their order."""
    order = np.argsort(part, kind="stable")
    starts = _runs(part[order])
    for a, places in zip(starts.tolist(), np.split(order, starts[1:]) if len(order) else (), strict=True):
        yield int(part[order[a]]), places


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: what Spark compresses well, as most are small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    """What ``_planes`` was made of."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _entries(block: pa.Table, parts: int) -> pa.Table:
    """ENTRIES of a block: gram parts count from 0, word parts from ``parts``."""
    number, train = block.column("block")[0].as_py(), block.column("train").to_numpy().astype(np.uint8)
    data, bounds = _texts(block.column("text").combine_chunks())
    rows = []
    g, n = _counted(data, bounds, train)
    for part, at in _dealt(_part_of_grams(g, parts)):
        rows.append((part, number, _planes(np.diff(g[at], prepend=0)), None, _planes(n[at].astype(np.uint32))))
    words, place, own = _words(data, bounds)
    n = np.bincount(place[np.repeat(train, np.diff(own)).astype(bool)], minlength=len(words))
    for part, at in _dealt(_part_of_words(words, parts)):
        rows.append((parts + part, number, None, words.take(pa.array(at)), _planes(n[at].astype(np.uint32))))
    types = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    columns[3:4] = [_lists(columns[3])] if rows else [()]
    return pa.Table.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in ENTRIES.split(", ")])


def _lists(lists: tuple) -> pa.Array:
    """A list column of string arrays, some of them null."""
    sizes = np.array([0 if x is None else len(x) for x in lists])
    values = pa.concat_arrays([pa.array([], pa.large_utf8()), *(x for x in lists if x is not None)]).cast(pa.string())
    none = pa.array([x is None for x in lists])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=none)


_SMALL = np.array([[math.lgamma(i + 0.5), math.lgamma(i + 1)] for i in range(1024)])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """ln gamma(n + 1/2) or ln gamma(n + 1) of whole numbers: a table, and Stirling's series beyond it."""
    out = _SMALL[np.minimum(n, len(_SMALL) - 1), 0 if half else 1]
    if len(large := np.flatnonzero(n >= len(_SMALL))):
        x = n[large] + (0.5 if half else 1.0)
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return _log_gamma(zeros, True) + _log_gamma(ones, True) - _log_gamma(zeros + ones, False) - math.log(math.pi)


class Level(NamedTuple):
    """The nodes of one depth: context and node number as one key, sorted, the weight of the own estimate and its probability of a one."""

    keys: np.ndarray
    share: np.ndarray
    one: np.ndarray


def _shorter(keys: np.ndarray) -> np.ndarray:
    """The keys with the oldest byte of the context gone."""
    return keys >> 16 << 8 | keys & 255


def _nodes(g: np.ndarray, bit: int) -> np.ndarray:
    """The key of each gram's node at a decision: the byte gives way to the node's number, 1 to 255."""
    return g >> 8 << 8 | 1 << bit | (g & 255) >> 8 - bit


def _folded(levels: list[tuple[np.ndarray, np.ndarray]], bit: int) -> tuple[list[Level], np.ndarray, np.ndarray, np.ndarray]:
    """The levels of one decision from DEPTH up, and ones, zeros and block probabilities of the last."""
    out, below = [], None
    for g, n in levels:
        key = _nodes(g, bit)
        starts = _runs(key)
        key, set_ = key[starts], g >> 7 - bit & 1
        ones, total = np.add.reduceat(n * set_, starts), np.add.reduceat(n, starts)
        own = log_estimate(total - ones, ones)
        if below is None:
            block, share = own, np.ones(len(own))
        else:
            children = np.bincount(np.searchsorted(key, _shorter(out[-1].keys)), below, len(key))
            block, share = mixed(own, children)
        out.append(Level(key, share, (ones + 0.5) / (total + 1)))
        below = block
    return out, ones, total - ones, block


def mixed(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of a node's block probability, and the share of its own estimate in it."""
    block = np.logaddexp(own + _HALF, children + _HALF)
    return block, np.exp(own + _HALF - block)


def _levels(g: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts by depth of context, from DEPTH to NAMED."""
    out = [(g, n)]
    for _ in range(DEPTH - NAMED):
        out.append(summed(_shorter(out[-1][0]), out[-1][1]))
    return out


def _merged(entries: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a part: its blocks, the grams of each, and all different ones with their counts."""
    own = [np.cumsum(_numbers(x.as_py(), np.int64)) for x in entries.column("grams")]
    n = [_numbers(x.as_py(), np.uint32) for x in entries.column("n")]
    return entries.column("block").to_pylist(), own, *summed(np.concatenate(own), np.concatenate(n).astype(np.int64))


TOPS = "key int, zeros long, ones long, children double"


def _tops(entries: pa.Table) -> pa.Table:
    """What a part's trees come to for contexts of one byte: TOPS by context and node."""
    *_, g, n = _merged(entries)
    levels, found = _levels(g, n), []
    for bit in range(8):
        nodes, ones, zeros, block = _folded(levels, bit)
        key = _shorter(nodes[-1].keys)
        found.append([key, zeros, ones, block])
    key, zeros, ones, block = (np.concatenate(x) for x in zip(*found, strict=True))
    different, at = np.unique(key, return_inverse=True)
    sums = [np.bincount(at, x, len(different)) for x in (zeros, ones, block)]
    return pa.table({"key": pa.array(different, pa.int32()), "zeros": sums[0].astype(np.int64), "ones": sums[1].astype(np.int64), "children": sums[2]})


def _top(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """By context of one byte and node: the probability of a one from there up, and the weight that is left for what is below."""
    key = np.array([r.key for r in rows], np.int64)
    zeros, ones = (np.zeros(1 << 16, np.int64) for _ in range(2))
    children = np.zeros(1 << 16)
    zeros[key], ones[key], children[key] = [r.zeros for r in rows], [r.ones for r in rows], [r.children for r in rows]
    block, share = mixed(log_estimate(zeros, ones), children)
    all_zeros, all_ones, all_blocks = (x.reshape(256, 256).sum(0) for x in (zeros, ones, block))
    _, root = mixed(log_estimate(all_zeros, all_ones), all_blocks)
    rest = np.tile(1 - root, 256)
    above = np.tile(root * (all_ones + 0.5) / (all_zeros + all_ones + 1), 256)
    return above + rest * share * (ones + 0.5) / (zeros + ones + 1), rest * (1 - share)


def _worth(entries: pa.Table, above: np.ndarray, left: np.ndarray) -> pa.Table:
    """VALUES: for each block the log10 of the probability of its grams' last bytes, in the order of its entry."""
    blocks, own, g, n = _merged(entries)
    levels, logp = _levels(g, n), np.zeros(len(g))
    for bit in range(8):
        nodes = _folded(levels, bit)[0]
        key = _shorter(nodes[-1].keys)
        one, rest = above[key], left[key]
        for i in range(len(nodes) - 1, -1, -1):
            level = nodes[i]
            if i < len(nodes) - 1:
                up = np.searchsorted(nodes[i + 1].keys, _shorter(level.keys))
                one, rest = one[up], rest[up]
            one, rest = one + rest * level.share * level.one, rest * (1 - level.share)
        at = np.searchsorted(nodes[0].keys, _nodes(g, bit))
        logp += np.log10(np.where(g >> 7 - bit & 1, one[at], 1 - one[at]))
    part = entries.column("part")[0].as_py()
    worth = [_planes(logp[np.searchsorted(g, x)].astype(np.float32)) for x in own]
    return _values(blocks, part, worth, [None] * len(blocks))


def _word_counts(entries: pa.Table) -> pa.Table:
    """VALUES: for each block the counts of its words, in the order of its entry; at the first also the part's sum and number of those that occur."""
    lists = entries.column("words").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n = np.concatenate([_numbers(x.as_py(), np.uint32) for x in entries.column("n")])
    total = np.bincount(codes, n, len(coded.dictionary)).astype(np.int64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    counts = [_planes(x) for x in np.split(total[codes], ends[:-1])]
    return _values(entries.column("block").to_pylist(), entries.column("part")[0].as_py(), [None] * len(counts), counts, (int(total.sum()), int(np.count_nonzero(total))))


def _values(blocks: list[int], part: int, worth: list, n: list, sums: tuple[int, int] | None = None) -> pa.Table:
    total, different = ([x, *[None] * (len(blocks) - 1)] for x in sums or (None, None))
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(x, t) for x, t in zip((blocks, [part] * len(blocks), worth, n, total, different), types, strict=True)], [f.split()[0] for f in VALUES.split(", ")])


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _score(block: pa.Table, values: pa.Table, parts: int, ends: int, trained: int, different: int) -> pa.Table:
    """Sums over each text of a block of what its grams and words are worth."""
    data, bounds = _texts(block.column("text").combine_chunks()) if block.num_rows else _texts(pa.array([], pa.string()))
    sent = {p: (w.as_py(), n.as_py()) for p, w, n in zip(values.column("part").to_pylist(), values.column("worth"), values.column("n"), strict=True)}
    different_grams, _ = _counted(data, bounds, np.zeros(len(bounds) - 1, np.uint8))
    worth = np.zeros(len(different_grams))
    for part, at in _dealt(_part_of_grams(different_grams, parts)):
        worth[at] = _numbers(sent[part][0], np.float32)
    score = np.zeros(len(bounds) - 1)
    for a, b, g in grams(data, bounds):
        order = np.argsort(g)
        sorted_, starts = g[order], _runs(g[order])
        each = np.repeat(worth[np.searchsorted(different_grams, sorted_[starts])], np.diff(np.append(starts, len(g))))
        first = int(np.searchsorted(bounds, a, side="right")) - 1
        row = np.repeat(np.arange(len(bounds) - 1 - first), np.diff(np.clip(bounds[first:], a, b)))
        sums = np.bincount(row[order], each)
        score[first : first + len(sums)] += sums
    words, place, own = _words(data, bounds)
    counts = np.zeros(len(words), np.int64)
    for part, at in _dealt(_part_of_words(words, parts)):
        counts[at] = _numbers(sent[parts + part][1], np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(own))
    floor = math.log10(trained + different + 1)
    base = np.bincount(text, np.log10(counts + 1)[place], len(bounds) - 1) + math.log10(ends + 1) - (np.diff(own) + 1) * floor
    known = np.bincount(text[counts[place] > 0], minlength=len(bounds) - 1) + (ends > 0)
    columns = [block.column("doc_id"), block.column("train"), np.diff(own) + 1, known, base, score, np.diff(bounds)]
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], [f.split()[0] for f in SCORED.split(", ")])


def score(docs: DataFrame, may_learn: Column, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte for every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(may_learn, F.lit(True)).alias("train"))
    total, ends = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    blocks, parts = max(1, -(-total // block_bytes)), max(1, -(-total // part_bytes))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(blocks)).cast("int"))
    entries = written(dealt.groupBy("block").applyInArrow(lambda block: _entries(block, parts), ENTRIES), "entries")
    of_grams = entries.where("grams is not null").groupBy("part")
    tops = of_grams.applyInArrow(_tops, TOPS).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")])
    above, left = _top(tops.collect())  # at most 65,280 nodes
    values = of_grams.applyInArrow(lambda part: _worth(part, above, left), VALUES).union(entries.where("words is not null").groupBy("part").applyInArrow(_word_counts, VALUES))
    values = written(values, "values")
    trained, different = values.agg(F.coalesce(F.sum("total"), F.lit(0)) + ends, F.coalesce(F.sum("different"), F.lit(0)) + min(ends, 1)).first()
    scored = dealt.groupBy("block").cogroup(values.select("block", "part", "worth", "n").groupBy("block")).applyInArrow(lambda block, own: _score(block, own, parts, ends, trained, different), SCORED)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return scored.withColumn("train_tokens", F.lit(trained).cast("long")).withColumn("bits_per_byte", bits)
