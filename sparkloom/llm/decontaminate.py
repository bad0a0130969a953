"""Operator 5: benchmark decontamination by latent semantic retrieval.

Documents are cut into half windows of ``HALF`` words; a passage is two of them in a
row, so passages overlap by half. Terms are hashed words, weighed by the square of their
logarithmic inverse frequency over the half windows of all documents. A randomised SVD of the
passages of all documents and items (items weigh ``ITEM_WEIGHT`` times as much) spans the latent
space: a round of subspace iteration over all of them, which starts where the rounds over the items
and about ``sample`` passages (by hash of the text, copies once) ended. Every
passage's cosine with every item is computed in blocks; pairs of at least ``cosine``
are candidates. So is, whatever its cosine, every pair that shares as many words as
a leak must have (``Cover``), so that a leak is found however many the items and
however short one is beside its passage. A candidate's item is compared with the text around the passage: the
longest common subsequence of words, as a share of the item's words, and whether the
answer, the item's last sentence, is there too. A document leaks an item if the share
is ``alone`` or more, or ``with_answer`` or more and the answer is found.

Items (a stated query set) go to the tasks in blocks of at most ``ITEMS`` items, each
block one pass, whatever their number; nothing else is broadcast but idf and basis,
of fixed size.

Defined cases: null and empty texts and items without words match nothing; repeated
rows and items are reported each; a null doc_id is reported as null; empty tables
give no rows; further columns are ignored. A text of any length is taken whole: its
words' hashes and the vectors of its half windows are in memory, about 30 bytes for
each of its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.lsa import basis, column_sum, spread, unit
from sparkloom.llm.shingles import hashed_words
from sparkloom.llm.terms import distinct
from sparkloom.llm.tokenize import slices
from sparkloom.storage import written

HALF, TERMS, RANK, ITEM_WEIGHT, ITEMS = 32, 1 << 14, 64, 4.0, 8192
#: Rare terms tell items apart, so the logarithm is squared.
IDF_POWER = 2
#: An answer of fewer words proves nothing; one is found if this share of its words is.
ANSWER_WORDS, ANSWER_SHARE = 3, 0.8
#: Counters and postings that ``Cover`` holds at once.
COUNTED = 1 << 21
SLICE = 1 << 20
HITS = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(50)).astype(np.int64)


def _halves(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every half window of texts with words, and the text of each."""
    counts = -(-np.diff(bounds) // HALF)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[:-1][text] + within * HALF, text


def _frequencies(batch: pa.RecordBatch) -> np.ndarray:
    """How many half windows have each term, and their number."""
    out = np.zeros(TERMS + 1, np.float32)
    for part in slices(batch, "text", SLICE):
        words, bounds = hashed_words(part.column("text"))
        starts, _ = _halves(bounds)
        if len(starts):
            half = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
            out[:TERMS] += np.bincount(distinct(half * TERMS + _terms(words)) % TERMS, minlength=TERMS)
            out[TERMS] += len(starts)
    return out


def _passages(starts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First half window and number of halves of each passage: two in a row of one text, or a text's only one."""
    follows = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
    alone = ~follows & ~np.concatenate([[False], follows[:-1]]) if len(text) else follows
    first = np.flatnonzero(follows | alone)
    return first, np.where(follows[first], 2, 1)


def _rows(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[np.ndarray]:
    """TF-IDF vectors of the passages, a dense block at a time; weighed by the column weight."""
    for part in slices(batch, "text", 1 << 16):
        words, bounds = hashed_words(part.column("text"))
        starts, text = _halves(bounds)
        first, n = _passages(starts, text)
        ends = np.append(starts, len(words))
        weight = part.column("weight").to_numpy()
        out = np.zeros((len(first), TERMS), np.float32)
        for i, (a, k) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
            np.add.at(out[i], _terms(words[ends[a] : ends[a + k]]), 1)
        yield unit(out * idf).astype(np.float32) * weight[text[first]][:, None].astype(np.float32)


def _runs_added(values: np.ndarray, index: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sum of the rows ``values[index]`` of each run that begins at ``edges``, eight rows at a time."""
    while True:
        counts = np.diff(np.append(edges, len(index)))
        parts = -(-counts // 8)
        first = np.cumsum(parts) - parts
        padded = np.full(8 * parts.sum(), len(values))
        padded[np.arange(len(index)) + np.repeat(8 * first - edges, counts)] = index
        padded, known = padded.reshape(-1, 8), np.vstack([values, np.zeros((1, values.shape[1]), values.dtype)])
        out = known[padded[:, 0]]
        for k in range(1, 8):
            out += known[padded[:, k]]
        if (parts == 1).all():
            return out
        values, index, edges = out, np.arange(len(out)), first


def _product(batch: pa.RecordBatch, q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'AQ of the rows A that ``_rows`` has, from sums over half windows, without these rows."""
    out, weighed = np.zeros(q.shape, np.float32), (q * idf[:, None]).astype(np.float32)
    for part in slices(batch, "text", SLICE):
        words, bounds = hashed_words(part.column("text"))
        starts, text = _halves(bounds)
        if not len(starts):
            continue
        terms, sizes = _terms(words), np.diff(np.append(starts, len(words)))
        first, n = _passages(starts, text)
        pair = np.flatnonzero(n == 2)
        halves = _sums(terms, starts, sizes, weighed)
        rows = halves[first]
        rows[pair] += halves[first[pair] + 1]
        # a half window lies in the passage that begins with it and in the one that ends with it
        half = np.repeat(np.arange(len(starts)), sizes)
        begins, ends = np.full((2, len(starts)), -1)
        begins[first], ends[first[pair] + 1] = np.arange(len(first)), pair
        inside = [(x[half] * TERMS + terms)[x[half] >= 0] for x in (begins, ends)]
        seen, times = np.unique(np.concatenate(inside), return_counts=True)
        squares = np.bincount(seen // TERMS, (times * idf[seen % TERMS]) ** 2, minlength=len(first))
        weight = part.column("weight").to_numpy()[text[first]]
        rows *= (weight**2 / np.maximum(squares, 1e-24))[:, None].astype(np.float32)
        back = np.zeros_like(halves)
        back[first] = rows
        back[first[pair] + 1] += rows[pair]
        order = np.argsort(terms.astype(np.int16), kind="stable")
        own = terms[order]
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[edges]] += _runs_added(back, half[order], edges)
    return (out * idf[:, None]).astype(np.float32).ravel()


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; a bit of an integer for each element of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b.tolist():
        if m := where.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(text: str | None) -> str:
    """The last sentence (or part between bars) that has letters or digits."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\|", text or "") if re.search(r"\w", p)]
    return parts[-1].strip() if parts else ""


def _rarest(words: np.ndarray, share: float, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Words without the commonest, half as many as ``share`` of them, and how many of the rest a text with that share has."""
    left_out = int(share * len(words)) // 2
    return words[np.argsort(idf[_terms(words)], kind="stable")[left_out:]], share * len(words) - left_out - 1e-9


class Cover:
    """Items of about one length, found by the words that a text has of them.

    Texts are cut into cells as long as ``Items.check`` looks to each side, so what it
    sees around a passage lies in the cell of the passage's middle and the two beside it.
    A leak has ``alone`` of the item's words there, or ``with_answer`` of them and of
    their weight and the answer's.
    An item's commonest words are not looked up and count as if they were there, so a
    pair that is left out here fails the check.
    """

    def __init__(self, members: list[int], words: list[np.ndarray], answers: list[np.ndarray], idf: np.ndarray, alone: float, with_answer: float):
        self.members = np.array(members)
        self.cell = HALF + max(len(words[i]) for i in members)
        own = [_rarest(words[i], min(alone, with_answer), idf) for i in members]
        named = [_rarest(answers[i], ANSWER_SHARE, idf) if len(answers[i]) >= ANSWER_WORDS else (answers[i][:0], np.inf) for i in members]
        lengths = np.array([len(words[i]) for i in members])
        self.some = np.array([least for _, least in own])
        self.enough = self.some + (alone - min(alone, with_answer)) * lengths
        self.named = np.array([least for _, least in named])
        looked_up = [w for w, _ in own + named]
        # the weight that the words looked up must have, single precision aside
        total, known = (np.array([idf[_terms(w)].sum(dtype=float) for w in x]) for x in ([words[i] for i in members], [w for w, _ in own]))
        self.heavy = 0.999 * with_answer * total - (total - known)
        columns = np.repeat(np.arange(len(looked_up)), [len(w) for w in looked_up])
        self.known, place = np.unique(np.concatenate(looked_up), return_inverse=True)
        pairs, times = np.unique(place.astype(np.int64) * len(looked_up) + columns, return_counts=True)
        self.columns, self.times = pairs % len(looked_up), times.astype(float)
        self.weights = self.times * idf[_terms(self.known)][pairs // len(looked_up)]
        self.bounds = np.searchsorted(pairs, np.arange(len(self.known) + 1) * len(looked_up))

    def near(self, own: np.ndarray, inverse: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts, cells in them and items that may leak around a middle in the cell."""
        if not len(self.known):
            return
        place = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = np.flatnonzero((self.known[place] == own)[inverse])
        place = place[inverse]
        first = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // self.cell))])
        text = np.searchsorted(bounds, at, side="right") - 1
        cell = first[text] + (at - bounds[text]) // self.cell
        before, after = cell > first[text], cell + 1 < first[text + 1]
        seen = distinct(np.concatenate([cell, cell[before] - 1, cell[after] + 1]) * len(self.known) + np.concatenate([place[at], place[at[before]], place[at[after]]]))
        cell, word = np.divmod(seen, len(self.known))
        number = self.bounds[word + 1] - self.bounds[word]
        width = 2 * len(self.members)
        held = np.cumsum(np.bincount(cell, number, minlength=first[-1]) + width) // COUNTED
        edges = np.concatenate([[0], np.flatnonzero(np.diff(held)) + 1, [first[-1]]]).astype(np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lo, hi = np.searchsorted(cell, [a, b])
            n = number[lo:hi]
            entry = np.repeat(self.bounds[word[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(cell[lo:hi] - a, n) * width + self.columns[entry]
            counts, weights = (np.bincount(place, x[entry], minlength=(b - a) * width).reshape(b - a, width) for x in (self.times, self.weights))
            own, named = counts[:, : width // 2], counts[:, width // 2 :]
            found, item = np.nonzero((own >= self.enough) | ((own >= self.some) & (named >= self.named) & (weights[:, : width // 2] >= self.heavy)))
            texts = np.searchsorted(first, found + a, side="right") - 1
            yield texts, found + a - first[texts], self.members[item]


class Items:
    """A block of items: their words, answers and latent vectors."""

    def __init__(self, rows: list, idf: np.ndarray, v: np.ndarray, alone: float, with_answer: float):
        texts = pa.array([r.text for r in rows], pa.large_string())
        words, bounds = hashed_words(texts)
        answers, ends = hashed_words(pa.array([answer_of(r.text) for r in rows], pa.large_string()))
        kept = np.flatnonzero(np.diff(bounds) > 0).tolist()
        self.ids = [rows[i].item_id for i in kept]
        self.words = [words[bounds[i] : bounds[i + 1]] for i in kept]
        self.answers = [answers[ends[i] : ends[i + 1]] for i in kept]
        self.known = [np.unique(w, return_inverse=True) for w in self.words]
        self.weights = [idf[_terms(w)] for w in self.words]
        weighed = v * idf[:, None]
        self.vectors = unit(np.array([weighed[_terms(w)].sum(0) for w in self.words], np.float32).reshape(-1, v.shape[1]))
        lengths: dict[int, list[int]] = {}
        for i, own in enumerate(self.words):
            lengths.setdefault((len(own) - 1).bit_length(), []).append(i)
        self.covers = [Cover(m, self.words, self.answers, idf, alone, with_answer) for m in lengths.values()]

    def check(self, item: int, words: np.ndarray, middle: int, alone: float, with_answer: float, similar: bool) -> tuple[float, bool] | None:
        """Share of the item's words in order around a passage and whether its answer is there, if it is a leak.

        Few words and an answer may be there by chance if they are common ones, so where
        the passage is not ``similar`` the words found must have their share of the weight too.
        """
        own, answer = self.words[item], self.answers[item]
        reach = HALF + len(own)
        around = words[max(0, middle - reach) : middle + reach]
        # no subsequence is longer than the words that both have
        known, place = self.known[item]
        at = np.minimum(np.searchsorted(known, around), len(known) - 1)
        seen = np.zeros(len(known), bool)
        seen[at[known[at] == around]] = True
        there = seen[place]
        common = np.count_nonzero(there) / len(own)
        if common < min(alone, with_answer):
            return None
        if not similar and self.weights[item][there].sum() < with_answer * self.weights[item].sum():
            if common < alone:
                return None
            with_answer = alone
        share = lcs(own, around) / len(own)
        found = len(answer) >= ANSWER_WORDS and lcs(answer, around) >= ANSWER_SHARE * len(answer)
        return (share, found) if share >= alone or (share >= with_answer and found) else None


def _sums(terms: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weighed: np.ndarray) -> np.ndarray:
    """The sum of its terms' rows for each half window, a place of all windows at a time."""
    out = weighed[terms[starts]]
    for k in range(1, int(lengths.max())):
        if (lengths > k).all():
            out += weighed[terms[starts + k]]
        else:
            longer = np.flatnonzero(lengths > k)
            out[longer] += weighed[terms[starts[longer] + k]]
    return out


def _scan(batch: pa.RecordBatch, items: Items, weighed: np.ndarray, least: float, alone: float, with_answer: float) -> Iterator[tuple]:
    """The best hit of each document and item."""
    for part in slices(batch, "text", SLICE):
        words, bounds = hashed_words(part.column("text"))
        starts, text = _halves(bounds)
        if not len(starts):
            continue
        halves = _sums(_terms(words), starts, np.diff(np.append(starts, len(words))), weighed)
        first, n = _passages(starts, text)
        vectors = halves[first]
        vectors[n == 2] += halves[first[n == 2] + 1]
        vectors = unit(vectors)
        docs, best = part.column("doc_id").to_pylist(), {}
        row_of, middle_of = text[first], starts[first] - bounds[text[first]] + HALF
        pairs = []
        for a in range(0, len(vectors), 4096):
            p, item = np.nonzero(vectors[a : a + 4096] @ items.vectors.T >= least)
            pairs.append((p + a) * len(items.ids) + item)
        similar = set(np.concatenate(pairs).tolist())
        begins = np.searchsorted(row_of, np.arange(len(bounds)))
        own, inverse = np.unique(words, return_inverse=True)
        for cover in items.covers:
            for row, cell, item in cover.near(own, inverse, bounds):
                # passages of a text have their middles HALF words apart, from HALF on
                lo = np.maximum(-(-cell * cover.cell // HALF) - 1, 0)
                hi = np.minimum(-(-(cell + 1) * cover.cell // HALF) - 1, begins[row + 1] - begins[row])
                n = np.maximum(hi - lo, 0)
                p = np.repeat(begins[row] + lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs.append(p * len(items.ids) + np.repeat(item, n))
        for pair in distinct(np.concatenate(pairs)).tolist():
            p, item = divmod(pair, len(items.ids))
            row = int(row_of[p])
            if hit := items.check(item, words[bounds[row] : bounds[row + 1]], int(middle_of[p]), alone, with_answer, pair in similar):
                found = (float(vectors[p] @ items.vectors[item]), *hit)
                best[row, item] = max(best.get((row, item), found), found, key=lambda x: (x[1], x[2], x[0]))
        for (row, item), hit in best.items():
            yield docs[row], items.ids[item], *hit


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.65, alone: float = 0.6, with_answer: float = 0.45, sample: int = 2048) -> DataFrame:
    """A row of HITS for each document and benchmark item that it leaks."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    counted = column_sum(texts.select("text").union(items.select("text")), _frequencies, TERMS + 1)
    idf = (np.log((1 + counted[-1]) / (1 + counted[:-1])) ** IDF_POWER).astype(np.float32)
    rate = max(1, int(counted[-1] // sample))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(rate)) == 0).select("text").distinct().select("text", F.lit(1.0).alias("weight"))
    fit = written(some.union(items.select("text", F.lit(ITEM_WEIGHT).alias("weight"))), "passages")
    begun = basis(spread(fit, sample), lambda batch: _rows(batch, idf), TERMS, RANK)
    everything = texts.select("text", F.lit(1.0).alias("weight")).union(items.select("text", F.lit(ITEM_WEIGHT).alias("weight")))
    turned = column_sum(everything, lambda batch: _product(batch, begun, idf), TERMS * RANK).reshape(TERMS, RANK)
    v = np.ascontiguousarray(np.linalg.svd(turned, full_matrices=False)[0].astype(np.float32))
    number = items.count()
    out = None
    for block in range(-(-number // ITEMS)):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-number // ITEMS))) == block).collect()
        known = Items(own, idf, v, alone, with_answer)

        def run(batches: Iterator[pa.RecordBatch], known: Items = known) -> Iterator[pa.RecordBatch]:
            names = [f.split()[0] for f in HITS.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            for batch in batches:
                rows = list(_scan(batch, known, (v * idf[:, None]).astype(np.float32), cosine, alone, with_answer))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        found = texts.mapInArrow(run, HITS)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)
