"""Operator 12: quality rules by labelling a text's lines with a linear-chain random field.

Every line that has a word is content or boilerplate. A line's signs (``SIGNS``:
shares of capitals, digits, symbols, exclamation marks, repeated words and so on,
each put into a bin) and the label of the line before weigh for one or the other;
the best labelling of all lines is found by Viterbi's algorithm, and a document
stays if at least ``least_content`` of its words lie in content lines. Besides,
``base_failed`` tells of texts that are short or mostly repeat themselves.

The field is fitted by conditional likelihood (forward-backward, the gradient
followed by ``ROUNDS`` steps) on at most ``most_labelled`` labelled documents,
chosen by hash. Their lines have no labels of their own: first all lines of a bad
document count as boilerplate, then only those that the field so fitted takes for it.

Defined cases: a null or empty text has no words, fails the base rules and goes;
repeated rows get a verdict each; of equal labellings the one with more content at
the first difference from the end is taken; without labels of both kinds every line
is content; an empty table gives no rows; further columns are ignored. A task holds
``slices`` of about 8 MB of text, or one longer text with about 100 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.folds import labelled_sample
from sparkloom.llm.terms import text_bytes
from sparkloom.llm.tokenize import slices

CONTENT, BOILERPLATE = 0, 1
#: Bounds of bins for shares, and for lengths in words and mean bytes of a word.
SHARES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
LENGTHS = np.array([1, 2, 4, 8, 16, 32, 64, 128])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 8, 12, 20])
#: What is told of a line; each has BINS weights.
SIGNS = ("capitals", "digits", "symbols", "exclamation marks", "other signs", "words like the one before", "words in repeated windows", "words", "bytes of a word", "ends a sentence", "repeats a line")
BINS = 10
ROUNDS, STEP, SHRINK = 150, 0.1, 1e-3
#: Lines of a training sequence; longer documents are several.
PIECE = 64

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_ENDS = np.isin(_CODES, list(b".!?:;\"')"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lines:
    """What a slice of texts consists of: counts by text, and signs of the lines that have a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    owner: np.ndarray  # of each line
    words: np.ndarray  # in each line
    signs: np.ndarray  # lines x SIGNS, numbers of bins


def _codes(kept: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Equal numbers for equal strings, which begin at ``starts`` in the bytes ``kept``."""
    offsets = np.append(starts, len(kept)).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated(*parts: np.ndarray) -> np.ndarray:
    """Which rows of equally long whole numbers occur more than once; sorted by a hash, whose ties are compared in full."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    a, b = order[1:][same], order[:-1][same]
    if any((p[a] != p[b]).any() for p in parts):  # a hash of two different rows
        order = np.lexsort(parts)
        same = np.logical_and.reduce([p[order[1:]] == p[order[:-1]] for p in parts])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def taken_apart(texts: pa.Array) -> Lines:
    data, bounds = text_bytes(texts)
    n = len(texts)

    def of_texts(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    inside = ~_BLANK[data]
    first = inside & ~np.concatenate([[False], inside[:-1]])[: len(data)]
    begins = bounds[:-1][np.diff(bounds) > 0]
    first[begins] = inside[begins]
    at = np.flatnonzero(first)
    words = _codes(data[inside], np.flatnonzero(first[inside]))
    of_word = np.searchsorted(bounds, at, side="right") - 1
    covered = np.zeros(len(at), bool)
    if len(at) > 2:
        whole = of_word[2:] == of_word[:-2]
        twice = np.zeros(len(at) - 2, bool)
        twice[whole] = _repeated(of_word[:-2][whole], words[:-2][whole], words[1:-1][whole], words[2:][whole])
        for i in range(3):
            covered[i : len(at) - 2 + i] |= twice

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, bounds[1:]]))
    owner = np.repeat(np.arange(n), of_texts(data == 10) + 1)

    def of_lines(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[starts]

    n_line = of_lines(first)
    kept = n_line > 0
    lines = _codes(data[data != 10], np.concatenate([[0], np.cumsum(ends - starts)[:-1]]) if len(starts) else starts)
    again = np.zeros(len(starts), bool)
    filled = np.flatnonzero(kept)
    order = filled[np.lexsort([filled, lines[filled], owner[filled]])]
    again[order[1:]] = (lines[order[1:]] == lines[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])

    def of_words(flags: np.ndarray) -> np.ndarray:
        marks = np.zeros(len(data), bool)
        marks[at[flags]] = True
        return of_lines(marks)

    like = np.zeros(len(at), bool)
    like[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    size = np.maximum(of_lines(inside), 1)
    other = inside & ~(_LETTER | _DIGIT | _SYMBOL)[data] & (data != ord("!"))
    shares = [
        of_lines(_UPPER[data]) / np.maximum(of_lines(_LETTER[data]), 1),
        of_lines(_DIGIT[data]) / size, of_lines(_SYMBOL[data]) / size, of_lines(data == ord("!")) / size, of_lines(other) / size,
        of_words(like) / np.maximum(n_line, 1), of_words(covered) / np.maximum(n_line, 1),
    ]
    last = np.zeros(len(starts), bool)
    tails = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])[: len(data)])
    if len(tails):
        place = np.searchsorted(tails, ends, side="left") - 1
        last = (place >= 0) & _ENDS[data[tails[np.maximum(place, 0)]]]
    signs = [np.searchsorted(SHARES, s, side="left") for s in shares]
    signs += [np.searchsorted(LENGTHS, n_line, side="left"), np.searchsorted(WIDTHS, size / np.maximum(n_line, 1), side="left"), last, again]
    return Lines(
        n_words=np.bincount(of_word, minlength=n), word_chars=of_texts(inside & ((data & 0xC0) != 0x80)), n_symbols=of_texts(_SYMBOL[data]),
        n_dup_lines=np.bincount(owner[again], minlength=n), n_repeat_words=np.bincount(of_word[covered], minlength=n),
        owner=owner[kept], words=n_line[kept], signs=np.stack(signs, 1)[kept].astype(np.int8),
    )


@dataclass
class Field:
    """Weights for boilerplate: of each sign's bins (content's are none), of label pairs, of the first label."""

    signs: np.ndarray  # SIGNS x BINS
    pairs: np.ndarray  # label before x label
    first: np.ndarray

    def potentials(self, signs: np.ndarray) -> np.ndarray:
        """lines x labels."""
        own = self.signs[np.arange(len(SIGNS)), signs].sum(1)
        return np.stack([np.zeros(len(own)), own], 1)


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from the longest to the shortest, where each begins, and how many are longer than each step."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longer = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    return order, starts, longer


def viterbi(field: Field, potentials: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of all lines; sequences lie one after the other and are decoded side by side."""
    _, starts, longer = _by_length(lengths)
    back = np.zeros((len(potentials), 2), np.int8)
    best = np.zeros((len(starts), 2))
    for t, n in enumerate(longer.tolist()):
        at = starts[:n] + t
        if t == 0:
            best[:n] = field.first + potentials[at]
            continue
        ways = best[:n, :, None] + field.pairs
        back[at] = ways.argmax(1)
        best[:n] = ways.max(1) + potentials[at]
    labels = np.zeros(len(potentials), np.int8)
    now = best.argmax(1).astype(np.int8)
    for t in range(len(longer) - 1, -1, -1):
        at = starts[: longer[t]] + t
        labels[at] = now[: longer[t]]
        now[: longer[t]] = back[at, now[: longer[t]]]
    return labels


def expected(field: Field, potentials: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of each sequence's sum over labellings (longest sequence first), chances of each line's labels, and of each pair of labels with the line before."""
    _, starts, longer = _by_length(lengths)
    forward, backward = np.zeros_like(potentials), np.zeros_like(potentials)
    pair = np.zeros((len(potentials), 2, 2))
    for t, n in enumerate(longer.tolist()):
        at = starts[:n] + t
        forward[at] = potentials[at] + (field.first if t == 0 else np.logaddexp.reduce(forward[at - 1][:, :, None] + field.pairs, axis=1))
    for t in range(len(longer) - 2, -1, -1):
        at = starts[: longer[t + 1]] + t
        backward[at] = np.logaddexp.reduce(field.pairs + (potentials[at + 1] + backward[at + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(forward[starts] + backward[starts], axis=1)
    of_line = np.zeros(len(potentials))
    for t, n in enumerate(longer.tolist()):
        of_line[starts[:n] + t] = total[:n]
    for t in range(1, len(longer)):
        at = starts[: longer[t]] + t
        pair[at] = np.exp(forward[at - 1][:, :, None] + field.pairs + (potentials[at] + backward[at])[:, None, :] - of_line[at][:, None, None])
    return total, np.exp(forward + backward - of_line[:, None]), pair


def fitted(signs: np.ndarray, labels: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> Field:
    """The field of greatest weighted conditional likelihood of the labels, less a penalty; Adam's steps from zero."""
    firsts = np.zeros(len(labels), bool)
    firsts[np.cumsum(lengths) - lengths] = True
    seen = np.flatnonzero(~firsts)
    truth = np.eye(2)[labels]
    size = len(SIGNS) * BINS
    theta, m, v = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    cells = signs + BINS * np.arange(len(SIGNS))
    total = weights.sum()

    def field() -> Field:
        return Field(theta[:size].reshape(-1, BINS), theta[size : size + 4].reshape(2, 2), theta[size + 4 :])

    for i in range(1, ROUNDS + 1):
        own = field()
        _, line, pair = expected(own, own.potentials(signs), lengths)
        miss = (truth - line) * weights[:, None]
        g = np.zeros_like(theta)
        g[:size] = np.bincount(cells.ravel(), np.repeat(miss[:, BOILERPLATE], len(SIGNS)), minlength=size)
        g[size : size + 4] = (np.einsum("ia,ib,i->ab", truth[seen - 1], truth[seen], weights[seen]) - np.einsum("iab,i->ab", pair[seen], weights[seen])).ravel()
        g[size + 4 :] = miss[firsts].sum(0)
        g = g / total - SHRINK * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + STEP * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return field()


def train(sample: list[tuple[int, np.ndarray]]) -> Field:
    """A field of documents (1 good or 0 bad, signs of their lines), both kinds weighing the same."""
    sample = [(good, signs) for good, signs in sample if len(signs)]
    if len({good for good, _ in sample}) < 2:
        return Field(np.full((len(SIGNS), BINS), -1.0), np.zeros((2, 2)), np.zeros(2))
    signs = np.concatenate([s for _, s in sample])
    bad = np.concatenate([np.full(len(s), 1 - good) for good, s in sample])
    lengths = np.array([n for _, s in sample for n in (*[PIECE] * (len(s) // PIECE), *[len(s) % PIECE] * (len(s) % PIECE > 0))])
    weights = np.where(bad == 1, 0.5 / max(bad.sum(), 1), 0.5 / max((1 - bad).sum(), 1))
    field = fitted(signs, bad, lengths, weights)
    labels = bad & viterbi(field, field.potentials(signs), lengths)
    return fitted(signs, labels, lengths, weights) if labels.any() else field


def content_words(field: Field, lines: Lines) -> np.ndarray:
    """By text: how many words lie in content lines."""
    n = len(lines.n_words)
    labels = viterbi(field, field.potentials(lines.signs), np.bincount(lines.owner, minlength=n))
    return np.bincount(lines.owner, lines.words * (labels == CONTENT), minlength=n).astype(np.int64)


def line_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", may_learn: Column | None = None, most_labelled: int = 4096, least_content: float = 0.5, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, content_words of every document.

    ``label`` is 1 for good documents; ``may_learn`` is on the labels' doc_id.
    """
    sample = labelled_sample(docs, labels, label, F.lit(True) if may_learn is None else may_learn, most_labelled)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = taken_apart(part.column("text"))
                cuts = np.searchsorted(lines.owner, np.arange(part.num_rows + 1))
                own = [lines.signs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(own, pa.binary())], ["doc_id", "label", "signs"])

    rows = sorted(sample.mapInArrow(signs, "doc_id long, label int, signs binary").collect())  # at most most_labelled
    field = train([(r.label, np.frombuffer(r.signs, np.int8).reshape(-1, len(SIGNS))) for r in rows])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = taken_apart(part.column("text"))
                content = content_words(field, x)
                failed = (x.n_words < least_words) | (100 * x.n_repeat_words > most_repeated * x.n_words)
                share = content / np.maximum(x.n_words, 1)
                counts = [pa.array(c, pa.int64()) for c in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(failed), pa.array(~failed & (share >= least_content)), pa.array(share), pa.array(content, pa.int64())],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "content_words"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, content_words long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)
