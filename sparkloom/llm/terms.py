"""Hashed terms of whole texts, computed on an Arrow column's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte trigrams and pairs of word shapes have numbers of their own.
TRIGRAMS, SHAPES = 1 << 13, 2 * 32 * 32
TERMS = TRIGRAMS + SHAPES
MULTIPLIER = np.uint32(2654435761)

#: What kind of byte each is: lower case, upper case, digit, other sign, part of a longer character; 0 is white space.
_KIND = np.full(256, 8, np.uint8)
_KIND[list(range(9, 14)) + [32]] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 16
#: Bytes of a text whose terms are in memory at once.
PIECE = 1 << 20
_PLACES = np.random.default_rng(20).integers(1, 2**63, 4096).astype(np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and each text's bounds in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted; for whole numbers far faster than ``np.unique``, which hashes them."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def trigrams(data: np.ndarray) -> np.ndarray:
    """A term for each byte but the last two."""
    x = data.astype(np.uint32)
    return ((x[:-2] | x[1:-1] << 8 | x[2:] << 16) * MULTIPLIER >> np.uint32(19)).astype(np.int64)


def shape_pairs(data: np.ndarray) -> np.ndarray:
    """A term for each word but the first: its shape, that of the word before and whether they are the same word."""
    kind = _KIND[data]
    inside = kind > 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if len(starts) < 2:
        return np.zeros(0, np.int64)
    shape = np.bitwise_or.reduceat(kind, starts).astype(np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    # white space after a word counts nothing in its hash
    value = data[starts[0] :] * inside[starts[0] :]
    words = np.add.reduceat(value * _PLACES[place & 4095], starts - starts[0])
    same = words[1:] == words[:-1]
    return TRIGRAMS + (same * 1024 + shape[:-1] * 32 + shape[1:])


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts by text and term; a short slice at a time, as it is dense, and a long text in pieces."""
    data, bounds = text_bytes(texts)
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for c in range(a, b - 2, PIECE):
            out[i, :TRIGRAMS] += np.bincount(trigrams(data[c : min(c + PIECE + 2, b)]), minlength=TRIGRAMS)
        for c, d in _word_pieces(data, a, b):
            out[i, TRIGRAMS:] += np.bincount(shape_pairs(data[c:d]) - TRIGRAMS, minlength=SHAPES)
    return out


def _word_pieces(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes of a text (more where two words are longer) that end behind a word, each beginning with the last word of the one before."""
    size = PIECE
    while a + size < b:
        inside = _KIND[data[a : a + size + 1]] > 0
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if len(ends) > 1 and len(starts := starts[starts < ends[-1]]) and starts[-1] > 0:
            yield a, a + int(ends[-1])
            a, size = a + int(starts[-1]), PIECE
        else:
            size *= 2
    yield a, b
