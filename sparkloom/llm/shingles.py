"""Hashed words of whole texts, and the sets of their five-word shingles.

A word is a run of letters and digits (any byte above 127 counts as one), lowered
in ASCII. A text of one to four words has one shingle, all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sparkloom.llm.terms import distinct, text_bytes

WORDS = 5
#: Bytes whose words are hashed at once.
WINDOW = 1 << 20
_LOWER = np.array([ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else i if i > 127 else 0 for i in range(256)], np.uint8)
_PLACES = np.random.default_rng(20).integers(1, 2**63, 4096).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and each text's bounds in them; the bytes are walked in windows that end between words."""
    data, bounds = text_bytes(texts)
    begins = bounds[:-1][np.diff(bounds) > 0]
    hashes, places, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < len(data):
        x, b = _window(data, a)
        inside = x > 0
        first = inside & ~np.concatenate([[False], inside[:-1]])
        own = begins[np.searchsorted(begins, a) : np.searchsorted(begins, b)] - a
        first[own] = inside[own]
        starts = np.flatnonzero(first)
        if len(starts):
            place = np.arange(starts[0], len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
            hashes.append(mixed(np.add.reduceat(x[starts[0] :] * _PLACES[place & 4095], starts - starts[0])))
            places.append(starts + a)
        a = b
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)


def _window(data: np.ndarray, a: int) -> tuple[np.ndarray, int]:
    """The lowered bytes from ``a`` on, about WINDOW of them and whole words (more where a word is longer), and their end."""
    size = WINDOW
    while a + size < len(data):
        x = _LOWER[data[a : a + size]]
        blank = np.flatnonzero(x[-4096:] == 0)
        if not len(blank):
            blank = np.flatnonzero(x == 0) - max(0, len(x) - 4096)
        if len(blank):
            end = max(0, len(x) - 4096) + int(blank[-1]) + 1
            return x[:end], a + end
        size *= 2
    return _LOWER[data[a:]], len(data)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its words' hashes and the sorted set of its shingles' hashes."""
    words, bounds = hashed_words(texts)
    runs = words.copy()
    for i in range(1, WORDS):
        runs = runs[: len(words) - i] * _FOLD + words[i:] if len(words) > i else runs[:0]
    runs = mixed(runs)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = words[a:b]
        if b - a >= WORDS:
            yield own, distinct(runs[a : b - WORDS + 1])
        elif b > a:
            short = own[:1]
            for w in own[1:]:
                short = short * _FOLD + w
            yield own, mixed(short ^ np.uint64(b - a))
        else:
            yield own, np.zeros(0, np.uint64)


def class_key(words: np.ndarray, text: str | None) -> bytes:
    """Equal for texts of the same words; texts without words are equal as they are."""
    return hashlib.blake2b(words.tobytes() if len(words) else b"text" + (text or "").encode(), digest_size=16).digest()
