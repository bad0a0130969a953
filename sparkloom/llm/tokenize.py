"""Token ids of whole texts by the ``tokenizers`` library, with a memory of words.

Some tokenizers drop white space and never join characters across it, so the ids
of a text are the ids of its white-space-separated words, one after the other, and
of the pieces that a known pattern cuts words into. For those a task asks the
library once for each different piece. Any other tokenizer,
and any text with ``NOT_PLAIN`` characters, for which Python's white space,
lower case or character classes might differ from the library's, goes to the
library whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from sparkloom.llm.terms import text_bytes

#: Texts without these are split at white space here: all but ASCII without the separators 1C-1F, and Latin letters
#: that are their own composed form and lower one to one. "<|" starts special tokens.
NOT_PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}]|<\|"
#: Different words that a Python worker remembers at most; then it starts afresh.
WORDS_KEPT = 1_000_000

#: The pattern of pieces (a fixed value of some public tokenizers) for which it is known where a word may be cut: between
#: letters and ASCII signs but the apostrophe, and beside a digit. With any other one, words stay whole until they are learnt.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of text whose pieces are in memory at once.
WINDOW = 1 << 24

_ENCODERS: dict[str, Encoder] = {}

_BLANK, _LETTER, _SIGN, _DIGIT, _WHOLE = range(5)
#: What each byte of a plain, lowered text is; a word with a byte that keeps it whole is not cut.
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[0x80:] = _LETTER  # C3 to C9 begin Latin letters, but for two signs
_KIND[[0x27, 0xC2, 0xE2]] = _WHOLE


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = word_pattern(path)
        self.words: dict[str, bytes] = {}
        if self.pattern:
            self.merger = Tokenizer.from_file(path)  # the merges alone, for pieces that are normalised and split
            self.merger.normalizer = normalizers.Sequence([])
            self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _learn(self, words: list[str]) -> None:
        """Adds the words' ids to the memory, by way of the pieces that they consist of; a piece is a word too."""
        split = {word: self.pattern.findall(word) for word in words if not word.isalpha()}
        new = set().union(*split.values()).difference(self.words)
        new = list(new.union(word for word in words if word not in split))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            (found,) = self.merger.encode_batch([" ".join(part)], add_special_tokens=False)
            data = np.array(found.ids, "<u4").tobytes()
            bounds = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(part) + 1))).tolist()
            self.words.update((word, data[a:b]) for word, a, b in zip(part, bounds[:-1], bounds[1:], strict=True))
        get = self.words.__getitem__
        self.words.update([(word, b"".join(map(get, pieces))) for word, pieces in split.items()])

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and each text's first position in them, then their number; a null text is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = np.zeros(len(texts), bool)
        if self.pattern:
            plain = ~pc.match_substring_regex(texts, NOT_PLAIN).to_numpy(zero_copy_only=False)
        words, counts = self._plain(texts.filter(pa.array(plain)))
        odd = [np.frombuffer(ids, "<u4") for ids in _ids(self.tokenizer, texts.filter(pa.array(~plain)).to_pylist())]
        lengths = np.zeros(len(texts), np.int64)
        lengths[plain], lengths[~plain] = counts, [len(ids) for ids in odd]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        if odd:
            every = np.empty(starts[-1], np.uint32)
            of_plain = np.repeat(plain, lengths)
            every[of_plain], every[~of_plain] = words, np.concatenate(odd)
            words = every
        return words, starts

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; the texts' bytes are walked in windows that end at white space."""
        data, bounds = text_bytes(pc.utf8_lower(texts))
        every, before, done, begin = [np.zeros(0, np.uint32)], np.zeros(len(bounds), np.int64), 0, 0
        while begin < len(data):
            end = _window_end(data, begin)
            first, last = np.searchsorted(bounds, [begin, end], side="right")
            values, starts, own = cut(data[begin:end], bounds[first:last] - begin, self.pattern.pattern == CUT_PATTERN)
            ids, ends = self._known(values, starts)
            before[first:last] = done + ends[own]
            every.append(ids)
            done, begin = done + len(ids), end
        return np.concatenate(every), np.diff(before)

    def _known(self, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that begin at ``starts`` in the bytes ``values``, and how many ids come before each piece and in all."""
        offsets = np.append(starts, len(values)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        ids = list(map(self.words.get, different))
        if None in ids:
            self._learn([word for word, known in zip(different, ids, strict=True) if known is None])
            ids = list(map(self.words.__getitem__, different))
        pool = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        firsts = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        at = np.repeat(firsts.astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return pool[at], ends


def _window_end(data: np.ndarray, begin: int) -> int:
    """The end of a window of whole words: about WINDOW bytes, or more where one word is longer."""
    size = WINDOW
    while (end := begin + size) < len(data):
        blank = np.flatnonzero(_KIND[data[max(begin, end - 4096) : end]] == _BLANK)
        if not len(blank):
            blank = np.flatnonzero(_KIND[data[begin:end]] == _BLANK) - max(0, size - 4096)
        if len(blank):
            return max(begin, end - 4096) + int(blank[-1]) + 1
        size *= 2
    return len(data)


def cut(data: np.ndarray, bounds: np.ndarray, inside_words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without white space, where each piece begins in them, and how many pieces begin before each bound."""
    kind = _KIND[data]
    kept = kind > 0
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    begins = bounds[bounds < len(data)]
    first[begins] |= kept[begins]
    if inside_words:
        # a change of kind, or a digit after a digit
        change = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        change &= kept[1:] & ~first[1:]
        whole = kind == _WHOLE
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < len(data)]
        whole[lead[np.isin(data[lead + 1], [0x97, 0xB7])]] = True
        cuts = np.flatnonzero(change) + 1
        if whole.any():
            words = np.flatnonzero(first)
            uncut = np.zeros(len(words) + 1, bool)
            uncut[np.searchsorted(words, np.flatnonzero(whole), side="right")] = True
            cuts = cuts[~uncut[np.searchsorted(words, cuts, side="right")]]
        first[cuts] = True
    own = np.searchsorted(np.flatnonzero(first), bounds)
    return data[kept], np.flatnonzero(first[kept]), own


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 23):
    """Parts of a batch with about ``most`` bytes of text each (a single row may have more)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _ids(tokenizer, texts: list[str]) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def word_pattern(path: str) -> regex.Pattern | None:
    """The pattern of a tokenizer's pieces if it lowers, drops white space and keeps the matches of one pattern without white space."""
    with open(path, encoding="utf-8") as f:
        head = json.load(f)
    head.pop("model")
    steps = [n.get("type") for n in (head["normalizer"] or {}).get("normalizers", [])]
    splits = (head["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in splits] != ["Split", "ByteLevel"]:
        return None
    split, level = splits
    if not split["invert"] or split["behavior"] != "Removed" or level["use_regex"] or level["add_prefix_space"]:
        return None
    pattern = regex.compile(split["pattern"]["Regex"])
    return None if pattern.search(" ") or pattern.findall("a b") != ["a", "b"] else pattern


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; found anew on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
