"""Operator 7: hierarchical packing of documents into sequences of several lengths.

Every partition is packed as it streams by, with no shuffle: whole windows of the
longest tier first, then each document's rest is routed to the shortest tier that
holds it. A rest in the longest tier leaves a gap, which pieces of the shorter
tiers fill; what the shorter tiers hold beyond a reserve for such gaps becomes
full sequences of their own length. Sequences of one tier form step groups of
equal token counts. A partition's last tokens are cut into sequences whose lengths
are powers of two, so none needs padding.

Defined cases: a null or empty text is one end token; repeated doc_ids are packed
as separate documents; a null doc_id stays null; an empty table gives no rows;
further columns are ignored. A task keeps a bounded number of tokens: one slice of
texts (see ``slices``), ``waiting`` long windows and ``reserve`` sequences a tier.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkloom.llm.tokenize import encoder, slices

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group: so many sequences of one tier make one training step.
STEP_TOKENS = 16_384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: doc_id, start in the document, ids, the document's tokens
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Turns documents into full sequences: lists of pieces, with the sequence's tier."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, waiting: int = 64, reserve: int = 4):
        self.tiers, self.longest, self.waiting, self.reserve = tiers, tiers[-1], waiting, reserve
        self.short: dict[int, deque[Piece]] = {t: deque() for t in tiers[:-1]}
        self.held = dict.fromkeys(tiers[:-1], 0)
        self.long: deque[Piece] = deque()

    def _route(self, piece: Piece) -> None:
        size = len(piece[2])
        tier = next(t for t in self.tiers if size <= t)
        if tier == self.longest:
            self.long.append(piece)
        else:
            self.short[tier].append(piece)
            self.held[tier] += size

    def _take(self, tier: int, most: int) -> list[Piece]:
        """At most so many tokens of a shorter tier's queue, its last piece cut to fit."""
        out, queue = [], self.short[tier]
        while most and queue:
            doc, start, ids, total = queue.popleft()
            if len(ids) > most:
                queue.appendleft((doc, start + most, ids[most:], total))
                ids = ids[:most]
            out.append((doc, start, ids, total))
            most -= len(ids)
            self.held[tier] -= len(ids)
        return out

    def _fill(self, piece: Piece) -> tuple[list[Piece], int] | None:
        """The long window of a piece with its gap filled from the shorter tiers, the longest first."""
        gap = self.longest - len(piece[2])
        if sum(self.held.values()) < gap:
            return None
        window = [piece]
        for tier in reversed(self.tiers[:-1]):
            took = self._take(tier, gap)
            gap -= sum(len(p[2]) for p in took)
            window += took
        return window, self.longest

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple[list[Piece], int]]:
        size, whole = len(ids), len(ids) - len(ids) % self.longest
        for start in range(0, whole, self.longest):
            yield [(doc, start, ids[start : start + self.longest], size)], self.longest
        if whole < size:
            self._route((doc, whole, ids[whole:].copy(), size))
        while self.long and (window := self._fill(self.long[0])):
            self.long.popleft()
            yield window
        if len(self.long) > self.waiting:  # nothing short to fill it: cut at the next tier, and the rest is short
            doc, start, rest, size = self.long.popleft()
            at = self.tiers[-2]
            yield [(doc, start, rest[:at], size)], at
            self._route((doc, start + at, rest[at:], size))
        for tier in self.tiers[:-1]:
            while self.held[tier] >= tier * self.reserve:
                yield self._take(tier, tier), tier

    def finish(self) -> Iterator[tuple[list[Piece], int]]:
        """What is left, in sequences of falling powers of two."""
        rest = [*self.long, *(p for t in reversed(self.tiers[:-1]) for p in self.short[t])]
        self.long.clear()
        first = self.tiers[-2]
        self.short, self.held = {first: deque(rest)}, {first: sum(len(p[2]) for p in rest)}
        while left := self.held[first]:
            size = min(self.longest, 1 << (left.bit_length() - 1))
            yield self._take(first, size), size


def pack(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence; with ``keep_ids`` also its ids.

    ``sequence_id`` and ``step_group`` hold the partition's number above bit 33.
    """
    schema = SCHEMA + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = encoder(tokenizer).encode, Packer(tiers), TaskContext.get().partitionId() << 33
        sequences, by_tier, rows, kept = 0, {}, [], []

        def place(filled: Iterator[tuple[list[Piece], int]]) -> None:
            nonlocal sequences
            for pieces, tier in filled:
                n = by_tier[tier] = by_tier.get(tier, -1) + 1
                step = base | n // max(1, step_tokens // tier) << 5 | tier.bit_length()
                offset = 0
                for doc, start, ids, total in pieces:
                    rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, base + sequences, offset, tier, step))
                    if keep_ids:
                        kept.append(ids.astype(np.int32))
                    offset += len(ids)
                sequences += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
            arrays = [pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(columns)]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            rows.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = encode(part.column("text"))
                ids = np.insert(ids, starts[1:], end_id)
                starts = starts + np.arange(len(starts))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    place(packer.add(doc, ids[a:b]))
                yield out()
        place(packer.finish())
        yield out()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
