"""Entity resolution within a document: mentions in order join a known name or found one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from sparkloom.config import DEFAULTS


def _places(a: str) -> dict[str, int]:
    """The places of each character, as bits."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def _common(where: dict[str, int], n: int, b: str) -> int:
    row = full = (1 << n) - 1
    for x in b:
        if m := where.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _common(_places(a), len(a), b)


def sorted_ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence of the sorted words by both lengths."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _counts(text: str) -> int:
    """How often the characters of each of 64 kinds occur, up to three times, as bits: names with so many different bits are at least so many insertions and deletions apart."""
    many: dict[int, int] = {}
    for x in text:
        many[ord(x) % 64] = many.get(ord(x) % 64, 0) + 1
    return sum(((1 << min(n, 3)) - 1) << 3 * kind for kind, n in many.items())


class NearNames:
    """Names among which those similar to another are found without comparing all.

    Words are sorted first. If 2 LCS / (m + n) reaches the threshold, at most
    ``apart`` characters go or come between two names of m and n characters. A known
    name is cut into one piece more than that; one of them then stands in the other
    name as it is, moved by ``apart`` places at most. Names are found by such pieces
    and by length.
    """

    def __init__(self, threshold: float):
        self.threshold, self.share = threshold, threshold / 100
        self.pieces: dict[tuple[int, int, str], list[str]] = {}
        self.lengths: set[int] = set()
        self.sorted: dict[str, str] = {}
        self.counts: dict[str, int] = {}
        self.least: dict[str, str] = {}  # of names with the same words

    def _apart(self, m: int, n: int) -> int:
        return int((1 - self.share) * (m + n) + 1e-9)

    def _longest(self, n: int) -> int:
        """The most characters a name similar to one of n can have."""
        return int(n * (2 - self.share) / self.share + 1e-9) if self.share > 0 else 1 << 30

    def _cuts(self, n: int) -> list[int]:
        count = min(n, self._apart(n, self._longest(n)) + 1) or 1
        return [n * i // count for i in range(count + 1)]

    def add(self, name: str) -> None:
        if name in self.sorted:
            return
        text = self.sorted[name] = " ".join(sorted(name.split()))
        self.counts[name] = _counts(text)
        self.least[text] = min(name, self.least.get(text, name))
        self.lengths.add(len(text))
        cuts = self._cuts(len(text))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            self.pieces.setdefault((len(text), i, text[a:b]), []).append(name)

    def near(self, name: str) -> set[str]:
        """All known names that can reach the threshold, and maybe some more."""
        text = " ".join(sorted(name.split()))
        found: set[str] = set()
        for n in self.lengths:
            if min(n, len(text)) * 2 < self.share * (n + len(text)) - 1e-9:
                continue
            moved, cuts = self._apart(n, len(text)), self._cuts(n)
            if moved + 1 > len(cuts) - 1:  # so short that every piece may have changed
                found.update(o for o, t in self.sorted.items() if len(t) == n)
                continue
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for at in range(max(0, a - moved), min(len(text) - (b - a), a + moved) + 1):
                    found.update(self.pieces.get((n, i, text[at : at + b - a]), ()))
        return found

    def best(self, name: str) -> str | None:
        """The known name most similar to another, the least of equal ones, if it reaches the threshold."""
        text = " ".join(sorted(name.split()))
        if text in self.least:
            return self.least[text]
        where, n, top, best, counts = _places(text), len(text), self.threshold, None, _counts(text)
        for other in self.near(name):
            own = self.sorted[other]
            if (counts ^ self.counts[other]).bit_count() > self._apart(n, len(own)):
                continue
            score = 200 * _common(where, n, own) / (n + len(own)) if n or own else 100.0
            if score > top or score == top and (best is None or other < best):
                top, best = score, other
        return best


def resolve_names(names: list[tuple[str, str]], threshold: float) -> list[str]:
    """The key of each (kind, canonical name), in order. A short word joins only as the initials of one known name; ties go to the least name."""
    known: dict[tuple[str, str], str] = {}
    index: dict[str, NearNames] = {}
    initials: dict[tuple[str, str], list[str]] = {}
    out = []
    for kind, name in names:
        if (kind, name) not in known:
            others = index.setdefault(kind, NearNames(threshold))
            if len(name) <= 5 and " " not in name:
                fit = initials.get((kind, name), [])
                best = fit[0] if len(fit) == 1 else None
            else:
                best = others.best(name)
            known[kind, name] = best or name
            if not best and name not in others.sorted:
                others.add(name)
                initials.setdefault((kind, "".join(w[0] for w in name.split())), []).append(name)
        out.append(known[kind, name])
    return out


def resolved(mentions: DataFrame, threshold: float = DEFAULTS.merge_threshold) -> DataFrame:
    """document_id, seq, kind, canonical, resolved: the order within a document decides, so a document is one group."""

    def of_document(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "kind", "canonical"])
        return rows.assign(resolved=resolve_names(list(zip(rows["kind"], rows["canonical"], strict=True)), threshold))

    # by number, as few bytes of names may be much work
    tasks = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = mentions.select("document_id", "seq", "kind", "canonical").repartition(tasks, "document_id")
    return own.groupBy("document_id").applyInPandas(of_document, "document_id string, seq int, kind string, canonical string, resolved string")
