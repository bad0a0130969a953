"""Sentences of raw text, with their places, by one pass over each text.

A sentence ends at a blank line, or at white space behind a closing sign (with any
quotes and brackets that close there) where what follows can begin one: a capital, a
digit, or an opening quote or bracket before either. It does not end behind an
abbreviation, an initial, or a number with a full stop at the beginning of a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkloom.config import DEFAULTS

# Words whose full stop ends no sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "cf", "al", "inc", "ltd", "corp", "co",
    "fig", "figs", "no", "nos", "vol", "pp", "p", "ed", "eds", "dept", "est", "approx", "jan", "feb", "mar", "apr",
    "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "gen", "col", "sgt", "capt", "lt", "rev", "hon", "u.s", "u.k",
)
_OPENING, _CLOSING = "\"'“‘«([{", "\"'”’»)]}"
_BREAK = regex.compile(rf"(?P<blank>\n[^\S\n]*\n\s*)|(?P<sign>[.!?…。！？]+)[{regex.escape(_CLOSING)}]*(?P<gap>\s+)(?=[{regex.escape(_OPENING)}]*[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{Nd}}])|(?<=[。！？])(?P<none>)(?=[^\s{regex.escape(_CLOSING)}。！？])")
_LAST = regex.compile(r"[^\s(\[{\"'“‘«]+$")
#: Characters before a full stop that are looked at for an abbreviation.
_SEEN = 24


def _goes_on(text: str, match: regex.Match) -> bool:
    """Whether the sentence goes on behind a match's full stop."""
    if match["sign"] != ".":
        return False
    at = match.start("sign")
    word = _LAST.search(text[max(0, at - _SEEN) : at])
    if not word:
        return False
    last = word[0]
    if last.lower() in ABBREVIATIONS or len(last) == 1 and last.isalpha() and last.isupper():
        return True
    # a number that counts a line
    return last.isdecimal() and (at - len(last) == 0 or text[at - len(last) - 1] == "\n")


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence, without white space around."""
    begin = 0
    for match in _BREAK.finditer(text):
        if match["blank"] is None and match["none"] is None and _goes_on(text, match):
            continue
        end = match.start("blank") if match["blank"] is not None else match.start("gap") if match["gap"] is not None else match.start()
        yield from _stripped(text, begin, end)
        begin = match.end()
    yield from _stripped(text, begin, len(text))


def _stripped(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    own = text[begin:end]
    if bare := own.strip():
        start = begin + len(own) - len(own.lstrip())
        yield start, start + len(bare)


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = DEFAULTS.sentence_chars) -> DataFrame:
    """key, sent_id (numbered from 0 over all sentences of a text), sentence, start, end of the sentences of at most ``most`` characters, which longer ones, mostly tables, are not. A null text has none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, parts, starts, ends = [], [], [], [], []
            for i, own in enumerate(batch.column(text).to_pylist()):
                for n, (a, b) in enumerate(spans(own or "")):
                    if most is None or b - a <= most:
                        rows.append(i)
                        numbers.append(n)
                        parts.append(own[a:b])
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(parts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "sent_id", "sentence", "start", "end"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, sent_id int, sentence string, start int, end int")
