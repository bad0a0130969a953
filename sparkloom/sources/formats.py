"""File formats to text. Column functions where Spark has them; parsers as Arrow-batched pandas UDFs, a file a row.

``extracted`` reads Spark's binaryFile rows (path, content) by suffix. A file that
can't be read, or has a suffix without a reader, comes out with its reason.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkloom.config import DEFAULTS, Config

# Encodings in order; elements without article content; the page id that an export's file names end with.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DROPPED = ("script", "style", "noscript", "template", "svg", "nav", "footer", "form")
EXPORT_ID = r"[ _-]+[0-9a-f]{32}$"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Markdown's marks, in order, and what is left of them.
MARKDOWN = (
    (r"(?m)^```.*$", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?m)^\s*[-*_]{3,}\s*$", ""),
    (r"(?m)^\s{0,3}>\s?", ""),
    (r"(?s)(\*\*|__)(.+?)\1", "$2"),
    (r"(?<![\p{L}\p{N}_])([*_])(?!\s)(.+?)(?<!\s)\1(?![\p{L}\p{N}_])", "$2"),
    (r"`{1,3}([^`]+)`{1,3}", "$1"),
)


class Unreadable(ValueError):
    """A file that its reader can't read."""


def decoded(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes every byte")


def markdown_text(text: Column) -> Column:
    for pattern, left in MARKDOWN:
        text = F.regexp_replace(text, pattern, left)
    return text


def markdown(text: str) -> str:
    import regex

    for pattern, left in MARKDOWN:
        text = regex.sub(pattern, left.replace("$", "\\"), text)
    return text


class _Page(HTMLParser):
    """Strings of a page outside dropped elements; headings, items and rows of cells become one string each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, list[str]]] = []  # elements that gather their strings
        self.dropped: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            self.dropped += [tag] * (tag == self.dropped[0])
        elif tag in DROPPED:
            self.dropped = [tag]
        elif re.fullmatch("h[1-6]|li|tr|td|th", tag):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped[0]:
                self.dropped.pop()
            return
        if any(t == tag for t, _ in self.open):
            while self.close_last() != tag:
                pass

    def close_last(self) -> str:
        tag, parts = self.open.pop()
        text = (" | " if tag == "tr" else " ").join(parts)
        if tag.startswith("h") and tag[1:].isdigit():
            text = f"{'#' * int(tag[1])} {text}"
        elif tag == "li":
            text = f"- {text}"
        if text:
            self.add(text)
        return tag

    def add(self, text: str) -> None:
        (self.open[-1][1] if self.open else self.out).append(text)

    def handle_data(self, data):
        if not self.dropped and data.strip():
            self.add(data.strip())


def page_text(html: str | None) -> str:
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.open:
        page.close_last()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(page.out))


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Readable text of a page, with Markdown's marks for headings and items."""
    return html.map(page_text)


def table_lines(raw: str, delimiter: str | None = None) -> str:
    """``name: value | ...`` a row, without empty values; rows as they are where the header has an empty name or nothing follows."""
    if delimiter is None:
        try:
            delimiter = csv.Sniffer().sniff(raw[:4096], delimiters=",;\t|").delimiter
        except csv.Error:
            delimiter = ","
    try:
        rows = list(csv.reader(io.StringIO(raw), delimiter=delimiter))
    except csv.Error as e:
        raise Unreadable(str(e)) from e
    if not rows:
        return ""
    names, body = [c.strip() for c in rows[0]], rows[1:]
    if all(names) and body:
        lines = (" | ".join(f"{n}: {v.strip()}" for n, v in zip(names, row, strict=False) if v.strip()) for row in body)
    else:
        lines = (" | ".join(c.strip() for c in row) for row in rows)
    return "\n".join(line for line in lines if line)


def flat_row(*columns: str) -> Column:
    """The same for a row of a table that Spark reads: ``column: value | ...``."""
    values = [F.trim(F.col(c).cast("string")) for c in columns]
    return F.concat_ws(" | ", *[F.when(v != "", F.concat(F.lit(f"{c}: "), v)) for c, v in zip(columns, values, strict=True)])


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs, headings marked, then all tables as rows of cells."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Unreadable(f"not a word-processing document: {e}") from e
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    blocks = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = "" if style is None else style.get(f"{_W}val", "")
        level = re.fullmatch(r"Heading ?(\d+)", name)
        mark = "#" * min(int(level[1]), 6) + " " if level else "# " if name == "Title" else ""
        if text := said(p):
            blocks.append(mark + text)
    for table in body.findall(f"{_W}tbl"):
        rows = (" | ".join(said(c) for c in r.findall(f"{_W}tc")) for r in table.findall(f"{_W}tr"))
        blocks.append("\n".join(r for r in rows if r.strip(" |")))
    return "\n\n".join(b for b in blocks if b)


def archive_text(content: bytes, config: Config = DEFAULTS) -> tuple[str, int, str | None]:
    """The readable members of an archive, in order of name and each under a heading, their number, and what was left out."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable(f"not an archive: {e}") from e
    left, blocks, taken, over = config.archive_bytes, [], 0, 0
    for info in sorted(archive.infolist(), key=lambda i: i.filename):
        parts = info.filename.split("/")
        suffix = suffix_of(info.filename)
        if info.is_dir() or parts[0] == "__MACOSX" or any(p.startswith(".") for p in parts) or suffix == ".zip" or suffix not in READERS:
            continue
        left -= info.file_size
        if left < 0:
            raise Unreadable(f"more than {config.archive_bytes} bytes unpacked")
        taken += 1
        if taken > config.archive_members:
            over += 1
            continue
        try:
            text = READERS[suffix](archive.read(info))[0].strip()
        except (Unreadable, OSError, zipfile.BadZipFile, RuntimeError):
            continue  # one bad member doesn't cost the rest
        if text:
            stem = parts[-1].rsplit(".", 1)[0]
            name = re.sub(EXPORT_ID, "", stem).replace("_", " ").strip() or stem
            blocks.append(text if text.startswith("#") else f"# {name}\n\n{text}")
    if not blocks:
        raise Unreadable("no readable member")
    return "\n\n".join(blocks), len(blocks), f"{over} members beyond {config.archive_members} left out" if over else None


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""


#: Suffix to reader: bytes to text, number of pages and, if something was left out, a remark. A later entry for a suffix replaces the earlier.
READERS: dict[str, Callable[[bytes], tuple]] = {}


def register(suffixes: tuple[str, ...], reader: Callable[[bytes], tuple]) -> None:
    READERS.update(dict.fromkeys(suffixes, reader))


def _pdf(content: bytes) -> tuple[str, int]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise Unreadable("no PDF library is installed") from e
    pages = PdfReader(io.BytesIO(content)).pages
    return "\n".join(t for p in pages if (t := (p.extract_text() or "").strip())), len(pages)


register((".txt", ".text", ".log", ".rst"), lambda b: (decoded(b), 1))
register((".md", ".markdown", ".mdx"), lambda b: (markdown(decoded(b)), 1))
register((".html", ".htm", ".xhtml"), lambda b: (page_text(decoded(b)), 1))
register((".csv",), lambda b: (table_lines(decoded(b)), 1))
register((".tsv",), lambda b: (table_lines(decoded(b), "\t"), 1))
register((".docx",), lambda b: (docx_text(b), 1))
register((".pdf",), _pdf)
register((".zip",), archive_text)


def supported() -> list[str]:
    return sorted(READERS)


def extracted(files: DataFrame) -> DataFrame:
    """path, modificationTime, length, file_type, text, page_count, error of binaryFile rows; a file without text has the reason in error, one that was read in part what is missing. Spark's source lists no file of no bytes."""

    def read(path: str, content: bytes) -> tuple:
        suffix = suffix_of(path)
        if suffix not in READERS:
            return suffix, None, None, f"unsupported; supported are {', '.join(supported())}"
        try:
            return suffix, *(*READERS[suffix](content), None)[:3]
        except Unreadable as e:
            return suffix, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([read(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["file_type", "text", "page_count", "error"], index=batch.index)
            yield pd.concat([batch[["path", "modificationTime", "length"]], rows.astype({"page_count": "Int32"})], axis=1)

    schema = "path string, modificationTime timestamp, length long, file_type string, text string, page_count int, error string"
    return files.select("path", "modificationTime", "length", "content").mapInPandas(run, schema)


# Where a text is cut, from the coarsest on.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs (which stays with what follows), merged with ``overlap``."""
    at = next(i for i, s in enumerate(separators) if s in text)
    mark, finer = separators[at], separators[at + 1 :]
    cut = [p for p in (re.split(f"(?={re.escape(mark)})", text) if mark else list(text)) if p]
    out: list[str] = []
    small: list[str] = []

    def merge() -> None:
        held: list[str] = []
        for piece in small:
            if held and sum(map(len, held)) + len(piece) > size:
                out.append("".join(held).strip())
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                    held.pop(0)
            held.append(piece)
        if held:
            out.append("".join(held).strip())
        small.clear()

    for piece in cut:
        if len(piece) <= size:
            small.append(piece)
        else:
            merge()
            out += split_recursively(piece, size, overlap, finer) if finer else [piece]
    merge()
    return [p for p in out if p]


def recursive_chunks(docs: DataFrame, key: str, column: str, config: Config = DEFAULTS) -> DataFrame:
    """key, chunk_id, text, start, end: each piece where it is found from the one before on."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[column], strict=True):
                at = 0
                for i, piece in enumerate(split_recursively(text, config.chunk_size, config.chunk_overlap)):
                    found = text.find(piece, at)
                    at = found if found >= 0 else max(text.find(piece), 0)
                    rows.append((k, i, piece, at, at + len(piece)))
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "text", "start", "end"])

    return docs.select(key, column).mapInPandas(run, f"{key} {kind}, chunk_id int, text string, start int, end int")
