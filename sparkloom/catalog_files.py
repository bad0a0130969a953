"""Queries over stated files and replies: every reader, file names and facts, and what is made of models' replies.

The files are written into the shared folder and read by Spark's binaryFile source;
what must come out stands beside them and becomes the SQL.
"""

from __future__ import annotations

import io
import re
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import ports
from sparkloom.catalog import query, stated, table
from sparkloom.operators import documents as D
from sparkloom.operators import questions as Q
from sparkloom.sources import formats, web
from sparkloom.storage import new_folder


def archive(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _docx() -> bytes:
    def cell(text: str) -> str:
        return f"<w:tc><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"

    def paragraph(text: str, style: str = "") -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"

    body = paragraph("Handbook", "Title") + paragraph("Leave", "Heading2") + f"<w:tbl><w:tr>{cell('x')}{cell('y')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + paragraph("Twenty days.") + paragraph(" ")
    return archive([("word/document.xml", f'<w:document xmlns:w="{formats._W[1:-1]}"><w:body>{body}</w:body></w:document>'.encode())])


_PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav>no</nav><h1>Head <b>ing</b></h1><p>Text &amp; more</p><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><script>x</script><footer>no</footer></body></html>"
#: name: content, the text that it must give (or none) and the number of its parts.
FILES: dict[str, tuple[bytes, str | None, int | None]] = {
    "page.html": (_PAGE.encode(), "T\n# Head ing\nText & more\n- one\n- two\na | b\n1 | 2", 1),
    "people.csv": (b"Name;Role\nAda;Engineer\nBo;\n\n", "Name: Ada | Role: Engineer\nName: Bo", 1),
    "commas.csv": (b'Name,Note\nAda,"a, b"\n', "Name: Ada | Note: a, b", 1),
    "bare.csv": (b"Name,\nAda,1\n", "Name | \nAda | 1", 1),
    "table.tsv": (b"a\tb\n1\t2", "a: 1 | b: 2", 1),
    "notes.md": (b"# T\n**bold** [l](u) ![i](u) `c`\n> q", "# T\nbold l i c\nq", 1),
    "utf8.txt": ("naïve “text”".encode(), "naïve “text”", 1),
    "marked.txt": ("﻿after a mark".encode("utf-8"), "after a mark", 1),
    "cp1252.log": ("café €".encode("cp1252"), "café €", 1),
    "latin.rst": (b"caf\xe9 \x81", "caf\xe9 \x81", 1),
    "handbook.docx": (_docx(), "# Handbook\n\n## Leave\n\nTwenty days.\n\nx | y\n1 | 2", 1),
    "export.zip": (
        archive([("Page_one 0123456789abcdef0123456789abcdef.md", b"hello"), ("__MACOSX/x.md", b"no"), ("in/t.csv", b"n,v\n1,2"), ("p.png", b"x"), (".hid/x.txt", b"no"), ("in/bad.docx", b"no"), ("in/more.zip", b"no"), ("in/z.md", b"# Own\nhead")]),
        "# Page one\n\nhello\n\n# t\n\nn: 1 | v: 2\n\n# Own\nhead", 3,
    ),
    "bad.zip": (b"no archive", None, None),
    "bad.docx": (b"no document", None, None),
    "picture.xyz": (b"?", None, None),
    "nothing.zip": (archive([("p.png", b"x")]), None, None),
}


def stated_files(spark: SparkSession) -> DataFrame:
    folder = new_folder(spark, "files")
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    for name, (content, _, _) in FILES.items():
        with filesystem.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(content)
    return formats.extracted(spark.read.format("binaryFile").load(folder))


def _sql_text(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS VARCHAR)"
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def _sql_values(rows: list[str], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS v({names})"


@query(_sql_values([f"'{name}', '{formats.suffix_of(name)}', {_sql_text(text)}, CAST({'NULL' if n is None else n} AS INTEGER), {'true' if text is None else 'false'}" for name, (_, text, n) in FILES.items()], "filename, file_type, text, page_count, failed"))
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader on a file of its kind, and files that can't be read."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return stated_files(spark).select(name.alias("filename"), "file_type", "text", "page_count", F.col("error").isNotNull().alias("failed"))


def _facts() -> list[str]:
    rows = []
    for name, (content, text, n) in FILES.items():
        plain = re.sub(r"[ \t]+\n", "\n", text or "").strip()  # as cleaned
        if plain:
            rows.append(f"'{name}', '{name.rsplit('.', 1)[1]}', CAST({len(content)} AS BIGINT), {n}, CAST({len(plain)} AS INTEGER), {len(plain.split())}")
    return rows


@query(_sql_values(_facts(), "filename, file_type, file_size, pages, char_count, word_count"))
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.file_metadata(stated_files(spark)).select("filename", "file_type", "file_size", "pages", "char_count", "word_count")


@query("SELECT unnest(['.csv', '.docx', '.htm', '.html', '.log', '.markdown', '.md', '.mdx', '.pdf', '.rst', '.text', '.tsv', '.txt', '.xhtml', '.zip']) AS suffix")
def supported_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in formats.supported()], "suffix string")


@query("SELECT page_id, 'my_page_' || page_id || '-' || substr(sha1(html), 1, 8) || '.html' AS name FROM pages")
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads under names with blanks, signs and folders."""
    name = F.concat(F.lit("../up loads\\my (page)&"), "page_id", F.lit(".HTML"))
    name = F.regexp_replace(name, r"\(page\)&", "page ")
    return table(spark, sf_dir, "pages").select("page_id", web.upload_name(name, F.col("html")).alias("name"))


#: Models' replies to the stated questions 1 to 6.
REPLIES = (
    (1, '{"answer": "Yes.", "key_points": ["a", "b", "c", "d", "e", "f"], "related_questions": ["p", "q", "r", "s", "t"]}'),
    (2, "plain words"),
    (3, '{"key_points": ["x"]}'),
    (4, " "),
    (5, None),
)
_EMPTY = "CAST([] AS VARCHAR[])"


@query(
    "SELECT query_id, answer, array_to_string(points, '|') AS points, array_to_string(related, '|') AS related, generator FROM (VALUES (1, 'Yes.', ['a','b','c','d','e'], ['p','q','r','s'], 'model'), "
    f"(2, 'plain words', {_EMPTY}, {_EMPTY}, 'model'), (3, '{REPLIES[2][1]}', ['x'], {_EMPTY}, 'model'), " + ", ".join(f"({i}, '{Q.NO_CONTEXT}', {_EMPTY}, {_EMPTY}, 'extractive')" for i in (4, 5, 6)) + ") AS v(query_id, answer, points, related, generator)"
)
def answers_from_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as answers; queries without a usable one get the extractive answer, here of nothing found."""
    replies = spark.createDataFrame(list(REPLIES), "query_id long, reply string")
    nothing = spark.createDataFrame([], "query_id long, citation_id int, text string")
    rows = ports.resilient_answers(replies, Q.extractive_answers(stated(spark), nothing))
    return rows.select("query_id", "answer", F.array_join("key_points", "|").alias("points"), F.array_join("related_questions", "|").alias("related"), "generator")


_VARIANT = '{{"query": "{q}", "strategy": "{s}", "confidence": {c}}}'
_GOOD = ", ".join(_VARIANT.format(q=q, s=s, c=c) for q, s, c in (("one", "expand", 0.9), ("two", "specify", 0.8), ("three", "expand", 0)))
#: Replies of a rewriter: a good one, too few variants, a confidence beyond 1, no JSON, none.
REWRITES = ((1, f'{{"queries": [{_GOOD}]}}'), (2, f'{{"queries": [{_VARIANT.format(q="x", s="y", c=0.5)}]}}'), (3, f'{{"queries": [{_GOOD.replace("0.9", "1.9")}]}}'), (4, "no"), (5, None))


def _sql_rewrites() -> str:
    good = _sql_values(["1, 0, 'expand', 'one', 0.9", "1, 1, 'specify', 'two', 0.8", "1, 2, 'expand', 'three', 0.0"], "query_id, variant_no, strategy, rewrite, confidence")
    plain = {2: "worthless pathetic moron the moron", 3: "achlichpf und die auch nicht", 4: "leaux que eau pour", 5: "token password secret license", 6: "zzz qqq"}
    rows = []
    for i, core in plain.items():
        for n, (strategy, wording, confidence) in enumerate(Q.VARIANTS):
            said = wording.replace("{subject}", core).replace("{core}", core)
            rows.append(f"{i}, {n}, '{strategy}', '{said}', {confidence}")
    both = f"{good} UNION ALL {_sql_values(rows, 'query_id, variant_no, strategy, rewrite, confidence')}"
    return f"SELECT query_id, CAST(variant_no AS INTEGER) AS variant_no, strategy, rewrite, CAST(confidence AS DOUBLE) AS confidence FROM ({both})"


@query(_sql_rewrites())
def rewrites_from_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's variants where its reply is sound, else the rules'."""
    return ports.parsed_rewrites(spark.createDataFrame(list(REWRITES), "query_id long, reply string"), Q.rewritten(stated(spark)))
