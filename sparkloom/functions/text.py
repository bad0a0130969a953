"""Column functions on text: cleaning, sections, windows, terms, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOPWORDS = (
    "a", "about", "am", "an", "and", "are", "as", "at",
    "be", "by", "can", "come", "for", "from", "how",
    "i", "in", "is", "it", "me", "my", "of", "on", "or",
    "our", "the", "to", "we", "what", "when", "where",
    "which", "who", "why", "with",
)
# What an organisation's name may end with, and what any name may begin with.
ORG_SUFFIXES = (
    "corporation", "corp", "incorporated", "inc", "limited", "ltd", "llc",
    "llp", "plc", "gmbh", "ag", "sa", "nv", "bv", "co", "company", "holdings",
    "group", "technologies", "technology", "labs", "laboratories",
)
LEADING_NOISE = ("the", "a", "an", "mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "madam")
# A line that begins a section, and a capitalised phrase.
BOUNDARY = r"\d+\.\s+[A-Z]|[A-Z][A-Z\s]{3,}|#+\s+"
PROPER_PHRASE = r"\b[A-Z][A-Za-z0-9&.-]*(?:\s+[A-Z][A-Za-z0-9&.-]*)*\b"
#: Letters, digits and underscore of any script; Java's \w knows ASCII only.
WORD = r"[\p{L}\p{N}_]+"
_SPACE = r"(?U)\s"
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A character that cleaning leaves in any text.
VISIBLE = r"(?U)[^\s\x{200b}-\x{200f}\x{feff}]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def clean(text: Column) -> Column:
    """Line ends, invisible characters, tabs, runs of blanks and blank lines put in order."""
    # What is replaced, in this order. A text is looked through for the signs first, byte by byte,
    # since most texts have few of them; ``[ \t]+\n`` is a blank and a line end once tabs and runs of blanks are gone.
    literal = (("\r\n", "\n"), ("\r", "\n"), *((c, "") for c in "\u200b\u200c\u200d\u200e\u200f\ufeff"), ("\t", " "))
    out = F.coalesce(text, F.lit(""))
    for sign, replacement in literal:
        out = _where_found(out, sign, lambda x, sign=sign, new=replacement: F.replace(x, F.lit(sign), F.lit(new)))
    out = _where_found(out, "  ", lambda x: F.regexp_replace(x, r" {2,}", " "))
    out = _where_found(out, " \n", lambda x: F.replace(x, F.lit(" \n"), F.lit("\n")))
    out = _where_found(out, "\n\n\n", lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))
    return strip(out)


def _where_found(text: Column, sign: str, change: Callable[[Column], Column]) -> Column:
    """The text, changed where it has the sign."""
    return let(text, lambda x: F.when(F.contains(x, F.lit(sign)), change(x)).otherwise(x))


def words(text: Column) -> Column:
    """All words, lowered, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """Search terms with repeats: words of two letters or more that are no stop words."""
    return F.filter(words(text), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))


def term_set(text: Column) -> Column:
    return F.array_distinct(terms(text))


def condensed(text: Column, most: int) -> Column:
    """White space runs as single blanks, then at most so many characters."""
    return F.substring(F.regexp_replace(strip(text), rf"{_SPACE}+", " "), 1, most)


def title(content: Column, section_id: Column) -> Column:
    """A section's first line, at most 100 characters; else its number."""
    line = F.substring(strip(F.split(content, "\n")[0]), 1, 100)
    return F.when(F.length(line) > 0, line).otherwise(F.concat(F.lit("Section "), section_id.cast("string")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, though lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def sections(text: Column) -> Column:
    """Array of section_id, title, content, start: a cleaned text cut before numbered, capital and marked headings."""

    def cut(parts: Column) -> Column:
        placed = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 1).alias("at")))
        return F.transform(placed, lambda s: F.struct(strip(s["p"]).alias("content"), (s["at"] + F.length(s["p"]) - F.length(F.regexp_replace(s["p"], rf"^{_SPACE}+", ""))).alias("start")))

    kept = F.filter(let(F.split(text, rf"\n(?={BOUNDARY})", -1), cut), lambda s: F.length(s["content"]) > 0)
    return F.transform(kept, lambda s, i: F.struct(i.alias("section_id"), title(s["content"], i).alias("title"), s["content"].alias("content"), s["start"].alias("start")))


def windows(content: Column, start: Column, size: int, overlap: int) -> Column:
    """Array of text, start, end: windows of ``size`` characters every ``size - overlap``, stripped, without blank ones."""

    step = size - overlap

    def raw(c: Column) -> Column:
        if overlap > step:  # a window reaches over more than its neighbour
            begins = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
            return F.transform(begins, lambda i: F.struct(i.alias("i"), F.substring(c, i + 1, F.lit(size)).alias("raw")))
        # cut once, since looking for a place walks a text from its start; a window is a piece and the beginning of the next
        pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        return let(pieces, lambda p: F.transform(p, lambda x, n: F.struct((n * step).alias("i"), F.concat(x, F.coalesce(F.substring(F.get(p, n + 1), 1, overlap), F.lit(""))).alias("raw"))))

    def cut(c: Column) -> Column:
        return F.transform(raw(c), lambda w: F.struct(strip(w["raw"]).alias("text"), (w["i"] + F.length(w["raw"]) - F.length(F.ltrim(w["raw"], F.lit(_SPACES)))).alias("at")))

    kept = F.filter(let(content, cut), lambda w: F.length(w["text"]) > 0)
    return F.transform(kept, lambda w: F.struct(w["text"].alias("text"), (start + w["at"]).alias("start"), (start + w["at"] + F.length(w["text"])).alias("end")))


def phrases(text: Column, least: int = 1) -> Column:
    """Capitalised phrases in order, with repeats."""
    return F.filter(F.regexp_extract_all(text, F.lit(PROPER_PHRASE), F.lit(0)), lambda p: F.length(p) >= least)


def canonical_name(name: Column, kind: Column) -> Column:
    """The key under which surface forms merge; only organisations, departments and untyped names lose legal suffixes."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)(?:'s|’s)(?![\p{L}\p{N}_])", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s&-]", " ")
    out = F.lower(strip(F.regexp_replace(out, rf"{_SPACE}+", " ")))
    out = F.regexp_replace(out, rf"^(?:(?:{'|'.join(LEADING_NOISE)})(?: |$))+", "")
    short = F.regexp_replace(out, rf"(?: (?:{'|'.join(ORG_SUFFIXES)}))+$", "")
    return F.when(kind.isNull() | kind.isin("ORG", "DEPARTMENT"), short).otherwise(out)


def display_name(name: Column) -> Column:
    """The surface form without possessive and leading article."""
    tidy = F.regexp_replace(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), rf"{_SPACE}+", " "), r"(?i)(?:'s|’s)(?![\p{L}\p{N}_])", "")
    tidy = strip(F.regexp_replace(tidy, r" +", " "))
    bare = F.regexp_replace(tidy, r"^(?i:(?:the|a|an)(?: |$))+", "")
    return F.when(F.length(bare) > 0, bare).otherwise(tidy)


def entity_id(kind: Column, canonical: Column) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.sha1(F.concat_ws("|", kind, canonical).cast("binary")), 1, 16))


def relation_id(source: Column, kind: Column, target: Column, polarity: Column) -> Column:
    return F.concat(F.lit("r_"), F.substring(F.sha1(F.concat_ws("|", source, kind, target, polarity).cast("binary")), 1, 16))
