"""Names of fetched pages; fetching itself is no engine's work, so pages come as a table of url and html."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import strip

UNNAMED = "web-page"


def title(html: Column) -> Column:
    """The title element's text on one line, at most 120 characters; '' without one."""
    inner = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.substring(strip(F.regexp_replace(inner, r"\s+", " ")), 1, 120)


def title_or_path(html: Column, url: Column) -> Column:
    """The title, else the last part of the path, else the host."""
    last = F.regexp_extract(F.url_decode(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))), r"([^/]*)/*$", 1)
    parts = [F.nullif(x, F.lit("")) for x in (title(html), last, F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit("")))]
    return F.coalesce(*parts, F.lit(UNNAMED))


def page_filename(name: Column) -> Column:
    """A safe .html file name of at most 80 characters before the suffix."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_-]+", "_"), r"^[_-]+|[_-]+$", ""), 1, 80)
    return F.concat(F.when(F.length(safe) > 0, safe).otherwise(UNNAMED), F.lit(".html"))


def upload_name(name: Column, content: Column) -> Column:
    """A safe name for an uploaded file: base name, stem of at most 80 characters and 8 digits of its content's hash."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r"(\.[^.]+)$", 1))
    stem = F.regexp_replace(F.substring(base, F.lit(1), F.length(base) - F.length(suffix)), r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.substring(stem, 1, 80), F.lit("-"), F.substring(F.sha1(content), 1, 8), suffix)
