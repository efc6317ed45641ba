"""OPML and lists of addresses."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUTLINE = re.compile(r"<outline\b[^>]*>", re.I)


def _attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"""\b{name}\s*=\s*("([^"]*)"|'([^']*)')""", tag, re.I)
    return unescape(m[2] if m[2] is not None else m[3]).strip() or None if m else None


def parse_opml(xml: str | None) -> list[dict]:
    """Feeds of an outline in order; the first of addresses equal but for case."""
    out: dict[str, dict] = {}
    for tag in _OUTLINE.findall(xml or ""):
        url = _attribute(tag, "xmlUrl")
        if url:
            out.setdefault(url.lower(), {"url": url, "title": _attribute(tag, "title") or _attribute(tag, "text"), "site_url": _attribute(tag, "htmlUrl")})
    return list(out.values())


class Scanner:
    """Outline tags from chunks of text; what a chunk's end cuts off waits for the next one."""

    def __init__(self) -> None:
        self.rest = ""

    def push(self, chunk: str) -> list[str]:
        text = self.rest + chunk
        found, end = [], 0
        for m in _OUTLINE.finditer(text):
            found.append(m[0])
            end = m.end()
        at = text.rfind("<", end)
        self.rest = text[at:] if at >= 0 and ">" not in text[at:] else ""
        return [u for t in found if (u := _attribute(t, "xmlUrl"))]


def outline_urls(xml: Column) -> Column:
    """Addresses of an outline by expressions alone."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r'(?i)<outline\b[^>]*?\bxmlUrl\s*=\s*"([^"]*)"'), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def _scan_all(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        s = Scanner()
        out.append([u for i in range(0, len(t or ""), 7) for u in s.push(t[i : i + 7])])
    return pd.Series(out, dtype=object)


def scanned(xml: str) -> Column:
    """A column of the addresses of outlines, read in chunks as a stream gives them."""
    return F.pandas_udf(_scan_all, "array<string>")(xml)


def _read_all(bodies: pd.Series) -> pd.Series:
    return pd.Series([parse_opml(b) for b in bodies], dtype=object)


def read_opml(xml: str) -> Column:
    """A column of the feeds of outlines, as an array of (url, title, site_url)."""
    return F.pandas_udf(_read_all, "array<struct<url:string,title:string,site_url:string>>")(xml)


def scan_urls(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s,]+"), lambda u: u.rlike(r"(?i)^https?://"))


def parse_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Addresses of a list, one a line, without comments and repeats."""
    from skein.functions.scalars import normalize_url

    url = normalize_url(F.trim(F.split(F.col(column), "#")[0]))
    return lines.where(F.trim(F.split(F.col(column), "#")[0]) != "").select(url.alias("url")).where("url is not null").distinct()
