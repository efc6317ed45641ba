"""Pages rewritten to be shown in a frame: a pass over their tags, all else as it is."""

from __future__ import annotations

import html as entities
import json
import re
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes of links that stay as they are, and of those that other programs open; the name under which a page announces itself.
OPAQUE, HANDOFF = ("javascript:", "data:", "blob:", "about:"), ("mailto:", "tel:", "sms:", "magnet:")
READER = "reader"


def absolute(href: str, base: str) -> str | None:
    """A web address against a base, with the host in lower case and a path; null where there is none."""
    try:
        u = urlsplit(urljoin(base, href.strip()))
        if u.scheme.lower() not in ("http", "https") or not u.hostname:
            return None
        return urlunsplit((u.scheme.lower(), u.netloc.lower() if "@" not in u.netloc else u.netloc, u.path or "/", u.query, u.fragment))
    except ValueError:
        return None


class _Seen(HTMLParser):
    """Whether a page has a head and a base, and where the base points."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.tags: set[str] = set()
        self.base: str | None = None

    def handle_starttag(self, tag, attrs) -> None:
        self.tags.add(tag)
        if tag == "base" and self.base is None:
            self.base = dict(attrs).get("href")


class _Rewriter(HTMLParser):
    def __init__(self, base: str, seen: _Seen, url: str, origin: str, frame: str) -> None:
        super().__init__(convert_charrefs=False)
        self.base, self.seen, self.frame, self.own = base, seen, frame, frame + quote(url, safe="!'()*-._~")
        message = json.dumps({"source": READER, "url": url}, separators=(",", ":"), ensure_ascii=False).replace("</", "<\\/")
        self.head = f"<script>try{{parent.postMessage({message},{json.dumps(origin)})}}catch(e){{}}</script>"
        if "base" not in seen.tags:
            self.head += f'<base href="{entities.escape(base)}">'
        self.out: list[str] = []
        self.in_head = self.headed = self.based = False
        if not {"head", "html"} & seen.tags:
            self.out.append(f"<head>{self.head}</head>")

    def through(self, url: str) -> str:
        return self.frame + quote(url, safe="!'()*-._~")

    def handle_starttag(self, tag, attrs, closed: bool = False) -> None:
        raw = self.get_starttag_text() or ""
        values = {}
        for k, v in attrs:
            values.setdefault(k, v)
        done = {"a": self._link, "form": self._form, "base": self._base, "meta": self._meta}.get(tag)
        new = done(dict(values)) if done else values
        if new is None:
            return
        self.out.append(raw if new == values else "<" + tag + "".join(f" {k}" if v is None else f' {k}="{entities.escape(v)}"' for k, v in new.items()) + (" />" if closed else ">"))
        if tag == "head" and not self.headed or tag == "html" and "head" not in self.seen.tags and not self.headed:
            self.headed = True
            self.in_head = tag == "head"
            self.out.append(self.head if tag == "head" else f"<head>{self.head}</head>")

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag) -> None:
        if tag == "head":
            self.in_head = False
        self.out.append(f"</{tag}>")

    def handle_data(self, data) -> None:
        self.out.append(data)

    def handle_entityref(self, name) -> None:
        self.out.append(f"&{name};" if self.rawdata.startswith(f"&{name};", self._at()) else f"&{name}")

    def handle_charref(self, name) -> None:
        self.out.append(f"&#{name};" if self.rawdata.startswith(f"&#{name};", self._at()) else f"&#{name}")

    def _at(self) -> int:
        """The place in the page of what is handled now."""
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_comment(self, data) -> None:
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl) -> None:
        self.out.append(f"<!{decl}>")

    def unknown_decl(self, data) -> None:
        self.out.append(f"<![{data}]>")

    def handle_pi(self, data) -> None:
        self.out.append(f"<?{data}>")

    def _base(self, values: dict) -> dict:
        if not self.based:
            self.based = True
            values["href"] = self.base
        return values

    def _meta(self, values: dict) -> dict | None:
        name = (values.get("http-equiv") or "").lower()
        if not self.in_head or name not in ("content-security-policy", "refresh"):
            return values
        if name == "content-security-policy":
            return None
        m = re.match(r"^\s*([\d.]+)\s*;\s*url\s*=\s*['\"]?([^'\"]+)['\"]?\s*$", values.get("content") or "", re.I)
        target = absolute(m[2], self.base) if m else None
        if target:
            values["content"] = f"{m[1]};url={self.through(target)}"
        return values

    def _form(self, values: dict) -> dict:
        action = (values.get("action") or "").strip()
        to = absolute(action, self.base) if action else self.base
        if to:
            values["action"] = to
        return values | {"target": "_blank"}

    def _link(self, values: dict) -> dict:
        href = (values.get("href") or "").strip()
        if not href:
            return values
        if href.startswith("#"):
            return values | {"href": self.own + href}
        scheme = re.match(r"[A-Za-z][A-Za-z\d+.-]*:", href)
        scheme = scheme[0].lower() if scheme else ""
        if scheme in OPAQUE:
            return values
        if scheme in HANDOFF:
            return values | {"target": "_blank"}
        target = (values.get("target") or "").strip().lower()
        if target in ("_blank", "_new"):
            return values | {"rel": " ".join(dict.fromkeys([*(values.get("rel") or "").split(), "noopener"]))}
        to = absolute(href, self.base)
        if to is None:
            return values
        if target in ("_top", "_parent"):
            values["target"] = "_self"
        return values | {"href": self.through(to)}


def reframe(html: str | None, url: str, origin: str) -> str | None:
    """A page as it is shown in a frame of ``origin``: it keeps its own base, links go through the reader, forms leave it, policies in its markup go, and it announces itself.

    Blank pages stay as they are. A page without head and html is taken as the body of one.
    """
    if not html or not html.strip():
        return html
    seen = _Seen()
    seen.feed(html)
    seen.close()
    base = (absolute(seen.base, url) if seen.base else None) or absolute(url, url) or url
    w = _Rewriter(base, seen, url, origin, f"{origin}/api/frame?u=")
    w.lines = [0, *(m.end() for m in re.finditer("\n", html))]
    w.feed(html)
    w.close()
    out = "".join(w.out)
    return out if re.match(r"\s*<!doctype", out, re.I) else f"<!doctype html>\n{out}"


def reframed(html: Column, url: Column, origin: str) -> Column:
    """``reframe`` over columns, in Arrow batches."""

    def run(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([reframe(h, u or "", origin) for h, u in zip(pages, urls, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(html, url)
