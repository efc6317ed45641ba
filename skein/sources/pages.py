"""Web pages: feeds made from pages, links to feeds, articles, safe HTML, identities, image headers."""

from __future__ import annotations

import json
import re
import struct
from collections import defaultdict
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skein.sources.documents import FEED, feeds_in, parse_date, plain

MOST_POSTS, LEAST_POSTS, ARTICLE_CHARS, MOST_HTML = 40, 3, 600, 400_000
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4"}
_CHROME = {"nav", "footer", "header", "aside", "form", "dialog"}
#: Elements and attributes that stay in cleaned HTML.
_TAGS = {"a", "abbr", "b", "blockquote", "br", "caption", "cite", "code", "dd", "del", "div", "dl", "dt", "em", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "ins", "kbd", "li", "mark", "ol", "p", "pre", "q", "s", "small", "span", "strong", "sub", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "u", "ul"}
_ATTRIBUTES = {"a": {"href", "title"}, "img": {"src", "alt", "title", "width", "height"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}, "abbr": {"title"}}
_DROPPED = {"script", "style", "iframe", "object", "noscript", "template", "svg", "form", "head", "title"}


class Node:
    """An element; ``order`` has all of the page's as they begin, this one and those in it from ``index`` to ``end``."""

    __slots__ = ("attrs", "children", "end", "index", "order", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: list[Node], end: int | None = None) -> None:
        self.tag, self.attrs, self.parent, self.order, self.index, self.end = tag, attrs, parent, order, len(order), end
        self.children: list[Node | str] = []
        order.append(self)

    def walk(self) -> list[Node]:
        return self.order[self.index : self.end]

    def has(self, other: Node) -> bool:
        return self.index <= other.index and (self.end is None or other.index < self.end)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                todo += reversed(n.children)
        return " ".join(" ".join(out).split())

    def inside(self, tags: set[str]) -> bool:
        n = self.parent
        while n is not None:
            if n.tag in tags:
                return True
            n = n.parent
        return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.order: list[Node] = []
        self.root = self.at = Node("", {}, None, self.order)
        self.depth = 0

    def updatepos(self, i, j):
        # nobody asks for lines and columns
        return j

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.order)
        self.at.children.append(node)
        if tag not in _VOID and self.depth < 500:
            self.at, self.depth = node, self.depth + 1
        else:
            node.end = len(self.order)

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at, self.order, len(self.order) + 1))

    def handle_endtag(self, tag):
        n, up = self.at, 0
        while n.parent is not None and n.tag != tag:
            n, up = n.parent, up + 1
        if n.parent is not None:
            while self.at is not n.parent:
                self.at.end, self.at = len(self.order), self.at.parent
            self.depth -= up + 1

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _post(url, title, summary, date, image, author=None) -> dict:
    return {"guid": url, "url": url, "title": title, "summary": summary, "content": None, "author": author, "published_at": parse_date(date), "image": image, "categories": [], "audio": None}


def json_ld(root: Node) -> list[dict]:
    """Objects of the page's linked data, nested ones too."""
    out, todo = [], []
    for n in root.find("script"):
        if n.attrs.get("type", "").split(";")[0].strip().lower() == "application/ld+json":
            try:
                todo.append((json.loads("".join(c for c in n.children if isinstance(c, str))), 0))
            except ValueError:
                continue
    while todo:
        x, depth = todo.pop(0)
        if isinstance(x, list):
            todo += [(y, depth) for y in x]
        elif isinstance(x, dict) and depth <= 4:
            out.append(x)
            todo += [(x[k], depth + 1) for k in ("@graph", "blogPost", "itemListElement", "item", "mainEntity", "hasPart") if k in x]
    return out


def posts_from_json_ld(root: Node, base: str) -> list[dict]:
    found = {}
    for x in json_ld(root):
        kinds = x.get("@type")
        if any(str(k).endswith(("Posting", "Article", "Report")) for k in (kinds if isinstance(kinds, list) else [kinds])):
            url = x.get("url") or x.get("@id") or (x.get("mainEntityOfPage") if isinstance(x.get("mainEntityOfPage"), str) else None)
            title = x.get("headline") or x.get("name")
            image = x.get("image")
            image = image[0] if isinstance(image, list) and image else image
            if url and title:
                url = urljoin(base, str(url))
                found.setdefault(url, _post(url, str(title), plain(str(x.get("description") or "")), str(x.get("datePublished") or ""), image.get("url") if isinstance(image, dict) else image))
    return list(found.values())


def usable_title(title: str) -> bool:
    return len(title) >= 12 and not re.match(r"(?i)^(read more|continue reading|learn more|click here|subscribe|sign up|all posts)", title)


def _from_block(n: Node, base: str) -> dict | None:
    of = defaultdict(list)
    for m in n.walk():
        of["h" if m.tag in _HEADINGS else m.tag].append(m)
    links = [a for a in of["a"] if a.attrs.get("href", "").strip() and not a.attrs["href"].startswith(("#", "javascript:", "mailto:"))]
    heading, title = next(((h, t) for h in of["h"] if (t := h.text())), (None, ""))
    inside = [a for a in links if heading is not None and (heading.has(a) or a.inside({heading.tag}))]
    link = (inside or sorted(links, key=lambda a: -len(a.text())) or [None])[0]
    title = title or (link.text() if link is not None else "")
    if link is None or not usable_title(title):
        return None
    time = next((t.attrs.get("datetime") or t.text() for t in of["time"]), "")
    image = next((i.attrs["src"] for i in of["img"] if i.attrs.get("src")), None)
    para = next((t for p in of["p"] if len(t := p.text()) > 40), None)
    return _post(urljoin(base, link.attrs["href"].strip()), title, plain(para), time, urljoin(base, image) if image else None)


def _distinct(posts) -> list[dict]:
    return list({p["url"]: p for p in reversed([p for p in posts if p])}.values())[::-1]


def posts_from_articles(root: Node, base: str) -> list[dict]:
    return _distinct(_from_block(n, base) for n in root.find("article") if not n.inside({"article"} | _CHROME))


def posts_from_clusters(root: Node, base: str) -> list[dict]:
    """Siblings of one make: the group with the most posts, dated ones counting double."""
    best, score = [], 0
    for parent in root.walk():
        if len(parent.children) < LEAST_POSTS:
            continue
        groups = defaultdict(list)
        for c in parent.children:
            if isinstance(c, Node) and c.tag in ("div", "li", "section", "tr", "p") and not c.inside(_CHROME):
                groups[c.tag, " ".join(sorted(c.attrs.get("class", "").split()))].append(c)
        for nodes in groups.values():
            if len(nodes) >= LEAST_POSTS:
                posts = _distinct(_from_block(n, base) for n in nodes)
                worth = len(posts) + 2 * sum(p["published_at"] is not None for p in posts)
                if len(posts) >= LEAST_POSTS and 10 * len(posts) >= 6 * len(nodes) and worth > score:
                    best, score = posts, worth
    return best


def site_meta(root: Node, url: str) -> dict:
    meta = {}
    for m in root.find("meta"):
        key = (m.attrs.get("property") or m.attrs.get("name") or "").lower()
        if key and m.attrs.get("content"):
            meta.setdefault(key, m.attrs["content"].strip())
    title = next((t.text() for t in root.find("title") if t.text()), None)
    lang = next((n.attrs.get("lang") for n in root.find("html") if n.attrs.get("lang")), None)
    image = meta.get("og:image") or meta.get("twitter:image")
    return {"title": meta.get("og:site_name") or title or urlsplit(url).hostname, "description": meta.get("og:description") or meta.get("description"), "language": lang, "image": urljoin(url, image) if image else None}


def feed_from_page(html: str | None, url: str) -> dict | None:
    """A feed from a page that has none: linked data, articles, then repeated blocks."""
    root = tree(html)
    for strategy in (posts_from_json_ld, posts_from_articles, posts_from_clusters):
        posts = strategy(root, url)[:MOST_POSTS]
        if len(posts) >= LEAST_POSTS:
            m = site_meta(root, url)
            return {"format": "scraped", "title": m["title"], "description": plain(m["description"]), "site_url": url, "language": m["language"], "image": m["image"], "kind": "blog", "categories": [], "items": posts}
    return None


def feed_links(html: str | None, url: str) -> list[str]:
    """Feeds that a page links to, once each, in order."""
    out = []
    for n in tree(html).find("link"):
        if "alternate" in n.attrs.get("rel", "").lower().split() and re.search(r"rss|atom|feed\+json|rdf", n.attrs.get("type", ""), re.I) and n.attrs.get("href"):
            out.append(urljoin(url, n.attrs["href"].strip()))
    return list(dict.fromkeys(out))


def playlist_links(html: str | None, url: str, most: int = 5) -> list[str]:
    from skein.sources.playlists import extension

    out = [urljoin(url, a.attrs["href"].strip()) for a in tree(html).find("a") if extension(a.attrs.get("href"))]
    return list(dict.fromkeys(out))[:most]


def sanitize(html: str | None) -> str:
    """HTML of allowed elements and attributes with web addresses only, closed as opened."""
    out: list[str] = []

    def close(stack: list[str], tag: str | None = None) -> None:
        while stack:
            t = stack.pop()
            out.append(f"</{t}>")
            if t == tag:
                return

    class Cleaner(HTMLParser):
        stack: list[str] = []
        skip = 0

        def handle_starttag(self, tag, attrs):
            if tag in _DROPPED:
                self.skip += tag not in _VOID
            elif not self.skip and tag in _TAGS:
                kept = []
                for k, v in attrs:
                    v = v or ""
                    if k in _ATTRIBUTES.get(tag, ()) and (k not in ("href", "src") or re.match(r"(?i)^(https?:|mailto:|/|#|[^:]*$)", re.sub(r"[\x00-\x20]", "", v))):
                        kept.append(f' {k}="{escape(v)}"')
                extra = ' rel="nofollow noopener" target="_blank"' if tag == "a" else ' loading="lazy" referrerpolicy="no-referrer"' if tag == "img" else ""
                out.append(f"<{tag}{''.join(kept)}{extra}>")
                if tag not in _VOID:
                    self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag in _DROPPED:
                self.skip = max(0, self.skip - 1)
            elif not self.skip and tag in self.stack:
                close(self.stack, tag)

        def handle_data(self, data):
            if not self.skip:
                out.append(escape(data, quote=False))

    c = Cleaner(convert_charrefs=True)
    c.stack, c.skip = [], 0
    c.feed((html or "")[:MOST_HTML])
    c.close()
    close(c.stack)
    return "".join(out)


def readable(html: str | None, url: str = "") -> dict | None:
    """The part of a page that reads as an article: the block whose paragraphs outweigh its links."""
    root = tree(html)
    best, score = None, 0.0
    for n in root.find("article", "main", "div", "section", "body", "td"):
        if n.inside(_CHROME) or n.tag in _CHROME:
            continue
        paras = [c for c in n.children if isinstance(c, Node) and c.tag in ("p", "pre", "blockquote", "ul", "ol", "h2", "h3", "figure")]
        text = sum(len(p.text()) for p in paras)
        linked = sum(len(a.text()) for p in paras for a in p.find("a"))
        worth = (text - 2 * linked) * (1.3 if n.tag in ("article", "main") else 1.0)
        if worth > score:
            best, score = n, worth
    if best is None:
        return None
    text = best.text()
    if len(text) < ARTICLE_CHARS and not best.find("figure"):
        return None
    title = next((h.text() for h in root.find("h1") if h.text()), None) or next((t.text() for t in root.find("title")), None)
    return {"title": title, "text": text, "images": [urljoin(url, i.attrs["src"]) for i in best.find("img") if i.attrs.get("src")], "chars": len(text)}


def identities(html: str | None, url: str) -> dict:
    """People and profiles a page names: rel=me, h-card, linked data, author."""
    root = tree(html)
    profiles = [urljoin(url, n.attrs["href"]) for n in root.find("a", "link") if "me" in n.attrs.get("rel", "").split() and n.attrs.get("href")]
    names = [(n.text(), "h-card", 0.8) for n in root.walk() if "p-author" in n.attrs.get("class", "").split() or "h-card" in n.attrs.get("class", "").split()]
    names += [(str(x.get("name")), "json-ld", 0.9) for x in json_ld(root) if x.get("@type") == "Person" and x.get("name")]
    names += [(m.attrs.get("content", ""), "meta", 0.6) for m in root.find("meta") if m.attrs.get("name", "").lower() == "author"]
    people = {}
    for name, source, sure in names:
        name = " ".join(name.split())
        if re.fullmatch(r"[^\d<>@]{3,60}", name) and 2 <= len(name.split()) <= 5:
            people.setdefault(name.lower(), {"name": name, "source": source, "confidence": sure})
    return {"profiles": list(dict.fromkeys(profiles)), "people": list(people.values())}


def humans_txt(text: str | None) -> list[dict]:
    """Names with contact and place from the blocks of a humans.txt."""
    out, now = [], {}
    for line in [*(text or "").splitlines(), ""]:
        m = re.match(r"\s*([A-Za-z ]{2,30}?)\s*:\s*(.+?)\s*$", line)
        if not m or line.strip().startswith("/*"):
            if not line.strip() and now:
                out.append(now)
                now = {}
            continue
        key, value = m[1].strip().lower(), m[2]
        if key in ("name", "author", "developer", "editor", "founder") or " " in value and "name" not in now and key not in ("site", "twitter", "location", "contact", "from", "last update", "standards", "components", "software"):
            if "name" in now:
                out.append(now)
                now = {}
            now |= {"name": value, "role": key}
        elif now:
            now[{"site": "url", "contact": "email", "from": "place", "location": "place"}.get(key, key)] = value
    return [p for p in out if "name" in p]


def image_size(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) from the header of PNG, GIF, BMP, ICO, WebP, JPEG or SVG."""
    d = data or b""
    if d[:8] == b"\x89PNG\r\n\x1a\n" and len(d) >= 24:
        return ("png", *struct.unpack(">II", d[16:24]))
    if d[:6] in (b"GIF87a", b"GIF89a") and len(d) >= 10:
        return ("gif", *struct.unpack("<HH", d[6:10]))
    if d[:2] == b"BM" and len(d) >= 26:
        w, h = struct.unpack("<ii", d[18:26])
        return ("bmp", w, abs(h))
    if d[:4] == b"\0\0\1\0" and len(d) >= 8:
        return ("ico", d[6] or 256, d[7] or 256)
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP" and len(d) >= 30:
        if d[12:16] == b"VP8X":
            return ("webp", 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little"))
        if d[12:16] == b"VP8L":
            bits = int.from_bytes(d[21:25], "little")
            return ("webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        return ("webp", *(x & 0x3FFF for x in struct.unpack("<HH", d[26:30])))
    if d[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(d) and d[i] == 0xFF:
            if 0xC0 <= d[i + 1] <= 0xCF and d[i + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", d[i + 5 : i + 9])
                return ("jpeg", w, h)
            i += 2 + int.from_bytes(d[i + 2 : i + 4], "big")
        return None
    if b"<svg" in d[:1000]:
        m = re.search(rb'viewBox\s*=\s*["\'][\d.\s-]*?([\d.]+)\s+([\d.]+)["\']', d[:2000])
        return ("svg", int(float(m[1])), int(float(m[2]))) if m else ("svg", 0, 0)
    return None


def _sanitized(html: pd.Series) -> pd.Series:
    return html.map(sanitize)


def _article(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [readable(h, u or "") for h, u in zip(html, url, strict=True)]
    return pd.DataFrame([[r[n] if r else None for n in ("title", "text", "images", "chars")] for r in rows], columns=["title", "text", "images", "chars"])


def _page_identities(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([identities(h, u or "") for h, u in zip(html, url, strict=True)], columns=["profiles", "people"])


def page_feed(html, url):
    made = feeds_in(SparkSession.getActiveSession())

    def feeds(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return made([feed_from_page(h, u or "") for h, u in zip(pages.to_pylist(), urls.to_pylist(), strict=True)])

    return F.arrow_udf(feeds, FEED)(html, url)


def sanitized(html):
    return F.pandas_udf(_sanitized, "string")(html)


def article(html, url):
    return F.pandas_udf(_article, "struct<title:string,text:string,images:array<string>,chars:bigint>")(html, url)


def page_identities(html, url):
    return F.pandas_udf(_page_identities, "struct<profiles:array<string>,people:array<struct<name:string,source:string,confidence:double>>>")(html, url)


def _feed_links(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([feed_links(h, u or "") for h, u in zip(html, url, strict=True)], dtype=object)


def page_feed_links(html, url):
    return F.pandas_udf(_feed_links, "array<string>")(html, url)


def _playlist_links(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([playlist_links(h, u or "") for h, u in zip(html, url, strict=True)], dtype=object)


def page_playlist_links(html, url):
    return F.pandas_udf(_playlist_links, "array<string>")(html, url)


def _humans(body: pd.Series) -> pd.Series:
    return pd.Series([[{"name": p["name"], "role": p.get("role")} for p in humans_txt(b)] for b in body], dtype=object)


def people_of_humans(body):
    """The people that a humans.txt names."""
    return F.pandas_udf(_humans, "array<struct<name:string,role:string>>")(body)


def _sizes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(d) or (None, None, None) for d in data], columns=["format", "width", "height"])


def picture_size(data):
    """A column of (format, width, height) of pictures' bytes; nulls where the header is none."""
    return F.pandas_udf(_sizes, "struct<format:string,width:long,height:long>")(data)


def page_title(html: Column) -> Column:
    """The title element's text, by expressions alone."""
    from skein.functions.text import strip_html

    return strip_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    """Addresses of the page's links, by expressions alone."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\shref="([^"]*)"'), F.lit(1))
