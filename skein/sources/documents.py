"""Readers of feed documents: RSS 2.0, Atom, RSS 1.0, JSON Feed; playlists go to ``playlists``.

Documents are parsed in Arrow batches by plain functions of (body, url); a document that cannot be
read gives a null. The structs are made by Arrow itself, not by way of pandas. Items come as an array of structs, to be exploded where rows are wanted.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import lru_cache
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalars import EPISODE_CHARS

ITEM = "struct<guid:string,url:string,title:string,summary:string,content:string,author:string,published_at:timestamp,image:string,categories:array<string>,audio:struct<url:string,type:string,bytes:bigint,seconds:bigint>>"
FEED = f"struct<format:string,title:string,description:string,site_url:string,language:string,image:string,kind:string,categories:array<string>,items:array<{ITEM}>>"
_STRINGS, _MOMENT = pa.list_(pa.string()), pa.timestamp("us", tz="UTC")
_AUDIO = pa.struct([("url", pa.string()), ("type", pa.string()), ("bytes", pa.int64()), ("seconds", pa.int64())])
_ITEM = pa.struct([*[(n, pa.string()) for n in ("guid", "url", "title", "summary", "content", "author")], ("published_at", _MOMENT), ("image", pa.string()), ("categories", _STRINGS), ("audio", _AUDIO)])
_FEED = pa.struct([*[(n, pa.string()) for n in ("format", "title", "description", "site_url", "language", "image", "kind")], ("categories", _STRINGS), ("items", pa.list_(_ITEM))])
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_KEEP = {"amp", "lt", "gt", "quot", "apos"}


@lru_cache(maxsize=1 << 14)
def parse_date(value: str | None) -> datetime | None:
    """RFC 822 or ISO 8601 with or without parts; null for anything else."""
    value = (value or "").strip()
    if not value:
        return None
    out = None
    try:
        out = datetime.fromisoformat(value)
    except ValueError:
        try:
            out = parsedate_to_datetime(value)
        except (TypeError, ValueError, IndexError):
            return None
    out = out if out.tzinfo else out.replace(tzinfo=UTC)
    try:
        return out.astimezone(UTC).replace(tzinfo=None)
    except OverflowError:
        return None


def seconds(value: str | None) -> int | None:
    """Seconds of s, m:s or h:m:s."""
    v = (value or "").strip()
    if not re.fullmatch(r"\d+(:\d{1,2}){0,2}(\.\d+)?", v):
        return None
    total = 0.0
    for part in v.split(":"):
        total = total * 60 + float(part)
    return int(total)


def _xml(body: str) -> ET.Element | None:
    """A tree without namespaces' addresses: tags read ``prefix:name`` for the known ones."""
    text = body.lstrip("﻿ \t\r\n")
    text = re.sub(r"^<\?xml[^>]*\?>", "", text)
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?>", "", text, flags=re.I)
    text = _ENTITY.sub(lambda m: m[0] if m[1] in _KEEP else html5.get(m[1] + ";", " "), text)
    text = re.sub(r"&(?!#?\w+;)", "&amp;", text)
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return None
    prefix = {"itunes": "itunes:", "dc/elements": "dc:", "content": "content:", "media/": "media:", "mrss": "media:", "podcast": "podcast:"}
    for e in root.iter():
        if isinstance(e.tag, str) and e.tag[0] == "{":
            space, _, name = e.tag[1:].partition("}")
            e.tag = next((p for k, p in prefix.items() if k in space), "") + name
    return root


def _text(e: ET.Element | None, *names: str) -> str | None:
    for n in names:
        for c in e.findall(n) if e is not None else ():
            t = "".join(c.itertext()).strip()
            if t:
                return t
    return None


def _inner(e: ET.Element | None) -> str | None:
    if e is None:
        return None
    if len(e) and e.get("type") == "xhtml":
        return "".join(ET.tostring(c, encoding="unicode") for c in e).strip() or None
    return "".join(e.itertext()).strip() or None


def plain(html: str | None, most: int = 400) -> str | None:
    """Visible text of HTML, cut at a space."""
    if not html:
        return None
    t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html) if "<" in html else html
    t = re.sub(r"&(#x?[0-9a-fA-F]+|\w+);", lambda m: _char(m[1]), t) if "&" in t else t
    t = " ".join(t.split())
    if len(t) <= most:
        return t or None
    head = t[:most]
    return (head[: head.rfind(" ")] if " " in head else head) + "…"


def _char(code: str) -> str:
    if code[0] != "#":
        return html5.get(code + ";", f"&{code};")
    n = int(code[2:], 16) if code[1] in "xX" else int(code[1:])
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else ""


def _categories(e: ET.Element) -> list[str]:
    out: dict[str, str] = {}
    for c in [*e.findall("category"), *e.findall("itunes:category"), *e.findall("dc:subject")]:
        t = (c.get("term") or c.get("text") or "".join(c.itertext())).strip()
        if t and len(t) <= 60:
            out.setdefault(t.lower(), t)
    return list(out.values())


def _audio(e: ET.Element) -> dict | None:
    for c in [*e.findall("enclosure"), *e.findall("media:content"), *[x for x in e.findall("link") if x.get("rel") == "enclosure"]]:
        url, kind = c.get("url") or c.get("href"), c.get("type") or ""
        if url and (kind.startswith(("audio/", "video/")) or re.search(r"\.(mp3|m4a|ogg|opus|mp4|m4v|webm)(\?|$)", url)):
            size = c.get("length") or c.get("fileSize") or ""
            return {"url": url, "type": kind or None, "bytes": int(size) if size.isdigit() else None, "seconds": seconds(_text(e, "itunes:duration") or c.get("duration"))}
    return None


def _image(e: ET.Element, content: str | None) -> str | None:
    for c in [*e.findall("media:thumbnail"), *[x for x in e.findall("media:content") if (x.get("medium") or x.get("type") or "").startswith("image")], *[x for x in e.findall("enclosure") if (x.get("type") or "").startswith("image/")], *e.findall("itunes:image")]:
        if c.get("url") or c.get("href"):
            return c.get("url") or c.get("href")
    m = re.search(r"<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)", content or "", re.I)
    return m[1] if m else None


def _item(guid, url, title, content, author, date, image, categories, audio) -> dict:
    return {"guid": guid or url or title, "url": url, "title": title, "summary": plain(content), "content": content, "author": author, "published_at": parse_date(date), "image": image, "categories": categories, "audio": audio}


#: A channel's tags of podcasts, and those by which its publisher declares one.
PODCAST_TAGS = ("itunes:owner", "itunes:category", "itunes:explicit", "itunes:type", "podcast:guid", "podcast:medium")
DECLARED_TAGS = ("itunes:type", "podcast:guid", "podcast:medium")


def kind_of(items: list[dict], medium: str | None, tags: set[str], url: str) -> str:
    """The class of a feed by what it declares and what its first posts hold: enclosures count where tags or a show's shape bear them out.

    A newsroom is told from stored posts and not from a document (``is_newsroom``).
    """
    if medium in ("music", "video", "podcast"):
        return medium
    sample = items[:5]
    if "youtube.com/feeds" in url or any("youtube.com/watch" in (i["url"] or "") for i in sample):
        return "video"
    podcast, media = bool(tags & set(PODCAST_TAGS)), [i for i in sample if i["audio"]]
    video = [i for i in media if (i["audio"]["type"] or "").startswith("video")]
    brief = sum(len(plain(i["content"], 10**9) or "") < EPISODE_CHARS for i in video)
    if video and (podcast or (2 * len(video) > len(sample) and 2 * brief > len(video))):
        return "video"
    return "podcast" if podcast and (tags & set(DECLARED_TAGS) or not sample or len(media) > len(video)) else "blog"


def _feed(fmt: str, title, description, site, language, image, items: list[dict], categories=(), medium=None, tags=frozenset(), url="") -> dict:
    return {"format": fmt, "title": title, "description": plain(description), "site_url": site, "language": language, "image": image, "kind": kind_of(items, medium, set(tags), url), "categories": list(categories), "items": items}


def parse_rss(root: ET.Element, url: str = "") -> dict:
    channel = root.find("channel") if root.tag != "channel" else root
    items = []
    for e in channel.findall("item") + (root.findall("item") if root.tag == "RDF" else []):
        content = _text(e, "content:encoded", "description")
        link = _text(e, "link") or (e.get("about") or next((v for k, v in e.attrib.items() if k.endswith("about")), None))
        guid = _text(e, "guid") or next((v for k, v in e.attrib.items() if k.endswith("about")), None)
        items.append(_item(guid, link, _text(e, "title"), content, _text(e, "dc:creator", "author", "itunes:author"), _text(e, "pubDate", "dc:date"), _image(e, content), _categories(e), _audio(e)))
    image = channel.find("itunes:image")
    return _feed("rdf" if root.tag == "RDF" else "rss", _text(channel, "title"), _text(channel, "description"), _text(channel, "link"), _text(channel, "language", "dc:language"),
                 (image.get("href") if image is not None else None) or _text(channel.find("image"), "url") or _text(root.find("image"), "url"), items, _categories(channel), _text(channel, "podcast:medium"), {c.tag for c in channel}, url)


def parse_atom(root: ET.Element, url: str = "") -> dict:
    def link(e: ET.Element) -> str | None:
        links = [x for x in e.findall("link") if x.get("href")]
        return next((x.get("href") for x in links if x.get("rel", "alternate") == "alternate"), links[0].get("href") if links else None)

    items = []
    for e in root.findall("entry"):
        content = _inner(e.find("content")) or _inner(e.find("summary")) or _text(e.find("media:group"), "media:description")
        items.append(_item(_text(e, "id"), link(e), _text(e, "title"), content, _text(e.find("author"), "name"), _text(e, "published", "updated"), _image(e, content) or _image(e.find("media:group"), None) if e.find("media:group") is not None else _image(e, content), _categories(e), _audio(e)))
    return _feed("atom", _text(root, "title"), _text(root, "subtitle"), link(root), next((v for k, v in root.attrib.items() if k.endswith("lang")), None), _text(root, "icon", "logo"), items, _categories(root), url=url)


def parse_json_feed(raw: dict, url: str = "") -> dict | None:
    if not isinstance(raw.get("items"), list):
        return None
    items = []
    for e in (x for x in raw["items"] if isinstance(x, dict)):
        content = e.get("content_html") or e.get("content_text") or e.get("summary")
        who = (e.get("authors") or [e.get("author") or {}])[0]
        a = next((x for x in e.get("attachments") or [] if str(x.get("mime_type", "")).startswith(("audio/", "video/"))), None)
        audio = a and {"url": a.get("url"), "type": a.get("mime_type"), "bytes": a.get("size_in_bytes"), "seconds": a.get("duration_in_seconds")}
        guid = e.get("id")
        items.append(_item(None if guid is None else str(guid), e.get("url") or e.get("external_url"), e.get("title"), content, who.get("name"), e.get("date_published") or e.get("date_modified"), e.get("image") or e.get("banner_image"), [str(t) for t in e.get("tags") or []], audio))
    return _feed("json", raw.get("title"), raw.get("description"), raw.get("home_page_url"), raw.get("language"), raw.get("icon") or raw.get("favicon"), items, medium=None, tags={"itunes:owner"} if "_itunes" in raw else (), url=url)


def parse_feed(body: str | None, url: str = "") -> dict | None:
    """The feed of a document, by what its first characters say; null where it is none."""
    from skein.sources.playlists import has_header, parse_playlist

    text = (body or "").lstrip("﻿ \t\r\n")
    if not text:
        return None
    if text[0] == "{":
        try:
            raw = json.loads(text)
        except ValueError:
            return None
        return parse_json_feed(raw, url) if isinstance(raw, dict) else None
    if has_header(text):
        return parse_playlist(text, url)
    root = _xml(text)
    if root is None:
        return None
    if root.tag in ("rss", "RDF", "channel") and (root.tag == "channel" or root.find("channel") is not None):
        return parse_rss(root, url)
    return parse_atom(root, url) if root.tag == "feed" else None


def feeds_in(session: SparkSession | None):
    """Feeds as an Arrow array; their moments are UTC without saying so, and are taken as the session's own time, as columns are."""
    zone = (session.conf.get("spark.sql.session.timeZone") if session else None) or "UTC"

    def made(rows: list[dict | None]) -> pa.Array:
        if zone != "UTC":
            for i in (i for r in rows if r for i in r["items"] if i["published_at"]):
                i["published_at"] = pd.Timestamp(i["published_at"]).tz_localize(zone, ambiguous=False).to_pydatetime()
        return pa.array(rows, _FEED)

    return made


def parsed(body, url):
    """A column of feeds from columns of bodies and addresses."""
    made = feeds_in(SparkSession.getActiveSession())

    def parse(bodies: pa.Array, urls: pa.Array) -> pa.Array:
        return made([parse_feed(b, u or "") for b, u in zip(bodies.to_pylist(), urls.to_pylist(), strict=True)])

    return F.arrow_udf(parse, FEED)(body, url)


def read_feeds(documents: DataFrame, url_col: str = "url", body_col: str = "body") -> DataFrame:
    """(url, feed) of landed documents."""
    return documents.select(F.col(url_col).alias("url"), parsed(body_col, url_col).alias("feed"))


def items_of(feeds: DataFrame) -> DataFrame:
    """A row per post of parsed feeds."""
    # an inner explode is preceded by a filter on its array, for which all documents would be parsed a second time
    posts = feeds.select("url", F.posexplode_outer("feed.items").alias("pos", "item")).where("pos is not null")
    return posts.select(F.col("url").alias("feed_url"), "pos", "item.*")
