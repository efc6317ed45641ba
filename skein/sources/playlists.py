"""Playlists as feeds: M3U with its extensions, PLS, HLS."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

EXTENSIONS = (".m3u", ".m3u8", ".pls", ".playlist")
_NUMBERING = re.compile(r"^(track|disc|cd|part|chapter|episode|ep)?\s*\d+$", re.I)


def extension(url: str | None) -> str | None:
    path = urlsplit(url or "").path.lower()
    return next((e for e in sorted(EXTENSIONS, key=len, reverse=True) if path.endswith(e)), None)


def has_header(body: str | None) -> bool:
    head = (body or "").lstrip("﻿ \t\r\n")[:40].lower()
    return head.startswith(("#extm3u", "[playlist]"))


def looks_like_playlist(content_type: str | None, body: str | None, url: str = "") -> bool:
    return bool(re.search(r"mpegurl|scpls|apple\.mpegurl", content_type or "", re.I)) or has_header(body) or extension(url) is not None and not (body or "").lstrip().startswith("<")


def split_artist(raw: str, declared: str | None = None) -> tuple[str | None, str]:
    """Artist and title of ``Artist - Title``, unless the first part only numbers."""
    m = re.match(r"^(.{1,80}?)\s+[-–—]\s+(.+)$", raw)
    if declared or not m or _NUMBERING.match(m[1].strip()):
        return declared, raw
    return m[1].strip(), m[2].strip()


def kind_of_entries(entries: list[dict]) -> str:
    live = sum(e["seconds"] == -1 for e in entries)
    video = sum(bool(re.search(r"\.(mp4|m4v|webm|mkv|ts)(\?|$)", e["url"], re.I)) for e in entries)
    if entries and 2 * live > len(entries):
        return "live"
    return "video" if video > len(entries) - video else "music"


def _item(e: dict, base: str) -> dict:
    url = urljoin(base, e["url"])
    artist, title = split_artist(e.get("title") or urlsplit(url).path.rsplit("/", 1)[-1], e.get("artist"))
    audio = {"url": url, "type": "video/mp4" if re.search(r"\.(mp4|m4v|webm)(\?|$)", url, re.I) else "audio/mpeg", "bytes": None, "seconds": e["seconds"] if (e["seconds"] or 0) > 0 else None}
    return {"guid": url, "url": url, "title": title, "summary": e.get("album"), "content": None, "author": artist, "published_at": None, "image": e.get("image"), "categories": [e["genre"]] if e.get("genre") else [], "audio": audio}


def parse_m3u(text: str, base: str = "") -> tuple[str | None, list[dict]]:
    title, entries, now = None, [], {}
    for line in (x.strip() for x in text.lstrip("﻿").splitlines()):
        key, _, value = line.partition(":")
        if key == "#EXTINF":
            length, _, name = value.partition(",")
            number = re.match(r"-?\d+(\.\d+)?", length.strip())
            now |= {"seconds": int(float(number[0])) if number else None, "title": name.strip() or None}
        elif key in ("#EXTALB", "#EXTART", "#EXTGENRE", "#EXTIMG"):
            now[{"#EXTALB": "album", "#EXTART": "artist", "#EXTGENRE": "genre", "#EXTIMG": "image"}[key]] = value.strip()
        elif key == "#PLAYLIST":
            title = value.strip()
        elif line and line[0] != "#":
            entries.append({"seconds": None, **now, "url": line})
            now = {k: v for k, v in now.items() if k in ("album", "artist", "genre")}
    return title, entries


def parse_pls(text: str, base: str = "") -> tuple[str | None, list[dict]]:
    got: dict[int, dict[str, str]] = {}
    title = None
    for line in text.splitlines():
        if m := re.match(r"\s*(File|Title|Length)(\d+)\s*=\s*(.*?)\s*$", line, re.I):
            got.setdefault(int(m[2]), {})[m[1].lower()] = m[3]
        elif m := re.match(r"\s*(?:X-)?(?:Playlist)?Title\s*=\s*(.*?)\s*$", line, re.I):
            title = m[1]
    entries = []
    for _, e in sorted(got.items()):
        if e.get("file"):
            length = e.get("length", "")
            entries.append({"url": e["file"], "title": e.get("title"), "seconds": int(length) if re.fullmatch(r"-?\d+", length) else None})
    return title, entries


def vod_seconds(text: str) -> int | None:
    """The running time of a stream that has an end."""
    if "#EXT-X-ENDLIST" not in text:
        return None
    return round(sum(float(x) for x in re.findall(r"#EXTINF:\s*(\d+(?:\.\d+)?)", text)))


def parse_hls(text: str, url: str) -> dict:
    total = vod_seconds(text)
    name = urlsplit(url).path.rsplit("/", 1)[-1] or url
    item = {"guid": url, "url": url, "title": name, "summary": None, "content": None, "author": None, "published_at": None, "image": None, "categories": [], "audio": {"url": url, "type": "application/vnd.apple.mpegurl", "bytes": None, "seconds": total}}
    return {"format": "hls", "title": name, "description": None, "site_url": url, "language": None, "image": None, "kind": "video" if total is not None or "#EXT-X-PLAYLIST-TYPE:VOD" in text else "live", "categories": [], "items": [item]}


def parse_playlist(body: str, url: str = "") -> dict | None:
    """The feed of a playlist; null where nothing is in it."""
    text = body.lstrip("﻿ \t\r\n")
    if re.search(r"#EXT-X-(TARGETDURATION|STREAM-INF|MEDIA-SEQUENCE)", text):
        return parse_hls(text, url)
    title, entries = parse_pls(text, url) if text[:10].lower() == "[playlist]" else parse_m3u(text, url)
    if not entries:
        return None
    items = [_item(e, url) for e in entries]
    return {"format": "playlist", "title": title or urlsplit(url).path.rsplit("/", 1)[-1] or url, "description": None, "site_url": url, "language": None, "image": next((i["image"] for i in items if i["image"]), None), "kind": kind_of_entries(entries), "categories": sorted({c for i in items for c in i["categories"]}), "items": items}
