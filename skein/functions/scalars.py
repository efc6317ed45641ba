"""Scalar helpers as Column expressions: names, addresses, dates, media, schedules."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.forms import unaccented
from skein.sources.model import KINDS, SEGMENTS

#: Minutes to wait after so many failures in a row.
BACKOFF = [60, 180, 360, 720, 1440]
MIN_INTERVAL, MAX_INTERVAL, UNDATED_CEILING = 60, 129_600, 1440
EPISODE_CHARS, RIVER_DEFAULT = 1200, 50


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normalize_kind(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin(KINDS), k)


def normalize_kinds(kinds: Column) -> Column:
    """Distinct known kinds of an array; null if there are none."""
    out = F.array_distinct(F.filter(F.transform(kinds, lambda x: F.lower(F.trim(x))), lambda x: x.isin(KINDS)))
    return F.when(F.size(out) > 0, out)


def segment_kinds(segment: Column) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, kinds in SEGMENTS.items():
        out = out.when(segment == name, F.array(*[F.lit(k) for k in kinds]))
    return out


def host_of(url: Column) -> Column:
    """The host of an address, or the address itself where it has none."""
    host = F.regexp_extract(F.lower(url), r"^https?://([^/?#:]+)", 1)
    return F.when(host != "", host).otherwise(url)


def apex_of(host: Column) -> Column:
    """The last two labels."""
    return F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), ".")


def plausible_host(host: Column) -> Column:
    """Labels of letters, digits and inner hyphens with a word at the end, or an IPv4 address."""
    name = host.rlike(r"^(?=.{1,253}$)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$")
    ip = host.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    return name | ip


def js_number(text: Column) -> Column:
    """A text as a number: blank is 0, decimal, exponent and hexadecimal spellings are read, all else is null."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    hexed = F.when(t.rlike(r"^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).cast("double"))
    return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(plain, hexed))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def normalize_url(url: Column) -> Column:
    """https where no scheme is named, also after ``//``; http(s) with a plausible host only; no fragment; null otherwise."""
    u = F.regexp_replace(F.regexp_replace(url, r"^[\s]+|[\s]+$", ""), r"[\t\r\n]", "")
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    named, other = u.rlike("(?i)^https?://"), u.rlike("(?i)^[a-z][a-z0-9+.-]*:")
    u = F.when(named, u).when(~other, F.concat(F.lit("https://"), u))
    u = F.replace(F.regexp_replace(u, "#.*$", ""), F.lit(" "), F.lit("%20"))
    parts = r"(?i)^(https?):/*((?:[^/?#@]*@)?)([^/?#:@]+)((?::\d{0,5})?)([/?].*)?$"
    part = lambda i: F.regexp_extract(u, parts, i)
    scheme, host, port, rest = F.lower(part(1)), F.lower(part(3)), F.regexp_replace(part(4), "^:$", ""), part(5)
    port = F.when((scheme == "https") & (port == ":443") | (scheme == "http") & (port == ":80"), "").otherwise(port)
    fits = (port == "") | (F.substring(port, 2, 5).try_cast("int") <= 65_535)
    return F.when(plausible_host(host) & fits, F.concat(scheme, F.lit("://"), part(2), host, port, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _v6() -> str:
    """IPv6: so many groups before the gap and at most so many after it, the last two of which may be an IPv4 address."""
    group = "[0-9a-fA-F]{1,4}"
    ways = [f"(?:{group}:){{7}}(?:{group}|:)", f"(?:{group}:){{6}}(?:{_V4}|:{group}|:)"]
    for n in range(5, 0, -1):
        ways.append(f"(?:{group}:){{{n}}}(?:(?::{group}){{0,{5 - n}}}:{_V4}|(?::{group}){{1,{7 - n}}}|:)")
    ways.append(f":(?:(?::{group}){{0,5}}:{_V4}|(?::{group}){{1,7}}|:)")
    return "^(?:" + "|".join(ways) + ")(?:%[0-9a-zA-Z.:-]+)?$"


def is_blocked_address(ip: Column) -> Column:
    """Private, loopback, link-local, shared, multicast and reserved addresses, also where IPv6 holds them, and what is no address."""
    v4 = F.when(ip.rlike(f"^{_V4}$"), ip)
    v6 = F.when(ip.rlike(_v6()), F.lower(ip))
    four = F.coalesce(v4, F.nullif(F.regexp_extract(v6, rf"^::ffff:({_V4})$", 1), F.lit("")))
    p = F.transform(F.split(four, r"\."), lambda x: x.cast("int"))
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    inner = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    own = v6.isin("::", "::1") | v6.startswith("fe80") | v6.startswith("fc") | v6.startswith("fd")
    return F.when(four.isNotNull(), inner).when(v6.isNotNull(), own).otherwise(True)


def backoff_minutes(errors: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in BACKOFF]), clamp(errors.cast("int"), 1, len(BACKOFF)))


def throttle_minutes(retry_after: Column) -> Column:
    """Whole minutes of the seconds asked for, a day at most; half an hour where nothing above zero is said."""
    seconds = retry_after.cast("double")
    said = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf"))
    return F.when(said, clamp(F.ceil(seconds / 60), 1, 1440)).otherwise(30)


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Whole seconds of a Retry-After header, a number or a date, within a day; null where it is neither."""
    number = F.when(F.trim(header) != "", js_number(header))
    number = F.when(number >= 0, number)
    date = F.try_to_timestamp(F.regexp_replace(F.trim(header), r"^[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    seconds = F.coalesce(number, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds.isNotNull(), clamp(round_half_up(seconds).cast("double"), 0, 86_400))


def billing_period_start(now: Column, day: int = 13) -> Column:
    """The latest such day of a month up to now."""
    this = F.make_date(F.year(now), F.month(now), F.lit(day))
    return F.when(F.dayofmonth(now) >= day, this).otherwise(F.add_months(this, -1))


def item_key(cluster: Column, slug: Column, guid: Column) -> Column:
    """A story by its cluster, or else by its feed and identifier."""
    return F.when(F.coalesce(cluster, F.lit("")) != "", F.concat(F.lit("c:"), cluster)).otherwise(F.concat(F.lit("g:"), slug, F.lit("\n"), guid))


def normalize_segment(segment: Column) -> Column:
    return F.lower(F.trim(segment))


def normalize_email(email: Column) -> Column:
    return F.lower(F.trim(email))


#: Types of playlists.
PLAYLIST_TYPES = ["audio/x-mpegurl", "audio/mpegurl", "application/x-mpegurl", "application/mpegurl", "application/vnd.apple.mpegurl", "audio/x-scpls", "audio/scpls", "application/pls+xml"]


def looks_like_references(body: Column) -> Column:
    """Whether the first twenty lines that are neither blank nor a comment are there and hold no markup."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.slice(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), 1, 20)
    return (F.size(lines) > 0) & F.forall(lines, lambda x: ~x.rlike(r"[<{]"))


def looks_like_playlist(content_type: Column, body: Column, url: Column) -> Column:
    """By the type, by the first characters, or by the address where the body is a list of references."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    typed = F.exists(F.array(*map(F.lit, PLAYLIST_TYPES)), lambda t: F.contains(kind, t))
    return typed | has_playlist_header(body) | (F.coalesce(playlist_extension(url).isNotNull(), F.lit(False)) & looks_like_references(body))


def is_transient(status: Column, reason: Column) -> Column:
    """Errors, and refusals by a server that failed itself."""
    return F.coalesce((status == "error") | ((status == "blocked") & reason.rlike(r"^http-[5-9]\d\d$")), F.lit(False))


def should_fetch(state: Column, fetched_at: Column, now: Column) -> Column:
    """Passing failures are tried again after ten minutes, other ones after a day, what went well never; an unknown time counts as long ago."""
    age = F.unix_timestamp(now) - F.unix_timestamp(fetched_at)
    refused = F.when(state.startswith("http-"), "blocked").otherwise(state)
    wait = F.when(is_transient(refused, state), 600).otherwise(86_400)
    return F.when(state.isNull(), True).when(state == "ok", False).otherwise(F.coalesce(age >= wait, F.lit(True)))


def freshness(status: Column, last_error: Column, error_count: Column, last_success: Column, interval_minutes: Column, newest_post: Column, now: Column) -> Column:
    """unread, failing, overdue (twice the interval since the last success), dormant (nothing for a year) or live."""
    since = F.unix_timestamp(now) - F.unix_timestamp(last_success)
    interval = 60 * F.greatest(F.coalesce(F.nullif(interval_minutes, F.lit(0)), F.lit(60)), F.lit(1))
    failing = (status == "error") | ((F.coalesce(last_error, F.lit("")) != "") & (error_count > 0))
    quiet = F.unix_timestamp(now) - F.unix_timestamp(newest_post) > 365 * 86_400
    return (F.when(last_success.isNull(), "unread").when(F.coalesce(failing, F.lit(False)), "failing").when(since > 2 * interval, "overdue").when(F.coalesce(quiet, F.lit(False)), "dormant").otherwise("live"))


def human_gap(seconds: Column) -> Column:
    """A plain interval of moments, minutes, hours, days, months or years, rounded half up."""
    s = F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0))
    minute, hour, day = 60, 3600, 86_400

    def part(size: int, unit: str) -> Column:
        n = F.floor(s / size + 0.5).cast("long")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))

    return (F.when(s < minute, "moments").when(s < hour, part(minute, "minute")).when(s < day, part(hour, "hour")).when(s < 60 * day, part(day, "day"))
            .when(s < 730 * day, part(30 * day, "month")).otherwise(part(365 * day, "year")))


def eta_label(hours: Column) -> Column:
    """Minutes (one at least) within the hour, hours within two days, else days, each rounded; a dash where nothing is known."""
    said = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    return (F.when(hours.isNull(), "—").when(hours < 1, said(F.greatest(round_half_up(hours * 60), F.lit(1)), "m")).when(hours < 48, said(round_half_up(hours), "h"))
            .otherwise(said(round_half_up(hours / 24), "d")))


def media_kind(url: Column, mime: Column, page: Column | None = None) -> Column:
    """peertube, youtube, video or, of any other type, audio; null without media. ``page`` is the post's own address."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    tube = F.lit(False) if page is None else peertube_embed(page, url, mime).isNotNull()
    return F.when(F.coalesce(url, F.lit("")) == "", None).when(tube, "peertube").when(kind == "video/youtube", "youtube").when(kind.startswith("video/"), "video").otherwise("audio")


def is_episode(url: Column, mime: Column, chars: Column, page: Column | None = None) -> Column:
    return media_kind(url, mime, page).isNotNull() & (F.coalesce(chars, F.lit(0)) < EPISODE_CHARS)


def lane_for(kind: Column) -> Column:
    return F.when(kind == "audio", "listen").when(kind.isin("video", "youtube", "peertube"), "watch").otherwise("read")


def monogram(title: Column) -> Column:
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t != "", F.upper(F.substring(t, 1, 1))).otherwise("·")


def hash31(text: Column, modulus: int) -> Column:
    """A string's hash in base 31, as a remainder."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % modulus)


def clamp_text(text: Column, limit: int) -> Column:
    """Cut at the limit, or at the last space before it if that is beyond 60 per cent of it, with an ellipsis."""
    head = F.substring(text, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    at = F.when(F.contains(head, F.lit(" ")) & (space > 0.6 * limit), space).otherwise(limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(head, F.lit(1), at.cast("int")), r"\s+$", ""), F.lit("…")))


def hms(seconds: Column) -> Column:
    """Hours, minutes and seconds with two digits each; nothing where there are none."""
    total = F.floor(F.coalesce(seconds.cast("double"), F.lit(0.0))).cast("long")
    return F.when(total <= 0, "").otherwise(F.format_string("%02d:%02d:%02d", F.floor(total / 3600).cast("long"), F.floor(total % 3600 / 60).cast("long"), total % 60))


def rfc822(ts: Column) -> Column:
    days = F.array(*[F.lit(d) for d in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")])
    return F.concat(F.element_at(days, F.dayofweek(ts)), F.lit(", "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def duration(text: Column) -> Column:
    """Whole seconds of s, m:s or h:m:s, in any numbers; null where a part is none or nothing is left."""
    parts = F.transform(F.split(F.trim(text), ":"), js_number)
    ok = (F.trim(text) != "") & F.size(parts).between(1, 3) & F.forall(parts, lambda x: F.coalesce(x >= 0, F.lit(False)))
    total = F.aggregate(parts, F.lit(0.0), lambda t, x: t * 60 + x)
    return F.when(ok & (total > 0), F.floor(total).cast("long"))


def normalize_lang(lang: Column) -> Column:
    """The primary subtag of two letters, or null."""
    code = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def chunk_filename(month: Column, part: Column) -> Column:
    return F.concat(F.lit("blogs-"), month, F.when(part == 1, "").otherwise(F.concat(F.lit("-"), part.cast("string"))), F.lit(".xml"))


def card_fit(width: Column, height: Column) -> Column:
    return F.when((width >= 600) & (height >= 315), "large").when((width >= 200) & (height >= 200), "small").otherwise("none")


#: Slugs that name the directory's own pages.
RESERVED = (
    "api submit search opml llms.txt robots.txt sitemap.xml about feeds blog blogs news podcasts music videos comics lives reels topics authors feed admin static _next favicon.ico"
).split()


def is_reserved(slug: Column) -> Column:
    return slug.isin(RESERVED)


def published(value: Column) -> Column:
    """Seconds since 1970 of a date in text, the smallest number where it is none."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(value)), F.lit(-(2**62)))


#: Platforms whose pages are no sites, and those whose subdomains are.
PLATFORM_HOSTS = (
    "amazon.com ebay.com etsy.com facebook.com instagram.com linkedin.com pinterest.com quora.com reddit.com threads.net tiktok.com tumblr.com twitter.com walmart.com wikipedia.org x.com yelp.com "
    "youtube.com youtu.be"
).split()
BLOG_PLATFORM_APEXES = "blogger.com blogspot.com bearblog.dev ghost.io medium.com micro.blog substack.com wordpress.com write.as".split()
#: Endings of files that are no pages.
FILES = r"(?i)\.(?:pdf|jpe?g|png|gif|webp|svg|mp[34]|zip|docx?|xlsx?)$"


def is_candidate_link(link: Column) -> Column:
    """A page of a site over http(s), and no file, platform or front page of a blogging platform."""
    parts = r"(?i)^\s*https?:/*(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(link, parts, 1)), r"^www\.", "")
    apex = apex_of(host)
    front = apex.isin(BLOG_PLATFORM_APEXES) & (host == apex)
    return F.coalesce((host != "") & ~apex.isin(PLATFORM_HOSTS) & ~front & ~F.regexp_extract(link, parts, 2).rlike(FILES), F.lit(False))


def playlist_feed_url(playlist_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?playlist_id="), playlist_id)


def instance_feed_url(host: Column, live: bool = False) -> Column:
    return F.concat(F.lit("https://"), host, F.lit("/feeds/videos.xml?isLive=true" if live else "/feeds/videos.xml"))


#: Where feeds often are.
FEED_PATHS = ["/feed", "/feed.xml", "/rss", "/rss.xml", "/atom.xml", "/index.xml", "/feed/", "/feeds/posts/default", "/?feed=rss2", "/feed.json"]
#: Types of feeds.
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/feed+json", "application/xml", "text/xml", "application/json"]


def guess_feed_urls(site: Column) -> Column:
    """Addresses at which a site's feed often is, none where the site's own is no address."""
    origin = F.lower(F.regexp_extract(site, r"(?i)^(https?://[^/?#]+)", 1))
    return F.when(origin == "", F.array().cast("array<string>")).otherwise(F.transform(F.array(*map(F.lit, FEED_PATHS)), lambda p: F.concat(origin, p)))


def looks_like_feed(content_type: Column, body: Column, url: Column | None = None) -> Column:
    """A playlist, or by its type, of which plain JSON must look like a feed, or by what it begins with."""
    kind, text = F.lower(F.coalesce(content_type, F.lit(""))), F.coalesce(body, F.lit(""))
    typed = F.exists(F.array(*map(F.lit, FEED_TYPES)), lambda t: F.contains(kind, t))
    bare = kind.contains("json") & ~kind.contains("feed+json")
    head = F.lower(F.substring(text, 1, 2000))
    starts = head.rlike(r"<rss\b") | head.rlike(r"<feed\b[^>]*xmlns") | head.rlike(r"<rdf:rdf\b") | head.rlike(r'"version"\s*:\s*"https://jsonfeed\.org')
    listed = looks_like_playlist(content_type, body, F.lit("") if url is None else url)
    return listed | F.when(typed, ~bare | text.rlike(r'"(?:items|version)"\s*:')).otherwise(starts)


def is_picture(html: Column) -> Column:
    from skein.functions.text import text_length

    return F.coalesce(html.rlike(r"(?i)<img\b"), F.lit(False)) & (text_length(html) < EPISODE_CHARS)


def is_stream(mime: Column) -> Column:
    return F.coalesce(F.lower(mime).contains("mpegurl"), F.lit(False))


def is_watchable(kind: Column) -> Column:
    return kind.isin("video", "youtube", "peertube")


def lanes_offered(kind: Column) -> Column:
    """The lanes a post may wait in; reading is always one."""
    lane = lane_for(kind)
    return F.when(lane == "read", F.array(F.lit("read"))).otherwise(F.array(lane, F.lit("read")))


def peertube_embed(page: Column, url: Column, mime: Column) -> Column:
    """The player of a video's page, where the file is a video on the same host."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    host = lambda x: F.lower(F.regexp_extract(x, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    origin = F.lower(F.regexp_extract(page, r"(?i)^(https?://)(?:[^/?#@]*@)?([^/?#]+)", 1))
    place = F.regexp_replace(F.lower(F.regexp_extract(page, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)", 1)), F.when(origin == "https://", ":443$").otherwise(":80$"), "")
    video = F.regexp_extract(page, r"(?i)^https?://[^/?#]+(?-i:/w/|/videos/watch/)([A-Za-z0-9_-]{6,})/?(?:[?#].*)?$", 1)
    ok = kind.startswith("video/") & (kind != "video/youtube") & (video != "") & (host(page) == host(url))
    return F.when(ok, F.concat(origin, place, F.lit("/videos/embed/"), video))


def playable_media(url: Column, mime: Column, page: Column | None = None) -> Column:
    """Kind and source over https, null where there is nothing to play."""
    kind = media_kind(url, mime, page)
    source = url if page is None else F.when(kind == "peertube", peertube_embed(page, url, mime)).otherwise(url)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.regexp_replace(source, "^http:", "https:").alias("src")))


def thumb_src(raw: Column) -> Column:
    """An image's address over https, of bounded length."""
    u = F.regexp_replace(F.trim(raw), "^http:", "https:")
    return F.when(u.rlike("^https://") & (F.length(u) <= 1000), u)


#: Pixels of the smallest picture shown on a card, and of a large one.
CARD_MIN, CARD_LARGE_WIDTH, CARD_LARGE_HEIGHT = 200, 600, 315


def feed_card(url: Column, width: Column, height: Column) -> Column:
    """(url, width, height, large) of a picture that is large enough for a card; null otherwise."""
    at = thumb_src(url)
    large = (width >= CARD_LARGE_WIDTH) & (height >= CARD_LARGE_HEIGHT)
    return F.when(at.isNotNull() & (width >= CARD_MIN) & (height >= CARD_MIN), F.struct(at.alias("url"), width.alias("width"), height.alias("height"), large.alias("large")))


def post_thumb(*images: Column) -> Column:
    return F.coalesce(*[thumb_src(i) for i in images])


def parse_chunk_filename(name: Column) -> Column:
    """Month and part of a file's name; the first part is not spelt out."""
    month, part = (F.regexp_extract(name, r"^blogs-(\d{4}-\d{2})(?:-(\d{1,9}))?\.xml$", i) for i in (1, 2))
    number = F.when(part == "", 1).otherwise(part.try_cast("int"))
    return F.when((month != "") & (number >= 1) & (part != "1"), F.struct(month.alias("month"), number.alias("part")))


def river_limit(raw: Column, fallback: int = RIVER_DEFAULT) -> Column:
    """A number between 1 and 200; the fallback where it is none or zero."""
    asked = js_number(raw)
    return clamp(F.when(asked.isNull() | (asked == 0), F.lit(float(fallback))).otherwise(asked), 1, 200).cast("double")


def fold(text: Column) -> Column:
    """Without accents, in lower case, white space folded."""
    return F.trim(F.regexp_replace(F.lower(unaccented(text)), r"[\s\x{a0}\x{feff}]+", " "))


def terms(query: Column) -> Column:
    return F.filter(F.split(F.trim(fold(query)), r"\s+"), lambda t: t != "")


#: What reasons in code mean.
REASONS = {
    "already-indexed": "already in the directory",
    "comments-feed": "a comment feed, not a blog",
    "partial-feed": "a tag or category feed",
    "too-few-items": "too few entries",
    "abandoned": "nothing posted in over 18 months",
    "duplicate-titles": "every entry has the same title",
    "unlinked-items": "entries link nowhere",
    "undated": "no dates on any entry",
    "untitled": "no title",
    "low-score": "did not score high enough",
    "no-feed-found": "no feed on the site",
    "timeout": "site did not respond",
    "fetch-failed": "site could not be reached",
    "blocked-host": "not a public address",
    "off-topic": "not about what was searched for",
    "blocked-redirect": "redirected somewhere we will not follow",
    "invalid-url": "not a usable address",
}


def explain(raw: Column) -> Column:
    """One code, or a JSON list of them, in words; answers of servers by their number."""
    value = F.coalesce(raw, F.lit(""))
    codes = F.when(value.startswith("["), F.coalesce(F.from_json(value, "array<string>"), F.array(value))).otherwise(F.array(value))
    named = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))])

    def words(code: Column) -> Column:
        number = F.regexp_extract(code, r"^http-(\d{3})$", 1)
        said = (F.when(number == "", code).when(number == "403", "site refused us (403)").when(number == "404", "page not found (404)").when(number == "429", "site rate-limited us (429)")
                .when(number >= "500", F.concat(F.lit("site is erroring ("), number, F.lit(")"))).otherwise(F.concat(F.lit("site answered "), number)))
        return F.coalesce(F.try_element_at(named, code), said)

    return F.when(value == "", "unknown").otherwise(F.coalesce(F.nullif(F.array_join(F.transform(codes, words), ", "), F.lit("")), F.lit("unknown")))


def described(event: Column, status: Column, subject: Column, amount: Column, detail: Column) -> Column:
    """What a line of the log says: of a feed that was crawled in a sentence, of other events what they carry."""
    feed, posts = F.coalesce(subject, F.lit("a feed")), F.coalesce(amount, F.lit(0)).cast("long")
    crawled = F.concat(F.lit("crawled "), feed, F.lit(" — "), F.when(posts == 0, "nothing new").otherwise(F.concat(F.format_number(posts, 0), F.lit(" new "), F.when(posts == 1, "post").otherwise("posts"))))
    failed = F.concat(feed, F.lit(" could not be crawled — "), F.coalesce(detail, F.lit("unknown")))
    carried = F.concat_ws(" ", F.nullif(subject, F.lit("")), F.nullif(detail, F.lit("")))
    return F.when((event == "feed") & (status == "error"), failed).when(event == "feed", crawled).otherwise(carried)


def text_line(at: Column, event: Column, status: Column, subject: Column, amount: Column, detail: Column, ms: Column) -> Column:
    """A line of the log as text: moment, level and event in columns, what it says, and how long it took."""
    pad = lambda x, n: F.when(F.length(x) < n, F.rpad(x, n, " ")).otherwise(x)
    took = F.when(ms.isNull(), "").otherwise(F.concat(F.lit(" ("), ms.cast("string"), F.lit("ms)")))
    moment = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(moment, F.lit(" "), pad(F.coalesce(status, F.lit("info")), 5), F.lit(" "), pad(event, 16), F.lit(" "), described(event, status, subject, amount, detail), took)


def playlist_extension(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"(\.(?:m3u8?|pls|playlist))$", 1), F.lit(""))


def has_playlist_header(body: Column) -> Column:
    return F.coalesce(F.lower(F.substring(F.regexp_replace(body, "^[﻿\\s]+", ""), 1, 40)).rlike(r"^(#extm3u|\[playlist\])"), F.lit(False))


def vod_seconds(text: Column) -> Column:
    """Whole running time of a stream that has an end; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)^#EXTINF\s*:\s*([\d.]+)"), F.lit(1))
    total = F.aggregate(found, F.lit(0.0), lambda t, x: t + F.coalesce(F.regexp_extract(x, r"^(\d*\.?\d*)", 1).try_cast("double"), F.lit(0.0)))
    return F.when(text.rlike(r"(?im)^#EXT-X-ENDLIST\b") & (total > 0), F.floor(total).cast("long"))


#: What only numbers.
NUMBERING = r"(?i)^(?:\d+|s\d+\s*e\d+|(?:ep|episode|track|part|no|pt)\.?\s*\d+)$"


def split_artist(raw: Column, declared: Column | None = None) -> Column:
    """(title, author) of ``Artist - Title`` unless the left side only numbers or the author is declared."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    left, right = (F.trim(F.regexp_extract(text, r"^(.{1,80}?)\s+-\s+(.+)$", i)) for i in (1, 2))
    split = F.when((left != "") & ~left.rlike(NUMBERING), F.struct(right.alias("title"), left.alias("author"))).otherwise(F.struct(text.alias("title"), F.lit("").alias("author")))
    given = F.lit("") if declared is None else F.coalesce(declared, F.lit(""))
    return F.when(given != "", F.struct(text.alias("title"), given.alias("author"))).otherwise(split)


def entity(code: Column) -> Column:
    """The character of a code point, nothing for what is none; a byte order mark goes before it, as U+FEFF by itself would be read as one."""
    return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32"))


#: What begins the words of a site's furniture, and the fewest characters of a title.
FURNITURE = (
    r"(?i)^(?:read(?: more| the rest)?|continue reading|older posts?|newer posts?|next page|previous page|subscribe|sign (?:up|in)|log ?in|contact(?: us)?|privacy policy|terms(?: of service)?"
    r"|back to top|view all|see all|learn more|share this)\b"
)
TITLE_CHARS = 12


def usable_title(title: Column) -> Column:
    return (F.length(title) >= TITLE_CHARS) & ~title.rlike(FURNITURE)


def body_length(*bodies: Column) -> Column:
    """Visible length of the first body that is not empty."""
    from skein.functions.text import text_length

    return text_length(F.coalesce(*[F.nullif(b, F.lit("")) for b in bodies], F.lit("")))


def absolute_image(raw: Column, base: Column) -> Column:
    """An image's address against its page's, web addresses only: whole, without a scheme, from the root, or beside the page."""
    r, b = F.trim(raw), F.regexp_replace(base, r"[?#].*$", "")
    site = F.regexp_extract(b, r"^(https?://[^/]+)", 1)
    folder = F.when(b.rlike(r"^https?://[^/]+/"), F.regexp_extract(b, r"^(https?://[^/]+/(?:.*/)?)", 1)).otherwise(F.concat(site, F.lit("/")))
    joined = (F.when(r.rlike(r"^https?://"), r).when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(r.startswith("//"), F.concat(F.regexp_extract(b, r"^(https?:)", 1), r))
              .when(r.startswith("/"), F.concat(site, r)).otherwise(F.concat(folder, F.regexp_replace(r, r"^(\./)+", ""))))
    return F.when((r != "") & joined.rlike("^https?://."), joined)


def hash_ip(ip: Column, salt: str | None) -> Column:
    """The first 32 hex digits of HMAC-SHA256; null where either is unset. The two hashes of the code are taken by Spark, over pads of the constant salt."""
    if not salt:
        return F.lit(None).cast("string")
    key = salt.encode() if len(salt.encode()) <= 64 else hashlib.sha256(salt.encode()).digest()
    inner, outer = (bytes(k ^ pad for k in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), ip.cast("binary")), 256))
    return F.when(ip != "", F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 32))