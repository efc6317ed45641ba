"""Expressions whose rule has many cases: each case is a value and what it must give, and feeds take turns in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.functions.forms import bound
from skein.plans.columns import N, pick
from skein.plans.reads import add
from skein.plans.verdicts import derived


def part(x: Column, i: int) -> Column:
    """A value in a case that has several, parted by bars; nothing is null."""
    return F.nullif(F.get(F.split(x, r"\|"), F.lit(i)), F.lit(""))


_INF = "'#EXTINF:' || cast(id % 7 as string) || '.6,' || chr(10)"
_PATHS = "list_transform(['/feed', '/feed.xml', '/rss', '/rss.xml', '/atom.xml', '/index.xml', '/feed/', '/feeds/posts/default', '/?feed=rss2', '/feed.json'], lambda p: {} || p)"

#: name: (expression, cases of a value and its result)
CASES: dict[str, tuple[Callable[[Column], Column], list[tuple[str, str]]]] = {
    "sca08_slugify": (T.slugify, [
        ("'  ' || title || '!! '", f"'order-' || {N}"), ("'É ' || title", f"'e-order-' || {N}"), (f"'--x' || {N} || '--'", f"'x' || {N}"), (f"'Don''t panic ' || {N}", f"'dont-panic-' || {N}"),
        (f"'Ő‘s ﬁne ½ ' || {N}", f"'o-s-fine-1-2-' || {N}"), (f"'ブログ ' || {N}", f"'ブログ-' || {N}"), ("'?!'", "''"), ("repeat('ab ', 40)", "repeat('ab-', 26) || 'ab'")]),
    "sca10_normalize_url": (S.normalize_url, [
        ("feed_url || '#top'", "feed_url"), ("'mailto:a@b.org'", "null"), (f"'//b.org/x' || {N}", f"'https://b.org/x' || {N}"), (f"'  Example.com/A b' || {N}", f"'https://example.com/A%20b' || {N}"), ("'example.com:8080/x'", "null"), (f"'HTTP://a.example:80?q=' || {N}", f"'http://a.example/?q=' || {N}"),
        (f"'https://u:p@a.example:444/' || {N}", f"'https://u:p@a.example:444/' || {N}"), ("'ftp://a.example/'", "null"), ("'https://localhost/'", "null"), ("'zombies.)'", "null"), ("'javascript:x'", "null"), ("' '", "null")]),
    "sca13_is_candidate_link": (S.is_candidate_link, [
        ("feed_url", "true"), (f"'https://www.youtube.com/' || {N}", "false"), (f"site_url || {N} || '.PDF?y'", "false"), (f"site_url || {N} || '?file=a.pdf'", "true"), (f"'https://m.facebook.com/' || {N}", "false"),
        (f"'https://a' || {N} || '.example/pic.svg'", "false"), (f"'ftp://a' || {N} || '.example/'", "false"), ("'https://www.medium.com/'", "false"), (f"'https://a' || {N} || '.medium.com/'", "true"), ("'no address'", "false")]),
    "sca27_is_transient": (lambda x: S.is_transient(part(x, 0), part(x, 1)), [
        (f"'error|' || {N}", "true"), ("'blocked|http-503'", "true"), ("'blocked|http-404'", "false"), ("'blocked|private'", "false"), ("'ok|http-503'", "false"), ("'blocked'", "false")]),
    "sca32_eta_label": (lambda x: S.eta_label(x.cast("double")), [
        ("cast(id % 47 + 1 as string)", "(id % 47 + 1)::varchar || 'h'"), ("cast(48 + id % 900 as string)", "floor((48 + id % 900) / 24 + 0.5)::bigint::varchar || 'd'"), ("'1.2'", "'1h'"), ("'49'", "'2d'"), ("'0.001'", "'1m'"), ("'0.5'", "'30m'"), ("null", "'—'")]),
    "sca34_media_kind": (lambda x: S.media_kind(part(x, 0), part(x, 1), part(x, 2)), [
        (f"'https://a/' || {N} || '|audio/mpeg'", "'audio'"), (f"'https://a/' || {N}", "'audio'"), (f"'https://a/' || {N} || '|video/mp4'", "'video'"), (f"'https://www.youtube.com/watch?v=' || {N} || '|Video/YouTube'", "'youtube'"), (f"'https://a/' || {N} || '|application/pdf'", "'audio'"),
        (f"'https://p.example/d.mp4|video/mp4|https://p.example/w/abcdef' || {N}", "'peertube'"), (f"'https://cdn.example/d.mp4|video/mp4|https://p.example/w/abcdef' || {N}", "'video'"), ("'|audio/mpeg'", "null")]),
    "sca35_is_episode": (lambda x: S.is_episode(part(x, 0), part(x, 1), part(x, 2).cast("long")), [("'https://a/b|audio/mpeg|' || cast(id % 2400 as string)", "id % 2400 < 1200"), (f"'https://a/' || {N}", "true"), ("'|audio/mpeg|5'", "false")]),
    "sca39_peertube_embed": (lambda x: S.peertube_embed(part(x, 0), part(x, 1), part(x, 2)), [
        (f"'https://P.example/w/abcdef' || {N} || '?x|https://p.example/d.mp4|video/mp4'", f"'https://p.example/videos/embed/abcdef' || {N}"),
        (f"'http://p.example:8080/videos/watch/b-cdef' || {N} || '/|https://p.example/d|Video/webm'", f"'http://p.example:8080/videos/embed/b-cdef' || {N}"),
        (f"'https://p.example/w/abcdef' || {N} || '|https://cdn.example/d.mp4|video/mp4'", "null"), (f"'https://p.example/w/abcdef' || {N} || '|https://p.example/d.mp3|audio/mpeg'", "null"),
        ("'https://p.example/w/abc|https://p.example/d.mp4|video/mp4'", "null"), (f"'https://p.example/x/' || {N} || '|https://p.example/d|video/mp4'", "null")]),
    "sca40_playable_media": (lambda x: F.concat_ws(" ", S.playable_media(part(x, 0), part(x, 1), part(x, 2))["kind"], S.playable_media(part(x, 0), part(x, 1), part(x, 2))["src"]), [
        (f"'http://a/' || {N} || '|audio/mpeg'", f"'audio https://a/' || {N}"), (f"'https://p.example/d.mp4|video/mp4|http://p.example/w/abcdef' || {N}", f"'peertube https://p.example/videos/embed/abcdef' || {N}"), ("'|audio/mpeg'", "''")]),
    "sca44_monogram": (S.monogram, [("'  ' || title", "'O'"), ("'  '", "'·'"), ("null", "'·'"), ("'éa'", "'É'"), ("'😀x'", "'😀'")]),
    "sca46_lane_for": (lambda x: S.lane_for(S.media_kind(part(x, 0), part(x, 1))), [(f"'https://a/' || {N} || '.mp3|audio/mpeg'", "'listen'"), ("'https://a/b|video/mp4'", "'watch'"), ("'https://a/b|video/youtube'", "'watch'"), ("'https://a/b'", "'listen'"), ("'|audio/mpeg'", "'read'")]),
    "sca47_lanes_offered": (lambda x: S.lanes_offered(S.media_kind(part(x, 0), part(x, 1))), [(f"'https://a/' || {N} || '.mp3|audio/mpeg'", "['listen', 'read']"), ("'https://a/b|video/mp4'", "['watch', 'read']"), ("'|'", "['read']")]),
    "sca48_chunk_filename": (lambda x: S.chunk_filename(part(x, 0), part(x, 1).cast("int")), [("'2024-01|1'", "'blogs-2024-01.xml'"), ("substr(cast(created_at as string), 1, 7) || '|' || cast(2 + id % 9 as string)", "'blogs-' || strftime(created_at, '%Y-%m') || '-' || (2 + id % 9)::varchar || '.xml'")]),
    "sca49_parse_chunk_filename": (lambda x: F.concat_ws("#", S.parse_chunk_filename(x)["month"], S.parse_chunk_filename(x)["part"].cast("string")), [
        ("'blogs-' || substr(cast(created_at as string), 1, 7) || '.xml'", "strftime(created_at, '%Y-%m') || '#1'"),
        ("'blogs-' || substr(cast(created_at as string), 1, 7) || '-' || cast(2 + id % 9 as string) || '.xml'", "strftime(created_at, '%Y-%m') || '#' || (2 + id % 9)::varchar"),
        ("'blogs-2024-01-1.xml'", "''"), ("'blogs-2024-01-0.xml'", "''"), ("'sitemap-2024-01-2.xml'", "''"), ("slug || '.xml'", "''")]),
    "sca50_river_limit": (S.river_limit, [(N, "least(greatest(case when id = 0 then 50 else id end, 1), 200)::double"), (f"' ' || {N} || ' '", "least(greatest(case when id = 0 then 50 else id end, 1), 200)::double"), (f"'-' || {N}", "case when id = 0 then 50 else 1 end::double"), ("'x'", "50::double"), ("null", "50::double"), ("'0'", "50::double"), ("'1e1'", "10::double")]),
    "sca51_normalise": (S.fold, [("'  Ünïted   É ' || title", f"'united e order ' || {N}"), (f"'Őze ﬁ ' || {N}", f"'oze ﬁ ' || {N}"), (f"'ガ ' || {N}", f"'ガ ' || {N}")]),
    "sca52_clamp": (lambda x: S.clamp_text(x, 12), [
        ("'short'", "'short'"), ("slug || '-without-a-space-in-it-at-all'", "substr(slug || '-without-a-space-in-it-at-all', 1, 12) || '…'"), ("'one two three four'", "'one two thre…'"), ("'four five six seven'", "'four five…'"), ("'twelve chars and more'", "'twelve chars…'"), (f"'ab cdefghijklm' || {N}", "'ab cdefghijk…'")]),
    "sca53_explain": (S.explain, [
        ("'abandoned'", "'nothing posted in over 18 months'"), (f"'other' || {N}", f"'other' || {N}"), ("'[\"undated\",\"untitled\"]'", "'no dates on any entry, no title'"), ("'http-404'", "'page not found (404)'"), ("'http-5' || cast(10 + id % 90 as string)", "'site is erroring (5' || (10 + id % 90)::varchar || ')'"),
        ("'http-418'", "'site answered 418'"), ("''", "'unknown'"), ("null", "'unknown'"), ("'[]'", "'unknown'"), ("'[broken'", "'[broken'")]),
    "sca58_split_artist": (lambda x: F.concat_ws("|", S.split_artist(x)["author"], S.split_artist(x)["title"]), [
        ("title || ' - Song'", "title || '|Song'"), (f"'Track ' || {N} || ' - Song'", f"'|Track ' || {N} || ' - Song'"), (f"'Pt. ' || {N} || ' - Song'", f"'|Pt. ' || {N} || ' - Song'"), (f"{N} || ' - Song'", f"'|' || {N} || ' - Song'"), ("title || ' – Song'", "'|' || title || ' – Song'"), ("title", "'|' || title")]),
    "sca59_vod_seconds": (S.vod_seconds, [
        (f"{_INF} || {_INF} || {_INF} || '#EXT-X-ENDLIST'", "nullif(floor(3 * (id % 7 + 0.6))::bigint, 0)"), (f"{_INF} || {_INF}", "null"), ("'#EXT-X-ENDLIST' || chr(10) || title", "null"), ("'#EXTINF:4.6,' || chr(10) || '#EXT-X-ENDLIST'", "4")]),
    "sca63_usable_title": (S.usable_title, [
        ("'Read more about ' || title", "false"), ("'A long enough ' || title", "true"), ("'Short'", "false"), ("'subscribe to ' || title", "false"), ("'Older posts here'", "false"), ("'Older postscript ' || title", "true"), ("'Click here for ' || title", "true"), ("'Contact us about ' || title", "false")]),
    "sca66_hms": (lambda x: S.hms(x.cast("double")), [("cast(id % 90000 as string)", "case when id % 90000 = 0 then '' else printf('%02d:%02d:%02d', id % 90000 // 3600, id % 90000 % 3600 // 60, id % 60) end"), ("'65.9'", "'00:01:05'"), ("'0'", "''"), ("null", "''"), ("'-3'", "''")]),
    "src24_guess_feed_urls": (S.guess_feed_urls, [("site_url || 'blog?x'", _PATHS.format("rtrim(site_url, '/')")), ("site_url", _PATHS.format("rtrim(site_url, '/')")), ("'no address'", "[]::varchar[]")]),
    "src25_looks_like_feed": (lambda x: S.looks_like_feed(part(x, 0), part(x, 1), part(x, 2)), [
        ("'|<rss version=''2''>' || title", "true"), ("'|<html>' || title", "false"), ("'| {\"version\": \"https://jsonfeed.org/version/1\", \"title\": \"' || title || '\"}'", "true"), ("'|{\"title\": \"' || title || '\"}'", "false"), ("'|<?xml?><feed xmlns=\"x\">' || title", "true"),
        ("'text/xml|<html>' || title", "true"), ("'application/json; charset=utf-8|{\"items\": []}'", "true"), ("'application/json|{\"a\": 1}'", "false"), ("'audio/x-scpls|x'", "true"), ("'|https://a.example/1.mp3|https://a.example/list.m3u'", "true"), ("'text/html|<feed>'", "false")]),
    "src29_is_blocked_address": (S.is_blocked_address, [
        ("cast(id % 256 as string) || '.' || cast(id % 251 as string) || '.5.4'", "id % 256 in (0, 10, 127) or id % 256 >= 224 or (id % 256 = 100 and id % 251 between 64 and 127) or (id % 256 = 169 and id % 251 = 254) or (id % 256 = 172 and id % 251 between 16 and 31) or (id % 256 = 192 and id % 251 = 168)"),
        ("'::ffff:10.0.0.' || cast(id % 256 as string)", "true"), ("'::FFFF:8.8.8.' || cast(id % 256 as string)", "false"), ("'192.0.5.' || cast(id % 256 as string)", "false"), ("'198.18.0.' || cast(id % 256 as string)", "false"),
        ("'::1'", "true"), ("'fe80::' || cast(id % 10 as string)", "true"), ("'fd00::' || cast(id % 10 as string)", "true"), ("'2001:db8::' || cast(id % 10 as string)", "false"), ("'1.2.3.999'", "true"), ("'host' || cast(id as string)", "true"), ("'1:2:3'", "true")]),
    "src30_retry_after": (lambda x: S.retry_after_seconds(x, F.lit("2001-01-01").cast("timestamp")), [
        (N, "least(id, 86400)::double"), ("' 999999 '", "86400::double"), ("'Mon, 01 Jan 2001 00:' || lpad(cast(id % 60 as string), 2, '0') || ':00 GMT'", "60.0 * (id % 60)"), ("null", "null"), ("'1.5'", "2::double"), ("'soon'", "null"), ("''", "null")]),
    "txt31_duration": (S.duration, [
        ("cast(id % 5000 as string)", "nullif(id % 5000, 0)"), ("cast(id % 90 as string) || ':' || lpad(cast(id % 60 as string), 2, '0')", "nullif(60 * (id % 90) + id % 60, 0)"), ("cast(id % 9 as string) || ':' || lpad(cast(id % 60 as string), 2, '0') || ':07'", "3600 * (id % 9) + 60 * (id % 60) + 7"),
        ("title", "null"), ("'1:150'", "210"), ("'0'", "null"), ("'1:2:3:4'", "null"), ("' 62.9 '", "62"), ("'-5'", "null")]),
    "txt43_clean_name": (T.clean_name, [
        (f"'by Ann B' || {N}", f"'Ann B' || {N}"), (f"'ann@x.org (Ann B' || {N} || ')'", f"'Ann B' || {N}"), (f"'Ann  B' || {N} || ' ·'", f"'Ann B' || {N}"), (f"'Written by Ann B' || {N} || ' |'", f"'Ann B' || {N}"), (f"'posted BY Ann B' || {N} || ' —'", f"'Ann B' || {N}"), (f"'Author: Ann B' || {N}", f"'Ann B' || {N}"), ("null", "''")]),
    "txt44_looks_like_person": (T.looks_like_person, [
        ("'Ann ' || upper(substr(category, 1, 1)) || substr(category, 2)", "true"), ("'Ann Team'", "false"), ("'Madonna'", "true"), ("title", "false"), ("'ann bee'", "true"), ("'keizerharm'", "false"), ("'KeizerHarm'", "false"), ("'McDonald'", "true"), ("'The Editors'", "false"), ("'ann@x.org'", "false"),
        ("'One two three four five six'", "false"), ("'bee'", "true"), (f"'user_' || {N}", "false"), ("'the newsroom'", "false")]),
    "txt45_split_bylines": (T.split_bylines, [
        ("'Ann Bee and Cy Dee, News Team'", "['Ann Bee', 'Cy Dee']"), ("'By Ann Bee; ' || title", "['Ann Bee']"), ("'Ann Bee with ANN BEE & Cy Dee'", "['Ann Bee', 'Cy Dee']"), ("'Sandy Anders / Cy'", "['Sandy Anders', 'Cy']"), ("''", "[]::varchar[]")]),
    "txt46_is_role_email": (T.is_role_email, [
        (f"'info@a' || {N} || '.org'", "true"), (f"'ann' || {N} || '@a.org'", "false"), ("title", "true"), (f"'News+' || {N} || '@a.org'", "true"), (f"'information@a' || {N} || '.org'", "true"), ("'jobs@a.org'", "true"), ("'editor@a.org'", "false"), ("'MAILTO:press.office@a.org?subject=x'", "true"), ("null", "true")]),
    "txt47_personal_email": (T.personal_email, [
        (f"'write to Ann' || {N} || '@a.org, please'", f"'ann' || {N} || '@a.org'"), ("'info@a.org ' || title", "null"), ("title", "null"), (f"'sales@a' || {N} || '.org'", "null"), (f"'editor@a' || {N} || '.org'", f"'editor@a' || {N} || '.org'")]),
    "txt49_classify_link": (lambda x: F.coalesce(bound(T.classify_link(x), lambda p: F.concat_ws(" ", p["network"], p["handle"], p["url"])), F.lit("")), [
        (f"'https://www.github.com/ann' || {N} || '/'", f"'github ann' || {N} || ' https://www.github.com/ann' || {N}"), (f"'https://github.com/ann/' || {N}", "''"), (f"'https://m.example/@ann' || {N}", f"'fediverse @ann' || {N} || '@m.example https://m.example/@ann' || {N}"),
        (f"'mailto:a' || {N} || '@b.org?x'", f"'email a' || {N} || '@b.org mailto:a' || {N} || '@b.org'"), ("'mailto:info@b.org'", "''"), ("site_url", "''"), (f"'https://bsky.app/profile/a' || {N} || '.example/'", f"'bluesky a' || {N} || '.example https://bsky.app/profile/a' || {N} || '.example'"),
        (f"'http://a-' || {N} || '.bandcamp.com/'", f"'bandcamp a-' || {N} || ' https://a-' || {N} || '.bandcamp.com/'"), (f"'https://linktr.ee/ann' || {N}", f"'linktree ann' || {N} || ' https://linktr.ee/ann' || {N}"), ("'nostr:npub1' || repeat('q', 58)", "'nostr npub1' || repeat('q', 58) || ' https://njump.me/npub1' || repeat('q', 58)"),
        (f"'xmpp:Ann' || {N} || '@Chat.example?join'", f"'xmpp ann' || {N} || '@chat.example xmpp:ann' || {N} || '@chat.example'"), (f"'https://www.youtube.com/@ann' || {N}", f"'youtube ann' || {N} || ' https://www.youtube.com/@ann' || {N}"), ("'https://youtube.com/channel/short'", "''"),
        (f"'https://de.linkedin.com/in/ann-' || {N}", f"'linkedin ann-' || {N} || ' https://de.linkedin.com/in/ann-' || {N}"), ("'https://orcid.org/0000-0002-1825-009x'", "'orcid 0000-0002-1825-009x https://orcid.org/0000-0002-1825-009x'"), (f"'https://old.reddit.com/user/ann' || {N}", f"'reddit ann' || {N} || ' https://old.reddit.com/user/ann' || {N}"), ("'nothing'", "''")]),
    "txt50_identity_key": (lambda x: T.identity_key(part(x, 0), part(x, 1), part(x, 2)), [
        (f"'https://ME' || {N} || '.example/|x|https://a.example/f'", f"'https://me' || {N} || '.example/'"), (f"'http://me.example:80/ann' || {N} || '/?utm_source=x&ref=y&p=1#top'", f"'https://me.example/ann' || {N} || '?p=1'"), (f"'| Ann  B' || {N} || '|https://www.A.example/f'", f"'ann b' || {N} || '@a.example'"), ("'||https://a.example/f'", "'@a.example'"), ("'|Ann'", "'ann@'")]),
}
for _name, (_f, _cases) in CASES.items():
    _x, _v = pick(*(c[0] for c in _cases)), pick(*(c[1] for c in _cases))
    add(_name, f"with c as (select * from feeds) select id, {_v} as v from c",
        lambda m, x=_x.replace("{", "{{").replace("}", "}}"), f=_f: derived(m, f"select id, {x} as x from feeds", feeds=m.feeds).select("id", f(F.col("x")).alias("v")))
