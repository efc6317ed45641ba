"""Expressions over columns that are derived from feeds: each beside SQL that knows how the column was made, and not how it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.plans.reads import add
from skein.plans.texts import STEM
from skein.plans.verdicts import derived
from skein.sources import sinks

N = "cast(id as string)"


def pick(*cases: str) -> str:
    """One of some SQL texts by the id."""
    return f"case id % {len(cases)} " + " ".join(f"when {i} then {c}" for i, c in enumerate(cases)) + " end"


#: name, the column, its value, expression.
COLUMNS = [
    ("sca02_normalize_kinds", pick("category || ', NEWS'", "upper(category) || ',' || category", f"'x' || {N}"), pick("list_sort(list_distinct([category, 'news']))", "[category]", "null"), lambda x: F.array_sort(S.normalize_kinds(F.split(x, ",")))),
    ("sca04_like_term", f"replace(title, ' ', '%') || '_' || {N}", f"replace(title, ' ', '\\%') || '\\_' || {N}", lambda x: F.regexp_replace(x, r"([%_])", r"\\$1")),
    ("sca09_is_reserved", pick("slug", "'api'", "'feed'"), "id % 3 <> 0", lambda x: S.is_reserved(x)),
    ("sca11_plausible_host", pick(f"'host' || {N} || '.example'", f"'host' || {N}", "'10.' || cast(id % 256 as string) || '.0.1'", "'10.' || cast(256 + id % 256 as string) || '.0.1'", f"'-a' || {N} || '.com'", f"'a_' || {N} || '.com'"), "id % 6 in (0, 2)", lambda x: S.plausible_host(x)),
    ("sca15_playlist_feed_url", f"'PL' || {N}", f"'https://www.youtube.com/feeds/videos.xml?playlist_id=PL' || {N}", lambda x: S.playlist_feed_url(x)),
    ("sca16_instance_feed_url", f"'v' || {N} || '.example'", f"'https://v' || {N} || '.example/feeds/videos.xml'", lambda x: S.instance_feed_url(x)),
    ("sca25_normalize_segment", f"' ' || upper(category) || ' '", "category", lambda x: S.normalize_segment(x)),
    ("sca26_normalize_email", f"'  Ann' || {N} || '@Example.ORG '", f"'ann' || {N} || '@example.org'", lambda x: S.normalize_email(x)),
    ("sca37_is_stream", pick("'application/x-mpegURL'", "'audio/mpeg; ' || title", "'Application/Vnd.Apple.MPEGURL; ' || title", "null"), "coalesce(id % 4 in (0, 2), false)", lambda x: S.is_stream(x)),
    ("sca38_is_watchable", pick("'video'", "'audio'", "'peertube'", "category", "'youtube'"), "case when id % 5 = 3 then category = 'video' else id % 5 <> 1 end", lambda x: S.is_watchable(x)),
    ("sca41_thumb_src", pick(f"' http://i.example/' || {N}", f"'ftp://' || {N}", f"'https://i.example/' || {N}", "repeat('https://i.example/', 60)"), pick(f"'https://i.example/' || {N}", "null", f"'https://i.example/' || {N}", "null"), lambda x: S.thumb_src(x)),
    ("sca55_playlist_extension", pick(f"'https://a/' || {N} || '.M3U8?y'", f"'https://a/' || {N} || '.mp3'", f"'https://a/' || {N} || '.pls#x'", f"'https://a/x.m3u/' || {N}"), pick("'.m3u8'", "null", "'.pls'", "null"), lambda x: S.playlist_extension(x)),
    ("sca56_has_playlist_header", pick("'  #EXTM3U' || chr(10) || title", "'[Playlist]' || title", "'<html>' || title", "title || '#EXTM3U'"), "id % 4 < 2", lambda x: S.has_playlist_header(x)),
    ("sca64_terms", "' Été  ' || title || ' '", f"['ete', 'order', {N}]", lambda x: S.terms(x)),
    ("src32_playlist_ids", f"'\"playlistId\":\"PL' || {N} || '\" \"playlistId\":\"PLb\" \"playlistId\":\"PL' || {N} || '\"'", f"list_sort(['PL' || {N}, 'PLb'])", lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit('"playlistId":"([^"]+)"'), F.lit(1))))),
    ("src47_playable", pick(f"'https://a/' || {N} || '.mp3'", f"'file:/' || {N}", "feed_url"), "id % 3 <> 1", lambda x: sinks.playable(x, F.lit("audio/mpeg"))),
    ("txt01_fts_query", pick("title", f"'a \"' || {N}"), pick(f"'\"Order\" \"' || {N} || '\"'", f"'\"a\" \"\"\"' || {N} || '\"'"), lambda x: T.fts_query(x)),
    ("txt12_stem", pick("'huskies'", "'dogs'", "'boxes'", "slug || 's'", "'glass'"), STEM.replace("(w", "(x").replace(" w ", " x ").replace("w,", "x,").replace("else w", "else x"), lambda x: T.stem(x)),
    ("txt19_is_series_feed", pick(f"'https://y/feeds?playlist_id=' || {N}", "feed_url", f"feed_url || '?a=1&playlist_id=' || {N}", f"'https://y/my_playlist_id=' || {N}"), "id % 4 in (0, 2)", lambda x: T.is_series_feed(x)),
    ("txt28_says_it_is_news", pick("'Breaking news of ' || title", "'My garden ' || title", f"'newsletter ' || {N}", "'the NEWSPAPER ' || title"), "id % 4 in (0, 3)", lambda x: T.says_it_is_news(x)),
    ("txt33_date", pick("replace(cast(created_at as string), ' ', 'T')", "title"), "case when id % 2 = 0 then created_at::timestamp end", lambda x: F.try_to_timestamp(x).cast("timestamp_ntz")),
    ("txt42_normalize_name", "'  ' || replace(title, ' ', '   ') || ' '", f"'order ' || {N}", lambda x: T.normalize_name(x)),
]
for _n, _x, _v, _f in COLUMNS:
    _duck = _x.replace("DIV", "//")
    add(_n, f"with c as (select *, {_duck} as x from feeds) select id, {_v} as v from c",
        lambda m, x=_x.replace('(id DIV 3)', '(id div 3)').replace('{', '{{').replace('}', '}}'), f=_f: derived(m, f"select id, {x} as x from feeds", feeds=m.feeds).select("id", f(F.col("x")).alias("v")))

LISTS = "select id, " + pick("'audio/x-mpegurl'", "'text/html'", "'text/plain'", "null") + " as kind, " + pick("'x'", "'<html>' || title", "'  #EXTM3U'", "title", "'<p>'") + " as body, " + pick("feed_url", f"'https://a/' || {N} || '.pls'", "''") + " as url from feeds"
add("src10_looks_like_playlist", "select id, id % 4 = 0 or id % 5 = 2 or (id % 3 = 1 and id % 5 not in (1, 4)) as v from feeds", lambda m: derived(m, LISTS, feeds=m.feeds).select("id", S.looks_like_playlist(F.col("kind"), F.col("body"), F.col("url")).alias("v")))
BACK = "select id, " + pick(f"'<a class=\"x\" rel=\"me nofollow\" href=\"https://A.example/@x' || {N} || '/\">'", f"'<a href=\"https://a.example/@x' || {N} || '\">'", f"'<link href=\"https://a.example/@x' || {N} || '\" rel=\"me\">'", f"'<a rel=\"home\" href=\"https://a.example/@x' || {N} || '\">'", f"'<a rel=\"me\" href=\"https://a.example/@y' || {N} || '\">'") + f" as html, 'https://a.example/@x' || {N} as url from feeds"
add("txt37_links_back", "select id, id % 5 in (0, 2) as v from feeds", lambda m: derived(m, BACK, feeds=m.feeds).select("id", T.links_back(F.col("html"), F.col("url")).alias("v")))
add("sca60_entity", "select id, case when id % 1200000 between 55296 and 57343 then null when id % 1200000 between 1 and 1114111 then chr((id % 1200000)::int) end as v from (select id * 19 as id from feeds)", lambda m: m.feeds.select((F.col("id") * 19).alias("id")).select("id", S.entity((F.col("id") % 1200000)).alias("v")))
