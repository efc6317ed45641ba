"""Expressions on single texts, each beside SQL over the same texts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import rows_of, rows_of_sql
from skein.functions import forms
from skein.functions import scalars as S
from skein.functions import text as T
from skein.plans.texts import STEM
from skein.sources import sinks


def literals(values):
    return "(values " + ", ".join("(" + ("null" if v is None else "'" + v.replace("'", "''") + "'") + ")" for v in values) + ") t(x)"


#: name, texts, SQL, expression: a row per text.
ON_TEXTS = [
    ("sca02_normalize_kinds", ["blog, NEWS", "x", "music,music"], "case when len(k) > 0 then list_sort(k) end from (select x, list_distinct(list_filter(list_transform(string_split(x, ','), lambda a: lower(trim(a))), lambda a: a in ('blog','news','podcast','music','video','comic','live','reel'))) as k from {t})", lambda x: F.array_sort(S.normalize_kinds(F.split(x, ",")))),
    ("sca04_like_term", ["50%", "a_b", "plain"], "replace(replace(x, '%', '\\%'), '_', '\\_')", lambda x: F.regexp_replace(x, r"([%_])", r"\\$1")),
    ("sca09_is_reserved", ["api", "my-blog", "feed"], "x in ('api', 'feed')", lambda x: S.is_reserved(x)),
    ("sca11_plausible_host", ["a.example", "localhost", "1.2.3.4", "-a.com", "a_b.com", "999.1.1.1"], "x in ('a.example', '1.2.3.4')", lambda x: S.plausible_host(x)),
    ("sca15_playlist_feed_url", ["PL1"], "'https://www.youtube.com/feeds/videos.xml?playlist_id=' || x", lambda x: S.playlist_feed_url(x)),
    ("sca16_instance_feed_url", ["v.example"], "'https://' || x || '/feeds/videos.xml'", lambda x: S.instance_feed_url(x)),
    ("sca25_normalize_segment", [" Audio ", ""], "lower(trim(x))", lambda x: F.lower(F.trim(x))),
    ("sca26_normalize_email", [" Ann@Example.ORG"], "lower(trim(x))", lambda x: F.lower(F.trim(x))),
    ("sca37_is_stream", ["application/x-mpegURL", "audio/mpeg"], "contains(lower(x), 'mpegurl')", lambda x: S.is_stream(x)),
    ("sca38_is_watchable", ["video", "audio", "peertube"], "x in ('video', 'peertube', 'youtube')", lambda x: S.is_watchable(x)),
    ("sca41_thumb_src", ["http://i.example/a.png", "ftp://x", "https://i.example/b"], "case when x like 'http%' then regexp_replace(x, '^http:', 'https:') end", lambda x: S.thumb_src(x)),
    ("sca55_playlist_extension", ["https://a/x.M3U8?y", "https://a/x.mp3"], "nullif(regexp_extract(lower(regexp_replace(x, '[?#].*$', '')), '(\\.(?:m3u8?|pls|playlist))$', 1), '')", lambda x: S.playlist_extension(x)),
    ("sca56_has_playlist_header", ["#EXTM3U", "[playlist]", "<html>"], "x <> '<html>'", lambda x: S.has_playlist_header(x)),
    ("sca64_terms", [" Été  news "], "['ete', 'news']", lambda x: S.terms(x)),
    ("src10_looks_like_playlist", ["#EXTM3U", "<p>"], "x = '#EXTM3U'", lambda x: S.has_playlist_header(x)),
    ("src32_playlist_ids", ['"playlistId":"PLa" "playlistId":"PLb" "playlistId":"PLa"'], "list_sort(list_distinct(regexp_extract_all(x, '\"playlistId\":\"([^\"]+)\"', 1)))", lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit('"playlistId":"([^"]+)"'), F.lit(1))))),
    ("src47_playable", ["https://a/x.mp3", "file:/x"], "x like 'https%'", lambda x: sinks.playable(x, F.lit("audio/mpeg"))),
    ("txt01_fts_query", ["two words", 'a "b'], "array_to_string(list_transform(string_split(x, ' '), lambda w: '\"' || replace(w, '\"', '\"\"') || '\"'), ' ')", lambda x: T.fts_query(x)),
    ("txt12_stem", ["huskies", "dogs", "boxes", "cat", "glass"], STEM.replace("(w", "(x").replace(" w ", " x ").replace("w,", "x,").replace("else w", "else x"), lambda x: T.stem(x)),
    ("txt19_is_series_feed", ["https://y/feeds?playlist_id=1", "https://y/"], "contains(x, 'playlist_id=')", lambda x: x.rlike("[?&]playlist_id=")),
    ("txt28_says_it_is_news", ["Breaking news", "My garden", "newsletter"], "x = 'Breaking news'", lambda x: T.says_it_is_news(x)),
    ("txt33_date", ["2026-08-01T10:00:00", "junk"], "try_cast(x as timestamp)", lambda x: F.try_to_timestamp(x).cast("timestamp_ntz")),
    ("txt42_normalize_name", ["  Ann   BEE "], "'ann bee'", lambda x: T.normalize_name(x)),
]


@pytest.mark.parametrize("name,values,sql,f", ON_TEXTS, ids=[t[0] for t in ON_TEXTS])
def test_literals(spark, name, values, sql, f):
    table = literals(values)
    query = f"select x, {sql.split(' from ')[0]} as v from {sql.split(' from ', 1)[1].replace('{t}', table)}" if "{t}" in sql else f"select x, {sql} as v from {table}"
    got = rows_of(spark.createDataFrame([(a,) for a in values], "x string").select("x", f(F.col("x")).alias("v")))
    assert got == rows_of_sql(duckdb.connect(), query)[1]


def test_framing(spark):
    cases = [("frame-ancestors 'none'", None, False), ("frame-ancestors *", "DENY", True), ("frame-ancestors 'none', frame-ancestors *", None, False), ("frame-ancestors https://o.example/", None, True), ("frame-ancestors *.example", None, True),
             ("frame-ancestors *.other", None, False), ("default-src *", "deny, sameorigin", False), (None, "allow-from https://o.example", False), (None, "something", True), (None, None, True), ("frame-ancestors http:", None, False), ("frame-ancestors", None, False)]
    d = spark.createDataFrame([(i, c, x) for i, (c, x, _) in enumerate(cases)], "i int, csp string, xfo string")
    got = {r.i: r.ok for r in d.select("i", T.framing_verdict(F.col("csp"), F.col("xfo"), "https://o.example")[0].alias("ok")).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(cases)}


def test_unicode_forms(spark):
    """Every code point by itself, and runs of characters whose marks stand in order, against Python's tables."""
    import unicodedata

    bare = lambda t: "".join(c for c in t if not "\u0300" <= c <= "\u036f")
    codes = [c for c in range(1, 0x30000, 3) if not 0xD800 <= c < 0xE000]
    texts = [chr(c) for c in codes] + ["Don't ő ブログ ﬁne ½ cafe\u0301 フ\u3099ロ ㍿", "İstanbul ŐŰ ñ Ａｂ", "plain"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select("t", forms.folded(F.col("t")).alias("a"), forms.unaccented(F.col("t")).alias("b"), forms.compatible(F.col("t")).alias("c")).collect()
    norm = unicodedata.normalize
    assert [(r.a, r.b, r.c) for r in got] == [(norm("NFC", bare(norm("NFKD", r.t))), norm("NFC", bare(norm("NFD", r.t))), norm("NFKC", r.t)) for r in got]


def test_plain_text(spark):
    cases = [("I&rsquo;ve &#x27;x&#39; &hellip; &unknown; &#8212;&#2;&#55296;", "I've 'x' … — "), ("<script>a</script>b<style>c</style>d<b>e</b>", "b d e"), ("&amp;lt; &#no; &#x;", "< &#no; &#x;"), (None, ""), ("a&nbsp;&nbsp;b\u00a0c", "a b c")]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.v for r in d.select("i", T.plain_text(F.col("t")).alias("v")).orderBy("i").collect()] == [v.strip() for _, v in cases]
    cut = lambda t, n: spark.range(1).select(T.summarize(F.lit(t), n)).first()[0]
    assert (cut("one two three", 7), cut("one two three", 6), cut("abcdef", 3), cut("one", 3)) == ("one two…", "one…", "abc…", "one")
