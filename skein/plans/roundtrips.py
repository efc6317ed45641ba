"""Documents written from the relations and read back by the parsers: their SQL is what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.operators import merges as M
from skein.operators import windows as W
from skein.plans.media import POSTS, _channels, _posts
from skein.plans.reads import add
from skein.plans.texts import HTML
from skein.plans.verdicts import derived
from skein.sources import documents, outlines, pages, sinks
from skein.sources.reframe import reframed
from skein.sources.tables import spread


def _read(m, fmt: str):
    """Posts of all channels, written in a format and parsed again."""
    written = sinks.syndicate(fmt, spread(_channels(m), "feed_id"), _posts(m)).select(F.concat(F.lit("https://read.example/"), "feed_id").alias("url"), F.col("document").alias("body"))
    out = documents.items_of(documents.read_feeds(written))
    return out.withColumn("feed_id", F.substring_index("feed_url", "/", -1).cast("long"))


PUBLISHED = "published_at::timestamp as published_at"
add("src02_read_rss", f"with {POSTS} select feed_id, pos - 1 as pos, title, url, guid, summary, {PUBLISHED}, audio_url as media from p",
    lambda m: _read(m, "rss").select("feed_id", "pos", "title", "url", "guid", "summary", F.col("published_at").cast("timestamp_ntz"), F.col("audio.url").alias("media")))
add("src03_read_atom", f"with {POSTS} select feed_id, pos - 1 as pos, title, url, url || '#' || guid as guid, summary, coalesce(published_at::timestamp, timestamp '1970-01-01') as published_at from p",
    lambda m: _read(m, "atom").select("feed_id", "pos", "title", "url", "guid", "summary", F.col("published_at").cast("timestamp_ntz")))
add("src05_read_json_feed", f"with {POSTS} select feed_id, pos - 1 as pos, title, url, guid, summary, {PUBLISHED} from p",
    lambda m: _read(m, "json").select("feed_id", "pos", "title", "url", "guid", "summary", F.col("published_at").cast("timestamp_ntz")))
PLAYED = "q as (select *, row_number() over (partition by feed_id order by pos) - 1 as k from p where audio_url is not null)"
LISTED = "select feed_id, k as pos, title, audio_url as url, nullif(audio_seconds, 0) as seconds from q"
for _name, _fmt in (("src07_read_m3u", "m3u"), ("src08_read_pls", "pls")):
    add(_name, f"with {POSTS}, {PLAYED} {LISTED}", lambda m, f=_fmt: _read(m, f).select("feed_id", "pos", "title", F.col("audio.url").alias("url"), F.col("audio.seconds").alias("seconds")))
RDF = """select id as feed_id, '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="x"><title>' || title
    || ' &amp; co</title><description>d</description></channel><item rdf:about="https://r.example/' || cast(id as string) || '"><title>One &lt;b&gt;</title><dc:creator>Ann Bee</dc:creator><dc:date>2001-02-03T04:05:06Z</dc:date></item></rdf:RDF>' as body from feeds"""
add("src04_read_rdf", "select id as feed_id, 'rdf' as format, title || ' & co' as title, 'https://r.example/' || id::varchar as url, 'One <b>' as item, 'Ann Bee' as author, timestamp '2001-02-03 04:05:06' as published_at from feeds",
    lambda m: derived(m, RDF, feeds=m.feeds).select("feed_id", documents.parsed("body", F.lit("")).alias("f")).select(
        "feed_id", "f.format", "f.title", F.col("f.items")[0]["url"].alias("url"), F.col("f.items")[0]["title"].alias("item"), F.col("f.items")[0]["author"].alias("author"), F.col("f.items")[0]["published_at"].cast("timestamp_ntz").alias("published_at")))
HLS = """select id, '#EXTM3U' || chr(10) || '#EXT-X-TARGETDURATION:9' || chr(10) || repeat('#EXTINF:8.5,' || chr(10) || 'part.ts' || chr(10), cast(id % 4 as int)) || '#EXTINF:' || cast(id % 8 as string) || '.0,' || chr(10) || 'last.ts' || chr(10)
    || case when id % 3 = 0 then '#EXT-X-ENDLIST' else '' end as body from feeds"""
add("src09_read_hls", "select id, case when id % 3 = 0 then 'video' else 'live' end as kind, case when id % 3 = 0 then round_even(8.5 * (id % 4) + id % 8, 0)::bigint end as seconds from feeds",
    lambda m: derived(m, HLS, feeds=m.feeds).select("id", documents.parsed("body", F.lit("https://h.example/a.m3u8")).alias("f")).select("id", "f.kind", F.col("f.items")[0]["audio"]["seconds"].alias("seconds")))
OPML = """select id, '<opml><body><outline text="A"><outline type="rss" text="' || replace(title, ' ', ' &amp; ') || '" xmlUrl="' || feed_url || '?a=1&amp;b=2" htmlUrl="' || site_url || '"/></outline><OUTLINE xmlurl=''' || upper(feed_url) || '?A=1&amp;B=2''/><outline xmlUrl="https://other.example/"/></body></opml>' as body from feeds"""
OPML_ENTRY = "array<struct<url:string,title:string,site_url:string>>"
add("src12_read_opml", "with f as (select id, 0 as pos, feed_url || '?a=1&b=2' as url, replace(title, ' ', ' & ') as title, site_url from feeds union all select id, 1, 'https://other.example/', null, null from feeds) select * from f",
    lambda m: derived(m, OPML, feeds=m.feeds).select("id", F.posexplode(outlines.read_opml("body")).alias("pos", "e")).select("id", "pos", "e.*"))
LINES = "select id, case id % 5 when 0 then '# only a note' when 1 then '' when 2 then feed_url || '   # a note' when 3 then ' ' || feed_url else 'not an address' end as value from feeds"
add("src16_read_list", "select distinct feed_url as url from feeds where id % 5 in (2, 3)", lambda m: outlines.parse_list(derived(m, LINES, feeds=m.feeds)))
add("src06_read_playlists", "select id, case when id % 2 = 0 then 'Song ' || id::varchar else 'Ann Bee - Song' end as shown, case when id % 2 = 1 then 'Ann Bee' end as author, id % 60 + 1 as seconds from feeds",
    lambda m: derived(m, "select id, '#EXTM3U' || chr(10) || '#EXTINF:' || cast(id % 60 + 1 as string) || ',' || case when id % 2 = 0 then 'Song ' || cast(id as string) else 'Ann Bee - Song' end || chr(10) || 'a.mp3' as body from feeds", feeds=m.feeds)
    .select("id", documents.parsed("body", F.lit("https://p.example/list.m3u")).alias("f")).select("id", F.col("f.items")[0].alias("i"))
    .select("id", F.concat(F.coalesce(F.concat("i.author", F.lit(" - ")), F.lit("")), "i.title").alias("shown"), "i.author", "i.audio.seconds"))

add("src57_topics_for_sitemap", "with topics as (select k.slug as slug, min(k.keyword) as keyword, count(distinct feed_id) as feed_count from feed_keywords k join feeds f on f.id = k.feed_id where f.status <> 'dead' group by k.slug having count(distinct feed_id) >= 2) select slug, feed_count from topics order by feed_count desc, slug limit 20000",
    lambda m: m.topics.orderBy(F.col("feed_count").desc(), "slug").limit(20000).select("slug", "feed_count"))
add("src43_build_json_feed", f"""with {POSTS}, b as (select feed_id, string_agg('{{"id":' || to_json(guid) || ',"url":' || to_json(url) || ',"title":' || to_json(title) || ',"content_text":' || to_json(summary) || coalesce(',"date_published":"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '.000Z"', '') || '}}', ',' order by pos) as items from p group by 1)
    select f.id as feed_id, '{{"version":"https://jsonfeed.org/version/1.1","title":' || to_json(title) || ',"home_page_url":' || to_json(site_url) || coalesce(',"description":' || to_json(description), '') || coalesce(',"items":[' || items || ']', '') || '}}' as document from feeds f left join b on b.feed_id = f.id""",
    lambda m: sinks.syndicate("json", _channels(m), _posts(m)))
_MD = "regexp_replace({0}, '([\\\\`*_{{}}\\[\\]<>()#+!|-])', '\\\\\\1', 'g')"
add("src44_build_markdown", f"""with {POSTS}, b as (select feed_id, string_agg(chr(10) || '- [' || {_MD.format('title')} || '](' || url || ')' || coalesce(' – ' || strftime(published_at, '%Y-%m-%d'), ''), '' order by pos) as body from p group by 1)
    select f.id as feed_id, '# ' || {_MD.format('title')} || chr(10) || coalesce(body, '') || chr(10) as document from feeds f left join b on b.feed_id = f.id""", lambda m: sinks.syndicate("md", _channels(m), _posts(m)))
add("src21_page_title", f"with h as (select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as html from pages) select page_id, {HTML} as title from h", lambda m: m.base("pages").select("page_id", pages.page_title(F.col("html")).alias("title")))
add("sca07_text_length", f"select page_id, length({HTML})::bigint as v from pages", lambda m: m.base("pages").select("page_id", T.text_length(F.col("html")).cast("long").alias("v")))
add("sca62_body_length", f"with b as (select page_id, case when page_id % 3 = 0 then '<p>short</p>' else html end as html from pages) select page_id, length({HTML})::bigint as v from b",
    lambda m: m.base("pages").select("page_id", S.body_length(F.expr("case page_id % 3 when 0 then '<p>short</p>' when 1 then '' end"), F.col("html")).cast("long").alias("v")))
add("sca36_is_picture", f"with b as (select page_id, case when page_id % 4 = 0 then '<img src=\"a.png\"> caption' when page_id % 4 = 1 then 'no image' else html end as html from pages), t as (select page_id, html as raw, length({HTML}) as n from b) select page_id, regexp_matches(raw, '(?i)<img\\b') and n < {S.EPISODE_CHARS} as v from t",
    lambda m: m.base("pages").select("page_id", S.is_picture(F.expr("case page_id % 4 when 0 then '<img src=\"a.png\"> caption' when 1 then 'no image' else html end")).alias("v")))
RAW = "select id, site_url || 'blog/post?x' as base, case id % 7 when 0 then '/a.png' when 1 then 'b.png' when 2 then '//cdn.example/c.png' when 3 then 'https://cdn.example/d.png' when 4 then 'data:image/png;x' when 5 then ' ' else './e.png' end as raw from feeds"
add("sca61_absolute_image", "select id, case id % 7 when 0 then site_url || 'a.png' when 1 then site_url || 'blog/b.png' when 2 then 'https://cdn.example/c.png' when 3 then 'https://cdn.example/d.png' when 6 then site_url || 'blog/e.png' end as v from feeds",
    lambda m: derived(m, RAW, feeds=m.feeds).select("id", S.absolute_image(F.col("raw"), F.col("base")).alias("v")))
_PADS = [bytes(k ^ pad for k in b"salt".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]
add("sca68_hash_ip", f"select id, substr(sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || ip_hash::blob))), 1, 32) as v from submissions", lambda m: m.submissions.select("id", S.hash_ip(F.col("ip_hash"), "salt").alias("v")))
IMAGES = "select page_id, case page_id % 6 when 0 then '<p>x</p>' when 1 then '<img width=\"1\" src=\"p.gif\"><img alt=\"\" src=\"a.png\">' when 2 then '<img src=\"https://feedburner.example/x\"><IMG SRC=\"b.png\">' when 3 then '<img height=\"2\" src=\"t.gif\">' when 4 then '<img src=\"c.png\"><img src=\"d.png\">' else html end as html from pages"
add("txt30_html_image", f"""with b as ({IMAGES}), t as (select page_id, unnest(regexp_extract_all(html, '(?i)<img\\b[^>]*>')) as tag, generate_subscripts(regexp_extract_all(html, '(?i)<img\\b[^>]*>'), 1) as n from b),
    g as (select page_id, regexp_extract(tag, '(?i)\\bsrc="([^"]+)"', 1) as src, row_number() over (partition by page_id order by n) as k from t where regexp_matches(tag, '(?i)\\bsrc="[^"]+"') and not regexp_matches(tag, '(?i)\\b(width|height)\\s*=\\s*"?[012]"?(\\D|$)') and not regexp_matches(tag, '(?i)(pixel|beacon|tracking|feedburner|doubleclick)'))
    select p.page_id, src as v from pages p left join g on g.page_id = p.page_id and k = 1""", lambda m: derived(m, IMAGES, pages=m.base("pages")).select("page_id", T.html_image(F.col("html")).alias("v")))
CARDS = "select page_id, case page_id % 4 when 0 then '<meta property=\"og:image\" content=\"https://i.example/' || cast(page_id as string) || '.png\">' when 1 then '<meta content=\"t.png\" name=\"twitter:image\"><meta property=\"og:image\" content=\"o.png\">' when 2 then '<meta property=\"og:image\" content=\"s.png\"><meta name=\"twitter:image\" content=\"s.png\">' else '<meta property=\"og:image\" content=\"\">' end as html from pages"
add("txt54_card_candidates", "select page_id, case page_id % 4 when 0 then ['https://i.example/' || page_id::varchar || '.png'] when 1 then ['o.png', 't.png'] when 2 then ['s.png'] else [] end as v from pages",
    lambda m: derived(m, CARDS, pages=m.base("pages")).select("page_id", T.card_candidates(F.col("html")).alias("v")))

SLUGGED = "select id, 'feed-' || cast(id % 50 as string) as base from import_entries"
add("win13_claim_slugs", f"""with n as (select *, row_number() over (partition by base order by id) as k from ({SLUGGED})), free as (select base, v, row_number() over (partition by base order by v) as k from
    (select b.base, unnest(generate_series(1, 100000 // 50)) as v from (select distinct base from n) b) g where not exists (select 1 from feeds f where f.slug = case when v = 1 then base else base || '-' || v::varchar end))
    select id, n.base, case when v = 1 then n.base else n.base || '-' || v::varchar end as slug from n join free on free.base = n.base and free.k = n.k""",
    lambda m: W.claim_slugs(derived(m, SLUGGED, import_entries=m.import_entries), m.feeds.select("slug")))
RAW_WORDS = "select run_id, 'Rust, ' || keyword || chr(10) || upper(keyword) || ',, go' || cast(id % 3 as string) || ',rust ' as raw, id from run_keywords"
add("win18_parse_keywords", "select id, unnest([0, 1, 4]) as pos, unnest(['Rust', keyword, 'go' || (id % 3)::varchar]) as keyword from run_keywords", lambda m: W.keywords_of(derived(m, RAW_WORDS, run_keywords=m.run_keywords), "id"))
add("win19_merge_credits", """with c as (select f.feed_id, a.id as pos, case when a.id % 5 = 0 then split_part(a.name, ' ', 1) || ' X' || (a.id % 2)::varchar else ' ' || upper(a.name) end as name, role, f.confidence, case when a.id % 2 = 0 then a.email end as email, identity_key as url from feed_authors f join authors a on a.id = f.author_id)
    select feed_id, max_by(name, (length(name), -pos)) as name, max(confidence) as confidence, case when bool_or(role = 'owner') then 'owner' else min_by(role, pos) end as role, min_by(email, case when coalesce(email, '') <> '' then pos end) as email, min_by(url, case when url <> '' then pos end) as url
    from c group by feed_id, lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))""",
    lambda m: W.merge_credits(m.feed_authors.join(m.authors.select(F.col("id").alias("author_id"), "name", "email", F.col("identity_key").alias("url")), "author_id").select(
        "feed_id", F.expr("case when author_id % 5 = 0 then split_part(name, ' ', 1) || ' X' || (author_id % 2) else ' ' || upper(name) end").alias("name"), "role", "confidence", F.expr("case when author_id % 2 = 0 then email end").alias("email"), "url", F.col("author_id").alias("pos"))))
add("dml20_win_move", """with own as (select id, user_id, lane, position, lag(id) over w as before_id, lag(position) over w as before from queue_entries where not done window w as (partition by user_id, lane order by position, id)),
    last as (select * from own qualify row_number() over (partition by user_id, lane order by position desc, id desc) = 1 and before_id is not null), swap as (select id, before as position from last union all select before_id, position from last)
    select q.id, coalesce(s.position, q.position) as position from queue_entries q left join swap s using (id)""",
    lambda m: M.move_all(m.queue_entries, m.spark.sql("select user_id, lane, max_by(id, struct(position, id)) as id from {q} where not done group by 1, 2", q=m.queue_entries)).select("id", "position"))

LINKED = "select id, site_url as url, '<html><head><link rel=\"alternate\" type=\"application/rss+xml\" href=\"/feed/' || cast(id as string) || '\"><LINK type=\"application/atom+xml\" rel=\"alternate\" href=\" https://x.example/a \"><link rel=\"stylesheet\" type=\"text/css\" href=\"/s.css\"><link rel=\"alternate\" hreflang=\"de\" href=\"/de\"><link rel=\"alternate\" type=\"application/rss+xml\" href=\"' || site_url || 'feed/' || cast(id as string) || '\"></head><body><a href=\"list.m3u\">a</a><a href=\"/b' || cast(id as string) || '.PLS?x=1\">b</a><a href=\"c.mp3\">c</a><a href=\"list.m3u\">again</a></body></html>' as html from feeds"
add("src23_feed_links", "select id, [site_url || 'feed/' || id::varchar, 'https://x.example/a'] as v from feeds", lambda m: derived(m, LINKED, feeds=m.feeds).select("id", pages.page_feed_links("html", "url").alias("v")))
add("src11_playlist_links", "select id, [site_url || 'list.m3u', site_url || 'b' || id::varchar || '.PLS?x=1'] as v from feeds", lambda m: derived(m, LINKED, feeds=m.feeds).select("id", pages.page_playlist_links("html", "url").alias("v")))
PICTURES = "select id, case id % 3 when 0 then '89504E470D0A1A0A0000000D49484452' || lpad(hex(id % 5000), 8, '0') || lpad(hex(id % 300), 8, '0') when 1 then '474946383961' || substr(lpad(hex(256 * (id % 250) + 1), 4, '0'), 1, 4) || '0100' else 'FFD8FFE0' end as data from feeds"
add("txt57_image_size", "select id, case id % 3 when 0 then 'png' when 1 then 'gif' end as format, case id % 3 when 0 then id % 5000 when 1 then 256 + id % 250 end as width, case id % 3 when 0 then id % 300 when 1 then 1 end as height from feeds",
    lambda m: derived(m, PICTURES, feeds=m.feeds).select("id", pages.picture_size(F.unhex("data")).alias("s")).select("id", "s.*"))
_ARTICLE = "'<article><h2><a href=\"/p/{0}' || cast(id as string) || '\">A long enough title {0}</a></h2><time datetime=\"2001-02-0{0}T00:00:00Z\">x</time><p>A paragraph of more than forty characters, for the summary.</p></article>'"
_LD = "'{{{{\"@type\":\"BlogPosting\",\"url\":\"/p/{0}' || cast(id as string) || '\",\"headline\":\"A long enough title {0}\",\"datePublished\":\"2001-02-0{0}T00:00:00Z\",\"description\":\"A paragraph of more than forty characters, for the summary.\"}}}}'"
_BLOCK = "'<div class=\"post x\"><h3><a href=\"/p/{0}' || cast(id as string) || '\">A long enough title {0}</a></h3><time>2001-02-0{0}T00:00:00Z</time><p>A paragraph of more than forty characters, for the summary.</p></div>'"
EXPECTED = "select id, k - 1 as pos, site_url || 'p/' || k::varchar || id::varchar as url, 'A long enough title ' || k::varchar as title, make_timestamp(2001, 2, k, 0, 0, 0) as published_at, 'A paragraph of more than forty characters, for the summary.' as summary from feeds, (values (1), (2), (3), (4)) v(k)"
for _name, _open, _close, _part, _glue in (("src18_posts_from_json_ld", "'<html><head><script type=\"application/ld+json\">['", "']</script></head><body><p>x</p></body></html>'", _LD, " || ',' || "),
                                           ("src19_posts_from_articles", "'<html><body><nav><article><h2><a href=\"/no\">Not a post of this page</a></h2></article></nav>'", "'</body></html>'", _ARTICLE, " || "),
                                           ("src20_posts_from_clusters", "'<html><body><div class=\"menu\"><a href=\"/a\">A</a></div><main>'", "'</main></body></html>'", _BLOCK, " || ")):
    _html = f"select id, site_url as url, {_open} || {_glue.join(_part.format(k) for k in range(1, 5))} || {_close} as html from feeds"
    add(_name, EXPECTED, lambda m, h=_html: derived(m, h, feeds=spread(m.feeds, "id")).select("id", F.posexplode(pages.page_feed("html", "url")["items"]).alias("pos", "i")).select("id", "pos", "i.url", "i.title", F.col("i.published_at").cast("timestamp_ntz").alias("published_at"), "i.summary"))
TAGGED = "select id, '<rss xmlns:media=\"http://search.yahoo.com/mrss/\" xmlns:itunes=\"http://www.itunes.com/dtds/podcast-1.0.dtd\"><channel><title>t</title><item><title>one</title>' || case id % 4 when 0 then '<media:thumbnail url=\"https://i.example/t' || cast(id as string) || '.png\"/>' when 1 then '<description>&lt;p&gt;&lt;img src=\"https://i.example/d.png\"&gt;</description>' when 2 then '<enclosure type=\"image/png\" url=\"https://i.example/e.png\"/>' else '' end || '<category>Linux</category><category> linux </category><itunes:category text=\"B' || cast(id as string) || '\"/></item></channel></rss>' as body from feeds"
add("txt29_item_image", "select id, case id % 4 when 0 then 'https://i.example/t' || id::varchar || '.png' when 1 then 'https://i.example/d.png' when 2 then 'https://i.example/e.png' end as v from feeds", lambda m: derived(m, TAGGED, feeds=m.feeds).select("id", documents.parsed("body", F.lit(""))["items"][0]["image"].alias("v")))
add("txt32_categories", "select id, ['Linux', 'B' || id::varchar] as v from feeds", lambda m: derived(m, TAGGED, feeds=m.feeds).select("id", documents.parsed("body", F.lit(""))["items"][0]["categories"].alias("v")))
CHUNKS = "select id, '<outline text=\"a\" xmlUrl=\"' || feed_url || '\"/><outline text=\"x\"><outline xmlUrl=\"https://b.example/' || cast(id as string) || '\"/></outline>' as xml from feeds"
add("src14_scan_chunks", "select id, [feed_url, 'https://b.example/' || id::varchar] as v from feeds", lambda m: derived(m, CHUNKS, feeds=m.feeds).select("id", outlines.scanned("xml").alias("v")))
ADDED = "select id + 5000000 as id, user_id, case when id % 2 = 0 then item_id else item_id + 1 end as item_id, lane from queue_entries"
add("dml39_enqueue", f"""with n as (select distinct on (user_id, lane, item_id) * from ({ADDED}) a order by user_id, lane, item_id, id), o as (select user_id, lane, item_id from queue_entries where not done), l as (select user_id, lane, max(position) as last from queue_entries group by 1, 2),
    f as (select n.*, coalesce(last, 0) + row_number() over (partition by n.user_id, n.lane order by n.id) as position from n left join l using (user_id, lane) where not exists (select 1 from o where o.user_id = n.user_id and o.lane = n.lane and o.item_id = n.item_id))
    select id, user_id, item_id, lane, position, done from queue_entries q where not exists (select 1 from f where f.user_id = q.user_id and f.lane = q.lane and f.item_id = q.item_id) union all select id, user_id, item_id, lane, position, false from f""",
    lambda m: M.enqueue(m.queue_entries, derived(m, ADDED, queue_entries=m.queue_entries)))

#: Pages with one link of each kind, whose frame SQL can tell.
FRAMED = """select id, feed_url as url, '<html><head><title>T</title>' || case when id % 2 = 0 then '<base href="/wiki/">' else '' end || '</head><body>' || case id % 5 when 0 then '<a href="x' || cast(id as string) || '">x</a>' when 1 then '<a href="#n">n</a>'
    when 2 then '<a href="mailto:a@b.org">m</a>' when 3 then '<form action="/s"></form>' else '<a href="javascript:x">j</a>' end || '</body></html>' as html from feeds"""
add("txt60_reframe_page", f"""with p as ({FRAMED}), b as (select *, regexp_extract(url, '^https://[^/]+') as site, case when id % 2 = 0 then regexp_extract(url, '^https://[^/]+') || '/wiki/' else url end as base, 'https://reader.example/api/frame?u=' as frame from p)
    select id, '<!doctype html>' || chr(10) || '<html><head><script>try{{parent.postMessage({{"source":"reader","url":"' || url || '"}},"https://reader.example")}}catch(e){{}}</script>' || case when id % 2 = 0 then '' else '<base href="' || url || '">' end || '<title>T</title>'
    || case when id % 2 = 0 then '<base href="' || base || '">' else '' end || '</head><body>' || case id % 5 when 0 then '<a href="' || frame || replace(replace(regexp_replace(base, '[^/]*$', '') || 'x' || id::varchar, ':', '%3A'), '/', '%2F') || '">x</a>'
        when 1 then '<a href="' || frame || replace(replace(url, ':', '%3A'), '/', '%2F') || '#n">n</a>' when 2 then '<a href="mailto:a@b.org" target="_blank">m</a>' when 3 then '<form action="' || site || '/s" target="_blank"></form>' else '<a href="javascript:x">j</a>' end || '</body></html>' as html from b""",
    lambda m: derived(m, FRAMED, feeds=m.feeds).select("id", reframed(F.col("html"), F.col("url"), "https://reader.example").alias("html")))
