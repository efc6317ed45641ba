"""Queries over documents, pages and sinks, and rollups of the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.plans.reads import add
from skein.sources import documents, outlines, pages, sinks
from skein.streaming import rollups

TEXT = "select feed_id, 'a' as x from items"
#: Posts in their place, as the writers take them.
POSTS = "p as (select feed_id, row_number() over (partition by feed_id order by published_at desc nulls last, id, title, summary, audio_url) as pos, title, 'https://post.example/' || id::varchar as url, id::varchar as guid, summary, published_at, audio_url, audio_type, audio_seconds from items)"


def _posts(m):
    return m.spark.sql("select feed_id, row_number() over (partition by feed_id order by published_at desc nulls last, id, title, summary, audio_url) as pos, title, 'https://post.example/' || id as url, string(id) as guid, summary, published_at, audio_url, audio_type, audio_seconds from {i}", i=m.items)


def _channels(m):
    return m.feeds.select(F.col("id").alias("feed_id"), "title", F.col("site_url").alias("link"), "description")


add("src41_build_rss", f"""with {POSTS}, b as (select feed_id, string_agg('<item><title>' || title || '</title><link>' || url || '</link><guid isPermaLink="false">' || guid || '</guid>' || coalesce('<pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate>', '') || '<description>' || summary || '</description>' || coalesce('<enclosure url="' || audio_url || '" type="' || audio_type || '" length="0"/>', '') || '</item>', '' order by pos) as body from p group by 1)
    select f.id as feed_id, '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>' || title || '</title><link>' || site_url || '</link><description>' || description || '</description>' || coalesce(body, '') || '</channel></rss>' as document from feeds f left join b on b.feed_id = f.id""", lambda m: sinks.syndicate("rss", _channels(m), _posts(m)))
add("src42_build_atom", f"""with {POSTS}, b as (select feed_id, string_agg('<entry><title>' || title || '</title><id>' || url || '#' || guid || '</id><link href="' || url || '"/><updated>' || coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '.000Z', '1970-01-01T00:00:00.000Z') || '</updated><summary>' || summary || '</summary></entry>', '' order by pos) as body from p group by 1)
    select f.id as feed_id, '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>' || title || '</title><id>' || site_url || '</id><link href="' || site_url || '"/>' || coalesce(body, '') || '</feed>' as document from feeds f left join b on b.feed_id = f.id""", lambda m: sinks.syndicate("atom", _channels(m), _posts(m)))
add("src45_build_m3u", f"""with {POSTS}, b as (select feed_id, string_agg('#EXTINF:' || audio_seconds::varchar || ',' || title || chr(10) || audio_url || chr(10), '' order by pos) as body from p where audio_url is not null group by 1)
    select f.id as feed_id, '#EXTM3U' || chr(10) || '#PLAYLIST:' || title || chr(10) || coalesce(body, '') as document from feeds f left join b on b.feed_id = f.id""", lambda m: sinks.syndicate("m3u", _channels(m), _posts(m)))
add("src46_build_pls", f"""with {POSTS}, q as (select *, row_number() over (partition by feed_id order by pos) as k from p where audio_url is not null), b as (select feed_id, count(*) as n, string_agg('File' || k::varchar || '=' || audio_url || chr(10) || 'Title' || k::varchar || '=' || title || chr(10) || 'Length' || k::varchar || '=' || audio_seconds::varchar || chr(10), '' order by k) as body from q group by 1)
    select f.id as feed_id, '[playlist]' || chr(10) || coalesce(body, '') || 'NumberOfEntries=' || coalesce(n, 0)::varchar || chr(10) || 'Version=2' || chr(10) as document from feeds f left join b on b.feed_id = f.id""", lambda m: sinks.syndicate("pls", _channels(m), _posts(m)))
add("src48_ad_positions", "select id, list_transform(list_filter([9, 19, 29], lambda p: p < item_count), lambda p: case when p + 1 < item_count then p else p - 1 end) as positions from (select id, item_count + id % 20 as item_count from feeds)",
    lambda m: m.feeds.select("id", sinks.ad_positions(F.col("item_count") + F.col("id") % 20).alias("positions")))
add("src50_build_opml", """select title, id, '<outline type="rss" text="' || title || '" xmlUrl="' || feed_url || '" htmlUrl="' || site_url || '"/>' as outline from feeds""", lambda m: sinks.opml_outline(m.feeds))
add("src51_feeds_for_export", "select id, title from feeds where status <> 'dead' order by title, id limit 5000", lambda m: sinks.export_page(m.feeds, limit=5000).select("id", "title"))
add("src52_export_page", "select id, title from feeds where status <> 'dead' and category = 'news' and (title > 'Order 2' or (title = 'Order 2' and id > 2)) order by title, id limit 200", lambda m: sinks.export_page(m.feeds, ("Order 2", 2), 200, "news").select("id", "title"))
add("src54_sitemap_chunks", "with c as (select strftime(created_at, '%Y-%m') as month, count(*) as n, max(created_at) as latest from feeds where status <> 'dead' group by 1) select month, unnest(generate_series(1, ceil(n / 50)::int))::int as part, n, latest from c", lambda m: sinks.sitemap_chunks(m.feeds, 50))
add("src55_sitemap_chunk_feeds", "select id, slug from feeds where status <> 'dead' and created_at >= timestamp '1998-03-01' and created_at < timestamp '1998-04-01' order by created_at, id limit 20 offset 20", lambda m: m.feeds.where("status <> 'dead' and created_at >= timestamp '1998-03-01' and created_at < timestamp '1998-04-01'").orderBy("created_at", "id").offset(20).limit(20).select("id", "slug"))
add("src58_authors_for_sitemap", "select id, slug from authors where confidence >= 0.6 order by confidence desc, id limit 20000", lambda m: m.authors.where("confidence >= 0.6").orderBy(F.col("confidence").desc(), "id").limit(20000).select("id", "slug"))
add("src17_feed_from_page", None, lambda m: m.base("pages").select("page_id", pages.page_feed("html", "url").alias("feed")).select("page_id", "feed.title", "feed.kind", F.size("feed.items").alias("posts")))
add("src22_readable_article", None, lambda m: m.base("pages").select("page_id", pages.article("html", "url").alias("a")).select("page_id", "a.title", "a.chars"))
add("src13_page_links", "select page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref=\"([^\"]*)\"', 1) as links from pages", lambda m: m.base("pages").select("page_id", pages.hrefs(F.col("html")).alias("links")))
add("src15_scan_urls", "select doc_id, list_filter(regexp_split_to_array(text, '[\\s,]+'), lambda u: regexp_matches(u, '(?i)^https?://')) as urls from documents", lambda m: m.base("documents").select("doc_id", outlines.scan_urls(F.col("text")).alias("urls")))
add("txt21_sanitize", None, lambda m: m.base("pages").select("page_id", pages.sanitized("html").alias("html")))
add("txt34_identities", None, lambda m: m.base("pages").select("page_id", pages.page_identities("html", "url").alias("i")).select("page_id", F.size("i.profiles").alias("profiles"), F.size("i.people").alias("people")))
add("src01_parse_feed", f"with {POSTS} select feed_id::varchar as feed_url, pos - 1 as pos, guid, title, published_at::timestamp as published_at from p", lambda m: documents.items_of(documents.read_feeds(sinks.syndicate("rss", _channels(m), _posts(m)).select(F.col("feed_id").cast("string").alias("url"), F.col("document").alias("body")))).select("feed_url", "pos", "guid", "title", "published_at"))
add("str01_hourly_rollup", "select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as lines, round(sum(value), 4) as amount from events group by 1, 2", lambda m: rollups.hourly(m.base("events")).withColumn("hour", F.col("hour").cast("timestamp_ntz")))
add("str02_gauge", "select date_trunc('hour', ts) as hour, max_by(value, (ts, event_id)) as value from events group by 1", lambda m: rollups.gauge(m.base("events")))
