"""Queries over what crawls, imports and checks write, schedules by observed changes, and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.operators import discovery as D
from skein.operators import listing as L
from skein.operators import windows as W
from skein.operators import writes
from skein.plans.reads import _now, add
from skein.plans.texts import KW, SLUG
from skein.plans.verdicts import POSTED, derived
from skein.sources import sinks
from skein.sources.model import AS_OF
from skein.streaming import cadence as C

STORED = "select feed_id, guid, title, case when id % 5 = 0 then null else published_at end as published_at, audio_url from items"
POSTS = "select feed_id, case when id % 4 = 0 then 'new' || guid else guid end as guid, 'again ' || title as title, published_at, coalesce(audio_url, 'https://cdn.example/x.mp3') as audio_url from items"
CRAWLS = """select id, 'Crawled ' || title as title, case when id % 2 = 0 then '' else 'fresh' end as description, case when id % 5 <> 0 then site_url end as site_url, case when id % 4 <> 0 then 'podcast' end as kind,
    case when id % 3 = 1 then '' else 'sv' end as language, case when id % 5 = 1 then 90 when id % 5 = 2 then 0 end as minutes, case when id % 7 <> 0 then created_at + DAYS(3) end as newest from feeds where status <> 'dead'"""
HELD = "select *, id % 11 = 0 as curated from feeds"
MERGED = f"""o as ({STORED}), p as ({POSTS}), n as (select feed_id, guid, arg_min(title, (title, coalesce(published_at, timestamp '0001-01-01'))) as title, arg_min_null(published_at, (title, coalesce(published_at, timestamp '0001-01-01'))) as published_at,
        arg_min(audio_url, (title, coalesce(published_at, timestamp '0001-01-01'))) as audio_url from p group by 1, 2),
    s as (select feed_id, guid, coalesce(o.title, n.title) as title, coalesce(o.published_at, n.published_at) as published_at, coalesce(o.audio_url, n.audio_url) as audio_url from o full join n using (feed_id, guid))"""


def _stored(m):
    return writes.store_crawl(derived(m, HELD, feeds=m.feeds), derived(m, STORED, items=m.items), derived(m, CRAWLS, feeds=m.feeds), derived(m, POSTS, items=m.items), _now())


add("str15_store_crawl", f"""with {MERGED}, t as (select feed_id, count(*) as total from s group by 1), c as ({CRAWLS}), f as ({HELD}),
    w as (select id, (case when c.minutes > 0 then c.minutes when coalesce(total, 0) > f.item_count then 60 else least(greatest(2 * greatest(coalesce(f.interval_minutes, 60), 60), 60), 1440) end)::bigint as wait, coalesce(total, 0) as total from f join c using (id) left join t on t.feed_id = id)
    select f.id, coalesce(c.title, f.title) as title, case when c.id is null then f.description else nullif(c.description, '') end as description, case when c.id is null then f.site_url else nullif(c.site_url, '') end as site_url,
        case when c.id is null then f.status else 'active' end as status, case when c.id is null then f.error_count else 0 end as error_count, case when c.id is null or curated then f.category else coalesce(c.kind, 'blog') end as category,
        case when c.id is null then f.language else coalesce(nullif(c.language, ''), f.language) end as language, case when c.id is null then f.last_fetched_at else {AS_OF} end as last_fetched_at, coalesce(wait, f.interval_minutes) as interval_minutes,
        case when c.id is null then f.next_fetch_at else {AS_OF} + to_minutes(wait) end as next_fetch_at, coalesce(total, f.item_count) as item_count, coalesce(c.newest, f.last_published_at) as last_published_at
    from f left join c using (id) left join w using (id)""", lambda m: _stored(m)[0])
add("str15_stored_items", f"with {MERGED} select * from s", lambda m: _stored(m)[1])

ENTRIES = "select id, submission_id, case when id % 4 = 0 then 'https://host' || cast(submission_id % 60 as string) || '.example/feed/' || cast(id as string) when id % 5 = 0 then 'https://import.example/twice' else upper(url) end as url, title from import_entries"
add("str20_drain_import", f"""with e as ({ENTRIES}), t as (select e.* from e join submissions s on s.id = submission_id where s.ready qualify row_number() over (partition by submission_id order by e.id) <= 5),
    u as (select * from t qualify row_number() over (partition by lower(url) order by id) = 1), n as (select u.*, row_number() over (order by id) - 1 as place from u where lower(url) not in (select lower(feed_url) from feeds))
    select id, submission_id, url, place, {AS_OF} + to_seconds(place * 60 // 240) as next_fetch_at from n""",
    lambda m: writes.drain_imports(m.submissions, derived(m, ENTRIES, import_entries=m.import_entries), m.feeds, _now(), 5)[0].select("id", "submission_id", "url", "place", "next_fetch_at"))
add("str20_entries_left", f"with e as ({ENTRIES}) select id from (select e.*, coalesce(s.ready, false) as ready, row_number() over (partition by submission_id order by e.id) as n from e left join submissions s on s.id = submission_id) where not ready or n > 5",
    lambda m: writes.drain_imports(m.submissions, derived(m, ENTRIES, import_entries=m.import_entries), m.feeds, _now(), 5)[1].select("id"))

FOUND = """select id, case when id % 9 = 0 then 'https://host' || cast(id % 60 as string) || '.example/feed/' || cast(id as string) when id % 4 = 0 then 'https://video.example/feeds?playlist_id=' || cast(id as string) when id % 13 = 0 then 'https://new.example/comments/feed' else 'https://new.example/' || cast(id as string) end as feed_url,
    case when id % 6 = 0 then '' else title end as title, description from feeds where status <> 'dead'"""
ASKED = "select id, id % 10 = 3 as curated from feeds"
add("str23_check_candidates", f"""with c as ({ASKED}), f as (select x.*, x.feed_url in (select feed_url from feeds) as known, contains(feed_url, 'playlist_id=') as series from ({FOUND}) x), q as ({POSTED}),
    i as (select feed_id as id, count(*) as n, sum((trim(coalesce(url, '')) <> '')::int) as linked, count(distinct lower(trim(title))) as titles, max(published_at) as newest, count(distinct nullif(lower(trim(author)), '')) as authors from q group by 1),
    d as (select f.*, coalesce(n, 0) as n, linked, titles, coalesce(authors, 0) as authors, (epoch({AS_OF}) - epoch(newest)) / 86400 as age, trim(title) <> '' as named, trim(coalesce(description, '')) <> '' as described from f left join i using (id)),
    r as (select *, case when series then case when n < 4 then 'too-short' when linked = 0 then 'unlinked-items' when authors > 3 then 'mixtape' end when feed_url like '%/comments/feed' then 'comments-feed' when n < 2 then 'too-few-items' when age > 548 then 'abandoned' when titles = 1 and n > 2 then 'duplicate-titles' end as verdict,
        case when series then case when n >= 12 then 35 when n >= 8 then 28 else 20 end + case authors when 0 then 5 when 1 then 35 else 15 end + case when named then 20 else 0 end + case when described then 5 else 0 end + case when linked = n then 5 else 0 end
        else greatest(case when n >= 10 then 30 when n >= 5 then 20 else 10 end + case when age is null then 10 when age <= 90 then 40 when age <= 365 then 25 else 15 end + case when named then 15 else 0 end + case when described then 10 else 0 end + case when linked = 0 then -20 else 5 end, 0) end as p from d)
    select c.id, case when r.id is null then 'error' when known then 'rejected' when curated then 'accepted' when verdict is null and p >= 50 then 'accepted' else 'rejected' end as status,
        case when r.id is null or known or curated then null when verdict is null then p else 0 end as score from c left join r using (id)""",
    lambda m: writes.check_candidates(derived(m, ASKED, feeds=m.feeds), derived(m, FOUND, feeds=m.feeds), derived(m, POSTED, items=m.items), m.feeds, _now()).select("id", "status", "score"))

add("txt07_topics_from", f"""with texts_ as (select * from texts), blocks as (select source, unnest([title, summary]) as summary from texts_ union all select distinct source, 'All about ' || source || ' gardens' from texts_ union all select distinct source, 'gardens of ' || source from texts_),
    {KW.replace('from texts where length(trim(summary)) >= 8', "from (select source, trim(regexp_replace(summary, '\\s+', ' ', 'g')) as summary from blocks) where length(summary) >= 8", 1)},
    p as (select source, keyword, 1 as words, count(*) as count, 'category' as src from (select source, lower(lang) as keyword from texts where lang is not null union all select distinct source, unnest(['gardens', 'green rooms']) from texts) group by 1, 2 union all select source, keyword, words, count, 'content' from kw where rank <= 250),
    y as (select source, keyword, case when src = 'category' then len(string_split(keyword, ' ')) else words end as words, count, src, {SLUG.format('keyword')} as slug from p),
    o as (select *, row_number() over (partition by source, slug order by case when src = 'category' then 0 else 1 end, count desc, words desc, keyword) as n from y where slug <> ''),
    r as (select *, row_number() over (partition by source order by case when src = 'category' then 0 else 1 end, count desc, words desc, keyword) as k from o where n = 1) select source as feed_id, slug, keyword, count from r where k <= 25""",
    lambda m: writes.topics_from(m.texts.select("source").distinct().select(F.col("source").alias("feed_id"), F.concat(F.lit("All about "), "source", F.lit(" gardens")).alias("title"), F.concat(F.lit("gardens of "), "source").alias("description"), F.array(F.lit("Gardens"), F.lit(" Green   Rooms")).alias("categories")),
                                 m.texts.where("doc_id % 2 = 0").select(F.col("source").alias("feed_id"), "title", "summary", F.array("lang").alias("categories")), m.texts.where("doc_id % 2 <> 0").select(F.col("source").alias("feed_id"), "title", "summary", F.array("lang").alias("categories"))).select("feed_id", "slug", "keyword", "count"))

#: Change logs of feeds: none, one entry, several, with nulls and times ahead among them.
LOGS = f"select id, case id % 6 when 0 then null when 1 then ARRAY() when 2 then ARRAY({AS_OF} - MINUTES(id)) when 3 then ARRAY({AS_OF} - MINUTES(30), {AS_OF} - MINUTES(id + 40), {AS_OF} + DAYS(2)) when 4 then ARRAY({AS_OF} - MINUTES(id), {AS_OF} - MINUTES(3 * id), {AS_OF} - MINUTES(4 * id), {AS_OF} - MINUTES(9 * id), {AS_OF} - MINUTES(id)) else ARRAY(null, {AS_OF} - MINUTES(20 * id), {AS_OF} - MINUTES(20 * id + 60)) end as log from feeds"


def _brackets(sql: str) -> str:
    """ARRAY(...) as a list of the other engine."""
    out, i = "", 0
    while True:
        j = sql.find("ARRAY(", i)
        if j < 0:
            return out + sql[i:]
        k, depth = j + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6 : k - 1]
        out += sql[i:j] + (f"[{inner}]" if inner else "cast([] as timestamp[])")
        i = k


def _logged(m):
    return derived(m, LOGS.replace("ARRAY()", "cast(array() as array<timestamp>)").replace("ARRAY(", "array("), feeds=m.feeds).withColumn("log", F.col("log").cast("array<timestamp>"))


add("cad03_interval_from_changes", f"""with l as ({_brackets(LOGS)}), t as (select distinct id, unnest(log) as t from l), v as (select id, t from t where t <= {AS_OF}), g as (select id, t, (epoch(t) - epoch(lag(t) over (partition by id order by t))) / 60 as gap from v),
    s as (select id, median(gap) as gap, (epoch({AS_OF}) - epoch(max(t))) / 60 as silence from g group by 1), x as (select id, coalesce(gap, silence) as gap, silence from s)
    select l.id, case when gap is not null then least(greatest(round(case when silence <= 3 * gap then gap / 2 else silence / 4 end), 60), 129600)::bigint end as minutes from l left join x using (id)""", lambda m: _logged(m).select("id", C.interval_from_changes(F.col("log"), _now()).alias("minutes")))
add("cad04_record_change", f"with l as ({_brackets(LOGS)}) select id, list_transform(case when id % 2 = 0 then list_prepend({AS_OF}, coalesce(log, []))[:12] else log end, lambda t: strftime(t, '%Y-%m-%d %H:%M:%S')) as log from l", lambda m: _logged(m).select("id", F.transform(C.record_change(F.col("log"), F.col("id") % 2 == 0, F.expr(AS_OF).cast("timestamp")), lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")).alias("log")))
add("cad05_never_sooner", "select id, case when id % 3 = 0 then null else greatest(id % 4000, case when id % 5 = 0 then 0 else interval_minutes end, 60) end as v from feeds", lambda m: m.feeds.select("id", C.never_sooner(F.when(F.col("id") % 3 != 0, F.col("id") % 4000), F.when(F.col("id") % 5 != 0, F.col("interval_minutes"))).alias("v")))
add("cad06_newest_published", "select feed_id, least(max(published_at), timestamp '1998-01-01')::timestamp as newest from items where published_at <= timestamp '1998-01-02' group by 1",
    lambda m: C.newest_published(m.items, F.expr("timestamp '1998-01-01'")).select("feed_id", F.col("newest").cast("timestamp_ntz").alias("newest")))
add("cad07_scatter", "select id, list_reduce(list_prepend(0::bigint, list_transform(string_split(slug, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) % 10000) / 10000 as v from feeds", lambda m: m.feeds.select("id", C.scatter(F.col("slug")).alias("v")))

add("set02_events_for_run", "with e as (select 'keyword' as source, id, \"at\", keyword as subject, status from run_keywords where run_id = 9 union all select 'site', id, \"at\", host, status from candidates where run_id = 9), t as (select * from e order by \"at\" desc, source desc, id desc limit 7) select * from t order by \"at\", source, id",
    lambda m: L.tail_of(L.lookup(m.run_keywords, run_id=9).select(F.lit("keyword").alias("source"), "id", "at", F.col("keyword").alias("subject"), "status").unionByName(L.lookup(m.candidates, run_id=9).select(F.lit("site").alias("source"), "id", "at", F.col("host").alias("subject"), "status")), ["at", "source", "id"], 7))
add("sca05_search_slug", f"with q as (select doc_id as id, case when doc_id % 7 = 0 then ' !! ' when doc_id % 11 = 0 then '  ' else ' ' || title end as x from texts), l as (select id, trim(lower(x)) as x from q) select id, case when x = '' then '' else coalesce(nullif({SLUG.format('x')}, ''), x) end as v from l",
    lambda m: m.texts.select(F.col("doc_id").alias("id"), T.search_slug(F.expr("case when doc_id % 7 = 0 then ' !! ' when doc_id % 11 = 0 then '  ' else ' ' || title end")).alias("v")))
CARD = "select id, case id % 5 when 0 then 'http://i.example/a.png' when 1 then 'ftp://i.example/a' when 2 then null else 'https://i.example/b.png' end as url, id % 1000 as width, id % 700 as height from feeds"
add("sca43_feed_card", f"select id, regexp_replace(url, '^http:', 'https:') as url, width, height, width >= 600 and height >= 315 as large from ({CARD}) where url like 'http%' and width >= 200 and height >= 200",
    lambda m: derived(m, CARD, feeds=m.feeds).select("id", S.feed_card(F.col("url"), F.col("width"), F.col("height")).alias("c")).where("c is not null").select("id", "c.*"))
ADS = "select s_suppkey - 1 as n, 'ad' || cast(s_suppkey as string) as id from supplier where s_suppkey <= 2"
LONG = "select supplier as by_id, row_number() over (partition by supplier order by id, guid, published_at, title) - 1 as pos, cast(id as string) as id, cast(published_at as timestamp) as at_ from items"
add("src49_interleave_ads", f"""with i as ({LONG}), c as (select by_id, count(*) as total from i group by 1), p as (select by_id, n, case when 10 * n + 9 + 1 < total then 10 * n + 9 else 10 * n + 8 end as pos from c, (values (0), (1)) a(n) where 10 * n + 9 < total),
    x as (select by_id, pos, false as ad, id, at_ from i union all select i.by_id, i.pos, true, 'ad' || (n + 1)::varchar, at_ - interval 1 second from i join p using (by_id, pos))
    select by_id, row_number() over (partition by by_id order by pos, ad) - 1 as pos, ad, id, at_ as "at" from x""",
    lambda m: writes.interleave(derived(m, LONG.replace("at_", "at"), items=m.items).withColumn("at", F.col("at").cast("timestamp_ntz")), derived(m, ADS, supplier=m.base("supplier")), "by_id"))
add("src53_each_feed_for_export", "select id, title from feeds where status <> 'dead'", lambda m: sinks.export_rows(m.feeds).select("id", "title"))
TITLED = "select id, case id % 6 when 0 then 'API' when 1 then '  ' when 2 then 'Feed' else 'Title ' || cast(id % 40 as string) end as title, case when id % 12 = 1 then null else site_url end as url from import_entries join (select id as fid, site_url from feeds) f on fid = id"
add("win15_unique_slug", f"""with b as (select id, case when trim(title) <> '' then lower(replace(title, ' ', '-')) when url is not null then replace(regexp_extract(url, '^https?://(?:www\\.)?([^/]+)', 1), '.', '-') else 'untitled' end as base from ({TITLED})),
    n as (select *, row_number() over (partition by base order by id) as k from b), g as (select base, v, row_number() over (partition by base order by v) as k from (select distinct base, v from b, (select unnest(generate_series(1, (select max(id) from feeds) + 6000)) as v) s) c where not (v = 1 and base in ('api', 'feed')) and case when v = 1 then base else base || '-' || v::varchar end not in (select slug from feeds))
    select n.id, case when v = 1 then n.base else n.base || '-' || v::varchar end as slug from n join g on g.base = n.base and g.k = n.k""",
    lambda m: W.unique_slugs(derived(m, TITLED, import_entries=m.import_entries, feeds=m.feeds), m.feeds.select("slug")).select("id", "slug"))
CHANNEL = "select id, case id % 8 when 0 then 'music' when 1 then 'newsletter' end as medium, case when id % 10 = 3 then 'https://www.youtube.com/feeds/videos.xml?x' else feed_url end as feed_url, id % 3 as videos, id % 4 as audios, id % 5 < 2 as tags, id % 7 = 0 as declared, id % 11 = 0 as shaped, id % 13 < 4 as newsroom, id % 6 as sample from feeds"
add("txt23_kind_of_channel", f"""select id, case when medium = 'music' then 'music' when feed_url like '%youtube.com/feeds%' then 'video' when videos > 0 and (tags or shaped) then 'video' when tags and (declared or sample = 0 or audios > 0) then 'podcast' when newsroom then 'news' else 'blog' end as v from ({CHANNEL})""",
    lambda m: derived(m, CHANNEL, feeds=m.feeds).select("id", T.kind_of_channel(*(F.col(c) for c in ("medium", "feed_url", "videos", "audios", "tags", "declared", "shaped", "newsroom", "sample"))).alias("v")))

add("src37_due_sources", f"with s as (select * from (values ('keywords', 24), ('directory', 26), ('list', 72), ('never', 1)) v(source, hours)), r as (select provider as source, max(created_at) - to_days(case provider when 'keywords' then 1 when 'directory' then 1 else 3 end) as last_run from runs group by 1) select s.source, last_run from s left join r using (source) where last_run is null or epoch({AS_OF}) - epoch(last_run) >= 3600 * hours",
    lambda m: D.due_sources(D.source_schedule(m.runs).select("source", (F.col("last_run") - F.expr("case source when 'keywords' then interval 1 day when 'directory' then interval 1 day else interval 3 day end")).alias("last_run")), {"keywords": 24, "directory": 26, "list": 72, "never": 1}, _now()))
add("src39_source_yield", "select r.provider, count(*) as feeds from candidates c join runs r on r.id = c.run_id where c.status = 'accepted' group by 1", lambda m: D.source_yield(m.candidates, m.runs))
add("src38_run_source", "select distinct host from candidates c where not exists (select 1 from feeds f where regexp_extract(f.feed_url, '^https?://([^/]+)', 1) = c.host)",
    lambda m: D.new_hosts(m.candidates, m.feeds, F.expr("regexp_extract(feed_url, '^https?://([^/]+)', 1)")).select("host"))
add("src34_rotate", "with n as (select id, row_number() over (order by id) - 1 as n, count(*) over () as total from authors) select id from n where (n - 7 * 5 % total + total) % total < 5", lambda m: D.rotate(m.authors, "id", 7, 5).select("id"))
add("str40_source_schedule", "select provider as source, max(created_at) as last_run, count(*) as runs from runs group by 1", lambda m: D.source_schedule(m.runs))
add("str25_refresh_run", "select run_id, count(*) as total, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'queued') = 0 as done from candidates group by 1", lambda m: D.refresh_runs(m.candidates))
WRITES = "select id, case id % 7 when 0 then 'INSERT  OR ignore' || chr(10) || ' INTO ' || event || '_log values (1)' when 1 then 'update ' || event || ' set a = 1' when 2 then '-- a note' || chr(10) || 'delete from ' || event || ' where 1' when 3 then 'replace into ' || event || ' values (2)' when 4 then 'select * from ' || event when 5 then 'insert into ' || event || '(a)' else ' ' end as sql from log"
add("str41_statement_shape", "select id, case id % 7 when 0 then 'insert ' || event || '_log' when 1 then 'update ' || event when 2 then 'delete ' || event when 3 then 'replace ' || event when 5 then 'insert ' || event else 'other ?' end as v from log",
    lambda m: derived(m, WRITES, log=m.log).select("id", D.statement_shape(F.col("sql")).alias("v")))
