"""Queries that judge feeds, jobs, pages and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.operators import aggregates as A
from skein.operators import windows as W
from skein.plans.reads import _now, add
from skein.plans.texts import KEY, STEMS
from skein.sources.model import AS_OF, spark_sql


def derived(m, sql: str, **tables):
    """Rows that one SQL text derives for both engines; ``tables`` stand for the relations it names."""
    for name in tables:
        sql = sql.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name}", f"join {{{name}}}")
    return m.spark.sql(spark_sql(sql), **tables)


#: Feeds with comment threads, parts of sites, blank and placeholder titles among them.
VARIED = """select id, category, case id % 41 when 0 then feed_url || '/comments/feed' when 1 then feed_url || '?feed=comments' when 2 then feed_url || '/COMMENTS.RSS'
        when 3 then replace(feed_url, '/feed/', '/Tags/') when 4 then replace(feed_url, '/feed/', '/author/') when 5 then feed_url || '/commentsy' else feed_url end as feed_url,
    case id % 29 when 0 then '(untitled)' when 1 then '  ' else title end as title, case id % 31 when 0 then ' ' when 1 then null else description end as description from feeds"""
#: Posts of their feeds, or of whole groups of feeds, so that some feeds have many and some none; some linked by white space only.
POSTED = """select feed as feed_id, case when feed % 997 < 9 then 'One Title' when id % 10 = 1 then ' PART ' else title end as title,
    case when feed % 997 % 5 = 0 then ' ' when id % 3 = 0 then null else 'https://post.example/' || cast(id as string) end as url,
    case when feed % 997 % 7 <> 0 then published_at - DAYS(feed % 997) end as published_at,
    case when feed % 997 % 4 = 0 then ' ' when feed % 997 % 4 = 1 then case when id % 2 = 0 then 'Ann Bee' else ' ann bee' end
        when feed % 997 % 4 = 2 then 'Author ' || cast(supplier % 3 as string) else 'Author ' || cast(supplier as string) end as author
    from (select *, case when feed_id % 4 = 0 then feed_id - feed_id % 64 + 4 else feed_id end as feed from items) x"""
FEEDS = f"select id, max(feed_url) as feed_url, max(title) as title, max(description) as description from ({VARIED}) v group by 1"
RANKED = "least(greatest(p, 0), 100)"

add(
    "txt16_assess_feed",
    f"""with v as ({FEEDS}), q as ({POSTED}),
    i as (select feed_id, count(*) as n, max(published_at) as newest, count(distinct lower(trim(title))) as titles, sum((trim(coalesce(url, '')) <> '')::int) as linked from q group by 1),
    d as (select id, feed_url, coalesce(trim(title), '') not in ('', '(untitled)') as named, trim(coalesce(description, '')) <> '' as described, coalesce(n, 0) as n, titles, linked,
        (epoch({AS_OF}) - epoch(newest)) / 86400 as age from v left join i on feed_id = id),
    r as (select *, case when regexp_matches(feed_url, '(?i)(/comments/?(feed)?/?$|[?&]feed=comments|/comments\\.rss$)') then 'comments-feed'
            when regexp_matches(feed_url, '(?i)/(tags?|category|categories|label|search|author)/') then 'partial-feed' when n < 2 then 'too-few-items' when age > 548 then 'abandoned'
            when titles = 1 and n > 2 then 'duplicate-titles' end as verdict,
        case when n >= 10 then 30 when n >= 5 then 20 else 10 end + case when age is null then 10 when age <= 90 then 40 when age <= 365 then 25 else 15 end
            + case when named then 15 else 0 end + case when described then 10 else 0 end + case when linked = 0 then -20 else 5 end as p from d)
    select id, verdict is null and {RANKED} >= 50 as worthy, case when verdict is null then {RANKED} else 0 end as score,
        case when verdict is not null then verdict else coalesce(nullif(concat_ws(',', case when age is null then 'undated' end, case when not named then 'untitled' end, case when linked = 0 then 'unlinked-items' end), ''),
            case when {RANKED} < 50 then 'low-score' else '' end) end as reasons from r""",
    lambda m: T.assess_feed(derived(m, FEEDS, feeds=m.feeds), derived(m, POSTED, items=m.items), _now()).withColumn("reasons", F.array_join("reasons", ",")),
)
add(
    "txt18_assess_series",
    f"""with v as ({FEEDS}), q as ({POSTED}),
    i as (select feed_id, count(*) as n, sum((trim(coalesce(url, '')) <> '')::int) as linked, count(distinct nullif(lower(trim(author)), '')) as authors from q group by 1),
    d as (select id, coalesce(trim(title), '') not in ('', '(untitled)') as named, trim(coalesce(description, '')) <> '' as described, coalesce(n, 0) as n, coalesce(linked, 0) as linked, coalesce(authors, 0) as authors from v left join i on feed_id = id),
    r as (select *, case when n < 4 then 'too-short' when linked = 0 then 'unlinked-items' when authors > 3 then 'mixtape' end as verdict,
        case when n >= 12 then 35 when n >= 8 then 28 else 20 end + case authors when 0 then 5 when 1 then 35 else 15 end + case when named then 20 else 0 end + case when described then 5 else 0 end + case when linked = n then 5 else 0 end as p from d)
    select id, verdict is null and {RANKED} >= 50 as accepted, case when verdict is null then {RANKED} else 0 end as score,
        case when verdict is not null then verdict else coalesce(nullif(concat_ws(',', case when authors = 0 then 'unattributed' end, case when not named then 'untitled' end, case when linked < n then 'some-unlinked-items' end), ''),
            case when {RANKED} < 50 then 'low-score' else '' end) end as reasons from r""",
    lambda m: T.assess_series(derived(m, FEEDS, feeds=m.feeds), derived(m, POSTED, items=m.items)).withColumn("reasons", F.array_join("reasons", ",")),
)

#: Headers of pages: single and repeated policies, lists, other directives, wrong and missing values.
HEADERS = """select page_id, case page_id % 11 when 0 then 'default-src *; frame-ancestors ''none''' when 1 then 'frame-ancestors *' when 2 then 'Frame-Ancestors https://O.example/ https://x.example'
        when 3 then 'frame-ancestors *.example' when 4 then 'frame-ancestors *, frame-ancestors ''self''' when 5 then 'frame-ancestors http:' when 6 then 'frame-ancestors https:; script-src *'
        when 7 then 'default-src *' when 8 then 'frame-ancestors' when 9 then 'frame-ancestors *.other.example x.example' end as csp,
    case page_id % 7 when 0 then 'DENY' when 1 then ' sameorigin' when 2 then 'allow-from https://o.example' when 3 then 'deny, sameorigin' when 4 then ' ' when 5 then 'nonsense' end as xfo from pages"""
add(
    "txt58_framing_verdict",
    f"""with h as ({HEADERS}), d as (select page_id, xfo, unnest(string_split(coalesce(csp, ''), ',')) as policy, generate_subscripts(string_split(coalesce(csp, ''), ','), 1) as k from h),
    w as (select page_id, k, trim(regexp_extract(lower(';' || policy), ';\\s*frame-ancestors((\\s[^;]*)?)(;|$)', 1)) as sources from d where regexp_matches(lower(';' || policy), ';\\s*frame-ancestors(\\s|;|$)')),
    s as (select page_id, k, unnest(case when sources = '' then [null] else regexp_split_to_array(sources, '\\s+') end) as source from w),
    p as (select page_id, k, bool_or(coalesce(source in ('*', 'https:') or regexp_replace(regexp_replace(source, '^https?://', ''), '/+$', '') in ('o.example', '*.example'), false)) as ok from s group by 1, 2),
    a as (select page_id, bool_and(ok) as ok from p group by 1),
    r as (select h.page_id, case when ok then 'csp-allows' when not ok then 'csp-frame-ancestors' when trim(coalesce(xfo, '')) = '' then 'no-policy' when regexp_matches(lower(xfo), '(^|,)\\s*deny\\s*(,|$)') then 'x-frame-options-deny'
        when regexp_matches(lower(xfo), '(^|,)\\s*sameorigin\\s*(,|$)') then 'x-frame-options-sameorigin' when lower(xfo) like 'allow-from%' then 'x-frame-options-allow-from' else 'unrecognised-policy' end as reason from h left join a using (page_id))
    select page_id, reason in ('csp-allows', 'no-policy', 'unrecognised-policy') as frameable, reason from r""",
    lambda m: (lambda f, r: derived(m, HEADERS, pages=m.base("pages")).select("page_id", f.alias("frameable"), r.alias("reason")))(*T.framing_verdict(F.col("csp"), F.col("xfo"), "https://o.example")),
)

STATE = "select id, status, error_count, case when id % 3 = 0 then 'timeout' when id % 3 = 1 then '' end as last_error, last_fetched_at as last_success, case when id % 19 = 0 then null when id % 19 < 9 then 500000 + interval_minutes else interval_minutes end as interval_minutes, last_published_at as newest from feeds"
add(
    "sca29_freshness",
    f"""select id, case when last_success is null then 'unread' when status = 'error' or (coalesce(last_error, '') <> '' and error_count > 0) then 'failing'
        when epoch({AS_OF}) - epoch(last_success) > 120 * coalesce(interval_minutes, 60) then 'overdue' when newest < {AS_OF} - interval 365 day then 'dormant' else 'live' end as v from ({STATE})""",
    lambda m: derived(m, STATE, feeds=m.feeds).select("id", S.freshness(*(F.col(c) for c in ("status", "last_error", "error_count", "last_success", "interval_minutes", "newest")), _now()).alias("v")),
)
add(
    "sca30_human_gap",
    """with g as (select id, case when id % 17 = 0 then id % 100 - 20 else id * (id % 13) * (id % 101) end as s from feeds),
    u as (select id, s, case when s < 60 then null when s < 3600 then 60 when s < 86400 then 3600 when s < 5184000 then 86400 when s < 63072000 then 2592000 else 31536000 end as size from g),
    n as (select *, (2 * s + size) // (2 * size) as n, case size when 60 then 'minute' when 3600 then 'hour' when 86400 then 'day' when 2592000 then 'month' else 'year' end as unit from u)
    select id, case when size is null then 'moments' else n::varchar || ' ' || unit || case when n = 1 then '' else 's' end end as v from n""",
    lambda m: m.feeds.select("id", S.human_gap(F.expr("case when id % 17 = 0 then id % 100 - 20 else id * (id % 13) * (id % 101) end")).alias("v")),
)
add(
    "sca18_throttle_minutes",
    "select id, case when id % 7 = 0 or id % 11 = 0 or id % 13 = 0 then 30 else least(greatest(ceil(id / 60), 1), 1440) end::bigint as v from feeds",
    lambda m: m.feeds.select("id", S.throttle_minutes(F.expr("case when id % 7 = 0 then null when id % 11 = 0 then -id when id % 13 = 0 then 0 else id end")).cast("long").alias("v")),
)
TRIED = "select item_id, case when item_id % 23 = 0 then null else state end as state, case when item_id % 9 = 0 then null else fetched_at end as fetched_at from extracts"
add(
    "sca28_should_fetch",
    f"""select item_id as id, case when state is null then true when state = 'ok' then false when fetched_at is null then true
        else epoch({AS_OF}) - epoch(fetched_at) >= case when state = 'error' or state like 'http-5__' then 600 else 86400 end end as v from ({TRIED})""",
    lambda m: derived(m, TRIED, extracts=m.extracts).select(F.col("item_id").alias("id"), S.should_fetch(F.col("state"), F.col("fetched_at"), _now()).alias("v")),
)

#: Jobs in all states: events are parted by blanks.
JOBS = f"""select 'update' as job, (select count(*) from feeds where next_fetch_at <= {AS_OF}) as backlog, cast(900 as bigint) as rate, 'view error' as events, true as expect_full, cast(null as bigint) as alarm_above, false as finished
    union all select 'first-crawl', (select count(*) from feeds where status = 'pending'), 900, 'view', false, 50, false union all select 'cards', (select count(*) from feeds where card_state = 'none'), 3, 'click', false, null, false
    union all select 'failing', 5, 9, 'error', false, null, false union all select 'clear', 0, null, 'signup', false, null, false union all select 'idle', 0, 5, 'nothing', false, null, false
    union all select 'walking', null, 7, 'nothing', false, null, false union all select 'resting', null, 0, 'click', false, null, false union all select 'silent', null, null, 'nothing', false, null, false
    union all select 'stuck', 7, 0, 'click purchase', true, null, false union all select 'unborn', 7, null, 'nothing', false, null, false union all select 'over', null, null, 'purchase', false, null, true"""
add(
    "agg45_job_rows",
    f"""with j as ({JOBS}), a as (select job, count(*) as runs, count(*) filter (log.status = 'error') as errors, max("at") as last_at from j join log on ' ' || j.events || ' ' like '% ' || log.event || ' %' group by 1),
    r as (select j.*, coalesce(runs, 0) as runs, coalesce(errors, 0) as errors, last_at from j left join a using (job))
    select job, backlog, runs, errors, last_at, case when errors > 0 and errors = runs then 'failing' when finished then 'done' when backlog = 0 and last_at is null then 'idle' when backlog = 0 then 'clear'
        when backlog is null and rate > 0 then 'working' when backlog is null and last_at is null then 'stalled' when backlog is null then 'idle' when coalesce(rate, 0) = 0 and last_at is null then 'idle' when coalesce(rate, 0) = 0 then 'stalled'
        when not expect_full and backlog > alarm_above then 'behind' else 'working' end as state, round(backlog / nullif(rate, 0), 6) as eta from r""",
    lambda m: A.job_rows(derived(m, JOBS, feeds=m.feeds).withColumn("events", F.split("events", " ")),
                         m.log.groupBy("event").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status") == "error").alias("errors"), F.max("at").alias("last_at"))),
)

UNKEYED = "select id, title, case when id % 13 = 0 then null else cluster_key end as cluster_key, published_at from items"
add(
    "win01_dedupe_items",
    f"""with x as (select *, coalesce(cluster_key, {KEY.format('title')}, '') as story from ({UNKEYED})),
    r as (select *, row_number() over (partition by story order by published_at desc nulls last, id) as n, count(*) over (partition by story) as c from x)
    select id, cluster_key, published_at, case when story = '' then 0 else c - 1 end as duplicates from r where story = '' or n = 1""",
    lambda m: W.dedupe_items(derived(m, UNKEYED, items=m.items), "cluster_key", W.newest_first("published_at", "id"), "title").drop("title"),
)
add(
    "win05_cumulative_back",
    """with d as (select cast(created_at as date) as day, count(*) as added from feeds where created_at >= timestamp '2000-06-01' group by 1), b as (select count(*) as earlier from feeds where created_at < timestamp '2000-06-01' or created_at is null)
    select day, added, (earlier + sum(added) over (order by day))::bigint as running from d, b""",
    lambda m: W.cumulative_back(m.feeds.where("created_at >= timestamp '2000-06-01'").groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("added")), "day", "added", A.count(m.feeds, "total")),
)

add(
    "txt14_feed_text",
    """with n as (select *, row_number() over (partition by source order by doc_id) as n from texts), p as (select source, string_agg(title || ' ' || summary, ' ' order by n) as posts from n where n <= 30 group by 1)
    select source, lower('About ' || source || ' ' || 'all of ' || source || ' ' || posts) as text from p""",
    lambda m: T.feed_text(m.texts.select("source").distinct().select("source", F.concat(F.lit("About "), "source").alias("title"), F.concat(F.lit("all of "), "source").alias("description")), m.texts, "source", ["doc_id"]),
)
add(
    "txt15_relevance",
    f"""with s as (select doc_id, {STEMS.format("title || ' unheardof wordings'")} as stems, lower(summary) as text from texts), x as (select doc_id, list_sort(list_filter(stems, lambda w: contains(text, w))) as matched, ceil(len(stems) / 2)::int as required from s)
    select doc_id, len(matched) >= required as relevant, matched, required from x""",
    lambda m: (lambda r, f, n: m.texts.select("doc_id", r.alias("relevant"), F.array_sort(f).alias("matched"), n.alias("required")))(*T.assess_relevance(F.concat("title", F.lit(" unheardof wordings")), F.col("summary"))),
)
