"""Queries that depend on order."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.operators import windows as W
from skein.plans.reads import _now, add
from skein.sources.model import AS_OF

RIVER = "order by published_at desc nulls last, id, cluster_key"
FOLD = """select id, cluster_key, published_at, 0 as duplicates from {t} where cluster_key = '' union all
    select id, cluster_key, published_at, n - 1 from (select *, row_number() over (partition by cluster_key order by published_at desc nulls last, id) as r, count(*) over (partition by cluster_key) as n from {t} where cluster_key <> '') where r = 1"""
ITEM = ["id", "cluster_key", "published_at"]
#: What readers follow, and what is filed under topics by its publisher: two rivers that have posts in common.
add("win02_merge_river", f"with r as (select id, cluster_key, published_at from items where feed_id in (select feed_id from follows) union all select id, cluster_key, published_at from items where feed_id in (select feed_id from feed_keywords where source = 'category')), x as (select * from r) select * from ({FOLD.format(t='x')}) {RIVER} limit 60",
    lambda m: W.merge_river([m.items.join(m.follows.select("feed_id"), "feed_id", "left_semi").select(ITEM), m.items.join(m.feed_keywords.where("source = 'category'").select("feed_id"), "feed_id", "left_semi").select(ITEM)]))
add("win03_following", f"""with s as (select 'feeds' as source, feed_id from follows where user_id = 110 union all select distinct 'topics', k.feed_id from feed_keywords k join topic_follows t on t.slug = k.slug where t.user_id = 110),
    p as (select *, row_number() over (partition by source order by published_at desc nulls last, id, cluster_key) as n from (select i.id, i.cluster_key, i.published_at, s.source from items i join s on s.feed_id = i.feed_id)),
    x as (select distinct id, cluster_key, published_at from p where n <= 60) select * from ({FOLD.format(t='x')}) {RIVER} limit 60""",
    lambda m: W.following(m.items.select("feed_id", *ITEM), m.follows.where("user_id = 110").select(F.lit("feeds").alias("source"), "feed_id").unionByName(
        m.feed_keywords.join(m.topic_follows.where("user_id = 110").select("slug").distinct(), "slug").select(F.lit("topics").alias("source"), "feed_id").distinct())).select(*ITEM, "duplicates"))
add("win04_select_batch", """with pool as (select o.user_id, o.source, i.id, i.created_at, case when i.cluster_key <> '' then 'c:' || i.cluster_key else 'g:' || i.id::varchar end as item_key from items i join (select user_id, feed_id, 'f' || (feed_id % 3)::varchar as source from follows where alerts) o on o.feed_id = i.feed_id),
    p as (select user_id, source, count(*) as n, max(created_at) as e from pool group by 1, 2), h as (select user_id, min(case when n >= 8 then e end) as horizon from p group by 1),
    r as (select pool.* from pool join h using (user_id) where (horizon is null or created_at <= horizon) and not exists (select 1 from alert_sent s where s.user_id = pool.user_id and s.item_key = pool.item_key)),
    f as (select * from r qualify row_number() over (partition by user_id, item_key order by created_at, id, source) = 1), k as (select * from f qualify rank() over (partition by user_id order by created_at) <= 5)
    select user_id, item_key, id, created_at, max(created_at) over (partition by user_id) as next_cursor from k""",
    lambda m: W.select_batch(m.items.join(m.follows.where("alerts").select("user_id", "feed_id", F.concat(F.lit("f"), (F.col("feed_id") % 3).cast("string")).alias("source")), "feed_id").select(
        "user_id", "source", "id", "created_at", F.when(F.col("cluster_key") != "", F.concat(F.lit("c:"), "cluster_key")).otherwise(F.concat(F.lit("g:"), F.col("id").cast("string"))).alias("item_key")), m.alert_sent, 8, 5))
add("win06_day_labels", "with d as (select max(\"at\")::date as today from log) select day, count(l.id) as lines from (select cast(unnest(generate_series(today - 29, today, interval 1 day)) as date) as day from d) left join log l on l.\"at\"::date = day group by 1",
    lambda m: W.day_labels(m.log.agg(F.max("at").cast("date").alias("today")), 30).join(m.log.select(F.col("at").cast("date").alias("day"), "id"), "day", "left").groupBy("day").agg(F.count("id").alias("lines")))
add("win07_queue_history", "select hour, crawled from hourly where hour >= timestamp '2024-01-29 00:00:00' order by hour", lambda m: m.hourly.where("hour >= timestamp '2024-01-29 00:00:00'").select("hour", "crawled").orderBy("hour"))
GRID = "g as (select unnest(generate_series(timestamp '2024-01-29 01:00:00', timestamp '2024-01-31 00:00:00', interval 1 hour)) as hour)"
add("win08_indexing_history", f"with {GRID} select g.hour, coalesce(crawled, 0) as crawled, h.hour is not null as recorded from g left join hourly h on h.hour = g.hour", lambda m: W.filled_hours(m.hourly.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "2024-01-31 00:00:00", 48))
add("win09_queue_samples", f"with {GRID} select g.hour, h.failed::bigint as failed from g left join hourly h on h.hour = g.hour", lambda m: W.sampled_hours(m.hourly.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "2024-01-31 00:00:00", 48, "failed"))
HOST = "regexp_extract(feed_url, '^https?://([^/]+)', 1)"
add("win10_spread_hosts", f"with r as (select id, {HOST} as host, next_fetch_at, row_number() over (partition by {HOST} order by next_fetch_at, id) as turn from feeds) select id, host, turn from r order by turn > 3, next_fetch_at, id limit 150", lambda m: W.spread_hosts(m.feeds, S.host_of(F.col("feed_url")), 150, 3, F.col("next_fetch_at"), F.col("id")).select("id", "host", "turn"))
add("win11_group_by_host", f"select {HOST} as host, count(*) as waiting, min(next_fetch_at) as first_due from feeds group by 1", lambda m: W.group_by_host(m.feeds, S.host_of(F.col("feed_url"))))
ENTRIES = "e as (select id, case when id % 5 = 0 then 'HTTPS://host17.example/feed/' || id::varchar else url end as url from import_entries)"
add("win12_queue_feeds", f"with {ENTRIES}, f as (select * from e qualify row_number() over (partition by lower(url) order by id) = 1), n as (select * from f where lower(url) not in (select lower(feed_url) from feeds)), p as (select id, url, row_number() over (order by id) - 1 as place from n) select id, url, place, {AS_OF} + to_seconds(place * 60) as next_fetch_at from p",
    lambda m: W.queue_feeds(m.import_entries.select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("HTTPS://host17.example/feed/"), F.col("id").cast("string"))).otherwise(F.col("url")).alias("url")), m.feeds, F.expr(f"{AS_OF}"), 60).select("id", "url", "place", "next_fetch_at"))
add("win14_import_feeds", "select id, url from (select *, row_number() over (partition by lower(url) order by id) as n from import_entries) where n = 1 and lower(url) not in (select lower(feed_url) from feeds)", lambda m: W.queue_feeds(m.import_entries, m.feeds, _now(), 60).select("id", "url"))
add("win16_series_authors", "select feed_id, min_by(name, id) as name, min(id) as id from (select feed_id, id, case when id % 2 = 0 then upper('supplier ' || (supplier % 3)::varchar) else 'Supplier ' || (supplier % 3)::varchar end as name from items) group by feed_id, lower(name)",
    lambda m: W.first_spelling(m.items.select("feed_id", "id", F.expr("case when id % 2 = 0 then upper('supplier ' || cast(supplier % 3 as string)) else 'Supplier ' || cast(supplier % 3 as string) end").alias("name")), "name", "id", "feed_id"))
add("win17_candidate_sites", f"select id as pos, {HOST} as host from feeds qualify row_number() over (partition by {HOST} order by id) = 1", lambda m: W.candidate_sites(m.feeds.withColumnRenamed("id", "pos"), S.host_of(F.col("feed_url"))).select("pos", "host"))
add("win24_rate_limit", """with recursive per as (select subject as identity, date_trunc('second', "at") as "at", count(*) as hits from log group by 1, 2),
    o as (select identity, min("at") as opened from per group by 1 union all select p.identity, min(p."at") from o join per p on p.identity = o.identity and p."at" >= o.opened + interval 1 hour group by 1),
    w as (select p.*, o.opened from per p asof join o on p.identity = o.identity and p."at" >= o.opened), u as (select *, coalesce(sum(hits) over (partition by identity, opened order by "at" rows between unbounded preceding and 1 preceding), 0) as used from w)
    select identity, "at", hits, opened, greatest(least(hits, 3 - used), 0)::bigint as allowed from u""", lambda m: W.first_window_limit(m.log.select(F.col("subject").alias("identity"), "at"), 3))
add("set03_keyword_diff", """with a as (select feed_id, case when feed_id % 5 = 0 then slug || '-new' else slug end as slug, keyword, case when feed_id % 3 = 0 then count + 1 else count end as count from feed_keywords), b as (select feed_id, slug, keyword, count from feed_keywords)
    select coalesce(a.feed_id, b.feed_id) as feed_id, coalesce(a.slug, b.slug) as slug, case when a.slug is null then 'delete' when b.slug is null then 'insert' else 'update' end as op from a full join b on a.feed_id = b.feed_id and a.slug = b.slug where a.slug is null or b.slug is null or a.count <> b.count or a.keyword <> b.keyword""",
    lambda m: W.keyword_diff(m.feed_keywords.withColumn("count", F.expr("case when feed_id % 3 = 0 then count + 1 else count end")).withColumn("slug", F.expr("case when feed_id % 5 = 0 then slug || '-new' else slug end")), m.feed_keywords).select("feed_id", "slug", "op"))
