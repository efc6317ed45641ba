"""Queries that apply one expression to a relation or to a few literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.operators import aggregates as A
from skein.plans.reads import add
from skein.plans.verdicts import derived
from skein.sources import pages


add("sca03_kind_filter", "select id from feeds where category in ('blog', 'comic')", lambda m: m.feeds.where(F.col("category").isin("blog", "comic")).select("id"))
add("sca14_channel_id", "select id, regexp_extract(feed_url, 'host(\\d+)', 1) as v from feeds", lambda m: m.feeds.select("id", F.regexp_extract("feed_url", r"host(\d+)", 1).alias("v")))
add("sca20_host_of", "select id, regexp_extract(feed_url, '^https?://([^/]+)', 1) as v from feeds", lambda m: m.feeds.select("id", S.host_of(F.col("feed_url")).alias("v")))
add("sca22_usage_day", "select id, strftime(created_at, '%Y-%m-%d') as v from feeds", lambda m: m.feeds.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("v")))
add("sca23_segment_kinds", "select slug, case segment when 'audio' then ['podcast', 'music'] when 'news' then ['news'] end as v from topic_follows", lambda m: m.topic_follows.select("slug", S.segment_kinds(F.col("segment")).alias("v")))
add("sca31_eta", "select id, round(item_count / nullif(error_count, 0), 6) as v from feeds", lambda m: m.feeds.select("id", F.round(A.eta(F.col("item_count"), F.col("error_count")), 6).alias("v")))
add("sca42_post_thumb", "select id, audio_url as v from items", lambda m: m.items.select("id", S.post_thumb(F.lit(None).cast("string"), F.col("audio_url")).alias("v")))
add("sca06_published", "select id, epoch(created_at)::bigint as v from feeds", lambda m: m.feeds.select("id", S.published(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("v")))
add("txt17_age_of_newest", "select feed_id, (epoch(timestamp '2002-01-01') - epoch(max(published_at)))::bigint as age from items group by 1", lambda m: T.age_of_newest(m.items, F.expr("timestamp '2002-01-01'")))
add("txt26_byline_count", "select feed_id, count(distinct supplier % 7) as bylines from items group by 1", lambda m: T.byline_count(m.items.select("feed_id", F.concat(F.lit("Ann N"), (F.col("supplier") % 7).cast("string")).alias("author"))))
add("txt24_is_newsroom", "select id, (id % 20 >= 12 and id % 2 = 0) or (id % 20 >= 3 and (id % 5 >= 2 or id % 3 = 0)) or (id % 3 = 0 and id % 20 >= 2) as v from feeds", lambda m: m.feeds.select("id", T.is_newsroom(F.col("id") % 20, F.col("id") % 5, F.col("id") % 3 == 0, F.col("id") % 2 == 0).alias("v")))
add("txt27_is_show_shaped", "select id, 2 * (id % 6) > 5 and 2 * (id % 4) > id % 6 as v from feeds", lambda m: m.feeds.select("id", T.is_show_shaped(F.col("id") % 6, F.col("id") % 4, F.lit(5)).alias("v")))
add("txt55_card_fit", "select id, case when id % 900 >= 600 and id % 500 >= 315 then 'large' when id % 900 >= 200 and id % 500 >= 200 then 'small' else 'none' end as v from feeds", lambda m: m.feeds.select("id", S.card_fit(F.col("id") % 900, F.col("id") % 500).alias("v")))
add("txt64_worth_searching", "select a.id, confidence >= 0.8 and coalesce(n, 0) = 0 as v from authors a left join (select author_id, count(*) as n from author_links group by 1) l on l.author_id = a.id", lambda m: m.authors.join(m.author_links.groupBy(F.col("author_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", T.worth_searching(F.col("confidence"), F.col("name"), F.col("n")).alias("v")))
add("txt65_searches_for", "select id, n as network, '\"' || name || '\" ' || n as query from authors, (values ('github'), ('mastodon')) v(n)", lambda m: T.searches_for(m.authors, ["github", "mastodon"]))
add("src56_month_bounds", "select distinct date_trunc('month', created_at)::date as lo, (date_trunc('month', created_at) + interval 1 month)::date as hi from feeds", lambda m: m.feeds.select(F.trunc("created_at", "month").alias("lo"), F.add_months(F.trunc("created_at", "month"), 1).alias("hi")).distinct())

#: Lines of the log as crawls write them, among others.
LINES = "select id, at, case when id % 3 = 0 then 'feed' else event end as event, status, 'feed-' || cast(subject as string) as subject, cast(id % 2500 as bigint) as amount, detail, case when id % 4 <> 0 then cast(id % 900 as bigint) end as ms from log"
add("sca54_text_line", f"""with l as ({LINES.replace(' at,', ' "at",')}) select id, strftime("at", '%Y-%m-%dT%H:%M:%S.%gZ') || ' ' || rpad(coalesce(status, 'info'), 5, ' ') || ' ' || rpad(event, 16, ' ') || ' '
    || case when event = 'feed' and status = 'error' then subject || ' could not be crawled — ' || coalesce(detail, 'unknown')
        when event = 'feed' then 'crawled ' || subject || ' — ' || case amount when 0 then 'nothing new' when 1 then '1 new post' else format('{{:,}}', amount) || ' new posts' end
        else concat_ws(' ', nullif(subject, ''), nullif(detail, '')) end || case when ms is null then '' else ' (' || ms::varchar || 'ms)' end as v from l""",
    lambda m: derived(m, LINES, log=m.log).select("id", S.text_line(F.col("at"), F.col("event"), F.col("status"), F.col("subject"), F.col("amount"), F.col("detail"), F.col("ms")).alias("v")))

#: Files that name people, as pages of feeds write them.
HUMANS = r"select id, case id % 4 when 0 then '/* TEAM */' || LF || 'Developer: Ann ' || category || LF || 'Contact: a@b.c' || LF || LF || 'Editor: Cy Dee' when 1 then 'Name: Ann Bee' when 2 then '/* SITE */' || LF || 'Language: English' else '' end as body from feeds"
add("txt35_humans_txt", f"""with h as ({HUMANS}) select id, name, role from (select id, 'Ann ' || regexp_extract(body, 'Developer: Ann (\\w+)', 1) as name, 'developer' as role from h where id % 4 = 0
    union all select id, 'Cy Dee', 'editor' from h where id % 4 = 0 union all select id, 'Ann Bee', 'name' from h where id % 4 = 1)""",
    lambda m: derived(m, HUMANS, feeds=m.feeds).select("id", F.explode(pages.people_of_humans("body")).alias("p")).select("id", "p.name", "p.role"))
