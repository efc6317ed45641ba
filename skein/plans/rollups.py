"""Queries that aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import aggregates as A
from skein.operators import joins as J
from skein.operators import listing as L
from skein.plans.joins import ALERTING
from skein.plans.reads import _now, add
from skein.sources.model import AS_OF, KINDS, LANES, LOG_AS_OF, SEGMENTS, TOPICS_SQL

VALUES = "(values " + ", ".join(f"('{k}')" for k in KINDS) + ") v(category)"
#: name, relation, condition: plain counts
COUNTS = [
    ("agg01_count_feeds", "feeds", "status <> 'dead' and category = 'news'"),
    ("agg03_count_items", "items", "feed_id = 77"),
    ("agg04_count_feed_keywords", "feed_keywords", "feed_id = 77"),
    ("agg14_count_due_feeds", "feeds", f"status <> 'dead' and not coalesce(next_fetch_at > {AS_OF}, false)"),
    ("agg15_count_author_queue", "feeds", "status = 'active' and authors_checked_at is null"),
    ("agg18_submission_count", "submissions", f"ip_hash = 'ip5' and created_at >= {AS_OF} - DAYS(7)"),
    ("agg19_count_import_entries", "import_entries", "submission_id = 13"),
    ("agg21_count_authors", "authors", "confidence >= 0.6"),
    ("agg26_count_runs", "runs", "provider = 'list'"),
    ("agg27_count_queued_keywords", "run_keywords", "status = 'queued'"),
    ("agg28_count_queued_candidates", "candidates", "status = 'queued'"),
    ("agg32_count_likes", "reactions", "user_id = 3 and liked"),
    ("agg33_count_comments", "comments", "item_id = 3 and not deleted"),
    ("agg35_author_follower_count", "author_follows", "author_id = 13"),
    ("agg36_topic_follower_count", "topic_follows", "slug = 'topic-11' and segment = 'audio'"),
    ("agg37_login_token_count", "login_tokens", f"email = 'user4@example.org' and created_at >= {AS_OF} - MINUTES(60)"),
    ("agg39_channel_count", "channels", "user_id = 4"),
    ("agg40_live_key_count", "api_keys", "user_id = 5 and revoked_at is null"),
]
for _name, _relation, _where in COUNTS:
    from skein.sources.model import spark_sql

    add(_name, f"select count(*) as n from {_relation} where {_where}", lambda m, r=_relation, w=_where: A.count(getattr(m, r).where(spark_sql(w))))

add("agg02_count_feeds_by_kind", f"select v.category, coalesce(n, 0) as n from {VALUES} left join (select category, count(*) as n from feeds where status <> 'dead' group by 1) c on c.category = v.category", lambda m: A.count_by(L.live(m.feeds), "category", KINDS))
add("agg05_topic_kind_counts", "select f.category, count(*) as feeds from feed_keywords k join feeds f on f.id = k.feed_id where k.slug = 'topic-3' and f.status <> 'dead' group by 1", lambda m: A.topic_kind_counts(m.feed_keywords, m.feeds, "topic-3"))
add("agg06_count_topics", f"with {TOPICS_SQL} select count(*) as n from topics where feed_count >= 3 and slug ilike '%1%'", lambda m: A.count(m.topics.where("feed_count >= 3 and slug ilike '%1%'")))
add("agg07_refresh_topics", f"with {TOPICS_SQL} select slug, keyword, feed_count from topics", lambda m: m.topics)
add("agg09_job_backlogs", f"""select 'crawl' as job, count(*) as backlog from feeds where status <> 'dead' and next_fetch_at <= {AS_OF} union all select 'authors', count(*) from feeds where status = 'active' and authors_checked_at is null
    union all select 'cards', count(*) from feeds where status <> 'dead' and card_state is distinct from 'ok' union all select 'import', count(*) from import_entries union all select 'keywords', count(*) from run_keywords where status = 'queued' union all select 'candidates', count(*) from candidates where status = 'queued'""",
    lambda m: A.job_backlogs(m.feeds, m.import_entries, m.run_keywords, m.candidates, _now()))
add("agg10_log_activity", f"""select event, count(*) as lines, count(*) filter (status = 'error') as errors, round(sum(amount), 4) as amount, sum(coalesce(case when detail like '{{%' then json_extract_string(detail, '$.k')::bigint end, 0))::bigint as k, max("at") as latest, trunc(avg(amount))::int as mean
    from log where "at" >= {LOG_AS_OF} - DAYS(20) group by 1""", lambda m: A.log_activity(m.log, F.expr(f"{LOG_AS_OF} - interval 20 days")))
add("agg11_crawl_stats", f"""select count(*) as total, count(*) filter (status = 'active') as active, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'error') as error, count(*) filter (status = 'dead') as dead,
    count(*) filter (status <> 'dead' and not coalesce(next_fetch_at > {AS_OF}, false)) as due, count(*) filter (status = 'active' and last_fetched_at < {AS_OF} - DAYS(7)) as stale, min(last_fetched_at) as oldest, max(last_fetched_at) as newest, sum(item_count)::bigint as items from feeds""", lambda m: A.crawl_stats(m.feeds, _now()))
add("agg11_hourly_rate", "select round(coalesce(sum(crawled), 0) / (1 + 30 / 60.0), 6) as per_hour from hourly where hour in (timestamp '2024-01-20 10:00:00', timestamp '2024-01-20 09:00:00')", lambda m: A.hourly_rate(m.hourly, F.expr("timestamp '2024-01-20 10:00:00'"), 30))
add("agg12_category_growth", f"select cast(created_at as date) as day, category, count(*) as added from feeds where created_at >= {AS_OF} - DAYS(30) group by 1, 2", lambda m: A.category_growth(m.feeds, F.expr(f"{AS_OF} - interval 30 days")))
add("agg13_card_coverage", "select count(*) as total, count(*) filter (card_state = 'ok') as ok, count(*) filter (card_state = 'none') as none, count(*) filter (card_state = 'error') as failed, count(*) filter (card_state is null) as unknown from feeds where status <> 'dead'", lambda m: A.card_coverage(m.feeds))
add("agg16_reliability", f"""with h as (select round(1 - sum(failed) / sum(crawled), 6) as success, count(*) as recorded, date_diff('hour', min(hour), max(hour)) + 1 as observed from hourly),
    f as (select count(*) filter (last_published_at >= {AS_OF} - DAYS(365)) as publishing, count(*) filter (not coalesce(last_published_at >= {AS_OF} - DAYS(365), false)) as dormant, min(next_fetch_at) as first_due, max(next_fetch_at) as last_due from feeds where status <> 'dead') select * from h, f""", lambda m: A.reliability(m.feeds, m.hourly, _now()))
add("agg17_submission_progress", "select count(*) as total, count(*) filter (status = 'active') as active, count(*) filter (status = 'error') as error, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'dead') as dead from feeds where submission_id = 8", lambda m: A.pivot_counts(L.lookup(m.feeds, submission_id=8), "status", ["active", "error", "pending", "dead"]))
add("agg20_author_stats", """select (select count(*) from authors where confidence >= 0.6) as authors, (select count(email) from authors where confidence >= 0.6) as with_email, (select count(distinct feed_id) from feed_authors where author_id in (select id from authors where confidence >= 0.6)) as feeds,
    (select count(*) from author_links) as links, (select count(*) from author_links where verified) as verified, (select count(distinct author_id) from author_links) as linked""", lambda m: A.author_stats(m.authors, m.author_links, m.feed_authors))
add("agg22_search_spend_since", "select coalesce(sum(queries), 0)::bigint as n from author_searches where \"at\" >= timestamp '1999-01-13'", lambda m: m.author_searches.where("at >= timestamp '1999-01-13'").agg(F.coalesce(F.sum("queries"), F.lit(0)).alias("n")))
add("agg23_keyword_progress", "select count(*) as total, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'done') as done, count(*) filter (status = 'searching') as searching, count(*) filter (status = 'error') as error from run_keywords where run_id = 9", lambda m: A.pivot_counts(L.lookup(m.run_keywords, run_id=9), "status", ["queued", "done", "searching", "error"]))
add("agg24_run_progress", "select count(*) as total, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'accepted') as accepted, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'error') as error from candidates where run_id = 9", lambda m: A.pivot_counts(L.lookup(m.candidates, run_id=9), "status", ["queued", "accepted", "rejected", "error"]))
add("agg25_run_count", f"select count(*) as n, count(*) filter (status = 'done') as done from runs where ip_hash = 'ip9' and created_at >= {AS_OF} - DAYS(30)", lambda m: L.lookup(m.runs, ip_hash="ip9").where(f"created_at >= {AS_OF} - interval 30 days").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done")))
add("agg29_language_counts", "select language, count(*) as feeds from feeds where trim(language) <> '' group by 1 order by 2 desc, 1 limit 100", lambda m: A.language_counts(m.feeds))
add("agg30_usage_for_day", "select day, sum(used)::bigint as used from usage group by 1", lambda m: m.usage.groupBy("day").agg(F.sum("used").alias("used")))
add("agg31_score_for", "select item_id, count(*) filter (vote = 1) as up, count(*) filter (vote = -1) as down, count(*) filter (vote = 1) - count(*) filter (vote = -1) as score from reactions group by 1", lambda m: A.score_for(m.reactions))
add("agg34_lane_counts", "select v.lane, coalesce(n, 0) as n from (values ('read'), ('listen'), ('watch')) v(lane) left join (select lane, count(*) as n from queue_entries where not done and user_id = 110 group by 1) c on c.lane = v.lane", lambda m: A.count_by(L.lookup(m.queue_entries, user_id=110).where("not done"), "lane", LANES))
add("agg38_alerting_account_count", f"with {ALERTING} select count(*) as n from users u where exists (select 1 from channels c where c.user_id = u.id and c.enabled) and u.id in (select user_id from a)", lambda m: A.count(J.users_with_alerts(m.users, m.channels, J.alerting_follows(m.follows, m.topic_follows, m.author_follows), m.alert_state, 10**7)))
add("agg41_offered_languages", "with c as (select language, count(*) as feeds from feeds where trim(language) <> '' group by 1), p as (select regexp_extract(lower(language), '^([a-z]{2,3})', 1) as code, sum(feeds)::bigint as feeds from c group by 1) select code, feeds from p order by case code when 'fr' then 1 when 'en' then 2 end nulls last, feeds desc, code limit 8", lambda m: A.offered_languages(A.language_counts(m.feeds), ["fr", "en"]))
GROUPS = "(values " + ", ".join(f"('{g}', '{k}')" for g, ks in SEGMENTS.items() for k in ks) + ") g(grp, category)"
KIND_N = "c as (select category, count(*) as n from feeds where status <> 'dead' and category <> 'comic' group by 1)"
add("agg42_filters_with_hits", f"with {KIND_N} select g.grp, sum(coalesce(n, 0))::bigint as n from {GROUPS} left join c on c.category = g.category group by 1 having sum(coalesce(n, 0)) > 0", lambda m: A.grouped_counts(L.live(m.feeds).where("category <> 'comic'").groupBy("category").agg(F.count(F.lit(1)).alias("n")), SEGMENTS))
add("agg43_total_hits", f"with {KIND_N} select sum(n)::bigint as n from c", lambda m: L.live(m.feeds).where("category <> 'comic'").groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n")))
add("agg44_groups_with_feeds", f"with k as (select f.category, count(*) as n from feed_keywords k join feeds f on f.id = k.feed_id where k.slug = 'topic-3' and f.status <> 'dead' group by 1) select g.grp, sum(coalesce(n, 0))::bigint as n from {GROUPS} left join k on k.category = g.category group by 1 having sum(coalesce(n, 0)) > 0", lambda m: A.grouped_counts(A.topic_kind_counts(m.feed_keywords, m.feeds, "topic-3").withColumnRenamed("feeds", "n"), SEGMENTS))
add("agg46_queue_runtime", "select q.user_id, case when 2 * count(case when i.audio_url is not null then i.audio_seconds end) >= count(*) then sum(case when i.audio_url is not null then i.audio_seconds end)::bigint end as seconds, count(*) as tracks from queue_entries q join items i on i.id = q.item_id group by 1", lambda m: A.queue_runtime(m.queue_entries, m.items))
add("agg47_write_tally", "select event as shape, count(*) as calls, round(sum(amount), 4) as amount from log group by 1", lambda m: m.log.groupBy(F.col("event").alias("shape")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("amount"), 4).alias("amount")))
add("set01_events", "select * from (select 'keyword' as source, id, \"at\", keyword as subject, status from run_keywords where run_id = 9 union all select 'site', id, \"at\", host, status from candidates where run_id = 9) order by \"at\", source, id limit 50",
    lambda m: L.page(L.lookup(m.run_keywords, run_id=9).select(F.lit("keyword").alias("source"), "id", "at", F.col("keyword").alias("subject"), "status").unionByName(L.lookup(m.candidates, run_id=9).select(F.lit("site").alias("source"), "id", "at", F.col("host").alias("subject"), "status")), F.col("at"), F.col("source"), F.col("id"), limit=50))
