"""Queries that give the state after a mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import merges as M
from skein.operators.windows import top_per
from skein.plans.reads import add
from skein.sources.model import AS_OF, LOG_AS_OF, spark_sql

#: name, relation, columns, condition, new values: what an UPDATE leaves.
UPDATES = [
    ("dml05_curate_category", "feeds", "id category", "feed_url in ('https://host17.example/feed/77', 'https://host1.example/feed/1') or id < 9", {"category": "'news'"}),
    ("dml08_set_feed_card", "feeds", "id card_state card_checked_at", "id % 100 = 7", {"card_state": "'ok'", "card_checked_at": AS_OF}),
    ("dml10_complete_submission", "submissions", "id ready", "id = 6", {"ready": "true"}),
    ("dml11_mark_submission_notified", "submissions", "id notified", "id = 5", {"notified": "true"}),
    ("dml13_mark_import_ready", "submissions", "id ready", "id in (6, 12)", {"ready": "true"}),
    ("dml21_mark_authors_checked", "feeds", "id authors_checked_at", "id = 77", {"authors_checked_at": AS_OF}),
    ("dml22_mark_authors_failed", "feeds", "id authors_checked_at", "id = 77", {"authors_checked_at": f"{AS_OF} - DAYS(6)"}),
    ("dml25_update_run", "runs", "id status", "id = 9", {"status": "coalesce('done', status)"}),
    ("dml28_mark_keyword", "run_keywords", "id status", "run_id = 9 and status = 'queued'", {"status": "'done'"}),
    ("dml29_mark_candidate", "candidates", "id status reason", "run_id = 9 and status = 'queued'", {"status": "'accepted'", "reason": "null"}),
    ("dml30_mark_run_notified", "runs", "id notified", "id = 9", {"notified": "true"}),
    ("dml34_set_reading_language", "users", "id lang", "id = 4", {"lang": "'de'"}),
    ("dml38_delete_comment", "comments", "id deleted", "item_id = 3 and user_id = 'user'", {"deleted": "true"}),
    ("dml43_set_done", "queue_entries", "id done", "user_id = 110 and lane = 'read'", {"done": "true"}),
    ("dml51_set_feed_alerts", "follows", "user_id feed_id alerts", "user_id = 110", {"alerts": "false"}),
    ("dml52_set_topic_alerts", "topic_follows", "user_id slug segment alerts", "user_id = 110", {"alerts": "true"}),
    ("dml53_set_author_alerts", "author_follows", "user_id author_id alerts", "user_id = 110", {"alerts": "true"}),
    ("dml55_set_channel_enabled", "channels", "id enabled failures", "id = 4", {"enabled": "true", "failures": "0"}),
    ("dml58_record_channel_result", "channels", "id enabled failures", "id % 8 = 2", {"failures": "failures + 1", "enabled": "enabled and failures + 1 < 5"}),
    ("str16_mark_unchanged", "feeds", "id status error_count next_fetch_at", "id % 50 = 1", {"status": "'active'", "error_count": "0", "next_fetch_at": f"{AS_OF} + MINUTES(90)"}),
    ("str17_mark_crawl_failure", "feeds", "id status error_count", "id % 50 = 2", {"error_count": "error_count + 1", "status": "case when error_count + 1 >= 10 then 'dead' else 'error' end"}),
    ("str18_mark_throttled", "feeds", "id next_fetch_at", "id % 50 = 3", {"next_fetch_at": f"{AS_OF} + MINUTES(30)"}),
    ("str19_mark_crawl_success", "feeds", "id status error_count item_count", "id % 50 = 4", {"status": "'active'", "error_count": "0", "item_count": "item_count + 3"}),
    ("str10_set_alert_cursor", "alert_state", "user_id cursor_at", "user_id = 4", {"cursor_at": AS_OF}),
    ("str11_touch_alert_state", "alert_state", "user_id served_at", "user_id = 4", {"served_at": AS_OF}),
]
#: name, relation, columns, condition: what a DELETE leaves.
DELETES = [
    ("dml40_remove_many", "queue_entries", "id user_id item_id", "user_id = 110 and item_id in (4411, 31)"),
    ("dml41_remove_entry", "queue_entries", "id user_id", "user_id = 110 and id = 4"),
    ("dml42_remove_item", "queue_entries", "id user_id item_id lane", "user_id = 110 and lane = 'read'"),
    ("dml44_clear_lane", "queue_entries", "id user_id lane done", "user_id = 110 and lane = 'listen' and done"),
    ("dml46_unfollow", "follows", "user_id feed_id", "user_id = 899 and feed_id = 0"),
    ("dml48_unfollow_topic", "topic_follows", "user_id slug segment", "slug = 'topic-11' and segment = 'audio'"),
    ("dml50_unfollow_author", "author_follows", "user_id author_id", "author_id = 13"),
    ("dml56_delete_channel", "channels", "id user_id", "id = 4 and user_id = 4"),
    ("dml57_delete_push_channel", "channels", "id user_id kind", "kind = 'push' and user_id = 10"),
    ("dml14_drop_import_entries", "import_entries", "id url", "id % 3 = 0"),
    ("str04_prune_crawl_log", "log", "id event", f"\"at\" < {LOG_AS_OF} - MINUTES(720)"),
    ("str05_prune_crawl_hours", "hourly", "hour crawled", f"hour < {LOG_AS_OF} - DAYS(20)"),
    ("str06_prune_queue_hours", "hourly", "hour items", f"hour < {LOG_AS_OF} - DAYS(10)"),
    ("str07_prune_alert_sent", "alert_sent", "user_id item_key", f"sent_at < {AS_OF} - DAYS(30)"),
    ("str08_purge_expired", "sessions", "user_id expires_at", f"expires_at < {AS_OF}"),
]
#: name, relation, key, new rows over the relation itself: what an INSERT that minds its key leaves.
INSERTS = [
    ("dml04_insert_feeds_bulk", "feeds", "slug", "id feed_url", "select 'feed-' || cast(id + 7 as string) as slug, id + 7 as id, feed_url from feeds where id < 20 or id > 14980"),
    ("dml26_insert_keywords", "run_keywords", "run_id keyword", "", "select run_id, 'topic-' || cast((id + 3) % 80 as string) as keyword from run_keywords where id % 50 = 0"),
    ("dml27_insert_candidates", "candidates", "run_id host", "", "select run_id, 'host' || cast((id + 5) % 950 as string) || '.example' as host from candidates where id % 50 = 1"),
    ("dml45_follow", "follows", "user_id feed_id", "", "select user_id, feed_id + 1 as feed_id from follows where user_id < 50 union all select user_id, feed_id from follows where user_id < 50"),
    ("dml47_follow_topic", "topic_follows", "user_id slug segment", "", "select user_id, 'topic-9' as slug, '' as segment from topic_follows"),
    ("dml49_follow_author", "author_follows", "user_id author_id", "", "select user_id, 13 as author_id from author_follows"),
    ("str12_mark_sent", "alert_sent", "user_id item_key", "", "select user_id, 'c:k1' as item_key from alert_sent where user_id < 200"),
]
for _name, _relation, _columns, _where, _sets in UPDATES:
    _sel = ", ".join(f"case when {_where} then {_sets[c]} else {c} end as {c}" if c in _sets else c for c in _columns.split())
    add(_name, f"select {_sel} from {_relation}", lambda m, r=_relation, c=_columns, w=_where, s=_sets: M.update_where(getattr(m, r), spark_sql(w), **{k: F.expr(spark_sql(v)) for k, v in s.items()}).select(*c.split()))
for _name, _relation, _columns, _where in DELETES:
    add(_name, f"select {', '.join(_columns.split())} from {_relation} where not coalesce({_where}, false)", lambda m, r=_relation, c=_columns, w=_where: M.delete_where(getattr(m, r), spark_sql(w.replace('"', ""))).select(*c.split()))
for _name, _relation, _key, _rest, _rows in INSERTS:
    _cols = f"{_key} {_rest}".split()
    _on = " and ".join(f"t.{k} = n.{k}" for k in _key.split())
    add(_name, f"with n as (select distinct on ({', '.join(_key.split())}) {', '.join(_cols)} from ({_rows}) order by {', '.join(_cols)}) select {', '.join(_cols)} from {_relation} union all select {', '.join(_cols)} from n where not exists (select 1 from {_relation} t where {_on})",
        lambda m, r=_relation, k=_key, c=_cols, q=_rows: M.insert_new(getattr(m, r).select(*c), m.spark.sql(q.replace(f"from {r}", "from {t}"), t=getattr(m, r)), *k.split()))

add("dml01_upsert_items", """with o as (select feed_id, guid, title, case when id % 5 = 0 then null else published_at end as published_at, audio_url from items qualify row_number() over (partition by feed_id, guid order by id, title, published_at, audio_url) = 1),
    n as (select feed_id, case when id % 3 = 0 then guid || '-new' else guid end as guid, 'new ' || title as title, published_at, coalesce(audio_url, 'x') as audio_url from items qualify row_number() over (partition by feed_id, guid order by id, title, published_at, audio_url) = 1)
    select feed_id, guid, coalesce(o.title, n.title) as title, coalesce(o.published_at, n.published_at) as published_at, coalesce(o.audio_url, n.audio_url) as audio_url from o full join n using (feed_id, guid)""",
    lambda m: (lambda one: M.merge(one.select("feed_id", "guid", "title", F.expr("case when id % 5 = 0 then null else published_at end").alias("published_at"), "audio_url"),
                                   one.select("feed_id", F.expr("case when id % 3 = 0 then guid || '-new' else guid end").alias("guid"), F.concat(F.lit("new "), "title").alias("title"), "published_at", F.coalesce("audio_url", F.lit("x")).alias("audio_url")), ["feed_id", "guid"], published_at=M.fill("published_at"), audio_url=M.fill("audio_url")))(
        m.spark.sql("select * from (select *, row_number() over (partition by feed_id, guid order by id, title, published_at, audio_url) as n from {t}) where n = 1", t=m.items)))
add("dml02_newest_items", "select feed_id, guid, id, title from items qualify row_number() over (partition by feed_id order by published_at desc nulls last, id desc, title) <= 2", lambda m: top_per(m.items, "feed_id", 2, F.col("published_at").desc_nulls_last(), F.col("id").desc(), F.col("title")).select("feed_id", "guid", "id", "title"))
add("dml15_upsert_author", "with n as (select id, case when id % 2 = 0 then '' else 'New ' || name end as name, case when id % 3 = 1 then 'n@example.org' end as email, 0.5 as confidence from authors where id < 60 union all select 1000, 'Someone', null, 0.4) select id, case when a.id is null then n.name when n.id is null then a.name else coalesce(nullif(n.name, ''), a.name) end as name, case when n.id is null then a.email else coalesce(nullif(n.email, ''), a.email) end as email, (case when a.id is null then n.confidence when n.id is null then a.confidence else greatest(a.confidence, n.confidence) end)::double as confidence from (select id, name, email, confidence from authors) a full join n using (id)",
    lambda m: M.merge(m.authors.select("id", "name", "email", "confidence"), m.spark.sql("select id, case when id % 2 = 0 then '' else 'New ' || name end as name, case when id % 3 = 1 then 'n@example.org' end as email, 0.5D as confidence from {a} where id < 60 union all select 1000, 'Someone', null, 0.4D", a=m.authors), ["id"], name=M.prefer_new("name"), email=M.prefer_new("email"), confidence=M.highest("confidence")))
add("dml20_link_feed_author", "with n as (select feed_id, author_id, 'owner' as role, 9.5 as confidence from feed_authors where author_id % 9 = 1) select feed_id, author_id, case when n.role = 'owner' or x.role = 'owner' then 'owner' else x.role end as role, greatest(x.confidence, n.confidence)::double as confidence from feed_authors x left join n using (feed_id, author_id)",
    lambda m: M.merge(m.feed_authors, m.feed_authors.where("author_id % 9 = 1").select("feed_id", "author_id", F.lit("owner").alias("role"), F.lit(9.5).alias("confidence")), ["feed_id", "author_id"], role=M.owner_wins(), confidence=M.highest("confidence")))
add("dml17_add_author_links", "with n as (select author_id, url, 'site' as network, true as verified from author_links where author_id % 4 = 1) select author_id, url, l.network, (l.verified or coalesce(n.verified, false)) as verified from author_links l left join n using (author_id, url)",
    lambda m: M.merge(m.author_links.select("author_id", "url", "network", "verified"), m.author_links.where("author_id % 4 = 1").select("author_id", "url", F.lit("site").alias("network"), F.lit(True).alias("verified")), ["author_id", "url"], verified=F.col("old_verified") | F.col("new_verified")))
add("dml32_save_translation", "with n as (select item_id, lang, 'new' as title, case when item_id % 4 = 0 then 'b' end as body from translations where item_id % 2 = 0) select item_id, lang, coalesce(n.title, t.title) as title, coalesce(n.body, t.body) as body from translations t left join n using (item_id, lang)",
    lambda m: M.merge(m.translations, m.translations.where("item_id % 2 = 0").select("item_id", "lang", F.lit("new").alias("title"), F.expr("case when item_id % 4 = 0 then 'b' end").alias("body")), ["item_id", "lang"], title=M.latest("title"), body=F.coalesce("new_body", "old_body")))
add("dml33_record_usage", "select user_id, day, sum(used)::bigint as used from (select user_id, day, used from usage union all select user_id, day, 1 from usage where user_id < 20) group by 1, 2", lambda m: m.usage.unionByName(m.usage.where("user_id < 20").withColumn("used", F.lit(1).cast("long"))).groupBy("user_id", "day").agg(F.sum("used").alias("used")))
for _n, _c, _v in (("dml35_set_like", "liked", "true"), ("dml36_set_vote", "vote", "1")):
    add(_n, f"select item_id, user_id, case when item_id % 5 = 0 then {_v} else {_c} end as {_c} from reactions", lambda m, c=_c, v=_v: M.merge(m.reactions.select("item_id", "user_id", c), m.reactions.where("item_id % 5 = 0").select("item_id", "user_id", F.expr(v).alias(c)), ["item_id", "user_id"], **{c: M.latest(c)}))
add("dml21_win_add_to_queue", "with r as (select id + 100000 as id, user_id, item_id, lane, row_number() over (partition by user_id, lane order by id) as k from queue_entries where done), l as (select user_id, lane, max(position) as last from queue_entries group by 1, 2), o as (select id, user_id, item_id, lane, position, done from queue_entries q where not exists (select 1 from r where r.user_id = q.user_id and r.lane = q.lane and r.item_id = q.item_id)) select * from o union all select id, user_id, item_id, lane, coalesce(last, 0) + k, false from r left join l using (user_id, lane)",
    lambda m: M.enqueue(m.queue_entries, m.queue_entries.where("done").select((F.col("id") + 100000).alias("id"), "user_id", "item_id", "lane")))
add("dml37_add_comment", "select id, item_id, body from comments union all select 10000000 + item_id, item_id, substr(trim(min(body)), 1, 4000) from comments where item_id < 20 group by item_id", lambda m: m.comments.select("id", "item_id", "body").unionByName(m.comments.where("item_id < 20").groupBy("item_id").agg(F.min("body").alias("body")).select((F.col("item_id") + 10000000).alias("id"), "item_id", F.substring(F.trim("body"), 1, M.COMMENT_CHARS).alias("body"))))
add("dml06_replace_feed_keywords", "select feed_id, slug, count from feed_keywords where feed_id <> 77 union all select 77, 'topic-1', 5", lambda m: M.delete_where(m.feed_keywords.select("feed_id", "slug", "count"), "feed_id = 77").unionByName(m.spark.sql("select 77L as feed_id, 'topic-1' as slug, 5L as count")))
INSERTS_MORE = [
    ("dml03_insert_feed", "feeds", "id slug title", "select 900001 as id, 'new-feed' as slug, 'New' as title"),
    ("dml09_insert_submission", "submissions", "id ip_hash", "select 900001 as id, 'ip1' as ip_hash"),
    ("dml12_stage_import_entries", "import_entries", "id submission_id url", "select 900001 as id, 13 as submission_id, 'https://x.example/' as url"),
    ("dml23_record_author_search", "author_searches", "id author_id queries", "select 900001 as id, 7 as author_id, 2 as queries"),
    ("dml24_insert_run", "runs", "id provider", "select 900001 as id, 'list' as provider"),
    ("str03_append_crawl_log", "log", "id event", "select 900001 as id, 'crawl' as event union all select 900002, 'crawl-error'"),
]
for _name, _relation, _columns, _rows in INSERTS_MORE:
    add(_name, f"select {', '.join(_columns.split())} from {_relation} union all {_rows}", lambda m, r=_relation, c=_columns, q=_rows: getattr(m, r).select(*c.split()).unionByName(m.spark.sql(q)))
add("dml18_add_feed_links", "with n as (select feed_id, url, 'site' as network, true as verified from feed_links where feed_id % 8 = 1 union all select 999999, 'https://new.example/', 'site', false) select feed_id, url, coalesce(l.network, n.network) as network, coalesce(l.verified, false) or coalesce(n.verified, false) as verified from feed_links l full join n using (feed_id, url)",
    lambda m: M.merge(m.feed_links.select("feed_id", "url", "network", "verified"), m.feed_links.where("feed_id % 8 = 1").select("feed_id", "url", F.lit("site").alias("network"), F.lit(True).alias("verified")).unionByName(m.spark.sql("select 999999L as feed_id, 'https://new.example/' as url, 'site' as network, false as verified")), ["feed_id", "url"], verified=F.col("old_verified") | F.col("new_verified")))
add("dml31_save_extract", "select item_id, case when item_id % 10 = 1 then 'ok' else state end as state from extracts", lambda m: M.merge(m.extracts.select("item_id", "state"), m.extracts.where("item_id % 10 = 1").select("item_id", F.lit("ok").alias("state")), ["item_id"], state=M.latest("state")))
add("dml54_add_channel", "with n as (select user_id, kind, target, true as enabled, 0 as failures from channels where id % 6 = 2 union all select 1, 'email', 'new', true, 0) select user_id, kind, target, coalesce(n.enabled, c.enabled) as enabled, coalesce(n.failures, c.failures)::bigint as failures from channels c full join n using (user_id, kind, target)",
    lambda m: M.merge(m.channels.select("user_id", "kind", "target", "enabled", "failures"), m.channels.where("id % 6 = 2").select("user_id", "kind", "target", F.lit(True).alias("enabled"), F.lit(0).cast("long").alias("failures")).unionByName(m.spark.sql("select 1L as user_id, 'email' as kind, 'new' as target, true as enabled, 0L as failures")), ["user_id", "kind", "target"], enabled=M.latest("enabled"), failures=M.latest("failures")))
