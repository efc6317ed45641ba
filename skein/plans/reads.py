"""Queries over single relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import listing as L
from skein.plans.registry import query
from skein.sources.model import AS_OF, LOG_AS_OF, TOPICS_SQL, Model, oracle


def add(name: str, sql: str | None, f) -> None:
    """Register a query over the model, with its SQL over the relations."""
    query(name, oracle(sql) if sql else None)(lambda spark, sf_dir: f(Model(spark, sf_dir)))


def _now():
    return F.expr(AS_OF)


#: name, relation, columns, key values (as SQL and DataFrame alike)
LOOKUPS = [
    ("rel01_feed_by_slug", "feeds", "id slug feed_url title category status", {"slug": "feed-77"}),
    ("rel02_feed_by_url", "feeds", "id slug feed_url", {"feed_url": "https://host17.example/feed/77"}),
    ("rel05_item_by_guid", "items", "id feed_id guid title", {"feed_id": 77, "guid": "1"}),
    ("rel07_feed_keyword_rows", "feed_keywords", "feed_id slug keyword words count source", {"feed_id": 77}),
    ("rel22_submission_by_id", "submissions", "id ip_hash email ready", {"id": 5}),
    ("rel23_submission_owner", "submissions", "id ip_hash", {"id": 6}),
    ("rel32_author_by_identity", "authors", "id slug name", {"identity_key": "https://id.example/7"}),
    ("rel35_run_by_id", "runs", "id provider status", {"id": 9}),
    ("rel41_extract_for_item", "extracts", "item_id state fetched_at", {"item_id": 12}),
    ("rel42_translation_for", "translations", "item_id lang title body", {"item_id": 12, "lang": "fr"}),
    ("rel43_item_text", "texts", "doc_id title summary", {"doc_id": 12}),
    ("rel44_reading_language", "users", "id lang", {"id": 4}),
    ("rel46_is_following", "follows", "user_id feed_id", {"user_id": 8, "feed_id": 300}),
    ("rel47_is_following_topic", "topic_follows", "user_id slug segment", {"slug": "topic-11", "segment": "audio"}),
    ("rel48_is_following_author", "author_follows", "user_id author_id", {"author_id": 13}),
    ("rel49_user_by_email", "users", "id email", {"email": "customer-000000004@example.org"}),
    ("rel50_user_by_id", "users", "id email lang", {"id": 4}),
    ("rel51_user_by_token", "users", "id email", {"token": "token-4"}),
    ("rel52_feed_token", "users", "id token", {"id": 4}),
    ("rel53_credential_by_id", "credentials", "id user_id credential_id", {"credential_id": "cred4"}),
    ("rel54_credentials_for_user", "credentials", "id user_id credential_id", {"user_id": 4}),
    ("rel58_channels_for_user", "channels", "id user_id kind target enabled", {"user_id": 4}),
    ("rel60_alert_cursor", "alert_state", "user_id cursor_at", {"user_id": 4}),
    ("rel62_keys_for_user", "api_keys", "id user_id revoked_at", {"user_id": 4}),
    ("rel33_links_for_feed", "feed_links", "feed_id url network verified", {"feed_id": 77}),
    ("rel34_feed_has_authors", "feed_authors", "feed_id author_id", {"feed_id": 77}),
]
for _name, _relation, _columns, _keys in LOOKUPS:
    _where = " and ".join(f"{k} = " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in _keys.items())
    add(_name, f"select {', '.join(_columns.split())} from {_relation} where {_where}", lambda m, r=_relation, c=_columns, k=_keys: L.lookup(getattr(m, r), *c.split(), **k))

FEED = ["id", "slug", "title", "category", "created_at"]
F_ = "id, slug, title, category, created_at"
add("rel03_list_feeds", f"select {F_} from feeds where status <> 'dead' and category = 'news' order by created_at desc, id desc limit 50 offset 10", lambda m: L.list_feeds(m.feeds, "news", 50, 10).select(FEED))
add("rel04_items_for_feed", "select id, guid, published_at from items where feed_id = 77 order by published_at desc nulls last, created_at desc, id desc limit 50", lambda m: L.items_for_feed(m.items, 77).select("id", "guid", "published_at"))
add("rel06_items_for_keywords", "select title, summary from items where feed_id = 78 order by published_at desc nulls last, created_at desc, id desc limit 200", lambda m: L.items_for_feed(m.items, 78, 200).select("title", "summary"))
add("rel08_keywords_for_feed", "select slug, keyword, count, source from feed_keywords where feed_id = 77 order by case when source = 'category' then 0 else 1 end, count desc, keyword limit 12", lambda m: L.keywords_for_feed(m.feed_keywords, 77).select("slug", "keyword", "count", "source"))
add("rel09_list_topics", f"with {TOPICS_SQL} select slug, keyword, feed_count from topics where feed_count >= 2 and (keyword ilike '%topic 1%' or slug ilike '%topic 1%') order by case when lower(keyword) = 'topic 1' then 0 when keyword ilike 'topic 1%' then 1 else 2 end, feed_count desc, slug limit 8", lambda m: L.list_topics(m.topics, "topic 1", limit=8))
add("rel10_topic_by_slug", "select k.slug, min(k.keyword) as keyword, count(*) as feed_count from feed_keywords k join feeds f on f.id = k.feed_id where f.status <> 'dead' and k.slug = 'topic-3' group by 1", lambda m: L.lookup(m.feed_keywords, slug="topic-3").join(L.live(m.feeds).select(F.col("id").alias("feed_id")), "feed_id").groupBy("slug").agg(F.min("keyword").alias("keyword"), F.count(F.lit(1)).alias("feed_count")))
add("rel11_failing_feeds", "select id, status, error_count from feeds where status in ('error', 'dead') order by error_count desc, id limit 20", lambda m: L.failing_feeds(m.feeds).select("id", "status", "error_count"))
add("rel12_recently_crawled", "select id, last_fetched_at from feeds where last_fetched_at is not null order by last_fetched_at desc, id limit 20", lambda m: L.recently_crawled(m.feeds).select("id", "last_fetched_at"))
DUE = f"status <> 'dead' and (next_fetch_at is null or next_fetch_at <= {AS_OF})"
add("rel13_express_feeds", f"select id, priority from feeds where {DUE} and priority > 0 and last_fetched_at is null order by priority desc, created_at, id limit 25", lambda m: L.express_feeds(m.feeds, _now()).select("id", "priority"))
add("rel14_due_feeds", f"""with e as (select id, row_number() over (order by priority desc, created_at, id) as rank from feeds where {DUE} and priority > 0 and last_fetched_at is null order by rank limit 12),
    r as (select id, row_number() over (order by next_fetch_at nulls first, id) as rank from feeds where {DUE} and id not in (select id from e) order by rank limit 25)
    select * from (select id, 0 as lane, rank from e union all select id, 1, rank from r) order by lane, rank limit 25""", lambda m: L.due_feeds(m.feeds, _now()))
add("rel15_feeds_needing_card", f"select id, card_state from feeds where status <> 'dead' and card_state is distinct from 'ok' and (card_checked_at is null or card_checked_at < {AS_OF}) order by card_checked_at nulls first, id limit 10", lambda m: L.feeds_needing_card(m.feeds, _now()).select("id", "card_state"))
add("rel16_neighbours", "with o as (select created_at from feeds where id = 77), d as (select * from feeds where status <> 'dead' and id <> 77) select * from (select id, 'previous' as side from d where created_at < timestamp '1998-01-01' order by created_at desc, id desc limit 1) union all select * from (select id, 'next' as side from d where created_at > timestamp '1998-01-01' order by created_at, id limit 1)", lambda m: L.neighbours(m.feeds, F.expr("timestamp '1998-01-01'"), 77).select("id", "side"))
add("rel17_random_slug", None, lambda m: L.random_feed(m.feeds, 7).select("slug"))
add("rel18_channel_ids", "select distinct regexp_extract(feed_url, 'host(\\d+)\\.example', 1) as channel_id from feeds where feed_url like '%host%'", lambda m: L.channel_ids(m.feeds))
add("rel19_crawl_log", "select id, event, status from log where id > 500 order by id limit 200", lambda m: L.crawl_log(m.log, 500).select("id", "event", "status"))
add("rel20_crawl_log_tail", "select id, event from (select * from log order by id desc limit 60) order by id", lambda m: L.crawl_log_tail(m.log).select("id", "event"))
add("rel21_operational_errors", f"select id, \"at\" from log where status = 'error' and \"at\" >= {LOG_AS_OF} - DAYS(5) order by id desc limit 20", lambda m: L.operational_errors(m.log, F.expr(f"{LOG_AS_OF} - interval 5 days")).select("id", "at"))
add("rel24_submission_events", "select id, status from feeds where submission_id = 8 and created_at > timestamp '1996-01-01' order by created_at, id limit 100", lambda m: L.submission_events(m.feeds, 8, F.expr("timestamp '1996-01-01'")).select("id", "status"))
add("rel25_take_import_entries", "select id, url from import_entries where submission_id = 13 order by id limit 5", lambda m: L.page(L.lookup(m.import_entries, submission_id=13), F.col("id"), limit=5).select("id", "url"))
add("rel26_existing_feed_keys", "select distinct * from (select 'url' as kind, lower(feed_url) as key from feeds union all select 'slug', slug from feeds)", lambda m: L.existing_keys(m.feeds))
add("rel27_known_feed_urls", "select feed_url from (values ('https://host17.example/feed/77'), ('https://nowhere.example/')) v(feed_url) where feed_url in (select feed_url from feeds)", lambda m: L.members(m.spark.createDataFrame([("https://host17.example/feed/77",), ("https://nowhere.example/",)], "feed_url string"), m.feeds, "feed_url"))
add("rel28_known_slugs", "select slug from (values ('feed-1'), ('feed-x')) v(slug) where slug in (select slug from feeds)", lambda m: L.members(m.spark.createDataFrame([("feed-1",), ("feed-x",)], "slug string"), m.feeds, "slug"))
add("rel29_taken_slugs", "select slug from feeds where slug = 'feed' or slug like 'feed-%'", lambda m: L.taken_slugs(m.feeds, "feed"))
add("rel30_due_for_authors", "select id from feeds where status = 'active' and (authors_checked_at is null or authors_checked_at < timestamp '1998-01-01') order by authors_checked_at nulls first, id limit 25", lambda m: L.page(L.lookup(m.feeds, status="active").where("authors_checked_at is null or authors_checked_at < timestamp '1998-01-01'"), F.col("authors_checked_at").asc_nulls_first(), F.col("id"), limit=25).select("id"))
add("rel31_taken_author_slugs", "select slug from authors where slug = 'supplier' or slug like 'supplier-%'", lambda m: L.taken_slugs(m.authors, "supplier"))
add("rel36_recent_runs", "select id, provider, created_at from runs order by created_at desc, id desc limit 20", lambda m: L.page(m.runs, F.col("created_at").desc(), F.col("id").desc(), limit=20).select("id", "provider", "created_at"))
add("rel37_queued_keywords", "select id, keyword from run_keywords where status = 'queued' order by id limit 10", lambda m: L.page(L.lookup(m.run_keywords, status="queued"), F.col("id"), limit=10).select("id", "keyword"))
add("rel38_rejected_for_run", "select id, host, status from candidates where run_id = 9 and status in ('rejected', 'error') order by id limit 100", lambda m: L.page(L.lookup(m.candidates, run_id=9).where("status in ('rejected', 'error')"), F.col("id"), limit=100).select("id", "host", "status"))
add("rel39_last_run_at", "select max(created_at) as last_run_at from runs where provider = 'keywords'", lambda m: L.lookup(m.runs, provider="keywords").agg(F.max("created_at").alias("last_run_at")))
add("rel40_known_hosts", "select distinct regexp_replace(regexp_extract(u, '^https?://([^/]+)', 1), '^www\\.', '') as host from (select site_url as u from feeds union all select feed_url from feeds)", lambda m: L.known_hosts(m.feeds))
add("rel45_usage_for_user", "select coalesce(sum(used), 0)::bigint as used from usage where user_id = 8 and day = date '2024-01-05'", lambda m: m.usage.where("user_id = 8 and day = date '2024-01-05'").agg(F.coalesce(F.sum("used"), F.lit(0)).alias("used")))
add("rel55_feed_follow_state", "select feed_id, true as following, alerts from follows where user_id = 899", lambda m: L.lookup(m.follows, user_id=899).select("feed_id", F.lit(True).alias("following"), "alerts"))
add("rel56_topic_follow_state", "select slug, segment, true as following, alerts from topic_follows where user_id = 110", lambda m: L.lookup(m.topic_follows, user_id=110).select("slug", "segment", F.lit(True).alias("following"), "alerts"))
add("rel57_author_follow_state", "select author_id, true as following, alerts from author_follows where user_id = 110", lambda m: L.lookup(m.author_follows, user_id=110).select("author_id", F.lit(True).alias("following"), "alerts"))
add("rel59_deliverable_channels", "select id, kind, target, json_extract_string(secret, '$.endpoint') as endpoint from channels where enabled order by id", lambda m: m.channels.where("enabled").select("id", "kind", "target", F.from_json("secret", "endpoint string")["endpoint"].alias("endpoint")).orderBy("id"))
add("rel61_already_sent", "select distinct item_key from alert_sent where user_id = 111 and item_key in ('c:k0', 'c:k9', 'c:k27')", lambda m: L.members(m.spark.createDataFrame([("c:k0",), ("c:k9",), ("c:k27",)], "item_key string"), L.lookup(m.alert_sent, user_id=111), "item_key"))
add("rel63_key_by_hash", "select id, user_id from api_keys where token_hash = md5('5') and revoked_at is null", lambda m: m.api_keys.where((F.col("token_hash") == F.md5(F.lit("5"))) & F.col("revoked_at").isNull()).select("id", "user_id"))
add("rel64_lanes_for_items", "select item_id, list_sort(list_distinct(list(lane))) as lanes from queue_entries where user_id = 110 group by 1", lambda m: L.lanes_for_items(m.queue_entries, 110))
add("rel65_reaction_for", "select coalesce(max(vote), 0)::int as vote, coalesce(bool_or(liked), false) as liked from reactions where item_id = 12 and user_id = 12", lambda m: m.reactions.where("item_id = 12 and user_id = 12").agg(F.coalesce(F.max("vote"), F.lit(0)).alias("vote"), F.coalesce(F.bool_or("liked"), F.lit(False)).alias("liked")))
add("rel66_list_filter", "select id from feeds where contains(lower(title), 'order') and contains(lower(title), '12')", lambda m: m.feeds.where(L.matches(F.lower("title"), ["order", "12"])).select("id"))
