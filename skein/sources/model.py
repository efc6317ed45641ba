"""The data model: feeds, posts, people, topics and jobs, mapped onto the supplied tables.

Each relation is one SQL text that holds for Spark and for the oracle's engine alike (DAYS and
MINUTES stand for an interval of so many). ``Model`` gives them as DataFrames.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from skein.sources.tables import table

#: The classes of feeds, those a parser can find, and the segments of topics.
KINDS = ["blog", "news", "podcast", "music", "video", "comic", "live", "reel"]
SEGMENTS = {"blogs": ["blog"], "news": ["news"], "podcasts": ["podcast"], "music": ["music"], "videos": ["video"], "comics": ["comic"], "live": ["live"], "reels": ["reel"], "audio": ["podcast", "music"]}
LANES = ["read", "listen", "watch"]
#: The moment at which the mapped tables are looked at.
AS_OF = "timestamp '2001-01-01 00:00:00'"
LOG_AS_OF = "timestamp '2024-01-31 00:00:00'"

_KIND = "case o_orderkey % 8 when 0 then 'blog' when 1 then 'news' when 2 then 'podcast' when 3 then 'music' when 4 then 'video' when 5 then 'comic' when 6 then 'live' else 'reel' end"

RELATIONS: dict[str, tuple[str, str]] = {
    "feeds": ("orders", f"""
        select o_orderkey as id, 'feed-' || cast(o_orderkey as string) as slug,
            'https://host' || cast(o_custkey % 60 as string) || '.example/feed/' || cast(o_orderkey as string) as feed_url,
            'https://www.host' || cast(o_custkey % 60 as string) || '.example/' as site_url,
            'Order ' || cast(o_orderkey as string) as title, 'about ' || o_orderpriority as description, {_KIND} as category,
            case o_orderkey % 6 when 0 then 'en' when 1 then 'de' when 2 then 'en-US' when 3 then '' when 4 then 'fr' end as language,
            case when o_orderkey % 37 = 0 then 'dead' when o_orderstatus = 'O' then 'active' when o_orderstatus = 'F' then 'error' else 'pending' end as status,
            case when o_orderstatus = 'F' then cast(o_orderkey % 12 as bigint) else cast(0 as bigint) end as error_count,
            o_orderkey % 23 as item_count, o_orderdate as created_at,
            case when o_orderkey % 5 <> 0 then o_orderdate + DAYS(o_orderkey % 400) end as last_fetched_at,
            o_orderdate + DAYS(o_orderkey % 700) as next_fetch_at,
            case when o_orderkey % 7 <> 0 then o_orderdate + DAYS(o_orderkey % 300) end as last_published_at,
            o_custkey % 3 as priority, case o_orderkey % 4 when 0 then 'ok' when 1 then 'none' when 2 then 'error' end as card_state,
            case when o_orderkey % 3 <> 0 then o_orderdate + DAYS(o_orderkey % 50) end as card_checked_at,
            case when o_orderkey % 9 <> 0 then o_orderdate + DAYS(o_orderkey % 60) end as authors_checked_at,
            o_custkey as submission_id, 60 * (1 + o_orderkey % 48) as interval_minutes from orders"""),
    "items": ("lineitem", """
        select l_orderkey * 10 + l_linenumber as id, l_orderkey as feed_id, cast(l_linenumber as string) as guid,
            'Part number ' || cast(l_partkey as string) || ' shipped by supplier ' || cast(l_suppkey as string) as title,
            'quantity ' || cast(cast(l_quantity as bigint) as string) as summary,
            case when l_linenumber % 7 <> 0 then l_shipdate end as published_at, l_shipdate + DAYS(1 + l_partkey % 5) as created_at,
            case when l_partkey % 11 = 0 then '' else 'k' || cast(l_partkey % 500 as string) end as cluster_key,
            case when l_returnflag = 'R' then 'https://cdn.example/' || cast(l_partkey as string) || '.mp3' end as audio_url,
            case when l_returnflag = 'R' then case when l_linenumber = 2 then 'video/mp4' else 'audio/mpeg' end end as audio_type,
            cast(l_quantity as bigint) * 60 as audio_seconds, l_suppkey as supplier
        from lineitem"""),
    "users": ("customer", "select c_custkey as id, lower(replace(c_name, '#', '-')) || '@example.org' as email, 'token-' || cast(c_custkey as string) as token, case c_nationkey % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' end as lang from customer"),
    "follows": ("orders", "select o_custkey as user_id, o_orderkey as feed_id, o_orderkey % 2 = 0 as alerts, o_orderdate as created_at from orders where o_orderkey % 3 = 0"),
    "topic_follows": ("orders", "select distinct o_custkey as user_id, 'topic-' || cast(o_orderkey % 40 as string) as slug, case o_orderkey % 3 when 0 then '' when 1 then 'audio' else 'news' end as segment, o_orderkey % 4 = 0 as alerts from orders where o_orderkey % 11 = 0"),
    "author_follows": ("orders", "select distinct o_custkey as user_id, o_orderkey % 100 as author_id, o_orderkey % 2 = 0 as alerts from orders where o_orderkey % 13 = 0"),
    "authors": ("supplier", "select s_suppkey as id, lower(replace(s_name, '#', '-')) as slug, 'Sam ' || s_name as name, 'https://id.example/' || cast(s_suppkey as string) as identity_key, round((s_acctbal + 1000.0) / 11000.0, 4) as confidence, case when s_suppkey % 3 = 0 then 'author' || cast(s_suppkey as string) || '@example.org' end as email from supplier"),
    "author_links": ("supplier", "select s_suppkey as author_id, n as network, 'https://' || n || '.example/' || cast(s_suppkey as string) as url, s_suppkey % 2 = 0 as verified from supplier, (select 'github' as n union all select 'mastodon' union all select 'youtube') networks where (s_suppkey + length(n)) % 3 <> 0"),
    "feed_authors": ("lineitem", "select l_orderkey as feed_id, l_suppkey as author_id, case when l_suppkey % 2 = 0 then 'owner' else 'author' end as role, round(max(l_discount) * 10, 2) as confidence from lineitem where l_linenumber <= 2 group by 1, 2, 3"),
    "feed_links": ("orders", "select o_orderkey as feed_id, 'https://social.example/' || cast(o_orderkey as string) as url, 'mastodon' as network, o_orderkey % 2 = 1 as verified from orders where o_orderkey % 4 < 2"),
    "feed_keywords": ("lineitem", "select l_orderkey as feed_id, 'topic-' || cast(l_partkey % 40 as string) as slug, min('Topic ' || cast(l_partkey % 40 as string)) as keyword, min(1 + l_partkey % 3) as words, count(*) as count, min(case when l_returnflag = 'R' then 'category' else 'content' end) as source from lineitem group by 1, 2"),
    "comments": ("conversations", "select conv_id * 1000 + turn as id, conv_id as item_id, turn, role as user_id, text as body, turn % 5 = 4 as deleted from conversations"),
    "reactions": ("labels", "select doc_id as item_id, doc_id % 50 as user_id, case when quality = 1 then 1 when toxic = 1 then -1 else 0 end as vote, doc_id % 3 = 0 as liked from labels"),
    "queue_entries": ("orders", "select o_orderkey as id, o_custkey as user_id, o_orderkey * 10 + 1 as item_id, case o_orderkey % 3 when 0 then 'read' when 1 then 'listen' else 'watch' end as lane, o_orderkey % 97 as position, o_orderkey % 4 = 0 as done, o_orderdate as done_at from orders where o_orderkey % 2 = 0"),
    "log": ("events", "select event_id as id, ts as at, event_type as event, case when event_type = 'error' then 'error' end as status, user_id as subject, value as amount, case when event_id % 3 = 0 then 'timeout' else props end as detail from events"),
    "submissions": ("customer", f"select c_custkey as id, 'ip' || cast(c_custkey % 40 as string) as ip_hash, case when c_custkey % 5 <> 0 then lower(replace(c_name, '#', '-')) || '@example.org' end as email, c_custkey % 7 = 0 as notified, {AS_OF} - DAYS(c_custkey % 30) as created_at, c_custkey % 6 <> 0 as ready from customer"),
    "import_entries": ("orders", "select o_orderkey as id, o_custkey as submission_id, 'https://import.example/' || cast(o_orderkey as string) as url, 'Import ' || cast(o_orderkey as string) as title from orders where o_custkey % 10 = 3"),
    "runs": ("customer", f"select c_custkey as id, case c_custkey % 3 when 0 then 'keywords' when 1 then 'directory' else 'list' end as provider, 'ip' || cast(c_custkey % 40 as string) as ip_hash, case when c_custkey % 4 = 0 then 'done' else 'running' end as status, {AS_OF} - DAYS(c_custkey % 90) as created_at, case when c_custkey % 2 = 0 then 'x@example.org' end as email, c_custkey % 8 = 0 as notified from customer where c_custkey % 3 = 0"),
    "run_keywords": ("orders", "select o_orderkey as id, o_custkey as run_id, 'topic-' || cast(o_orderkey % 70 as string) as keyword, case o_orderkey % 4 when 0 then 'queued' when 1 then 'done' when 2 then 'searching' else 'error' end as status, o_orderdate as at from orders where o_custkey % 3 = 0"),
    "candidates": ("orders", "select o_orderkey as id, o_custkey as run_id, 'host' || cast(o_orderkey % 900 as string) || '.example' as host, case o_orderkey % 5 when 0 then 'queued' when 1 then 'accepted' when 2 then 'rejected' when 3 then 'error' else 'known' end as status, case o_orderkey % 5 when 1 then 'feed-' || cast(o_orderkey * 2 as string) end as feed_slug, o_orderdate as at, 'reason ' || cast(o_orderkey % 7 as string) as reason from orders where o_custkey % 3 = 0 and o_orderkey % 2 = 1"),
    "channels": ("customer", "select c_custkey as id, c_custkey as user_id, case c_custkey % 3 when 0 then 'email' when 1 then 'push' else 'webhook' end as kind, 'target' || cast(c_custkey as string) as target, c_custkey % 4 <> 0 as enabled, c_custkey % 6 as failures, case when c_custkey % 3 = 1 then '{\"endpoint\":\"e' || cast(c_custkey as string) || '\"}' end as secret from customer where c_custkey % 2 = 0"),
    "alert_state": ("customer", f"select c_custkey as user_id, {AS_OF} - DAYS(c_custkey % 200) as cursor_at, {AS_OF} - DAYS(c_custkey % 9) as served_at from customer where c_custkey % 5 <> 0"),
    "alert_sent": ("orders", f"select o_custkey as user_id, 'c:k' || cast(o_orderkey % 500 as string) as item_key, {AS_OF} - DAYS(o_orderkey % 60) as sent_at from orders where o_orderkey % 9 = 0"),
    "api_keys": ("customer", f"select c_custkey as id, c_custkey % 50 as user_id, md5(cast(c_custkey as string)) as token_hash, case when c_custkey % 4 = 0 then {AS_OF} end as revoked_at, {AS_OF} - DAYS(c_custkey % 300) as created_at from customer"),
    "credentials": ("customer", f"select c_custkey as id, c_custkey % 70 as user_id, 'cred' || cast(c_custkey as string) as credential_id, {AS_OF} - DAYS(c_custkey % 300) as created_at from customer"),
    "sessions": ("customer", f"select md5('s' || cast(c_custkey as string)) as token_hash, c_custkey as user_id, {AS_OF} + DAYS(c_custkey % 20 - 10) as expires_at from customer"),
    "login_tokens": ("customer", f"select c_custkey as id, 'user' || cast(c_custkey % 30 as string) || '@example.org' as email, {AS_OF} - MINUTES(c_custkey % 240) as created_at from customer"),
    "translations": ("documents", "select doc_id as item_id, 'fr' as lang, 'title ' || cast(doc_id as string) as title, case when doc_id % 2 = 0 then 'body ' || cast(doc_id as string) end as body from documents where doc_id % 3 = 0"),
    "usage": ("events", "select user_id, cast(ts as date) as day, count(*) as used from events group by 1, 2"),
    "author_searches": ("orders", "select o_orderkey as id, o_orderkey % 100 as author_id, o_orderkey % 5 as queries, o_orderdate as at from orders where o_orderkey % 17 = 0"),
    "extracts": ("documents", f"select doc_id as item_id, case doc_id % 5 when 0 then 'ok' when 1 then 'error' when 2 then 'http-503' when 3 then 'http-404' else 'thin' end as state, {AS_OF} - MINUTES(doc_id * 7 % 4000) as fetched_at from documents"),
    "hourly": ("events", "select date_trunc('hour', ts) as hour, count(*) as crawled, sum(case when event_type = 'error' then 1 else 0 end) as failed, sum(case when event_type = 'view' then 1 else 0 end) as items from events group by 1"),
    "texts": ("documents", "select doc_id, source, lang, split_part(text, LF, 1) as title, substr(text, length(split_part(text, LF, 1)) + 2) as summary from documents"),
}


def spark_sql(text: str) -> str:
    text = re.sub(r"MINUTES\(", "make_dt_interval(0, 0, ", re.sub(r"DAYS\(", "make_dt_interval(", text))
    text = re.sub(r"make_dt_interval\(((?:0, 0, )?)([^()]*)\)", r"make_dt_interval(\1cast(\2 as int))", text)
    return text.replace("LF", r"'\n'")


def duck_sql(text: str) -> str:
    text = re.sub(r"DAYS\(([^()]*)\)", r"to_days(cast(\1 as integer))", text)
    return re.sub(r"MINUTES\(([^()]*)\)", r"to_minutes(cast(\1 as integer))", text).replace("LF", "chr(10)")


def oracle(body: str) -> str:
    """SQL over the relations, with those that it names in front."""
    need, todo = [], [body]
    while todo:
        text = todo.pop()
        for name, (_, sql) in RELATIONS.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.append(name)
    own = ", ".join(f"{n} as ({duck_sql(RELATIONS[n][1])})" for n in RELATIONS if n in need)
    body = duck_sql(body).strip()
    if not own:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {own}, {body[15:]}"
    return f"with {own}, {body[5:]}" if body.lower().startswith("with ") else f"with {own} {body}"


class Model:
    """The relations of a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            raise AttributeError(name)
        base, sql = RELATIONS[name]
        return self.spark.sql(re.sub(rf"\bfrom {base}\b", "from {base}", spark_sql(sql)).replace("{", "{{").replace("}", "}}").replace("{{base}}", "{base}"), base=table(self.spark, self.sf_dir, base))

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def topics(self) -> DataFrame:
        from skein.operators.aggregates import refresh_topics

        return refresh_topics(self.feed_keywords, self.feeds)


TOPICS_SQL = "topics as (select k.slug as slug, min(k.keyword) as keyword, count(distinct feed_id) as feed_count from feed_keywords k join feeds f on f.id = k.feed_id where f.status <> 'dead' group by k.slug having count(distinct feed_id) >= 2)"
