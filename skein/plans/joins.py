"""Queries that join relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import joins as J
from skein.operators import listing as L
from skein.plans.reads import _now, add
from skein.sources.model import AS_OF, TOPICS_SQL


def cols(*names):
    return lambda df: df.select(*names)


TOP = "t as (select f.id from feed_keywords k join feeds f on f.id = k.feed_id where k.slug = '{slug}' and f.status <> 'dead' order by case when k.source = 'category' then 0 else 1 end, k.count desc, f.id limit 200)"
add("join01_feeds_for_topic", "select f.id, k.count, k.source from feed_keywords k join feeds f on f.id = k.feed_id where k.slug = 'topic-3' and f.status <> 'dead' and f.category in ('blog', 'news') order by case when k.source = 'category' then 0 else 1 end, k.count desc, f.id limit 200",
    lambda m: J.feeds_for_topic(m.feed_keywords, m.feeds, "topic-3", ["blog", "news"]).select("id", "count", "source"))
add("join02_items_for_topic", f"with {TOP.format(slug='topic-4')} select i.id, i.feed_id, f.slug as feed_slug, i.published_at from items i join feeds f on f.id = i.feed_id where i.feed_id in (select id from t) and i.published_at >= {AS_OF} - DAYS(730) order by i.published_at desc, i.id desc limit 180",
    lambda m: J.items_for_topic(m.feed_keywords, m.feeds, m.items, "topic-4", _now()).select("id", "feed_id", "feed_slug", "published_at"))
add("join03_media_for_topic", f"with {TOP.format(slug='topic-5')} select i.id, i.audio_url, i.published_at from items i join feeds f on f.id = i.feed_id where i.feed_id in (select id from t) and i.audio_url is not null order by i.published_at desc nulls last, i.id desc limit 60",
    lambda m: J.media_for_topic(m.feed_keywords, m.feeds, m.items, "topic-5").select("id", "audio_url", "published_at"))
add("join06_authors_for_feed", "select x.feed_id, a.id, x.role, x.confidence as \"of\" from feed_authors x join authors a on a.id = x.author_id where x.feed_id = 77",
    lambda m: J.authors_for_feeds(L.lookup(m.feed_authors, feed_id=77), m.authors).select("feed_id", "id", "role", "of"))
add("join07_authors_for_feeds", "select x.feed_id, list(a.slug order by a.slug) as authors from feed_authors x join authors a on a.id = x.author_id where x.feed_id in (1, 2, 3, 77) group by 1",
    lambda m: J.authors_for_feeds(m.feed_authors, m.authors, m.spark.createDataFrame([(1,), (2,), (3,), (77,)], "feed_id long")).groupBy("feed_id").agg(F.array_sort(F.collect_list("slug")).alias("authors")))
add("join08_author_by_slug", """with own as (select f.slug from feed_authors x join feeds f on f.id = x.feed_id where x.author_id = 7 and f.status <> 'dead' order by x.confidence desc, f.id limit 100)
    select a.id, a.slug, (select list(url order by verified desc, network, url) from author_links where author_id = a.id) as links, (select list(slug order by slug) from own) as feeds from authors a where a.slug = 'supplier-000000007'""",
    lambda m: J.author_card(m.authors, m.author_links, m.feed_authors, m.feeds, "supplier-000000007").select("id", "slug", "links", "feeds"))
add("join09_with_links", "select a.id, coalesce(list(l.url order by l.verified desc, l.network, l.url) filter (l.url is not null), []) as links from authors a left join author_links l on l.author_id = a.id group by 1",
    lambda m: J.with_links(m.authors, m.author_links).select("id", "links"))
add("join10_list_authors", """select a.id, (select count(*) from feed_authors x where x.author_id = a.id) as feed_count, (select count(*) from author_links l where l.author_id = a.id) as link_count from authors a
    where confidence >= 0.6 and exists (select 1 from author_links l where l.author_id = a.id and network = 'github') and name ilike '%supplier%' order by feed_count desc, id limit 50""",
    lambda m: J.list_authors(m.authors, m.feed_authors, m.author_links, network="github", name="supplier").select("id", "feed_count", "link_count"))
add("join11_posts_by_author_feeds", "select id from items where feed_id in (1, 2, 77) order by published_at desc nulls last, id desc limit 12",
    lambda m: J.posts_by_feeds(m.items, m.spark.createDataFrame([(1,), (2,), (77,)], "feed_id long")).select("id"))
add("join12_posts_by_author_id", "with t as (select feed_id from feed_authors where author_id = 7 order by confidence desc, feed_id limit 20) select id from items where feed_id in (select feed_id from t) order by published_at desc nulls last, id desc limit 60",
    lambda m: J.posts_by_author(m.items, m.feed_authors, 7).select("id"))
add("join13_authors_without_contact", "select a.id, count(distinct x.feed_id) as feed_count from authors a join feed_authors x on x.author_id = a.id where a.confidence >= 0.1 and contains(name, ' ') and not exists (select 1 from author_links l where l.author_id = a.id and l.network = 'github') and not exists (select 1 from author_searches s where s.author_id = a.id and s.queries > 3) group by 1 order by 2 desc, 1 limit 10",
    lambda m: J.authors_without_contact(m.authors, m.author_links.where("network = 'github'"), m.author_searches.where("queries > 3"), m.feed_authors, 0.1).select("id", "feed_count"))
add("join14_queued_candidates", "select c.id, r.provider from candidates c join runs r on r.id = c.run_id where c.status = 'queued' order by c.id limit 20", lambda m: J.queued_candidates(m.candidates, m.runs).select("id", "provider"))
add("join15_accepted_for_run", "select c.id, c.feed_slug, f.title as feed_title from candidates c left join feeds f on f.slug = c.feed_slug where c.run_id = 30 and c.status = 'accepted' order by c.id limit 200", lambda m: J.accepted_for_run(m.candidates, m.feeds, 30).select("id", "feed_slug", "feed_title"))
add("join16_unsearched_topics", f"with {TOPICS_SQL} select slug, feed_count from topics where feed_count between 2 and 100000 and not exists (select 1 from run_keywords r where r.keyword = topics.slug and r.status = 'done') and slug not ilike '%topic-3%' order by feed_count desc, slug limit 50",
    lambda m: J.unsearched_topics(m.topics, m.run_keywords.where("status = 'done'"), 2, 100000, ["topic-3"]).select("slug", "feed_count"))
add("join17_runs_awaiting_notice", "select id from runs r where email is not null and not notified and not exists (select 1 from candidates c where c.run_id = r.id and c.status = 'queued') and not exists (select 1 from run_keywords k where k.run_id = r.id and k.status = 'queued') order by created_at, id limit 5",
    lambda m: J.awaiting_notice(m.runs, (m.candidates.where("status = 'queued'"), "run_id"), (m.run_keywords.where("status = 'queued'"), "run_id")).select("id"))
add("join18_submissions_awaiting_notice", "select id from submissions s where email is not null and not notified and not exists (select 1 from feeds f where f.submission_id = s.id and f.status = 'pending') and not exists (select 1 from import_entries e where e.submission_id = s.id) order by created_at, id limit 5",
    lambda m: J.awaiting_notice(m.submissions, (m.feeds.where("status = 'pending'"), "submission_id"), (m.import_entries, "submission_id")).select("id"))
add("join19_next_import", "select id from submissions s where ready and exists (select 1 from import_entries e where e.submission_id = s.id) order by created_at, id limit 1", lambda m: J.next_import(m.submissions, m.import_entries).select("id"))
add("join20_followed_feeds", "select f.id, f.slug, w.alerts from follows w join feeds f on f.id = w.feed_id where w.user_id = 110 order by w.created_at desc, f.id limit 200", lambda m: J.followed_feeds(m.follows, m.feeds, 110).select("id", "slug", "alerts"))
add("join21_followed_items", "select i.id, f.slug as feed_slug from follows w join feeds f on f.id = w.feed_id join items i on i.feed_id = f.id where w.user_id = 110 and f.status <> 'dead' order by i.published_at desc nulls last, i.id desc limit 60", lambda m: J.followed_items(m.follows, m.feeds, m.items, 110).select("id", "feed_slug"))
add("join22_followed_topics", "select t.slug, t.segment, (select min(keyword) from feed_keywords k where k.slug = t.slug) as keyword from topic_follows t where t.user_id = 110", lambda m: J.followed_topics(m.topic_follows, m.feed_keywords, 110).select("slug", "segment", "keyword"))
add("join23_followed_authors", "select w.author_id, a.name, (select count(*) from feed_authors x where x.author_id = w.author_id) as feed_count from author_follows w join authors a on a.id = w.author_id where w.user_id = 110", lambda m: J.followed_authors(m.author_follows, m.authors, m.feed_authors, 110).select("author_id", "name", "feed_count"))
add("join24_user_by_session", f"select u.id, u.email from sessions s join users u on u.id = s.user_id where s.token_hash = md5('s15') and s.expires_at > {AS_OF}", lambda m: J.user_by_session(m.sessions, m.users, F.md5(F.lit("s15")), _now()).select("id", "email"))
ALERTING = "a as (select user_id, 'feed' as kind, feed_id::varchar as key from follows where alerts union all select user_id, 'topic', slug || '/' || segment from topic_follows where alerts union all select user_id, 'author', author_id::varchar from author_follows where alerts)"
add("join25_alerting_follows", f"with {ALERTING} select * from a where user_id = 110", lambda m: J.alerting_follows(m.follows, m.topic_follows, m.author_follows, 110))
add("join26_users_with_alerts", f"with {ALERTING} select u.id, s.served_at from users u left join alert_state s on s.user_id = u.id where exists (select 1 from channels c where c.user_id = u.id and c.enabled) and u.id in (select user_id from a) order by s.served_at nulls first, u.id limit 50",
    lambda m: J.users_with_alerts(m.users, m.channels, J.alerting_follows(m.follows, m.topic_follows, m.author_follows), m.alert_state).select("id", "served_at"))
add("join27_new_items_from_alerted_feeds", "select i.id, f.slug as feed_slug from follows w join feeds f on f.id = w.feed_id join items i on i.feed_id = f.id where w.user_id = 110 and w.alerts and f.status <> 'dead' and i.created_at > timestamp '1997-01-01' order by i.created_at, i.id limit 50",
    lambda m: J.new_items(m.items, m.feeds, L.lookup(m.follows, user_id=110).where("alerts").select(F.col("feed_id").alias("id")), F.expr("timestamp '1997-01-01'")).select("id", "feed_slug"))
add("join28_alerted_topics", "select t.slug, t.segment, (select min(keyword) from feed_keywords k where k.slug = t.slug) as keyword from topic_follows t where t.user_id = 44 and alerts", lambda m: J.followed_topics(m.topic_follows.where("alerts"), m.feed_keywords, 44).select("slug", "segment", "keyword"))
add("join29_alerted_authors", "select w.user_id, a.id, a.name from author_follows w join authors a on a.id = w.author_id where w.alerts", lambda m: m.author_follows.where("alerts").join(m.authors.withColumnRenamed("id", "author_id"), "author_id").select("user_id", F.col("author_id").alias("id"), "name"))
add("join30_new_items_for_topic", f"with {TOP.format(slug='topic-6').replace('limit 200', 'limit 50')} select i.id from items i join feeds f on f.id = i.feed_id where i.feed_id in (select id from t) and i.created_at > timestamp '1999-01-01' order by i.created_at, i.id limit 50",
    lambda m: J.new_items(m.items, m.feeds, J.feeds_for_topic(m.feed_keywords, m.feeds, "topic-6", limit=50), F.expr("timestamp '1999-01-01'")).select("id"))
add("join31_new_items_for_author", "with t as (select feed_id from feed_authors where author_id = 7 order by confidence desc, feed_id limit 20) select i.id from items i join feeds f on f.id = i.feed_id where f.status <> 'dead' and i.feed_id in (select feed_id from t) and i.created_at > timestamp '1997-01-01' order by i.created_at, i.id limit 50",
    lambda m: J.new_items(m.items, m.feeds, L.page(L.lookup(m.feed_authors, author_id=7), F.col("confidence").desc(), F.col("feed_id"), limit=20).select(F.col("feed_id").alias("id")), F.expr("timestamp '1997-01-01'")).select("id"))
add("join32_queue_listing", "select q.id as entry_id, i.title as item_title, f.slug as feed_slug from queue_entries q join items i on i.id = q.item_id join feeds f on f.id = i.feed_id where q.lane = 'read' and not q.done and q.user_id = 110 order by q.position, q.id limit 200",
    lambda m: J.queue_listing(m.queue_entries, m.items, m.feeds, 110, "read").select("entry_id", "item_title", "feed_slug"))
add("join33_liked_items", "select i.id as item_id, f.slug as feed_slug from reactions r join items i on i.id = r.item_id join feeds f on f.id = i.feed_id where r.liked and r.user_id = 33 order by i.id limit 200", lambda m: J.liked_items(m.reactions, m.items, m.feeds, 33).select("item_id", "feed_slug"))
add("join34_comments_for", "select id, turn, case when not deleted then body end as body, user_id from comments where item_id = 3 order by turn, id limit 200", lambda m: J.comments_for(m.comments, 3).select("id", "turn", "body", "user_id"))
