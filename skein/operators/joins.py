"""Joins between relations. Caps are written as limits on the small side, which then is a semi-join key set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.listing import like_term, live, page

TOPIC_FEEDS, TOPIC_DAYS, AUTHOR_FEEDS, MOST_OVERREAD = 200, 730, 20, 600
MIN_CONFIDENCE = 0.6


def feeds_for_topic(keywords: DataFrame, feeds: DataFrame, slug: str, kinds: list[str] | None = None, limit: int = 200) -> DataFrame:
    """Live feeds of a topic, those whose publisher names it first."""
    df = keywords.where(F.col("slug") == slug).select(F.col("feed_id").alias("id"), "count", "source").join(live(feeds), "id")
    if kinds:
        df = df.where(F.col("category").isin(kinds))
    return page(df, F.when(F.col("source") == "category", 0).otherwise(1), F.col("count").desc(), F.col("id"), limit=limit)


def overread(limit: int) -> int:
    """Rows to read before stories are folded."""
    return min(3 * limit, MOST_OVERREAD)


def items_of(items: DataFrame, feeds: DataFrame, feed_ids: DataFrame) -> DataFrame:
    """Posts of some feeds with the feeds' own columns beside them."""
    own = feeds.select(F.col("id").alias("feed_id"), F.col("slug").alias("feed_slug"), F.col("title").alias("feed_title"), F.col("category"))
    return items.join(feed_ids.select(F.col("id").alias("feed_id")), "feed_id", "left_semi").join(own, "feed_id")


def items_for_topic(keywords: DataFrame, feeds: DataFrame, items: DataFrame, slug: str, now: Column, kinds: list[str] | None = None, limit: int = 60) -> DataFrame:
    """Posts of the topic's strongest feeds within two years, newest first, read over for folding."""
    top = feeds_for_topic(keywords, feeds, slug, kinds, TOPIC_FEEDS)
    df = items_of(items, feeds, top).where(F.col("published_at") >= now - F.make_dt_interval(F.lit(TOPIC_DAYS)))
    return page(df, F.col("published_at").desc(), F.col("id").desc(), limit=overread(limit))


def media_for_topic(keywords: DataFrame, feeds: DataFrame, items: DataFrame, slug: str, kinds: list[str] | None = None, limit: int = 60) -> DataFrame:
    """Posts with audio of the topic's strongest feeds, undated ones last."""
    top = feeds_for_topic(keywords, feeds, slug, kinds, TOPIC_FEEDS)
    df = items_of(items.where("audio_url is not null"), feeds, top)
    return page(df, F.col("published_at").desc_nulls_last(), F.col("id").desc(), limit=limit)


def authors_for_feeds(feed_authors: DataFrame, authors: DataFrame, feed_ids: DataFrame | None = None) -> DataFrame:
    """Authors of feeds, owners first; the link's confidence goes under ``of``."""
    links = feed_authors if feed_ids is None else feed_authors.join(feed_ids.select("feed_id"), "feed_id", "left_semi")
    links = links.select("feed_id", F.col("author_id").alias("id"), "role", F.col("confidence").alias("of"))
    return links.join(authors, "id").orderBy("feed_id", F.coalesce(F.col("role") == "owner", F.lit(False)).desc(), F.col("of").desc(), "id")


def with_links(authors: DataFrame, links: DataFrame) -> DataFrame:
    """Each author with a list of links, verified ones first; an empty list where there are none."""
    own = links.groupBy(F.col("author_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((~F.col("verified")).alias("unverified"), "network", "url"))).alias("l"))
    own = own.select("id", F.transform("l", lambda x: x["url"]).alias("links"))
    return authors.join(own, "id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def author_card(authors: DataFrame, links: DataFrame, feed_authors: DataFrame, feeds: DataFrame, slug: str, limit: int = 100) -> DataFrame:
    """An author with links and feeds."""
    who = with_links(authors.where(F.col("slug") == slug), links)
    own = feed_authors.join(who.select(F.col("id").alias("author_id")), "author_id").join(live(feeds).select(F.col("id").alias("feed_id"), F.col("slug").alias("feed_slug")), "feed_id")
    own = page(own, F.col("confidence").desc(), F.col("feed_id"), limit=limit).groupBy(F.col("author_id").alias("id")).agg(F.array_sort(F.collect_list("feed_slug")).alias("feeds"))
    return who.join(own, "id", "left").withColumn("feeds", F.coalesce("feeds", F.array().cast("array<string>")))


def list_authors(authors: DataFrame, feed_authors: DataFrame, links: DataFrame, min_confidence: float = MIN_CONFIDENCE, network: str | None = None, name: str | None = None, limit: int = 50) -> DataFrame:
    """Authors with how many feeds and links each has."""
    df = authors.where(F.col("confidence") >= min_confidence)
    if network:
        df = df.join(links.where(F.col("network") == network).select(F.col("author_id").alias("id")), "id", "left_semi")
    if name:
        df = df.where(F.col("name").ilike(f"%{like_term(name)}%"))
    feeds_of = feed_authors.groupBy(F.col("author_id").alias("id")).agg(F.count(F.lit(1)).alias("feed_count"))
    links_of = links.groupBy(F.col("author_id").alias("id")).agg(F.count(F.lit(1)).alias("link_count"))
    df = df.join(feeds_of, "id", "left").join(links_of, "id", "left").fillna(0, ["feed_count", "link_count"])
    return page(df, F.col("feed_count").desc(), F.col("id"), limit=limit)


def posts_by_feeds(items: DataFrame, feed_ids: DataFrame, limit: int = 12) -> DataFrame:
    return page(items.join(feed_ids.select("feed_id"), "feed_id", "left_semi"), F.col("published_at").desc_nulls_last(), F.col("id").desc(), limit=limit)


def posts_by_author(items: DataFrame, feed_authors: DataFrame, author_id: int, limit: int = 60) -> DataFrame:
    """Posts of an author's surest feeds."""
    own = page(feed_authors.where(F.col("author_id") == author_id), F.col("confidence").desc(), F.col("feed_id"), limit=AUTHOR_FEEDS)
    return posts_by_feeds(items, own, limit)


def authors_without_contact(authors: DataFrame, links: DataFrame, searches: DataFrame, feed_authors: DataFrame, min_confidence: float = 0.8, limit: int = 10) -> DataFrame:
    """Sure authors with a full name who have no link and were never searched for."""
    df = authors.where((F.col("confidence") >= min_confidence) & F.col("name").contains(" "))
    for other in (links, searches):
        df = df.join(other.select(F.col("author_id").alias("id")), "id", "left_anti")
    count = feed_authors.groupBy(F.col("author_id").alias("id")).agg(F.count_distinct("feed_id").alias("feed_count"))
    return page(df.join(count, "id"), F.col("feed_count").desc(), F.col("id"), limit=limit)


def queued_candidates(candidates: DataFrame, runs: DataFrame, limit: int = 20, run_id: int | None = None) -> DataFrame:
    df = candidates.where("status = 'queued'")
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    return page(df.join(runs.select(F.col("id").alias("run_id"), "provider"), "run_id"), F.col("id"), limit=limit)


def accepted_for_run(candidates: DataFrame, feeds: DataFrame, run_id: int, limit: int = 200) -> DataFrame:
    df = candidates.where((F.col("run_id") == run_id) & (F.col("status") == "accepted"))
    return page(df.join(feeds.select(F.col("slug").alias("feed_slug"), F.col("title").alias("feed_title")), "feed_slug", "left"), F.col("id"), limit=limit)


def unsearched_topics(topics: DataFrame, run_keywords: DataFrame, least: int = 2, most: int = 10**9, avoid: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Topics of a middling size that no run has searched."""
    df = topics.where(F.col("feed_count").between(least, most)).join(run_keywords.select(F.col("keyword").alias("slug")), "slug", "left_anti")
    for a in avoid or []:
        df = df.where(~F.col("slug").ilike(f"%{like_term(a)}%"))
    return page(df, F.col("feed_count").desc(), F.col("slug"), limit=limit)


def awaiting_notice(jobs: DataFrame, *pending: tuple[DataFrame, str], limit: int = 5) -> DataFrame:
    """Jobs with an address to tell, not told yet, of which nothing is pending."""
    df = jobs.where("email is not null and not notified")
    for frame, key in pending:
        df = df.join(frame.select(F.col(key).alias("id")), "id", "left_anti")
    return page(df, F.col("created_at"), F.col("id"), limit=limit)


def next_import(submissions: DataFrame, entries: DataFrame) -> DataFrame:
    """The oldest ready submission with staged entries."""
    return page(submissions.where("ready").join(entries.select(F.col("submission_id").alias("id")), "id", "left_semi"), F.col("created_at"), F.col("id"), limit=1)


def followed_feeds(follows: DataFrame, feeds: DataFrame, user_id: int, limit: int = 200) -> DataFrame:
    df = follows.where(F.col("user_id") == user_id).select(F.col("feed_id").alias("id"), F.col("created_at").alias("followed_at"), "alerts").join(feeds, "id")
    return page(df, F.col("followed_at").desc(), F.col("id"), limit=limit)


def followed_items(follows: DataFrame, feeds: DataFrame, items: DataFrame, user_id: int, limit: int = 60) -> DataFrame:
    df = items_of(items, feeds, followed_feeds(follows, live(feeds), user_id, 10**6))
    return page(df, F.col("published_at").desc_nulls_last(), F.col("id").desc(), limit=limit)


def followed_topics(topic_follows: DataFrame, keywords: DataFrame, user_id: int) -> DataFrame:
    """Followed topics with their words, null where no feed has them."""
    mine = topic_follows.where(F.col("user_id") == user_id)
    words = keywords.join(mine.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.min("keyword").alias("keyword"))
    return mine.join(words, "slug", "left")


def followed_authors(author_follows: DataFrame, authors: DataFrame, feed_authors: DataFrame, user_id: int) -> DataFrame:
    count = feed_authors.groupBy("author_id").agg(F.count(F.lit(1)).alias("feed_count"))
    df = author_follows.where(F.col("user_id") == user_id).join(authors.select(F.col("id").alias("author_id"), "slug", "name"), "author_id")
    return df.join(count, "author_id", "left").fillna(0, ["feed_count"])


def user_by_session(sessions: DataFrame, users: DataFrame, token_hash: Column, now: Column) -> DataFrame:
    return sessions.where((F.col("token_hash") == token_hash) & (F.col("expires_at") > now)).select(F.col("user_id").alias("id")).join(users, "id")


def alerting_follows(follows: DataFrame, topic_follows: DataFrame, author_follows: DataFrame, user_id: int | None = None) -> DataFrame:
    """All follows with alerts as (user_id, kind, key)."""
    parts = [(follows, "feed", F.col("feed_id").cast("string")), (topic_follows, "topic", F.concat_ws("/", "slug", "segment")), (author_follows, "author", F.col("author_id").cast("string"))]
    out = None
    for df, kind, key in parts:
        df = df.where("alerts").select("user_id", F.lit(kind).alias("kind"), key.alias("key"))
        out = df if out is None else out.unionByName(df)
    return out if user_id is None else out.where(F.col("user_id") == user_id)


def users_with_alerts(users: DataFrame, channels: DataFrame, alerting: DataFrame, state: DataFrame, limit: int = 50) -> DataFrame:
    """Users with a live channel and something that alerts; those never served first."""
    df = users.join(channels.where("enabled").select(F.col("user_id").alias("id")), "id", "left_semi").join(alerting.select(F.col("user_id").alias("id")), "id", "left_semi")
    df = df.join(state.select(F.col("user_id").alias("id"), "served_at", "cursor_at"), "id", "left")
    return page(df, F.col("served_at").asc_nulls_first(), F.col("id"), limit=limit)


def new_items(items: DataFrame, feeds: DataFrame, feed_ids: DataFrame, cursor: Column, limit: int = 50) -> DataFrame:
    """Posts that came in after a cursor, in the order they came."""
    return page(items_of(items, live(feeds), feed_ids).where(F.col("created_at") > cursor), F.col("created_at"), F.col("id"), limit=limit)


def queue_listing(queue: DataFrame, items: DataFrame, feeds: DataFrame, user_id: int, lane: str, done: bool = False, limit: int = 200) -> DataFrame:
    """A lane of a queue: open entries by place, done ones by when."""
    df = queue.where((F.col("user_id") == user_id) & (F.col("lane") == lane) & (F.col("done") == done)).withColumnRenamed("id", "entry_id")
    df = df.join(items.select(F.col("id").alias("item_id"), "feed_id", F.col("title").alias("item_title")), "item_id").join(feeds.select(F.col("id").alias("feed_id"), F.col("slug").alias("feed_slug")), "feed_id")
    return page(df, F.col("done_at").desc() if done else F.col("position"), F.col("entry_id"), limit=limit)


def liked_items(reactions: DataFrame, items: DataFrame, feeds: DataFrame, user_id: int, limit: int = 200) -> DataFrame:
    mine = reactions.where((F.col("user_id") == user_id) & F.col("liked")).select("item_id")
    df = items.withColumnRenamed("id", "item_id").join(mine, "item_id").join(feeds.select(F.col("id").alias("feed_id"), F.col("slug").alias("feed_slug")), "feed_id")
    return page(df, F.col("item_id"), limit=limit)


def comments_for(comments: DataFrame, item_id: int, limit: int = 200) -> DataFrame:
    """Comments of a post; the text of deleted ones is withheld."""
    df = comments.where(F.col("item_id") == item_id).withColumn("body", F.when(~F.col("deleted"), F.col("body")))
    return page(df, F.col("turn"), F.col("id"), limit=limit)
