"""What a crawl, an import and a check of candidates write, each as one job over all that waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import UNDATED_CEILING, clamp
from skein.functions.text import assess_feed, assess_series, extract_keywords, feed_topics, identity_key
from skein.operators.merges import fill, highest, merge, owner_wins
from skein.operators.windows import numbered
from skein.sources.sinks import ad_positions

#: Addresses of playlists, which are judged as collections.
SERIES_FEED = r"[?&]playlist_id="


def store_crawl(feeds: DataFrame, items: DataFrame, crawls: DataFrame, posts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(feeds, items) after crawls (id, title, description, site_url, kind, language, minutes, newest) with posts (feed_id, guid, title, published_at, audio_url).

    Posts are merged by feed and guid, where a date or an enclosure fills a null and nothing else
    changes. A crawled feed becomes active without errors; a curated category, a language and a date
    that the crawl does not give stay; its interval is the minutes given, or an hour where posts came
    in and else twice the old one up to a day. Feeds and posts not crawled stay as they are.
    """
    one = posts.groupBy("feed_id", "guid").agg(*[F.min_by(c, F.struct("title", "published_at")).alias(c) for c in ("title", "published_at", "audio_url")])
    stored = merge(items.select("feed_id", "guid", "title", "published_at", "audio_url"), one, ["feed_id", "guid"], published_at=fill("published_at"), audio_url=fill("audio_url"))
    counts = stored.groupBy(F.col("feed_id").alias("id")).agg(F.count(F.lit(1)).alias("total"))
    new = crawls.select("id", *[F.col(c).alias(f"new_{c}") for c in ("title", "description", "site_url", "kind", "language", "minutes", "newest")], F.lit(True).alias("crawled"))
    df = feeds.join(new, "id", "left").join(counts, "id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    ladder = F.when(F.col("total") > F.col("item_count"), 60).otherwise(clamp(2 * F.greatest(F.coalesce("interval_minutes", F.lit(60)), F.lit(60)), 60, UNDATED_CEILING))
    wait = F.when(F.col("new_minutes") > 0, F.col("new_minutes")).otherwise(ladder).cast("long")
    done = F.coalesce("crawled", F.lit(False))
    value = {
        "title": F.col("new_title"), "description": F.nullif("new_description", F.lit("")), "site_url": F.nullif("new_site_url", F.lit("")), "status": F.lit("active"), "error_count": F.lit(0).cast("long"),
        "category": F.when(F.col("curated"), F.col("category")).otherwise(F.coalesce("new_kind", F.lit("blog"))), "language": F.coalesce(F.nullif("new_language", F.lit("")), F.col("language")),
        "last_fetched_at": now, "interval_minutes": wait, "next_fetch_at": now + F.make_dt_interval(F.lit(0), F.lit(0), wait.cast("int")), "item_count": F.col("total"), "last_published_at": F.coalesce("new_newest", "last_published_at")}
    return df.select("id", *[F.when(done, v).otherwise(F.col(k)).alias(k) for k, v in value.items()]), stored


def topics_from(feeds: DataFrame, stored: DataFrame, fresh: DataFrame, most: int = 25) -> DataFrame:
    """(feed_id, slug, keyword, words, count, source) from feeds (feed_id, title, description, categories), stored posts and fresh ones (feed_id, title, summary, categories).

    Blocks are titles, descriptions and summaries; categories win over counted words.
    """
    posts = stored.select("feed_id", "title", "summary", "categories").unionByName(fresh.select("feed_id", "title", "summary", "categories"))
    texts = lambda df, *cols: df.select("feed_id", F.explode(F.array(*cols)).alias("text")).where("text <> ''")
    blocks = texts(feeds, "title", "description").unionByName(texts(posts, "title", "summary"))
    named = feeds.select("feed_id", "categories").unionByName(posts.select("feed_id", "categories")).select("feed_id", F.explode("categories").alias("c"))
    named = named.select("feed_id", F.lower(F.trim(F.regexp_replace("c", r"\s+", " "))).alias("keyword")).where(F.length("keyword").between(1, 60))
    return feed_topics(extract_keywords(blocks), named.groupBy("feed_id", "keyword").agg(F.count(F.lit(1)).alias("count")), most=most)


def drain_imports(submissions: DataFrame, entries: DataFrame, feeds: DataFrame, now: Column, slice_size: int, per_minute: int = 240) -> tuple[DataFrame, DataFrame]:
    """(queued, left): of each ready submission the next slice of entries (submission_id, id, url, title), oldest first.

    Addresses already known, in the directory or earlier in the slice, are dropped and not queued; the
    others are due one after another at the rate. What is not in the slice is left.
    """
    waiting = entries.join(submissions.where("ready").select(F.col("id").alias("submission_id")), "submission_id", "left_semi")
    ranked = waiting.withColumn("_n", F.row_number().over(Window.partitionBy("submission_id").orderBy("id")))
    taken = ranked.where(F.col("_n") <= slice_size).drop("_n")
    left = entries.join(taken.select("id"), "id", "left_anti")
    once = taken.groupBy(F.lower("url").alias("_key")).agg(F.min_by(F.struct(*taken.columns), "id").alias("row"))
    new = once.join(feeds.select(F.lower("feed_url").alias("_key")), "_key", "left_anti").select("row.*")
    queued = numbered(new, "id")
    seconds = F.floor(F.col("place") * 60 / per_minute).cast("decimal(18,6)")
    return queued.withColumn("next_fetch_at", now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)), left


def check_candidates(candidates: DataFrame, resolved: DataFrame, posts: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """(id, status, score, reasons) of candidates (id, curated) by what they resolve to (id, feed_url, title, description; no row where it failed) with posts (feed_id, title, url, published_at, author).

    error where nothing was found, rejected where the directory has the address or the judgement is
    bad; a curated one is taken as it is, a playlist is judged as a collection.
    """
    known = feeds.select("feed_url", F.lit(True).alias("known")).distinct()
    found = resolved.join(known, "feed_url", "left")
    plain, lists = found.where(~F.col("feed_url").rlike(SERIES_FEED)), found.where(F.col("feed_url").rlike(SERIES_FEED))
    verdicts = assess_feed(plain, posts, now).withColumnRenamed("worthy", "ok").unionByName(assess_series(lists, posts).withColumnRenamed("accepted", "ok"))
    df = candidates.join(found.select("id", "known", F.lit(True).alias("found")), "id", "left").join(verdicts, "id", "left")
    curated = F.coalesce("curated", F.lit(False))
    state = F.when(F.col("found").isNull(), "error").when(F.col("known"), "already").when(curated, "curated").when(F.col("ok"), "accepted").otherwise("rejected")
    df = df.withColumn("_s", state)
    judged = F.col("_s").isin("accepted", "rejected")
    reasons = F.when(F.col("_s") == "already", F.array(F.lit("already-indexed"))).when(F.col("_s") == "curated", F.array(F.lit("curated"))).when(judged, F.col("reasons"))
    status = F.when(F.col("_s") == "already", "rejected").when(F.col("_s") == "curated", "accepted").otherwise(F.col("_s"))
    return df.select("id", status.alias("status"), F.when(judged, F.col("score")).alias("score"), reasons.alias("reasons"))


def interleave(items: DataFrame, ads: DataFrame, by: str) -> DataFrame:
    """(by, pos, ad, id, at): posts (by, pos from 0, id, at) with ads (n from 0, id) after those that ``ad_positions`` names, dated a second before them, so that they sort after them."""
    slots = items.groupBy(by).agg(F.count(F.lit(1)).alias("_total")).select(by, F.posexplode(ad_positions(F.col("_total"))).alias("n", "pos"))
    placed = slots.join(ads.select("n", F.col("id").alias("_ad")), "n").join(items, [by, "pos"])
    rows = items.select(by, "pos", F.lit(False).alias("ad"), "id", "at").unionByName(placed.select(by, "pos", F.lit(True).alias("ad"), F.col("_ad").alias("id"), (F.col("at") - F.expr("interval 1 second")).alias("at")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("pos", "ad")) - 1)


def replace_keywords(stored: DataFrame, topics: DataFrame) -> DataFrame:
    """Stored keywords with those of each feed in ``topics`` replaced; other feeds keep theirs."""
    kept = stored.join(topics.select("feed_id").distinct(), "feed_id", "left_anti")
    return kept.unionByName(topics.select(stored.columns))


def prepare_credits(credits: DataFrame, feeds: DataFrame) -> DataFrame:
    """(feed_id, identity_key, name, email, url, role, confidence) of credits (feed_id, name, email, url, role, confidence, pos): one a person of a feed, the surest first, an owner's role wins."""
    key = identity_key(F.col("url"), F.col("name"), F.col("feed_url"))
    df = credits.join(feeds.select(F.col("id").alias("feed_id"), "feed_url"), "feed_id").withColumn("identity_key", key).where("identity_key is not null")
    sure = F.struct(-F.col("confidence"), F.col("pos"))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", sure)).alias(c)
    role = F.when(F.bool_or(F.col("role") == "owner"), "owner").otherwise(F.min_by("role", sure)).alias("role")
    return df.groupBy("feed_id", "identity_key").agg(first("name"), first("email"), first("url"), role, F.max("confidence").alias("confidence"))


def store_credits(authors: DataFrame, feed_authors: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(authors, feed_authors) after the credits: authors (identity_key, name, email, confidence) are merged by key, links (feed_id, identity_key, role, confidence) by feed and key.

    A stored name stays, a missing address is filled, the higher confidence and an owner's role win.
    """
    sure = F.struct(-F.col("confidence"), F.col("feed_id"))
    one = prepared.groupBy("identity_key").agg(F.min_by("name", sure).alias("name"), F.min_by("email", F.when(F.col("email").isNotNull(), sure)).alias("email"), F.max("confidence").alias("confidence"))
    people = merge(authors.select("identity_key", "name", "email", "confidence"), one, ["identity_key"], email=fill("email"), confidence=highest("confidence"))
    links = merge(feed_authors.select("feed_id", "identity_key", "role", "confidence"), prepared.select("feed_id", "identity_key", "role", "confidence"), ["feed_id", "identity_key"], role=owner_wins(), confidence=highest("confidence"))
    return people, links
