"""Single-relation reads: lookups, listings, queues and cursors. All take and give DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LOG, EXPRESS_SHARE = 1000, 0.5


def lookup(df: DataFrame, *columns: str, **equals) -> DataFrame:
    """Rows whose columns have the given values; these columns only, if any are named."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.select(*columns) if columns else df


def live(feeds: DataFrame) -> DataFrame:
    return feeds.where("status <> 'dead'")


def page(df: DataFrame, *order: Column, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of an ordered listing; the order should name a unique column last."""
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def list_feeds(feeds: DataFrame, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Live feeds, newest first."""
    df = live(feeds) if category is None else live(feeds).where(F.col("category") == category)
    return page(df, F.col("created_at").desc_nulls_last(), F.col("id").desc(), limit=limit, offset=offset)


def items_for_feed(items: DataFrame, feed_id: int, limit: int = 50) -> DataFrame:
    """Posts of a feed, newest first, undated ones last."""
    return page(items.where(F.col("feed_id") == feed_id), F.col("published_at").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc(), limit=limit)


def keywords_for_feed(keywords: DataFrame, feed_id: int, limit: int = 12) -> DataFrame:
    """Publisher's categories first, then the most frequent."""
    return page(keywords.where(F.col("feed_id") == feed_id), F.when(F.col("source") == "category", 0).otherwise(1), F.col("count").desc(), F.col("keyword"), limit=limit)


def like_term(term: str) -> str:
    """A search term in which LIKE's signs stand for themselves."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def list_topics(topics: DataFrame, query: str | None = None, min_feeds: int = 2, limit: int = 50, offset: int = 0) -> DataFrame:
    """Topics with enough feeds; a query is matched anywhere and ranks exact, prefix, other."""
    df = topics.where(F.col("feed_count") >= min_feeds)
    order = [F.col("feed_count").desc(), F.col("slug")]
    if query:
        term = like_term(query)
        df = df.where(F.col("keyword").ilike(f"%{term}%") | F.col("slug").ilike(f"%{term}%"))
        rank = F.when(F.lower("keyword") == query.lower(), 0).when(F.col("keyword").ilike(f"{term}%"), 1).otherwise(2)
        order = [rank, *order]
    return page(df, *order, limit=limit, offset=offset)


def failing_feeds(feeds: DataFrame, limit: int = 20) -> DataFrame:
    return page(feeds.where(F.col("status").isin("error", "dead")), F.col("error_count").desc(), F.col("id"), limit=limit)


def recently_crawled(feeds: DataFrame, limit: int = 20) -> DataFrame:
    return page(feeds.where("last_fetched_at is not null"), F.col("last_fetched_at").desc(), F.col("id"), limit=limit)


def _due(feeds: DataFrame, now: Column) -> DataFrame:
    return live(feeds).where(F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now))


def express_feeds(feeds: DataFrame, now: Column, limit: int = 25) -> DataFrame:
    """Feeds with priority that were never fetched."""
    return page(_due(feeds, now).where("priority > 0 and last_fetched_at is null"), F.col("priority").desc(), F.col("created_at"), F.col("id"), limit=limit)


def due_feeds(feeds: DataFrame, now: Column, limit: int = 25) -> DataFrame:
    """At most half of the batch by the express lane, the rest in order of their due time; no feed twice.

    The ordinary branch leaves out exactly what the express branch took.
    """
    most = int(limit * EXPRESS_SHARE)
    express = express_feeds(feeds, now, most).select("id", F.lit(0).alias("lane"), F.row_number().over(_order(F.col("priority").desc(), F.col("created_at"), F.col("id"))).alias("rank"))
    rest = _due(feeds, now).join(express.select("id"), "id", "left_anti")
    rest = page(rest, F.col("next_fetch_at").asc_nulls_first(), F.col("id"), limit=limit).select("id", F.lit(1).alias("lane"), F.row_number().over(_order(F.col("next_fetch_at").asc_nulls_first(), F.col("id"))).alias("rank"))
    return page(express.unionByName(rest), F.col("lane"), F.col("rank"), limit=limit)


def _order(*columns: Column):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def feeds_needing_card(feeds: DataFrame, before: Column, limit: int = 10) -> DataFrame:
    """Feeds whose card is not known to be fine (also where nothing is known) and not tried since."""
    df = live(feeds).where(~F.col("card_state").eqNullSafe(F.lit("ok"))).where(F.col("card_checked_at").isNull() | (F.col("card_checked_at") < before))
    return page(df, F.col("card_checked_at").asc_nulls_first(), F.col("id"), limit=limit)


def neighbours(feeds: DataFrame, created_at: Column, feed_id: int) -> DataFrame:
    """The live feeds before and after a moment."""
    df = live(feeds).where(F.col("id") != feed_id)
    older = page(df.where(F.col("created_at") < created_at), F.col("created_at").desc(), F.col("id").desc(), limit=1).withColumn("side", F.lit("previous"))
    newer = page(df.where(F.col("created_at") > created_at), F.col("created_at"), F.col("id"), limit=1).withColumn("side", F.lit("next"))
    return older.unionByName(newer)


def random_feed(feeds: DataFrame, seed: int = 0) -> DataFrame:
    """One live feed, each as likely as another; the same for the same seed."""
    return live(feeds).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1)


def channel_ids(feeds: DataFrame, pattern: str = r"host(\d+)\.example") -> DataFrame:
    """Ids that a pattern captures in the feeds' addresses."""
    return feeds.where(F.col("feed_url").like("%host%")).select(F.regexp_extract("feed_url", pattern, 1).alias("channel_id")).where("channel_id <> ''").distinct()


def crawl_log(log: DataFrame, since: int | None = None, limit: int = 200) -> DataFrame:
    """Log lines after a cursor, oldest first; the limit is held between 1 and MAX_LOG."""
    df = log if since is None else log.where(F.col("id") > since)
    return page(df, F.col("id"), limit=max(1, min(MAX_LOG, limit)))


def crawl_log_tail(log: DataFrame, limit: int = 60) -> DataFrame:
    """The last lines, oldest of them first."""
    return page(log, F.col("id").desc(), limit=limit).orderBy("id")


def operational_errors(log: DataFrame, since: Column, limit: int = 20) -> DataFrame:
    """Errors that are about no single feed."""
    return page(log.where("status = 'error'").where(F.col("at") >= since), F.col("id").desc(), limit=limit)


def submission_events(feeds: DataFrame, submission_id: int, since: Column | None = None, limit: int = 100) -> DataFrame:
    """Feeds of a submission: after a cursor in order, or else the latest."""
    df = feeds.where(F.col("submission_id") == submission_id)
    if since is not None:
        return page(df.where(F.col("created_at") > since), F.col("created_at"), F.col("id"), limit=limit)
    return page(df, F.col("created_at").desc(), F.col("id").desc(), limit=limit).orderBy("created_at", "id")


def members(values: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Those of ``values`` that are known."""
    return values.join(known.select(on).distinct(), on, "left_semi")


def taken_slugs(df: DataFrame, base: str) -> DataFrame:
    """The slug itself and its numbered variants."""
    return df.where((F.col("slug") == base) | F.col("slug").like(like_term(base) + "-%")).select("slug")


def existing_keys(feeds: DataFrame) -> DataFrame:
    """Addresses in lower case and slugs that are taken."""
    return feeds.select(F.lit("url").alias("kind"), F.lower("feed_url").alias("key")).unionByName(feeds.select(F.lit("slug").alias("kind"), F.col("slug").alias("key"))).distinct()


def known_hosts(feeds: DataFrame) -> DataFrame:
    """Hosts of sites and feeds without a leading www."""
    urls = feeds.select(F.explode(F.array("site_url", "feed_url")).alias("url"))
    return urls.select(F.regexp_replace(F.expr("try_parse_url(url, 'HOST')"), r"^www\.", "").alias("host")).where("host is not null").distinct()


def matches(haystack: Column, wanted: list[str]) -> Column:
    """Whether a folded text has every term."""
    out = F.lit(True)
    for term in wanted:
        out = out & F.contains(haystack, F.lit(term))
    return out


def lanes_for_items(queue: DataFrame, user_id: int) -> DataFrame:
    """The lanes each item of a user's queue waits in."""
    return queue.where(F.col("user_id") == user_id).groupBy("item_id").agg(F.array_sort(F.collect_set("lane")).alias("lanes"))


def tail_of(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The last ``n`` rows in the order of ``by``, oldest first."""
    return rows.orderBy(*[F.col(c).desc() for c in by]).limit(n).orderBy(*by)
