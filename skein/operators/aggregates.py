"""Aggregations: one pass with conditional counts, partial sums before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.listing import live


def count(df: DataFrame, name: str = "n", **equals) -> DataFrame:
    """How many rows have the given values."""
    for k, v in equals.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(df: DataFrame, column: str, values: list[str], name: str = "n") -> DataFrame:
    """Counts per value with a zero for each of ``values`` that is not there."""
    zero = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return zero.join(df.groupBy(column).agg(F.count(F.lit(1)).alias(name)), column, "left").fillna(0, [name])


def pivot_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a count per value and the total."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def refresh_topics(keywords: DataFrame, feeds: DataFrame, min_feeds: int = 2) -> DataFrame:
    """The rollup of topics that at least ``min_feeds`` live feeds share."""
    df = keywords.join(live(feeds).select(F.col("id").alias("feed_id")), "feed_id", "left_semi")
    return df.groupBy("slug").agg(F.min("keyword").alias("keyword"), F.count_distinct("feed_id").alias("feed_count")).where(F.col("feed_count") >= min_feeds)


def topic_kind_counts(keywords: DataFrame, feeds: DataFrame, slug: str) -> DataFrame:
    return keywords.where(F.col("slug") == slug).select(F.col("feed_id").alias("id")).join(live(feeds), "id").groupBy("category").agg(F.count(F.lit(1)).alias("feeds"))


def job_backlogs(feeds: DataFrame, entries: DataFrame, run_keywords: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """What each job has waiting, from one pass over each relation."""
    f = feeds.agg(
        F.count_if((F.col("status") != "dead") & (F.col("next_fetch_at") <= now)).alias("crawl"),
        F.count_if((F.col("status") == "active") & F.col("authors_checked_at").isNull()).alias("authors"),
        F.count_if((F.col("status") != "dead") & ~F.col("card_state").eqNullSafe(F.lit("ok"))).alias("cards"))
    rows = f.select(F.expr("stack(3, 'crawl', crawl, 'authors', authors, 'cards', cards) as (job, backlog)"))
    for df, name in ((entries, "import"), (run_keywords.where("status = 'queued'"), "keywords"), (candidates.where("status = 'queued'"), "candidates")):
        rows = rows.unionByName(df.agg(F.count(F.lit(1)).alias("backlog")).select(F.lit(name).alias("job"), "backlog"))
    return rows


def log_activity(log: DataFrame, since: Column) -> DataFrame:
    """Per event: lines, errors, amounts, a JSON number where the detail is JSON, the latest moment."""
    k = F.when(F.col("detail").like("{%"), F.get_json_object("detail", "$.k").cast("long"))
    return log.where(F.col("at") >= since).groupBy("event").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.sum("amount"), 4).alias("amount"),
        F.sum(F.coalesce(k, F.lit(0))).alias("k"), F.max("at").alias("latest"), F.avg("amount").cast("int").alias("mean"))


def crawl_stats(feeds: DataFrame, now: Column) -> DataFrame:
    """One row of the crawler's state; due is what is neither dead nor scheduled later."""
    return feeds.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "pending", "error", "dead")],
        (F.count(F.lit(1)) - F.count_if(F.col("status") == "dead") - F.count_if((F.col("status") != "dead") & (F.col("next_fetch_at") > now))).alias("due"),
        F.count_if((F.col("status") == "active") & (F.col("last_fetched_at") < now - F.make_dt_interval(F.lit(7)))).alias("stale"),
        F.min("last_fetched_at").alias("oldest"), F.max("last_fetched_at").alias("newest"), F.sum("item_count").alias("items"))


def hourly_rate(hourly: DataFrame, hour: Column, minutes: int) -> DataFrame:
    """Crawls an hour over this hour so far and the one before."""
    two = hourly.where((F.col("hour") <= hour) & (F.col("hour") >= hour - F.make_dt_interval(F.lit(0), F.lit(1))))
    return two.agg(F.round(F.coalesce(F.sum("crawled"), F.lit(0)) / F.lit(1 + minutes / 60.0), 6).alias("per_hour"))


def category_growth(feeds: DataFrame, since: Column) -> DataFrame:
    """New feeds by day and category."""
    return feeds.where(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("day"), "category").agg(F.count(F.lit(1)).alias("added"))


def card_coverage(feeds: DataFrame) -> DataFrame:
    return live(feeds).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("card_state") == "ok").alias("ok"), F.count_if(F.col("card_state") == "none").alias("none"), F.count_if(F.col("card_state") == "error").alias("failed"), F.count_if(F.col("card_state").isNull()).alias("unknown"))


def reliability(feeds: DataFrame, hourly: DataFrame, now: Column) -> DataFrame:
    """Success rate, hours recorded of those observed, feeds that still publish."""
    h = hourly.agg(F.round(1 - F.sum("failed") / F.sum("crawled"), 6).alias("success"), F.count(F.lit(1)).alias("recorded"), ((F.unix_timestamp(F.max("hour")) - F.unix_timestamp(F.min("hour"))) / 3600 + 1).cast("long").alias("observed"))
    f = live(feeds).agg(F.count_if(F.col("last_published_at") >= now - F.make_dt_interval(F.lit(365))).alias("publishing"), F.count_if(~F.coalesce(F.col("last_published_at") >= now - F.make_dt_interval(F.lit(365)), F.lit(False))).alias("dormant"), F.min("next_fetch_at").alias("first_due"), F.max("next_fetch_at").alias("last_due"))
    return h.crossJoin(f)


def author_stats(authors: DataFrame, links: DataFrame, feed_authors: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    sure = authors.where(F.col("confidence") >= min_confidence)
    a = sure.agg(F.count(F.lit(1)).alias("authors"), F.count("email").alias("with_email"))
    f = feed_authors.join(sure.select(F.col("id").alias("author_id")), "author_id", "left_semi").agg(F.count_distinct("feed_id").alias("feeds"))
    x = links.agg(F.count(F.lit(1)).alias("links"), F.count_if("verified").alias("verified"), F.count_distinct("author_id").alias("linked"))
    return a.crossJoin(f).crossJoin(x)


def language_counts(feeds: DataFrame, limit: int = 100) -> DataFrame:
    """Feeds by declared language, blanks left out."""
    df = feeds.where(F.trim("language") != "").groupBy("language").agg(F.count(F.lit(1)).alias("feeds"))
    return df.orderBy(F.col("feeds").desc(), "language").limit(limit)


def offered_languages(counts: DataFrame, pinned: list[str] | None = None, limit: int = 8) -> DataFrame:
    """Languages by primary subtag: pinned ones first in their order, then by feeds."""
    code = F.regexp_extract(F.lower("language"), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    df = counts.select(code.alias("code"), "feeds").where("code <> ''").groupBy("code").agg(F.sum("feeds").alias("feeds"))
    at = F.array_position(F.array(*[F.lit(p) for p in pinned]), F.col("code")) if pinned else F.lit(0)
    return df.withColumn("pin", F.when(at > 0, at)).orderBy(F.col("pin").asc_nulls_last(), F.col("feeds").desc(), "code").limit(limit).drop("pin")


def score_for(reactions: DataFrame, item_id: int | None = None) -> DataFrame:
    """Votes up, down and their difference, of one post or of each."""
    aggs = [F.count_if(F.col("vote") == 1).alias("up"), F.count_if(F.col("vote") == -1).alias("down"), (F.count_if(F.col("vote") == 1) - F.count_if(F.col("vote") == -1)).alias("score")]
    return reactions.groupBy("item_id").agg(*aggs) if item_id is None else reactions.where(F.col("item_id") == item_id).agg(*aggs)


def grouped_counts(counts: DataFrame, groups: dict[str, list[str]], kind: str = "category", n: str = "n", positive: bool = True) -> DataFrame:
    """Sums of kinds' counts over groups that may share kinds."""
    table = counts.sparkSession.createDataFrame([(g, k) for g, ks in groups.items() for k in ks], f"grp string, {kind} string")
    out = table.join(counts, kind, "left").groupBy("grp").agg(F.sum(F.coalesce(n, F.lit(0))).alias("n"))
    return out.where("n > 0") if positive else out


def eta(backlog: Column, rate: Column) -> Column:
    """Hours that a backlog takes; null where nothing moves."""
    return backlog / F.nullif(rate, F.lit(0))


def job_state(backlog: Column, rate: Column, last_at: Column, errors: Column, runs: Column, expect_full: Column, alarm_above: Column, finished: Column) -> Column:
    """failing (every line an error), done, clear, idle, working, stalled or behind (more waits than the job's alarm)."""
    moving, ran = F.coalesce(rate, F.lit(0)) > 0, last_at.isNotNull()
    return (F.when((errors > 0) & (errors == runs), "failing").when(finished, "done").when(backlog == 0, F.when(ran, "clear").otherwise("idle"))
            .when(backlog.isNull(), F.when(moving, "working").when(ran, "idle").otherwise("stalled")).when(~moving, F.when(ran, "stalled").otherwise("idle"))
            .when(expect_full, "working").when(backlog > alarm_above, "behind").otherwise("working"))


def job_rows(jobs: DataFrame, activity: DataFrame) -> DataFrame:
    """Jobs (job, backlog, rate, events, expect_full, alarm_above, finished) with their lines in the log, state and hours to go.

    activity has event, lines, errors and last_at; a job's lines are those of all its events.
    """
    of = jobs.select("job", F.explode("events").alias("event")).join(activity, "event").groupBy("job").agg(F.sum("lines").alias("runs"), F.sum("errors").alias("errors"), F.max("last_at").alias("last_at"))
    df = jobs.join(of, "job", "left").fillna(0, ["runs", "errors"])
    state = job_state(*(F.col(c) for c in ("backlog", "rate", "last_at", "errors", "runs", "expect_full", "alarm_above", "finished")))
    return df.select("job", "backlog", "runs", "errors", "last_at", state.alias("state"), F.round(eta(F.col("backlog"), F.col("rate")), 6).alias("eta"))


def queue_runtime(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Seconds of each user's queue, null if less than half of its tracks are timed."""
    df = queue.join(items.select(F.col("id").alias("item_id"), F.when(F.col("audio_url").isNotNull(), F.col("audio_seconds")).alias("seconds")), "item_id")
    return df.groupBy("user_id").agg(F.when(2 * F.count("seconds") >= F.count(F.lit(1)), F.sum("seconds")).alias("seconds"), F.count(F.lit(1)).alias("tracks"))
