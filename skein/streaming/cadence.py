"""When to look at a feed again: from the dates of its posts, or from the times it was seen to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import MAX_INTERVAL, MIN_INTERVAL, UNDATED_CEILING, clamp

AHEAD_HOURS, LOG_LIMIT = 24, 12


def interval_from(gap: Column, silence: Column) -> Column:
    """Minutes: half a gap while the rhythm holds, a quarter of the silence when it is longer than three gaps."""
    return clamp(F.round(F.when(silence <= 3 * gap, gap / 2).otherwise(silence / 4)), MIN_INTERVAL, MAX_INTERVAL).cast("long")


def intervals_from_dates(items: DataFrame, now: Column, by: str = "feed_id", at: str = "published_at") -> DataFrame:
    """(by, gap, silence, minutes) of owners with two different dates that are not in the future."""
    t = published_times(items, now, by, at)
    gaps = t.withColumn("gap", (F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(Window.partitionBy(by).orderBy("at")))) / 60)
    g = gaps.groupBy(by).agg(F.median("gap").alias("gap"), F.max("at").alias("newest"))
    silence = F.greatest((F.unix_timestamp(now) - F.unix_timestamp("newest")) / 60, F.lit(0.0))
    return g.where("gap is not null").select(by, F.col("gap"), silence.alias("silence"), interval_from(F.col("gap"), silence).alias("minutes"))


def published_times(items: DataFrame, now: Column, by: str = "feed_id", at: str = "published_at") -> DataFrame:
    """The different dates of each owner's posts that can be believed: not null, not more than a day ahead."""
    return items.where(F.col(at).isNotNull() & (F.col(at) <= now + F.make_dt_interval(F.lit(0), F.lit(AHEAD_HOURS)))).select(by, F.col(at).alias("at")).distinct()


def newest_published(items: DataFrame, now: Column, by: str = "feed_id", at: str = "published_at") -> DataFrame:
    """(by, newest) of each owner with a date that can be believed; a date ahead counts as now."""
    return published_times(items, now, by, at).groupBy(by).agg(F.least(F.max("at"), now).alias("newest"))


def interval_from_changes(log: Column, now: Column) -> Column:
    """Minutes by the times a feed was seen to change: the rule of dates, and with a single time its silence for the gap; null without times."""
    times = F.array_sort(F.array_distinct(F.filter(log, lambda t: t.isNotNull() & (t <= now))))
    seconds = F.transform(times, lambda t: F.unix_timestamp(t).cast("double"))
    n = F.size(seconds)
    gaps = F.array_sort(F.transform(F.slice(seconds, 2, F.greatest(n - 1, F.lit(0))), lambda t, i: (t - F.get(seconds, i)) / 60))
    k = F.size(gaps)
    median = (F.get(gaps, F.floor((k - 1) / 2).cast("int")) + F.get(gaps, F.floor(k / 2).cast("int"))) / 2
    silence = (F.unix_timestamp(now) - F.get(seconds, n - 1)) / 60
    return F.when(n >= 1, interval_from(F.when(n == 1, silence).otherwise(median), silence))


def next_interval(dated: Column, new_items: Column, current: Column) -> Column:
    """What the dates say, or for undated feeds an hour after news and twice as long after none."""
    return F.coalesce(dated, F.when(new_items > 0, F.lit(MIN_INTERVAL)).otherwise(clamp(2 * current, MIN_INTERVAL, UNDATED_CEILING)))


def never_sooner(following: Column, current: Column) -> Column:
    return F.when(following.isNull(), None).otherwise(F.greatest(following, F.coalesce(current, F.lit(0)), F.lit(MIN_INTERVAL)))


def record_change(log: Column, changed: Column, now: Column) -> Column:
    """The log with this moment in front if something changed, of bounded length."""
    return F.when(changed, F.slice(F.concat(F.array(now), F.coalesce(log, F.array().cast("array<timestamp>"))), 1, LOG_LIMIT)).otherwise(log)


def content_signature(owners: DataFrame, items: DataFrame, by: str = "feed_id") -> DataFrame:
    """(by, signature) of each owner: a hash of its posts' identifiers, links and titles that does not depend on their order; posts without any count as none."""
    own = F.concat_ws("\u0001", *[F.coalesce(c, F.lit("")) for c in ("guid", "url", "title")])
    some = items.where(own != "\u0001\u0001").groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(F.sha1(own.cast("binary")))), ",").alias("all"))
    return owners.select(by).join(some, by, "left").select(by, F.sha1(F.coalesce("all", F.lit("")).cast("binary")).alias("signature"))


def scatter(key: Column) -> Column:
    """A share of one by a key, to spread what would come at once."""
    from skein.functions.scalars import hash31

    return hash31(key, 10_000) / 10_000


def settle(feeds: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The next state of feeds after an outcome: unchanged, throttled, failed or crawled (id, outcome, error, minutes, new_items)."""
    from skein.functions.scalars import backoff_minutes, throttle_minutes

    df = feeds.join(outcomes, "id")
    errors = F.when(F.col("outcome") == "failed", F.col("error_count") + 1).when(F.col("outcome") == "throttled", F.col("error_count")).otherwise(0)
    wait = (F.when(F.col("outcome") == "failed", backoff_minutes(F.col("error_count") + 1)).when(F.col("outcome") == "throttled", throttle_minutes(F.col("retry_after")))
            .otherwise(next_interval(F.col("minutes"), F.col("new_items"), F.col("interval_minutes"))))
    status = F.when((F.col("outcome") == "failed") & (errors >= 10), "dead").when(F.col("outcome") == "failed", "error").when(F.col("outcome") == "throttled", F.col("status")).otherwise("active")
    return df.select("id", status.alias("status"), errors.alias("error_count"), wait.cast("long").alias("wait"), (now + F.make_dt_interval(F.lit(0), F.lit(0), wait.cast("int"))).alias("next_fetch_at"))
