"""Operators that depend on order: folding of stories, rivers, batches, series, spreading, numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import RESERVED
from skein.functions.text import cluster_key, slugify

RIVER_LIMIT, PER_SOURCE, PER_HOST, MESSAGE_ITEMS = 60, 60, 8, 25


def newest_first(at: str = "published_at", *ties: str) -> Column:
    """A rank that grows from the newest to the oldest, undated rows last, then by ``ties``."""
    return F.struct(F.col(at).isNull().alias("undated"), (-F.unix_micros(F.col(at).cast("timestamp"))).alias("age"), *ties)


def dedupe_items(rows: DataFrame, key: str, rank: Column, title: str | None = None) -> DataFrame:
    """The row of each story with the smallest rank, and how many others it had.

    A null key is made from the title where ``title`` names it; rows with an empty key, or none,
    belong to no story and stay as they are. Stories are folded by partial aggregates before the
    shuffle, so a story that many feeds tell makes no large group.
    """
    own = F.coalesce(F.col(key), cluster_key(F.col(title))) if title else F.col(key)
    all_ = rows.withColumn("_story", F.coalesce(own, F.lit("")))
    first = all_.where("_story <> ''").groupBy("_story").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), rank).alias("row"), F.count(F.lit(1)).alias("n"))
    loose = all_.where("_story = ''").drop("_story").withColumn("duplicates", F.lit(0).cast("long"))
    return first.select("row.*", (F.col("n") - 1).alias("duplicates")).unionByName(loose)


def merge_river(sources: list[DataFrame], key: str = "cluster_key", limit: int = RIVER_LIMIT) -> DataFrame:
    """Posts of all sources, newest first, undated ones last, one row a story."""
    order = [F.col("published_at").desc_nulls_last(), F.col("id"), F.col(key)]
    rows = reduce(DataFrame.unionByName, sources)
    return dedupe_items(rows, key, newest_first("published_at", "id", key)).orderBy(*order).limit(limit)


def top_per(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def following(items: DataFrame, sources: DataFrame, limit: int = RIVER_LIMIT) -> DataFrame:
    """A user's river: of each source (source, feed_id) its newest posts, merged."""
    own = items.join(sources, "feed_id")
    own = top_per(own, "source", PER_SOURCE, F.col("published_at").desc_nulls_last(), F.col("id"), F.col("cluster_key")).select("id", "cluster_key", "published_at")
    return merge_river([own.distinct()], limit=limit)


def select_batch(pool: DataFrame, sent: DataFrame, cap: int, size: int = MESSAGE_ITEMS) -> DataFrame:
    """What an alert sends: pool has user_id, source, id, created_at, item_key.

    A source that gave its cap of rows may have more beyond its last one, so nothing later than the
    earliest such end is taken; of equal keys the first; none that was sent; the cut at ``size``
    keeps ties with its last row together.
    """
    per = pool.groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("end"))
    horizon = per.groupBy("user_id").agg(F.min(F.when(F.col("n") >= cap, F.col("end"))).alias("horizon"))
    rows = pool.join(horizon, "user_id").where(F.col("horizon").isNull() | (F.col("created_at") <= F.col("horizon")))
    rows = rows.join(sent.select("user_id", "item_key").distinct(), ["user_id", "item_key"], "left_anti")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "item_key").orderBy("created_at", "id", "source"))).where("_n = 1")
    ranked = first.withColumn("_r", F.rank().over(Window.partitionBy("user_id").orderBy("created_at"))).where(F.col("_r") <= size)
    return ranked.select("user_id", "item_key", "id", "created_at", F.max("created_at").over(Window.partitionBy("user_id")).alias("next_cursor"))


def cumulative_back(series: DataFrame, at: str, added: str, total: DataFrame) -> DataFrame:
    """A running total told backwards from today's, the one number of ``total``. A series has a row a day."""
    later = F.sum(added).over(Window.orderBy(at).rowsBetween(1, Window.unboundedFollowing))
    return series.crossJoin(total.toDF("_total")).withColumn("running", F.col("_total") - F.coalesce(later, F.lit(0))).drop("_total")


def day_labels(today: DataFrame, days: int) -> DataFrame:
    """The last days up to the one day of ``today``; none where it is null."""
    day = F.col(today.columns[0])
    return today.select(F.explode(F.sequence(F.date_sub(day, days - 1), day)).alias("day"))


def filled_hours(hourly: DataFrame, until: str, hours: int) -> DataFrame:
    """Hours up to a moment, zero where nothing was recorded."""
    spark = hourly.sparkSession
    grid = spark.sql(f"select explode(sequence(timestamp_ntz '{until}' - interval {hours - 1} hours, timestamp_ntz '{until}', interval 1 hour)) as hour")
    df = grid.join(hourly.withColumn("recorded", F.lit(True)), "hour", "left")
    return df.select("hour", F.coalesce("crawled", F.lit(0)).alias("crawled"), F.coalesce("recorded", F.lit(False)).alias("recorded"))


def sampled_hours(hourly: DataFrame, until: str, hours: int, gauge: str) -> DataFrame:
    """Hours up to a moment, null where nothing was sampled."""
    spark = hourly.sparkSession
    grid = spark.sql(f"select explode(sequence(timestamp_ntz '{until}' - interval {hours - 1} hours, timestamp_ntz '{until}', interval 1 hour)) as hour")
    return grid.join(hourly.select("hour", gauge), "hour", "left")


def spread_hosts(feeds: DataFrame, host: Column, batch: int, per_host: int, *order: Column) -> DataFrame:
    """A batch in which a host has at most ``per_host`` feeds, filled up with held ones if there is room."""
    ranked = feeds.withColumn("host", host)
    ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy(*order)))
    return ranked.withColumn("held", F.col("turn") > per_host).orderBy("held", *order).limit(batch)


def group_by_host(feeds: DataFrame, host: Column) -> DataFrame:
    """One queue for each host, the longest first."""
    return feeds.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("waiting"), F.min("next_fetch_at").alias("first_due")).orderBy(F.col("waiting").desc(), "host")


def numbered(rows: DataFrame, by: str, ranges: int = 512) -> DataFrame:
    """``rows`` with their place (from 0) in the order of a number, from ranks within ranges and the sizes of the ranges before: no task sees all rows.

    The ranges are cut at approximate quantiles, so that ids that crowd together are dealt out as well
    as others; where they are cut does not matter for the places. Equal numbers share a range, in any order; nulls come first.
    """
    steps = [1 << k for k in reversed(range((ranges - 1).bit_length()))]
    cuts = rows.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    if cuts is None:
        return rows.withColumn("place", F.lit(None).cast("long"))
    bounds = F.lit(sorted(set(cuts)))
    # how many bounds are not above the number, by halves
    beyond = lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col(by), at + step).otherwise(at)
    dealt = rows.withColumn("_range", F.aggregate(F.lit(steps), F.lit(0), beyond))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return dealt.withColumn("_own", own).join(before, "_range").withColumn("place", (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def queue_feeds(entries: DataFrame, feeds: DataFrame, start: Column, per_hour: int) -> DataFrame:
    """New addresses once each, without known ones, with due times one after another."""
    first = entries.groupBy(F.lower("url").alias("_key")).agg(F.min_by(F.struct(*entries.columns), "id").alias("row"))
    new = first.join(feeds.select(F.lower("feed_url").alias("_url")), F.col("_key") == F.col("_url"), "left_anti").select("row.*")
    return numbered(new, "id").withColumn("next_fetch_at", start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("place") * F.lit(3600 // per_hour)).cast("decimal(18,6)")))


def claim_slugs(entries: DataFrame, taken: DataFrame, base: str = "base") -> DataFrame:
    """A free slug for each entry: the base itself, or with the next free numbers from 2 on.

    Numbers of taken variants are left out by counting the free ones, so there is no loop.
    """
    own = Window.partitionBy(base).orderBy("id")
    n = entries.withColumn("_k", F.row_number().over(own))
    need = n.groupBy(base).agg(F.max("_k").alias("_most"))
    used = taken.select(F.col("slug").alias("_slug"), F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1).alias(base), F.regexp_extract("slug", r"-(\d+)$", 1).alias("_no"))
    plain = taken.select(F.col("slug").alias(base), F.lit(1).alias("_no"))
    used = used.where("_no <> ''").select(base, F.expr("try_cast(_no as int)").alias("_no")).unionByName(plain)
    count = used.groupBy(base).agg(F.count(F.lit(1)).alias("_used"))
    grid = need.join(count, base, "left").select(base, F.explode(F.sequence(F.lit(1), (F.col("_most") + F.coalesce("_used", F.lit(0))).cast("int"))).alias("_no"))
    free = grid.join(used, [base, "_no"], "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy(base).orderBy("_no")))
    return n.join(free, [base, "_k"]).withColumn("slug", F.when(F.col("_no") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_no").cast("string")))).drop("_k", "_no")


def unique_slugs(entries: DataFrame, taken: DataFrame) -> DataFrame:
    """A free slug for each of ``entries`` (id, title, url): from the title, else from the address's host, else ``untitled``; reserved words count as taken."""
    host = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^https?://([^/?#]+)", 1), r"^www\.", "")
    base = F.coalesce(F.nullif(slugify(F.coalesce("title", F.lit(""))), F.lit("")), F.nullif(slugify(host), F.lit("")), F.lit("untitled"))
    reserved = entries.sparkSession.createDataFrame([(r,) for r in RESERVED], "slug string")
    return claim_slugs(entries.withColumn("base", base), taken.select("slug").unionByName(reserved).distinct()).drop("base")


def first_spelling(rows: DataFrame, name: str, at: str, *by: str) -> DataFrame:
    """Names without regard to case, each as it is spelt first."""
    return rows.groupBy(*by, F.lower(name).alias("_key")).agg(F.min_by(name, at).alias(name), F.min(at).alias(at)).drop("_key")


def candidate_sites(results: DataFrame, host: Column) -> DataFrame:
    """The first link of each host."""
    return results.withColumn("host", host).withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy("pos"))).where("_n = 1").drop("_n")


def parse_keywords(raw: DataFrame, column: str = "raw", most: int = 100) -> DataFrame:
    """Words of a list by lines or commas, once each without regard to case, the first ones."""
    words = raw.select(F.posexplode(F.split(column, r"[\n,]")).alias("pos", "keyword")).withColumn("keyword", F.trim("keyword")).where("keyword <> ''")
    once = words.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("keyword")).orderBy("pos"))).where("_n = 1")
    return once.orderBy("pos").limit(most).select("pos", "keyword")


def keywords_of(raw: DataFrame, by: str, column: str = "raw", most: int = 100) -> DataFrame:
    """(by, pos, keyword): words of each owner's list by lines or commas, once each without regard to case, the first ``most``."""
    words = raw.select(by, F.posexplode(F.split(column, r"[\n,]")).alias("pos", "keyword")).withColumn("keyword", F.trim("keyword")).where("keyword <> ''")
    once = words.groupBy(by, F.lower("keyword").alias("_k")).agg(F.min_by("keyword", "pos").alias("keyword"), F.min("pos").alias("pos"))
    return top_per(once, by, most, F.col("pos")).select(by, "pos", "keyword")


def merge_credits(credits: DataFrame, by: str = "feed_id") -> DataFrame:
    """One credit per person of a feed: equal names, and a single word with the one fuller name it begins.

    The highest confidence and an owner's role win; other fields are the first that are not empty.
    """
    c = credits.withColumn("_name", F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))))
    full = c.where("_name like '% %'").select(by, F.substring_index("_name", " ", 1).alias("_name"), F.col("_name").alias("_full")).groupBy(by, "_name").agg(F.min("_full").alias("_full"))
    c = c.join(full, [by, "_name"], "left").withColumn("_key", F.coalesce("_full", "_name"))
    value = lambda x: F.min_by(x, F.when(F.coalesce(F.col(x), F.lit("")) != "", F.col("pos")))
    return c.groupBy(by, "_key").agg(F.max_by("name", F.struct(F.length("name"), -F.col("pos"))).alias("name"), F.max("confidence").alias("confidence"),
                                     F.when(F.max((F.col("role") == "owner").cast("int")) == 1, "owner").otherwise(F.min_by("role", "pos")).alias("role"), value("email").alias("email"), value("url").alias("url")).drop("_key")


def keyword_diff(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """What to delete, insert or update so that stored becomes extracted; unchanged rows are left out."""
    a, b = extracted.select("feed_id", "slug", F.col("keyword").alias("kw"), F.col("count").alias("n")), stored.select("feed_id", "slug", F.col("keyword").alias("old_kw"), F.col("count").alias("old_n"))
    op = F.when(F.col("kw").isNull(), "delete").when(F.col("old_kw").isNull(), "insert").when((F.col("kw") != F.col("old_kw")) | (F.col("n") != F.col("old_n")), "update")
    return a.join(b, ["feed_id", "slug"], "full_outer").withColumn("op", op).where("op is not null")


def first_window_limit(hits: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """Whether each hit of an identity is within the limit of its window, which its first hit opens.

    Windows depend on one another, so an identity's hits are walked in order. They are first thinned
    to counts per second, which bounds a group by the span of time and not by the number of hits.
    """
    import pandas as pd

    per = hits.groupBy("identity", F.date_trunc("second", "at").alias("at")).agg(F.count(F.lit(1)).alias("hits"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        opened, used, out = None, 0, []
        for at, n in zip(pdf["at"], pdf["hits"], strict=True):
            if opened is None or (at - opened).total_seconds() >= seconds:
                opened, used = at, 0
            out.append((opened, max(0, min(n, limit - used))))
            used += n
        pdf["opened"], pdf["allowed"] = zip(*out, strict=True)
        return pdf

    at = dict(per.dtypes)["at"]
    return per.groupBy("identity").applyInPandas(walk, f"identity {dict(per.dtypes)['identity']}, at {at}, hits long, opened {at}, allowed long")
