"""What stands for a feed: the picture of its card, and the kind of a playlist's entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import card_fit

#: How pictures are ranked, by how they fit a card.
RANKS = {"large": 2, "small": 1, "none": 0}
#: Types of streams.
STREAMS = ["application/vnd.apple.mpegurl", "video/vnd.apple.mpegurl"]
#: Places of candidates in a feed fit in so many bits beside the rank.
_PLACES = 32


def find_cards(feeds: DataFrame, candidates: DataFrame, pictures: DataFrame) -> DataFrame:
    """(feed_id, state, url, width, height, type, fit, source): the first large picture of a feed, or else the first of those that fit best.

    feeds: feed_id, page_failed. candidates: feed_id, place, source, url. pictures: url, and what was
    found there (probed_url, type, width, height; an address is there once). A vector picture is no card but a picture. The state is
    ok, none where nothing was found, or error where the page failed and nothing else was offered.
    """
    fit = F.when(F.col("type") == "svg", "none").otherwise(F.coalesce(card_fit(F.col("width"), F.col("height")), F.lit("none")))
    offered = candidates.where("url <> ''").groupBy("feed_id", "url").agg(F.min("place").alias("place"))
    seen = offered.join(pictures.withColumn("fit", fit), "url")
    rank = F.when(F.col("fit") == "large", RANKS["large"]).when(F.col("fit") == "small", RANKS["small"]).otherwise(RANKS["none"])
    # one long tells the better picture, so the choice is a hash aggregate
    order = F.shiftleft((RANKS["large"] - rank).cast("long"), _PLACES) + F.col("place")
    best = seen.groupBy("feed_id").agg(F.min(order).alias("best"))
    chosen = best.select("feed_id", F.col("best").bitwiseAND((1 << _PLACES) - 1).alias("place")).join(seen, ["feed_id", "place"]).join(candidates.select("feed_id", "place", "source"), ["feed_id", "place"])
    any_ = offered.select("feed_id").distinct().withColumn("offered", F.lit(True))
    rows = feeds.join(any_, "feed_id", "left").join(chosen.select("feed_id", "probed_url", "width", "height", "type", "fit", "source"), "feed_id", "left")
    state = F.when(F.col("probed_url").isNotNull(), "ok").when(F.col("page_failed") & F.col("offered").isNull(), "error").otherwise("none")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("feed_id", state.alias("state"), F.coalesce("probed_url", F.lit("")).alias("url"), F.coalesce("width", F.lit(0)).cast("long").alias("width"), F.coalesce("height", F.lit(0)).cast("long").alias("height"),
                       empty("type"), F.coalesce("fit", F.lit("none")).alias("fit"), empty("source"))


def kind_of_entries(entries: DataFrame, by: str) -> DataFrame:
    """(by, kind) of playlists by their entries (type, seconds): live where most are streams, video where it outnumbers audio, else music."""
    kind = F.coalesce("type", F.lit(""))
    live = kind.isin(STREAMS) | ((kind == "") & F.col("seconds").isNull())
    counts = entries.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(live).alias("live"), F.count_if(kind.startswith("video/")).alias("video"), F.count_if(kind.startswith("audio/")).alias("audio"))
    return counts.select(by, F.when(2 * F.col("live") > F.col("n"), "live").when(F.col("video") > F.col("audio"), "video").otherwise("music").alias("kind"))
