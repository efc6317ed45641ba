"""Writers: feeds, playlists, outlines and site maps as text, made by aggregation in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import escape_xml, rfc822

AD_EVERY, AD_MAX, SITEMAP_PART = 10, 3, 20_000
FORMATS = ("rss", "xml", "atom", "json", "md", "m3u", "pls")


def playable(url: Column, mime: Column) -> Column:
    return F.coalesce(url.rlike("^https?://") & (F.coalesce(mime, F.lit("")) != "video/youtube"), F.lit(False))


def _joined(rows: DataFrame, by: str, at: str, line: Column, name: str) -> DataFrame:
    """The lines of each group in their order, as one text."""
    parts = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), line.alias("line")))).alias("parts"))
    return parts.select(by, F.array_join(F.transform("parts", lambda p: p["line"]), "").alias(name))


def _tag(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), escape_xml(value), F.lit(f"</{name}>"))).otherwise("")


def rss(channels: DataFrame, items: DataFrame, by: str = "feed_id") -> DataFrame:
    """RSS 2.0; channels: by, title, link, description; items: by, pos, title, url, guid, summary, published_at, audio_url, audio_type."""
    enclosure = F.when(F.col("audio_url").isNotNull(), F.concat(F.lit('<enclosure url="'), escape_xml(F.col("audio_url")), F.lit('" type="'), F.coalesce("audio_type", F.lit("audio/mpeg")), F.lit('" length="0"/>'))).otherwise("")
    line = F.concat(F.lit("<item>"), _tag("title", F.col("title")), _tag("link", F.col("url")), F.lit('<guid isPermaLink="false">'), escape_xml(F.col("guid")), F.lit("</guid>"), _tag("pubDate", rfc822(F.col("published_at"))), _tag("description", F.col("summary")), enclosure, F.lit("</item>"))
    body = _joined(items, by, "pos", line, "body")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), _tag("title", F.col("title")), _tag("link", F.col("link")), _tag("description", F.coalesce("description", F.lit(""))))
    return channels.join(body, by, "left").select(by, F.concat(head, F.coalesce("body", F.lit("")), F.lit("</channel></rss>")).alias("document"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def atom(channels: DataFrame, items: DataFrame, by: str = "feed_id") -> DataFrame:
    """Atom; an identifier that is no address becomes the link with it as a fragment."""
    ident = F.when(F.col("guid").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("guid")).otherwise(F.concat("url", F.lit("#"), F.url_encode("guid")))
    line = F.concat(F.lit("<entry>"), _tag("title", F.coalesce("title", F.lit("Untitled"))), _tag("id", ident), F.lit('<link href="'), escape_xml(F.col("url")), F.lit('"/>'), _tag("updated", F.coalesce(iso(F.col("published_at")), F.lit("1970-01-01T00:00:00.000Z"))), _tag("summary", F.col("summary")), F.lit("</entry>"))
    body = _joined(items, by, "pos", line, "body")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom">'), _tag("title", F.col("title")), _tag("id", F.col("link")), F.lit('<link href="'), escape_xml(F.col("link")), F.lit('"/>'))
    return channels.join(body, by, "left").select(by, F.concat(head, F.coalesce("body", F.lit("")), F.lit("</feed>")).alias("document"))


def json_feed(channels: DataFrame, items: DataFrame, by: str = "feed_id") -> DataFrame:
    """JSON Feed 1.1."""
    item = F.struct(F.col("pos"), F.struct(F.col("guid").alias("id"), F.col("url"), F.col("title"), F.col("summary").alias("content_text"), iso(F.col("published_at")).alias("date_published")).alias("i"))
    body = items.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("l")).select(by, F.transform("l", lambda x: x["i"]).alias("items"))
    doc = F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.col("title"), F.col("link").alias("home_page_url"), F.col("description"), F.col("items")))
    return channels.join(body, by, "left").select(by, doc.alias("document"))


def _md(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>()#+!|-])", r"\\$1")


def markdown(channels: DataFrame, items: DataFrame, by: str = "feed_id") -> DataFrame:
    line = F.concat(F.lit("\n- ["), _md(F.coalesce("title", F.lit("Untitled"))), F.lit("]("), F.replace(F.col("url"), F.lit(")"), F.lit("%29")), F.lit(")"), F.coalesce(F.concat(F.lit(" – "), F.date_format("published_at", "yyyy-MM-dd")), F.lit("")))
    body = _joined(items, by, "pos", line, "body")
    return channels.join(body, by, "left").select(by, F.concat(F.lit("# "), _md(F.col("title")), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("document"))


def m3u(channels: DataFrame, items: DataFrame, by: str = "feed_id") -> DataFrame:
    """What can be played, with -1 where the length is unknown."""
    line = F.concat(F.lit("#EXTINF:"), F.coalesce(F.col("audio_seconds").cast("string"), F.lit("-1")), F.lit(","), F.regexp_replace("title", r"[\r\n]+", " "), F.lit("\n"), F.col("audio_url"), F.lit("\n"))
    body = _joined(items.where(playable(F.col("audio_url"), F.col("audio_type"))), by, "pos", line, "body")
    return channels.join(body, by, "left").select(by, F.concat(F.lit("#EXTM3U\n#PLAYLIST:"), F.regexp_replace("title", r"[\r\n]+", " "), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("document"))


def pls(channels: DataFrame, items: DataFrame, by: str = "feed_id") -> DataFrame:
    """What can be played, numbered from one."""
    own = items.where(playable(F.col("audio_url"), F.col("audio_type"))).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "audio_url", "title", F.coalesce("audio_seconds", F.lit(-1)).cast("long").alias("s")))).alias("l"))
    n = lambda i: (i + 1).cast("string")
    text = F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("File"), n(i), F.lit("="), x["audio_url"], F.lit("\nTitle"), n(i), F.lit("="), x["title"], F.lit("\nLength"), n(i), F.lit("="), x["s"].cast("string"), F.lit("\n"))), "")
    body = own.select(by, text.alias("body"), F.size("l").alias("n"))
    return channels.join(body, by, "left").select(by, F.concat(F.lit("[playlist]\n"), F.coalesce("body", F.lit("")), F.lit("NumberOfEntries="), F.coalesce("n", F.lit(0)).cast("string"), F.lit("\nVersion=2\n")).alias("document"))


WRITERS = {"rss": rss, "xml": rss, "atom": atom, "json": json_feed, "md": markdown, "m3u": m3u, "pls": pls}


def syndicate(fmt: str, channels: DataFrame, items: DataFrame, by: str = "feed_id") -> DataFrame:
    """One document per channel in any of FORMATS."""
    if fmt not in WRITERS:
        raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
    return WRITERS[fmt](channels, items, by)


def opml_outline(feeds: DataFrame) -> DataFrame:
    """A line per feed in order of title and id; lines go to a file as they are, so that no text holds all feeds."""
    line = F.concat(F.lit('<outline type="rss" text="'), escape_xml(F.col("title")), F.lit('" xmlUrl="'), escape_xml(F.col("feed_url")), F.lit('" htmlUrl="'), escape_xml(F.coalesce("site_url", F.lit(""))), F.lit('"/>'))
    return feeds.select("title", "id", line.alias("outline"))


def ad_positions(total: Column, every: int = AD_EVERY, most: int = AD_MAX) -> Column:
    """The places (from 0) of the posts that an ad follows: every tenth, three at most; at the last post it steps back by one, so that no list ends in an ad."""
    tenth = F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: i * every - 1), lambda p: p < total)
    return F.array_distinct(F.filter(F.transform(tenth, lambda p: F.when(p + 1 < total, p).otherwise(p - 1)), lambda p: p >= 0))


def sitemap_chunks(feeds: DataFrame, size: int = SITEMAP_PART) -> DataFrame:
    """Months with how many feeds and when the last changed, in parts of bounded size."""
    df = feeds.where("status <> 'dead'").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest"))
    return df.select("month", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / size).cast("int"))).alias("part"), "n", "latest")


def export_page(feeds: DataFrame, after: tuple[str, int] | None = None, limit: int = 2000, kind: str | None = None) -> DataFrame:
    """A page by (title, id) after the last row of the one before."""
    df = feeds.where("status <> 'dead'")
    if kind:
        df = df.where(F.col("category") == kind)
    if after:
        df = df.where((F.col("title") > after[0]) | ((F.col("title") == after[0]) & (F.col("id") > after[1])))
    return df.orderBy("title", "id").limit(limit)


def export_rows(feeds: DataFrame) -> DataFrame:
    """All feeds of an export in the order of its pages, sorted in ranges; to be written as it is and not in pages."""
    return feeds.where("status <> 'dead'").orderBy("title", "id")
