"""Who writes a feed: accounts told by addresses, credits told by channels and bylines, links of pages about a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import classify_link, clean_name, identity_url, looks_like_person, normalize_name, personal_email, split_bylines

#: Hosts and paths that name an account (network, host, path, profile's address).
ACCOUNTS = [
    ("github", r"^([a-z0-9][a-z0-9-]{0,38})\.github\.io$", None, "https://github.com/{}"),
    ("gitlab", r"^([a-z0-9][\w.-]{1,60})\.gitlab\.io$", None, "https://gitlab.com/{}"),
    ("codeberg", r"^([a-z0-9][\w-]{0,38})\.codeberg\.page$", None, "https://codeberg.org/{}"),
    ("sourcehut", r"^([\w.-]{1,64})\.srht\.site$", None, "https://git.sr.ht/~{}"),
    ("substack", r"^([\w-]{1,60})\.substack\.com$", None, "https://{}.substack.com"),
    ("medium", r"^([\w-]{1,60})\.medium\.com$", None, "https://medium.com/@{}"),
    ("tumblr", r"^([\w-]{1,32})\.tumblr\.com$", None, "https://{}.tumblr.com"),
    ("microblog", r"^([\w.-]{1,60})\.micro\.blog$", None, "https://micro.blog/{}"),
    ("bearblog", r"^([\w-]{1,60})\.bearblog\.dev$", None, "https://bearblog.dev/{}"),
    ("medium", r"^(?:www\.)?medium\.com$", r"^/@([\w.-]{1,60})(?:/|$)", "https://medium.com/@{}"),
    ("devto", r"^dev\.to$", r"^/([\w-]{1,60})(?:/|$)", "https://dev.to/{}"),
    ("hashnode", r"^hashnode\.com$", r"^/@([\w-]{1,60})(?:/|$)", "https://hashnode.com/@{}"),
    ("microblog", r"^(?:www\.)?micro\.blog$", r"^/([\w.-]{1,60})(?:/|$)", "https://micro.blog/{}"),
    ("substack", r"^(?:www\.)?substack\.com$", r"^/@([\w-]{1,60})(?:/|$)", "https://substack.com/@{}"),
]
#: Names that are no account's.
RESERVED_HANDLES = "www blog docs help api status about support mail admin pages app static assets cdn media news test demo example".split()
#: Folders and names of pictures that belong to a site and not to a post; pixels of the smallest figure.
CHROME_DIRS = r"(?i)/(?:static|assets|templates?|themes?|skins?|icons?|logos?|emoji|sprites?)/"
CHROME_NAMES = r"(?i)(?:^|[/_-])(?:logo|avatar|icon|badge|button|sprite|pixel|spacer|sidebar|banner)s?[._-]"
MIN_FIGURE = 200
BYLINES = 25


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/?#]+)", 1)), r":\d+$", "")


def host_identity(urls: Column) -> Column:
    """Accounts (network, url, handle) that an array of addresses names by host or path, each once."""

    def accounts(url: Column) -> Column:
        host, path = _host(url), F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
        found = []
        for network, of_host, of_path, profile in ACCOUNTS:
            handle = F.lower(F.regexp_extract(host if of_path is None else path, of_host if of_path is None else of_path, 1))
            ok = host.rlike(of_host) & (handle != "") & ~handle.isin(RESERVED_HANDLES)
            before, after = profile.split("{}")
            found.append(F.when(ok, F.struct(F.lit(network).alias("network"), F.concat(F.lit(before), handle, F.lit(after)).alias("url"), handle.alias("handle"))))
        return F.array_compact(F.array(*found))

    return F.array_distinct(F.flatten(F.transform(urls, accounts)))


def credit(name: Column, email: Column, url: Column) -> Column:
    """(name, email, url) of a person, null where the name is none; the address may stand in the name."""
    cleaned = clean_name(name)
    return F.when(looks_like_person(cleaned), F.struct(cleaned.alias("name"), personal_email(F.coalesce(email, name)).alias("email"), identity_url(url).alias("url")))


def feed_credits(channels: DataFrame, inputs: DataFrame, items: DataFrame) -> DataFrame:
    """(feed_id, name, email, url, role, source, confidence, pos) of everyone a feed credits, to be merged.

    channels: feed_id, title. inputs: what the channel says (feed_id, pos, name, email, url, role, source, confidence). items: feed_id,
    pos, title, author; the bylines of the first posts count, unless they repeat the post's or the
    feed's title.
    """
    said = inputs.withColumn("c", credit(F.col("name"), F.col("email"), F.col("url"))).where("c is not null").select("feed_id", "c.*", F.coalesce("role", F.lit("author")).alias("role"), "source", "confidence", "pos")
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy("feed_id").orderBy("pos"))).where(F.col("_n") <= BYLINES)
    first = first.join(channels.select("feed_id", normalize_name(F.col("title")).alias("_feed")), "feed_id")
    raw = normalize_name(F.col("author"))
    first = first.where((raw != "") & ~raw.eqNullSafe(normalize_name(F.col("title"))) & ~raw.eqNullSafe(F.col("_feed")))
    names = first.select("feed_id", F.explode(split_bylines(F.col("author"))).alias("name"), personal_email(F.col("author")).alias("email"), (F.lit(1000) + F.col("_n")).alias("pos"))
    return said.unionByName(names.select("feed_id", "name", "email", F.lit(None).cast("string").alias("url"), F.lit("author").alias("role"), F.lit("item-byline").alias("source"), F.lit(0.6).alias("confidence"), "pos"))


def feed_contacts(inputs: DataFrame) -> DataFrame:
    """(feed_id, url, network, source): ways to reach a feed whose name is no person's: a personal address, or a profile; each once, as the channel says it first."""
    nobody = inputs.where(credit(F.col("name"), F.col("email"), F.col("url")).isNull())
    mail = personal_email(F.coalesce("email", "name"))
    links = nobody.select("feed_id", "source", "pos", F.posexplode(F.array(F.concat(F.lit("mailto:"), mail), F.col("url"))).alias("k", "url")).where("url is not null")
    links = links.withColumn("network", classify_link(F.col("url"))["network"]).where("network is not null")
    return links.groupBy("feed_id", "url").agg(F.min_by(F.struct("network", "source"), F.struct("pos", "k")).alias("m")).select("feed_id", "url", "m.*")


def links_of_bio(html: Column) -> Column:
    """Profiles (network, url, handle) among the addresses of a page that lists a person's links, each once; the list's own host is none."""
    found = F.array_distinct(F.slice(F.regexp_extract_all(html, F.lit(r"(https?://[^\s\"'<>\\)]+)"), F.lit(1)), 1, 500))
    typed = F.transform(F.transform(found, lambda u: F.struct(u.alias("url"), classify_link(u).alias("as"))), lambda t: F.struct(t["as"]["network"].alias("network"), t["url"].alias("url"), t["as"]["handle"].alias("handle")))
    return F.filter(typed, lambda t: t["network"].isNotNull() & ~_host(t["url"]).isin("linktr.ee", "www.linktr.ee"))


def figures(html: Column, url: Column) -> Column:
    """Addresses of a post's own pictures: of its site, not small where sizes are given, and no part of the site's furniture."""
    site = lambda u: F.regexp_extract(_host(u), r"([^.]+\.[^.]+)$", 1)
    size = lambda tag, name: F.coalesce(F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*"?(\d+)', 1).try_cast("int"), F.lit(0))
    source = lambda tag: F.regexp_extract(tag, r'(?i)\bsrc\s*=\s*"([^"]+)"', 1)
    small = lambda n: (n > 0) & (n < MIN_FIGURE)
    path = lambda u: F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    good = F.filter(tags, lambda t: (source(t) != "") & (site(source(t)) == site(url)) & ~small(size(t, "width")) & ~small(size(t, "height")) & ~path(source(t)).rlike(CHROME_DIRS) & ~path(source(t)).rlike(CHROME_NAMES))
    return F.transform(good, source)
