"""Text analytics as Column expressions and DataFrame plans: tokens, keywords, stories, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.forms import bound, compatible, folded

#: Grammar words, never a topic.
STOPWORDS = (
    "a an and are as at be been being but by can could did do does doing done for from had has have having he her here hers herself him himself his how i if in into is it its itself just "
    "may me might more most my myself no nor not of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then "
    "there these they this those through to too under until up us very was we were what when where which while who whom why will with would you your yours yourself yourselves all any each few many much another every either "
    "ive im id ill dont cant wont didnt doesnt isnt arent wasnt werent hasnt havent hadnt wouldnt couldnt shouldnt thats theres theyre theyve youre youve youll weve wed lets "
    "after before during since without within upon about above below between against again further both because per via"
).split()
#: Words that a phrase may hold but that are no topic alone.
FURNITURE = (
    "page website site click open close menu search login log sign subscribe view read learn see show next previous back home share follow loading new now today free best top get use using used "
    "like just really thing things lot way ways going want need know think say says said make makes made still even also well around actually probably maybe something someone anything everything nothing"
).split()
#: Words of story titles that tell nothing.
TITLE_STOPWORDS = "a an the and or but of to in on at for with from by is are was were be as it its this that how why what".split()
#: Words of a keyword that carry no topic.
RELEVANCE_STOPWORDS = "a an and are as at be best blog blogs by for from how in is of on or the to top with".split()
#: Words in s that are no plurals.
NEVER_PLURAL = (
    "news physics mathematics economics politics ethics linguistics series species analysis basis crisis thesis chaos lens bus gas plus virus status focus bonus campus census "
    "css js aws ios macos linux unix sass redis kubernetes"
).split()
GENERIC_WORDS = 4
MIN_BLOCK, MIN_WORD, MIN_PHRASE, MOST_KEYWORDS, MOST_TOPICS = 8, 3, 2, 250, 25


def tokenize(text: Column) -> Column:
    """Words in lower case: letters, digits, + # and inner hyphens; no stop words, no bare numbers, two characters at least."""
    t = F.regexp_replace(F.lower(compatible(text)), "['’]", "")
    t = F.regexp_replace(F.regexp_replace(t, "&", " and "), r"[^\p{L}\p{N}+#-]+", " ")
    words = F.transform(F.split(t, " "), lambda w: F.regexp_replace(w, r"^-+|-+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS) & ~w.rlike(r"^\p{N}+$"))


def singularize(word: Column) -> Column:
    """English plurals to singulars by their ending; short words and the exceptions stay."""
    n = F.length(word)
    return (F.when((n < 4) | word.isin(NEVER_PLURAL), word).when((n > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when((n > 4) & word.rlike("(ss|sh|ch|x|z|o)es$"), F.regexp_replace(word, "es$", ""))
            .when(word.rlike("s$") & ~word.rlike("(ss|us|is|os)$"), F.regexp_replace(word, "s$", "")).otherwise(word))


def topic_slug(keyword: Column) -> Column:
    """A keyword as an address: plus and sharp spelt out, hyphens between words, each in the singular, 60 characters at most."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(keyword), r"\+", " plus "), "#", " sharp "), "['’]", "")
    t = F.substring(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.array_join(F.transform(F.split(F.regexp_replace(t, "-+$", ""), "-"), singularize), "-")


def search_slug(query: Column) -> Column:
    """What a search for topics looks up: the query as a slug, or as it is where that leaves nothing."""
    t = F.trim(F.lower(F.coalesce(query, F.lit(""))))
    return F.when(t == "", "").otherwise(F.coalesce(F.nullif(topic_slug(t), F.lit("")), t))


def slugify(text: Column, most: int = 80) -> Column:
    """An address of letters and digits of any script; accents and apostrophes are dropped."""
    t = F.regexp_replace(F.lower(folded(text)), "['’]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(t, 1, most), "-+$", "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, each once."""
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def extract_keywords(blocks: DataFrame, by: str = "feed_id", text: str = "text", min_word: int = MIN_WORD, min_phrase: int = MIN_PHRASE, most: int = MOST_KEYWORDS) -> DataFrame:
    """(by, keyword, words, count): words and phrases by the number of different blocks that have them.

    Blocks are compared with their white space folded, and those of fewer than eight characters are
    left out. Where nothing is frequent enough everything counts. Partial counts are made before the
    shuffle, and the rank is per owner; equal counts go by words, then by the keyword's code points.
    """
    b = blocks.select(by, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text")).where(F.length("text") >= MIN_BLOCK).distinct()
    tokens = b.select(by, tokenize(F.col("text")).alias("words"))
    grams = tokens.select(by, F.explode(F.concat(ngrams(F.col("words"), 1), ngrams(F.col("words"), 2), ngrams(F.col("words"), 3))).alias("keyword"))
    counted = grams.groupBy(by, "keyword").agg(F.count(F.lit(1)).alias("count")).withColumn("words", F.size(F.split("keyword", " ")))
    counted = counted.where(F.exists(F.split("keyword", " "), lambda w: ~w.isin(FURNITURE)))
    enough = F.when(F.col("words") == 1, F.col("count") >= min_word).otherwise(F.col("count") >= min_phrase)
    counted = counted.withColumn("enough", enough)
    any_ = counted.groupBy(by).agg(F.bool_or("enough").alias("some"))
    kept = counted.join(any_, by).where(F.col("enough") | ~F.col("some"))
    w = Window.partitionBy(by).orderBy(F.col("count").desc(), F.col("words").desc(), "keyword")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(by, "keyword", "words", "count", "rank")


def feed_topics(content: DataFrame, categories: DataFrame, by: str = "feed_id", most: int = MOST_TOPICS) -> DataFrame:
    """Topics of each feed: publisher's categories win over content with the same slug, then come first."""
    parts = categories.select(by, "keyword", F.size(F.split("keyword", " ")).alias("words"), "count", F.lit("category").alias("source")).unionByName(content.select(by, "keyword", "words", "count", F.lit("content").alias("source")))
    parts = parts.withColumn("slug", topic_slug(F.col("keyword"))).where("slug <> ''")
    order = [F.when(F.col("source") == "category", 0).otherwise(1), F.col("count").desc(), F.col("words").desc(), F.col("keyword")]
    once = parts.withColumn("_n", F.row_number().over(Window.partitionBy(by, "slug").orderBy(*order))).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def title_words(title: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(TITLE_STOPWORDS))


def cluster_key(title: Column) -> Column:
    """A story's fingerprint; null for titles of fewer than four words that count."""
    return F.when(F.size(title_words(title)) >= GENERIC_WORDS, F.substring(F.sha1(F.array_join(F.array_sort(title_words(title)), " ").cast("binary")), 1, 16))


def stem(word: Column) -> Column:
    """A word without its plural's ending, for comparing and not for reading."""
    n = F.length(word)
    return F.when((n > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "")).when((n > 4) & word.endswith("es"), F.regexp_replace(word, "es$", "")).when((n > 3) & word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)


def keyword_stems(keyword: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(keyword), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(RELEVANCE_STOPWORDS))
    return F.array_distinct(F.transform(words, stem))


def feed_text(owners: DataFrame, items: DataFrame, by: str, order: list[str], most: int = 30) -> DataFrame:
    """(by, text): title and description of each owner and the titles and summaries of its first ``most`` posts, in lower case."""
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most)
    part = F.struct("_n", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).alias("text"))
    posts = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), " ").alias("posts"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), "posts")
    return owners.join(posts, by, "left").select(by, F.lower(text).alias("text"))


def relevance(keyword: Column, text: Column) -> Column:
    """Whether at least half of a keyword's stems are in a text."""
    return assess_relevance(keyword, text)[0]


def assess_relevance(keyword: Column, text: Column) -> tuple[Column, Column, Column]:
    """(relevant, matched, required): the keyword's stems that a text has, of which half, rounded up, must be there."""
    stems = keyword_stems(keyword)
    matched = F.filter(stems, lambda s: F.contains(F.lower(text), s))
    required = F.ceil(F.size(stems) / 2).cast("int")
    return F.size(matched) >= required, matched, required


def strip_html(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


def text_length(html: Column) -> Column:
    return F.length(strip_html(F.coalesce(html, F.lit(""))))


#: Named characters as they are written out, one after the other.
NAMED = [("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("rsquo|lsquo|apos|#39", "'"), ("rdquo|ldquo|bdquo", '"'), ("mdash|ndash|minus", "-"), ("hellip", "…")]


def plain_text(html: Column) -> Column:
    """Text without scripts, styles and tags, characters written out, unknown ones left out, white space folded."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for names, char in NAMED:
        t = F.regexp_replace(t, f"(?i)&(?:{names});", char)

    def numbered(piece: Column, digits: str, base: int) -> Column:
        code = F.regexp_extract(piece, digits, 1)
        value = F.conv(F.right(code, F.lit(9)), base, 10).cast("long")
        char = F.when(value.between(32, 0x10FFFF) & ~value.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")).otherwise(" ")
        return F.when(code != "", F.concat(char, F.regexp_replace(piece, digits, "")))

    pieces = F.split(t, "&#")
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.coalesce(numbered(p, "^[xX]([0-9A-Fa-f]+);", 16), numbered(p, "^([0-9]+);", 10), F.concat(F.lit("&#"), p)))
    t = F.array_join(F.concat(F.slice(pieces, 1, 1), rest), "")
    t = F.regexp_replace(t, "(?i)&[a-z][a-z0-9]{1,10};", " ")
    return F.trim(F.regexp_replace(t, r"[\s\x{a0}\x{feff}]+", " "))


def summarize(html: Column, most: int = 400) -> Column:
    """The plain text, cut at the last space up to ``most`` characters."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, most + 1)
        at = F.length(head) - F.locate(" ", F.reverse(head))
        return F.when(F.length(t) <= most, t).otherwise(F.concat(F.trim(F.when(F.contains(head, F.lit(" ")) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(F.substring(t, 1, most))), F.lit("…")))

    return bound(plain_text(html), cut)


def reasons_of(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for when, name in pairs]))


def _named(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t != "") & (t != "(untitled)")


#: Addresses of comment threads and of parts of a site.
COMMENT_FEED = r"(?i)/comments/?(?:feed)?/?$|[?&]feed=comments|/comments\.rss$"
PARTIAL_FEED = r"(?i)/(?:tag|tags|category|categories|label|search|author)/"


def assess_feed(feeds: DataFrame, items: DataFrame, now: Column, least: int = 2, most_days: int = 548, enough: int = 50) -> DataFrame:
    """(id, worthy, score, reasons): rejects for the kind of address, few, old or equal posts; else points for volume, age, title, description and links.

    items: feed_id, title, url, published_at. A rejected feed has score 0 and that one reason; others
    have all reasons that cost them points.
    """
    linked = F.count_if(F.trim(F.coalesce("url", F.lit(""))) != "")
    i = items.groupBy(F.col("feed_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("published_at").alias("newest"), F.count_distinct(F.lower(F.trim(F.coalesce("title", F.lit(""))))).alias("titles"), linked.alias("linked"))
    df = feeds.join(i, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("age", F.unix_timestamp(now) - F.unix_timestamp("newest"))
    address, day, n = F.coalesce("feed_url", F.lit("")), 86_400, F.col("n")
    verdict = (F.when(address.rlike(COMMENT_FEED), "comments-feed").when(address.rlike(PARTIAL_FEED), "partial-feed").when(n < least, "too-few-items")
               .when(F.col("age") > most_days * day, "abandoned").when((F.col("titles") == 1) & (n > 2), "duplicate-titles"))
    points = (
        F.when(n >= 10, 30).when(n >= 5, 20).otherwise(10)
        + F.when(F.col("age").isNull(), 10).when(F.col("age") <= 90 * day, 40).when(F.col("age") <= 365 * day, 25).otherwise(15)
        + F.when(_named(F.col("title")), 15).otherwise(0)
        + F.when(F.trim(F.coalesce("description", F.lit(""))) != "", 10).otherwise(0)
        + F.when(F.col("linked") == 0, -20).otherwise(5))
    df = df.withColumn("verdict", verdict).withColumn("points", F.least(F.greatest(points, F.lit(0)), F.lit(100)))
    found = reasons_of((F.col("age").isNull(), "undated"), (~_named(F.col("title")), "untitled"), (F.col("linked") == 0, "unlinked-items"))
    return _judged(df, found, enough, "worthy")


def _judged(df: DataFrame, found: Column, enough: int, name: str) -> DataFrame:
    """The verdict alone where there is one, else points and reasons; a low score without a reason says so."""
    low = F.col("points") < enough
    reasons = F.when(F.col("verdict").isNotNull(), F.array("verdict")).when(low & (F.size(found) == 0), F.array(F.lit("low-score"))).otherwise(found)
    score = F.when(F.col("verdict").isNull(), F.col("points")).otherwise(0)
    return df.select("id", (F.col("verdict").isNull() & ~low).alias(name), score.alias("score"), reasons.alias("reasons"))


def assess_series(feeds: DataFrame, items: DataFrame, least: int = 4, most_authors: int = 3, enough: int = 50) -> DataFrame:
    """(id, accepted, score, reasons) of collections: four posts, some linked, three authors at most.

    items: feed_id, url, author. Authors are told apart without regard to case.
    """
    author = F.lower(F.trim("author"))
    linked = F.count_if(F.trim(F.coalesce("url", F.lit(""))) != "")
    i = items.groupBy(F.col("feed_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), linked.alias("linked"), F.count_distinct(F.when(author != "", author)).alias("authors"))
    df = feeds.join(i, "id", "left").fillna(0, ["n", "linked", "authors"])
    n, authors = F.col("n"), F.col("authors")
    verdict = F.when(n < least, "too-short").when(F.col("linked") == 0, "unlinked-items").when(authors > most_authors, "mixtape")
    points = (
        F.when(n >= 12, 35).when(n >= 8, 28).otherwise(20)
        + F.when(authors == 1, 35).when(authors > 1, 15).otherwise(5)
        + F.when(_named(F.col("title")), 20).otherwise(0)
        + F.when(F.trim(F.coalesce("description", F.lit(""))) != "", 5).otherwise(0)
        + F.when(F.col("linked") < n, 0).otherwise(5))
    df = df.withColumn("verdict", verdict).withColumn("points", F.least(F.greatest(points, F.lit(0)), F.lit(100)))
    found = reasons_of((authors == 0, "unattributed"), (~_named(F.col("title")), "untitled"), (F.col("linked") < n, "some-unlinked-items"))
    return _judged(df, found, enough, "accepted")


def items_per_day(items: DataFrame, now: Column) -> DataFrame:
    """Posts a day by feed, of feeds with three dated posts and a new one within a week."""
    i = items.where("published_at is not null").groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    span = (F.unix_timestamp("b") - F.unix_timestamp("a")) / 86_400
    fresh = F.unix_timestamp(now) - F.unix_timestamp("b") <= 7 * 86_400
    return i.where((F.col("n") >= 3) & fresh & (span > 0)).select("feed_id", F.round((F.col("n") - 1) / span, 6).alias("per_day"))


def byline_count(items: DataFrame, author: str = "author") -> DataFrame:
    """Different names of two to five words in the bylines of each feed."""
    names = items.select("feed_id", F.explode(F.split(author, r"\s*(?:[,;&]|\band\b)\s*")).alias("name"))
    names = names.withColumn("name", F.lower(F.trim("name"))).where(F.size(F.split("name", r"\s+")).between(2, 5))
    return names.groupBy("feed_id").agg(F.count_distinct("name").alias("bylines"))


def clean_name(value: Column) -> Column:
    """A name without what introduces it, a separator at its end, or the address before it."""
    t = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\x{a0}]+", " "))
    t = F.regexp_replace(t, r"(?i)^(?:by|written by|posted by|author:?)\s+", "")
    t = F.regexp_replace(t, r"\s*[|·•—–-]\s*$", "")
    inner = F.regexp_extract(t, r"^\S+@\S+\s*\((.+)\)$", 1)
    return F.trim(F.when(inner != "", inner).otherwise(t))


#: Names that are roles, mailboxes that are shared, and the most characters of a name.
ROLE_NAMES = (
    "admin, administrator, author, contact, contributor, correspondent, editor, editors, editorial, editorial board, editorial staff, editorial team, guest, guest author, guest post, info, moderator, "
    "news desk, news staff, newsroom, noreply, no reply, staff, staff writer, staff writers, support, team, the editor, the editors, the team, unknown, anonymous, webmaster, wordpress, root, user, "
    "guest contributor, press office, press team, media team, marketing, marketing team, sales, sales team, hello, enquiries, inquiries"
).split(", ")
ROLE_MAILBOXES = (
    "admin administrator billing contact enquiries feedback help hello hi info information inquiries jobs legal mail marketing media news newsletter noreply no-reply office postmaster press privacy sales "
    "security social support team webmaster abuse careers partnerships subscribe unsubscribe"
).split()
NAME_CHARS = 60


def looks_like_person(name: Column) -> Column:
    """One to five words with a letter each, no role, no group, no address; a single one must not read as a login."""

    def judged(n: Column) -> Column:
        folded_ = normalize_name(n)
        words = F.split(n, r"\s+")
        role = folded_.isin(ROLE_NAMES) | F.regexp_replace(folded_, r"^(?:the|our|a)\s+", "").isin(ROLE_NAMES)
        address = (n.contains("@") & ~n.rlike(r"\s")) | n.rlike("(?i)^https?://")
        group = (F.size(words) > 1) & F.element_at(words, -1).rlike("(?i)^(?:team|staff|desk|board|crew|bot|editors|writers|contributors)$")
        camel = n.rlike(r"\p{Ll}\p{Lu}") & ~n.rlike(r"^(?:Mc|Mac|De|Di|Du|La|Le|Van|Von|O')\p{Lu}")
        login = (F.size(words) == 1) & (n.rlike(r"[\d_]") | (F.length(n) < 2) | ((n == F.lower(n)) & (F.length(n) > 3)) | camel)
        return F.length(n).between(1, NAME_CHARS) & ~role & ~address & (F.size(words) <= 5) & ~group & F.forall(words, lambda w: w.rlike(r"\p{L}")) & ~login

    return bound(clean_name(name), judged)


def split_bylines(value: Column) -> Column:
    """The people of a byline, each once without regard to case, as first spelt."""
    parts = F.transform(F.split(clean_name(value), r"(?i)\s*(?:,|;|&|/|\band\b|\bwith\b)\s*"), clean_name)
    people = F.filter(parts, looks_like_person)
    keys = F.transform(people, normalize_name)
    return F.filter(people, lambda p, i: F.array_position(keys, normalize_name(p)) == i + 1)


def is_role_email(email: Column) -> Column:
    """Whether an address is a shared mailbox, by its local part or the beginning of it, or none at all."""
    address = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(email, F.lit("")), "(?i)^mailto:", ""), r"(?s)\?.*$", "")))
    return bound(F.regexp_extract(address, r"^([^@\s]+)@[^@\s]+\.[^@\s]+$", 1), lambda local: (local == "") | local.isin(ROLE_MAILBOXES) | F.get(F.split(local, "[+._-]"), F.lit(0)).isin(ROLE_MAILBOXES))


def personal_email(text: Column) -> Column:
    """The first address of a text in lower case; null where there is none or it is a shared mailbox."""
    first = F.lower(F.regexp_extract(text, r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)", 1))
    return bound(first, lambda x: F.when(~is_role_email(x), x))


def identity_url(url: Column) -> Column:
    """https, the host in lower case, no user, fragment, tracking or slash at the end, but for the root's."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    part = lambda i: F.regexp_extract(u, r"(?i)^(https?)://(?:[^/@?]*@)?([^/?:]+)(?::(\d*))?([^?]*)(?:\?(.*))?$", i)
    host, port, path = F.lower(part(2)), part(3), F.when(part(4) == "", "/").otherwise(part(4))
    port = F.when((port == "") | (port == F.when(F.lower(part(1)) == "https", "443").otherwise("80")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    kept = F.array_join(F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(?:utm_|ref(=|$)|ref_|fbclid|gclid|mc_|source(=|$)|si(=|$))")), "&")
    full = F.concat(F.lit("https://"), host, port, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", F.when(path == "/", full).otherwise(F.regexp_replace(full, "/$", "")))


#: Networks as (name, the last two labels of their host, what may stand before them, the path of a profile). A name in the host is a handle itself.
_W = r"(?:www\.)?"
PROFILES = [
    ("github", "github.com", _W, r"([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))"),
    ("gitlab", "gitlab.com", _W, r"([A-Za-z0-9][\w.-]{1,254})"),
    ("codeberg", "codeberg.org", "", r"([A-Za-z0-9][\w.-]{0,38})"),
    ("sourcehut", "sr.ht", r"git\.", r"~([\w.-]{1,64})"),
    ("bluesky", "bsky.app", _W, r"profile/([\w.:-]+)"),
    ("twitter", "twitter.com", r"(?:www\.|mobile\.)?", r"(\w{1,15})"),
    ("twitter", "x.com", r"(?:www\.|mobile\.)?", r"(\w{1,15})"),
    ("linkedin", "linkedin.com", r"(?:[a-z]{2}\.)?(?:www\.)?", r"in/([\w%-]{1,120})"),
    ("youtube", "youtube.com", r"(?:www\.|m\.)?", r"(?:@|c/|user/|channel/(?=UC[\w-]{20,26}/?$))([\w.-]{1,120})"),
    ("instagram", "instagram.com", _W, r"([\w.]{1,30})"),
    ("tiktok", "tiktok.com", _W, r"@([\w.]{1,30})"),
    ("threads", "threads.net", _W, r"@([\w.]{1,30})"),
    ("threads", "threads.com", _W, r"@([\w.]{1,30})"),
    ("facebook", "facebook.com", r"(?:www\.|web\.|m\.)?", r"([\w.]{3,60})"),
    ("reddit", "reddit.com", r"(?:www\.|old\.|new\.)?", r"u(?:ser)?/([\w-]{1,30})"),
    ("medium", "medium.com", _W, r"@([\w.-]{1,60})"),
    ("devto", "dev.to", "", r"([\w-]{1,60})"),
    ("hashnode", "hashnode.com", "", r"@([\w-]{1,60})"),
    ("patreon", "patreon.com", _W, r"([\w-]{1,60})"),
    ("kofi", "ko-fi.com", _W, r"([\w-]{1,60})"),
    ("buymeacoffee", "buymeacoffee.com", _W, r"([\w-]{1,60})"),
    ("keybase", "keybase.io", "", r"([\w-]{1,60})"),
    ("telegram", "t.me", _W, r"(\w{5,32})"),
    ("matrix", "matrix.to", "", r"#/(@[^/]+)"),
    ("flickr", "flickr.com", _W, r"(?:people|photos)/([\w@.-]{1,64})"),
    ("goodreads", "goodreads.com", _W, r"(?:author/show|user/show)/([\w.-]{1,64})"),
    ("stackoverflow", "stackoverflow.com", _W, r"users/(\d+)(?:/[\w-]*)?"),
    ("twitch", "twitch.tv", _W, r"(\w{3,25})"),
    ("soundcloud", "soundcloud.com", _W, r"([\w-]{1,60})"),
    ("bandcamp", "bandcamp.com", r"([\w-]{1,60})\.", ""),
    ("substack", "substack.com", r"([\w-]{1,60})\.", ""),
    ("microblog", "micro.blog", _W, r"([\w.-]{1,60})"),
    ("tumblr", "tumblr.com", r"([\w-]{1,32})\.", ""),
    ("orcid", "orcid.org", _W, r"(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])"),
    ("nostr", "njump.me", "", r"(npub1\w{20,70})"),
    ("nostr", "primal.net", _W, r"p/(npub1\w{20,70})"),
    ("nostr", "snort.social", "", r"p/(npub1\w{20,70})"),
    ("nostr", "iris.to", "", r"(npub1\w{20,70})"),
]
#: Hosts of pages that only hold a person's links.
BIO_HOSTS = (
    "linktr.ee bio.link beacons.ai campsite.bio taplink.cc solo.to lnk.bio allmylinks.com hoo.be magic.ly many.link shor.by withkoji.com liinks.co links.page bento.me about.me linkin.bio msha.ke contactin.bio"
).split()


def _profile(at: Column, found: Column) -> Column:
    """(network, handle, url) of a web address with its host and path, by the row of its network, or as a page of links or a server of the fediverse."""
    host, path, url = at["host"], at["path"], at["url"]
    user = F.regexp_extract(path, r"^/(?:@|users/)([A-Za-z0-9_]{1,30})/?$", 1)
    row = lambda network, handle: F.struct(network.alias("network"), handle.alias("handle"), url.alias("url"))
    own = F.when(F.rlike(path, found["path"]), row(found["network"], F.call_function("regexp_extract", F.when(found["in_host"], host).otherwise(path), F.when(found["in_host"], found["host"]).otherwise(found["path"]), F.lit(1))))
    page = row(F.lit("linktree"), F.coalesce(F.nullif(F.regexp_extract(path, "^/?([^/]*)", 1), F.lit("")), host))
    return F.when(F.coalesce(F.rlike(host, found["host"]), F.lit(False)), own).when(host.isin(BIO_HOSTS), page).when(user != "", row(F.lit("fediverse"), F.concat(F.lit("@"), user, F.lit("@"), host)))


def classify_link(value: Column) -> Column:
    """(network, handle, url) of a profile; null where it is none.

    Networks are one table, looked up by the last two labels of the host; what its pattern of hosts
    fits must have the path of a profile. Other hosts may be pages of links or servers of the fediverse.
    """
    rows = []
    for name, end, before, own in PROFILES:
        host = f"^{before}{end.replace('.', chr(92) + '.')}$"
        rows += [F.lit(end), F.struct(F.lit(name).alias("network"), F.lit(host).alias("host"), F.lit(f"^/{own}/?$" if own else "^/?$").alias("path"), F.lit(not own).alias("in_host"))]

    def web(url: Column) -> Column:
        part = lambda i: F.regexp_extract(url, r"^https://([^/?:]+)(?::\d+)?([^?]*)", i)
        apex = lambda at: F.regexp_extract(at["host"], r"([^.]+\.[^.]+|[^.]+)$", 1)
        return bound(F.struct(part(1).alias("host"), part(2).alias("path"), url.alias("url")), lambda at: bound(F.try_element_at(F.create_map(*rows), apex(at)), lambda found: _profile(at, found)))

    def known(raw: Column) -> Column:
        key, jid = F.lower(F.regexp_extract(raw, r"(?i)^nostr:(npub1\w{20,70})$", 1)), F.lower(F.regexp_extract(raw, r"(?i)^xmpp:([^?\s]+@[^?\s]+)", 1))
        one = lambda network, handle, before: F.when(F.coalesce(handle, F.lit("")) != "", F.struct(F.lit(network).alias("network"), handle.alias("handle"), F.concat(F.lit(before), handle).alias("url")))
        mail = F.when(raw.rlike("(?i)^mailto:"), personal_email(raw))
        return F.when(raw.rlike("(?i)^https?:"), bound(identity_url(raw), web)).otherwise(F.coalesce(one("email", mail, "mailto:"), one("nostr", key, "https://njump.me/"), one("xmpp", jid, "xmpp:")))

    return bound(F.trim(F.coalesce(value, F.lit(""))), known)


def kind_of_channel(medium: Column, feed_url: Column, videos: Column, audios: Column, podcast_tags: Column, declared: Column, show_shaped: Column, newsroom: Column, sample: Column) -> Column:
    """The class of a feed: the medium it declares, a video site, enclosures that tags or the shape of a show bear out, podcast tags with audio, a newsroom, else a blog."""
    return (F.when(medium.isin("podcast", "music", "video"), medium).when(feed_url.rlike(r"youtube\.com/feeds"), "video").when((videos > 0) & (podcast_tags | show_shaped), "video")
            .when(podcast_tags & (declared | (sample == 0) | (audios > 0)), "podcast").when(newsroom, "news").otherwise("blog"))


def is_series_feed(url: Column) -> Column:
    """Whether an address is that of a playlist."""
    return url.rlike("[?&]playlist_id=")


def says_it_is_news(text: Column) -> Column:
    return text.rlike(r"(?i)\b(news|headlines|breaking news|newsroom|journalism|newspaper|current affairs)\b")


def is_newsroom(per_day: Column, bylines: Column, declared: Column, headlined: Column) -> Column:
    """A wire of articles, or two signs of a newsroom: the busier the feed the weaker the other may be."""
    return F.coalesce(((per_day >= 12) & headlined) | ((per_day >= 3) & ((bylines >= 2) | declared)) | ((bylines >= 8) & (per_day >= 0.5)) | (declared & (per_day >= 2)), F.lit(False))


def is_show_shaped(media: Column, brief: Column, sample: Column) -> Column:
    return (2 * media > sample) & (2 * brief > media)


def frame_ancestors(csp: Column) -> Column:
    """The sources of each policy that has the directive, in lower case; commas part policies."""
    def sources(policy: Column) -> Column:
        words = F.transform(F.split(policy, ";"), lambda d: F.split(F.lower(F.trim(d)), r"\s+"))
        return F.get(F.filter(words, lambda w: F.get(w, F.lit(0)) == "frame-ancestors"), F.lit(0))

    found = F.filter(F.transform(F.split(F.coalesce(csp, F.lit("")), ","), sources), lambda w: w.isNotNull())
    return F.transform(found, lambda w: F.slice(w, F.lit(2), F.size(w)))


def framing_verdict(csp: Column, xfo: Column, origin: str) -> tuple[Column, Column]:
    """(whether a page lets itself be framed by ``origin``, why): every policy with frame-ancestors must allow it; else X-Frame-Options, a list of which any refusal counts."""
    host = origin.split("://", 1)[-1]

    def allows(source: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(source, "^https?://", ""), "/+$", "")
        wild = bare.startswith("*.") & F.lit(host).endswith(F.substring(bare, F.lit(2), F.length(bare)))
        scheme = source.isin("https:", "http:")
        return ~source.isin("'none'", "'self'") & ((source == "*") | (scheme & F.lit(origin).startswith(source)) | (~scheme & ((bare == host) | wild)))

    policies = frame_ancestors(csp)
    allowed = F.forall(policies, lambda p: F.exists(p, allows))
    tokens = F.transform(F.split(F.lower(F.coalesce(xfo, F.lit(""))), ","), lambda t: F.trim(t))
    refusal = (F.when(F.array_contains(tokens, "deny"), "x-frame-options-deny").when(F.array_contains(tokens, "sameorigin"), "x-frame-options-sameorigin")
               .when(F.exists(tokens, lambda t: t.startswith("allow-from")), "x-frame-options-allow-from"))
    reason = (F.when((F.size(policies) > 0) & allowed, "csp-allows").when(F.size(policies) > 0, "csp-frame-ancestors").when(F.trim(F.coalesce(xfo, F.lit(""))) == "", "no-policy")
              .otherwise(F.coalesce(refusal, F.lit("unrecognised-policy"))))
    return reason.isin("csp-allows", "no-policy", "unrecognised-policy"), reason


def fts_query(query: Column, mode: str = "all") -> Column:
    """Quoted terms, all or any of them."""
    terms = F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " " if mode == "all" else " OR ")


def normalize_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def identity_key(url: Column, name: Column, feed_url: Column) -> Column:
    """Who a person is: their address, or else their name at the feed's host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(feed_url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return F.coalesce(identity_url(url), F.concat(normalize_name(F.coalesce(name, F.lit(""))), F.lit("@"), host))


def links_back(html: Column, url: Column) -> Column:
    """Whether a page links with rel=me to an address, compared by host and path."""
    found = F.concat(F.regexp_extract_all(html, F.lit(r'(?i)<(?:a|link)\b[^>]*?\brel="[^"]*\bme\b[^"]*"[^>]*?\bhref="([^"]+)"'), F.lit(1)), F.regexp_extract_all(html, F.lit(r'(?i)<(?:a|link)\b[^>]*?\bhref="([^"]+)"[^>]*?\brel="[^"]*\bme\b'), F.lit(1)))
    return F.exists(found, lambda f: identity_url(f).eqNullSafe(identity_url(url)))


def meta_content(html: Column, name: str) -> Column:
    """The content of a meta element by its property or name, in either order of attributes; null if there is none."""
    a = F.regexp_extract(html, rf'(?i)<meta\b[^>]*?\b(?:property|name)="{name}"[^>]*?\bcontent="([^"]*)"', 1)
    b = F.regexp_extract(html, rf'(?i)<meta\b[^>]*?\bcontent="([^"]*)"[^>]*?\b(?:property|name)="{name}"', 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def card_candidates(html: Column) -> Column:
    """Images that a page offers for its card."""
    return F.array_distinct(F.array_compact(F.array(meta_content(html, "og:image"), meta_content(html, "twitter:image"))))


def html_image(html: Column) -> Column:
    """The first image that is neither a dot nor a tracker."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    good = F.filter(tags, lambda t: ~t.rlike(r'(?i)\b(width|height)\s*=\s*"?[012]"?(\D|$)') & ~t.rlike(r"(?i)(pixel|beacon|tracking|feedburner|doubleclick)") & t.rlike(r'(?i)\bsrc="[^"]+"'))
    return F.nullif(F.regexp_extract(F.get(good, F.lit(0)), r'(?i)\bsrc="([^"]+)"', 1), F.lit(""))


def worth_searching(confidence: Column, name: Column, links: Column) -> Column:
    return (confidence >= 0.8) & (F.size(F.split(F.trim(name), r"\s+")) >= 2) & (F.coalesce(links, F.lit(0)) == 0)


def searches_for(authors: DataFrame, targets: list[str]) -> DataFrame:
    """A query for each author and network."""
    return authors.select("id", F.explode(F.array(*[F.lit(t) for t in targets])).alias("network"), "name").select("id", "network", F.concat(F.lit('"'), F.col("name"), F.lit('" '), F.col("network")).alias("query"))


def age_of_newest(items: DataFrame, now: Column) -> DataFrame:
    """Seconds since each feed's newest dated post."""
    return items.groupBy("feed_id").agg((F.unix_timestamp(now) - F.unix_timestamp(F.max("published_at"))).alias("age"))
