"""Queries over texts: keywords, stories, scores, search, schedules, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.functions import porter
from skein.operators import index
from skein.plans.reads import _now, add
from skein.sources.model import AS_OF
from skein.streaming import cadence as C
from skein.streaming.delivery import shared_folder


def quoted(words):
    return ", ".join(f"'{w}'" for w in words)


TOKENS = ("list_filter(list_transform(string_split(regexp_replace(replace(regexp_replace(lower({0}), '[''’]', '', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}+#-]+', ' ', 'g'), ' '), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), "
          "lambda w: length(w) >= 2 and w not in (" + quoted(T.STOPWORDS) + ") and not regexp_matches(w, '^\\d+$'))")
TITLE = "list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '' and w not in (" + quoted(T.TITLE_STOPWORDS) + "))"
KEY = "case when len(" + TITLE + ") >= 4 then substr(sha1(array_to_string(list_sort(" + TITLE + "), ' ')), 1, 16) end"


def sing(w):
    return f"case when length({w}) < 4 or {w} in ({quoted(T.NEVER_PLURAL)}) then {w} when length({w}) > 4 and {w} like '%ies' then regexp_replace({w}, 'ies$', 'y') when length({w}) > 4 and regexp_matches({w}, '(ss|sh|ch|x|z|o)es$') then regexp_replace({w}, 'es$', '') when regexp_matches({w}, 's$') and not regexp_matches({w}, '(ss|us|is|os)$') then regexp_replace({w}, 's$', '') else {w} end"


SLUG = "array_to_string(list_transform(string_split(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower({0}), '+', ' plus '), '#', ' sharp '), '[''’]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), '-'), lambda w: " + sing("w").replace("{", "{{").replace("}", "}}") + "), '-')"
add("txt02_tokenize", f"select doc_id, {TOKENS.format('title')} as tokens from texts", lambda m: m.texts.select("doc_id", T.tokenize(F.col("title")).alias("tokens")))
add("txt03_singularize", f"with w as (select distinct unnest({TOKENS.format('title')}) as word from texts) select word, {sing('word')} as singular from w", lambda m: m.texts.select(F.explode(T.tokenize(F.col("title"))).alias("word")).distinct().select("word", T.singularize(F.col("word")).alias("singular")))
add("txt04_topic_slug", f"select doc_id, {SLUG.format('title')} as slug from texts", lambda m: m.texts.select("doc_id", T.topic_slug(F.col("title")).alias("slug")))
GRAM = "list_distinct(list_transform(range(1, greatest(len(words) - {n} + 2, 1)), lambda i: array_to_string(words[i:i + {n} - 1], ' ')))"
KW = f"""b as (select distinct source, summary as text from texts where length(trim(summary)) >= 8), t as (select source, {TOKENS.format('text')} as words from b),
    g as (select source, unnest(list_concat({GRAM.format(n=1)}, {GRAM.format(n=2)}, {GRAM.format(n=3)})) as keyword from t),
    c as (select source, keyword, count(*) as count, len(string_split(keyword, ' ')) as words from g group by 1, 2 having len(list_filter(string_split(keyword, ' '), lambda w: w not in ({quoted(T.FURNITURE)}))) > 0),
    e as (select *, case when words = 1 then count >= 3 else count >= 2 end as enough from c), s as (select *, bool_or(enough) over (partition by source) as anyone from e),
    kw as (select source, keyword, words::int as words, count, row_number() over (partition by source order by count desc, words desc, keyword)::int as rank from s where enough or not anyone)"""
add("txt05_extract_keywords", f"with {KW} select * from kw where rank <= 250", lambda m: T.extract_keywords(m.texts.select("source", F.col("summary").alias("text")), "source"))
add("txt06_feed_topics", f"""with {KW}, p as (select source, lang as keyword, 1 as words, count(*) as count, 'category' as src from texts group by 1, 2 union all select source, keyword, words, count, 'content' from kw where rank <= 250),
    x as (select *, {SLUG.format('keyword')} as slug from p), o as (select *, row_number() over (partition by source, slug order by case when src = 'category' then 0 else 1 end, count desc, words desc, keyword) as n from x where slug <> ''),
    r as (select *, row_number() over (partition by source order by case when src = 'category' then 0 else 1 end, count desc, words desc, keyword) as k from o where n = 1) select source, slug, keyword, count from r where k <= 25""",
    lambda m: T.feed_topics(T.extract_keywords(m.texts.select("source", F.col("summary").alias("text")), "source").withColumnRenamed("source", "feed_id"),
                            m.texts.groupBy(F.col("source").alias("feed_id"), F.col("lang").alias("keyword")).agg(F.count(F.lit(1)).alias("count"))).select(F.col("feed_id").alias("source"), "slug", "keyword", "count"))
add("txt09_title_words", f"select doc_id, {TITLE.format('title')} as words from texts", lambda m: m.texts.select("doc_id", T.title_words(F.col("title")).alias("words")))
add("txt10_cluster_key", f"select doc_id, {KEY.format('title')} as cluster_key from texts", lambda m: m.texts.select("doc_id", T.cluster_key(F.col("title")).alias("cluster_key")))
add("txt11_backfill_cluster_keys", f"select id, coalesce({KEY.format('title')}, '') as cluster_key from items where cluster_key = ''", lambda m: m.items.where("cluster_key = ''").select("id", F.coalesce(T.cluster_key(F.col("title")), F.lit("")).alias("cluster_key")))
STEM = "case when length(w) > 4 and w like '%ies' then regexp_replace(w, 'ies$', '') when length(w) > 4 and w like '%es' then regexp_replace(w, 'es$', '') when length(w) > 3 and w like '%s' then regexp_replace(w, 's$', '') else w end"
STEMS = "list_distinct(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 and w not in (" + quoted(T.RELEVANCE_STOPWORDS) + f")), lambda w: {STEM}))"
add("txt13_keyword_stems", f"select doc_id, list_sort({STEMS.format('title')}) as stems from texts", lambda m: m.texts.select("doc_id", F.array_sort(T.keyword_stems(F.col("title"))).alias("stems")))
HTML = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\\s\\x{a0}]+', ' ', 'g'))"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _names, _char in T.NAMED:
    _PLAIN = f"regexp_replace({_PLAIN}, '(?i)&({_names});', '{_char.replace(chr(39), chr(39) * 2)}', 'g')"
#: Numbered characters, decimal as these pages have them.
_PLAIN = f"regexp_replace(list_reduce(list_concat([string_split({_PLAIN}, '&#')[1]], list_transform(string_split({_PLAIN}, '&#')[2:], lambda p: case when regexp_matches(p, '^\\d+;') then chr(regexp_extract(p, '^(\\d+);', 1)::int) || regexp_replace(p, '^\\d+;', '') else '&#' || p end)), lambda a, b: a || b), '(?i)&[a-z][a-z0-9]{{1,10}};', ' ', 'g')"
add("txt20_summarize", f"""with t as (select page_id, trim(regexp_replace({_PLAIN}, '[\\s\\x{{a0}}]+', ' ', 'g')) as t from pages) select page_id, case when length(t) <= 400 then t else
    trim(case when contains(substr(t, 2, 400), ' ') then regexp_replace(substr(t, 1, 401), '(?s) [^ ]*$', '') else substr(t, 1, 400) end) || '…' end as summary from t""", lambda m: m.base("pages").select("page_id", T.summarize(F.col("html")).alias("summary")))
add("txt22_text_length", f"select page_id, length({HTML}) as chars from pages", lambda m: m.base("pages").select("page_id", T.text_length(F.col("html")).cast("long").alias("chars")))
add("txt25_items_per_day", "with i as (select feed_id, count(*) as n, min(published_at) as a, max(published_at) as b from items where published_at is not null group by 1) select feed_id, round((n - 1) / ((epoch(b) - epoch(a)) / 86400), 6) as per_day from i where n >= 3 and epoch(timestamp '2001-05-01') - epoch(b) <= 7 * 86400 and b > a", lambda m: T.items_per_day(m.items, F.expr("timestamp '2001-05-01'")))
add("txt48_identity_url", "select page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?]+)', 1)), ':\\d+$', '') || regexp_replace(regexp_extract(url, '^https?://[^/?]+([^?#]*)', 1), '/+$', '') || case when q <> '' then '?' || q else '' end as identity from (select *, array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '(?i)^(utm_[a-z]+|ref|fbclid|gclid)=')), '&') as q from pages)", lambda m: m.base("pages").select("page_id", T.identity_url(F.col("url")).alias("identity")))
add("txt63_normalize_lang", "select id, nullif(regexp_extract(lower(trim(language)), '^([a-z]{2})(?:[-_].*)?$', 1), '') as lang from feeds", lambda m: m.feeds.select("id", S.normalize_lang(F.col("language")).alias("lang")))
#: Stems of the texts' words with their places, and the texts' lengths.
_TOKENS = "list_filter(string_split(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"
POST = f"""ws as (select doc_id as id, 0 as col, {_TOKENS.format('title')} as ws from texts union all select doc_id, 1, {_TOKENS.format('summary')} from texts),
    raw as (select id, col, unnest(ws) as term, generate_subscripts(ws, 1) as pos from ws), {porter.sql('raw')},
    w as (select id, col, pos, coalesce(stem, term) as term from raw left join stems using (term)), p as (select term, id, count(*) as tf from w group by 1, 2), l as (select id, count(*) as len from w group by 1),
    c as (select (select count(*) from texts) as n, (select sum(len) from l) * 1.0 / (select count(*) from texts) as mean)"""
BM = "df as (select term, count(*) as df from {q} where term in ('the', 'of') group by 1), s as (select q.id, round(-sum(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) as rank, count(*) as k from {q} q join df using (term) join l using (id), c group by 1)"
#: Buckets of the index of these small tables.
TERM_BUCKETS = 16
_INDEXES: dict[tuple[str, str], str] = {}


def text_index(m) -> str:
    """The stored index of the texts, written once a session in two segments."""
    key = (m.spark.sparkContext.applicationId, m.sf_dir)
    if key not in _INDEXES:
        path = shared_folder(m.spark, "index")
        for part in ("lang = 'en'", "lang is null or lang <> 'en'"):
            index.add(m.texts.where(part), path, "doc_id", "title", "summary", buckets=TERM_BUCKETS, files=1)
        _INDEXES[key] = path
    return _INDEXES[key]


add("join04_search_items", f"with {POST}, {BM.format(q='p')} select id, rank from s where k = 2 order by rank, id limit 40", lambda m: index.search(m.spark, text_index(m), "THEING of", buckets=TERM_BUCKETS))
add("join05_search_any", f"with {POST}, {BM.format(q='p')} select id, rank from s order by rank, id limit 20", lambda m: index.search(m.spark, text_index(m), "the of", mode="any", limit=20, buckets=TERM_BUCKETS))
add("agg08_search_kind_counts", f"with {POST} select t.lang as kind, count(*) as posts, count(distinct t.source) as feeds from texts t where doc_id in (select id from p where term = 'the') and doc_id in (select id from p where term = 'of') group by 1",
    lambda m: index.kind_counts(m.spark, text_index(m), "the of", m.texts.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("feed_id")), buckets=TERM_BUCKETS))
add("join04_search_postings", f"with {POST}, q as (select 'the' as term, a.id, count(*) as tf from w a join w b on b.id = a.id and b.col = a.col and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the' group by a.id), {BM.format(q='q')} select id, rank from s order by rank, id limit 40",
    lambda m: index.search(m.spark, text_index(m), "of-the", buckets=TERM_BUCKETS))
add("cad01_intervals_from_dates", f"""with t as (select distinct feed_id, published_at as at_ from items where published_at <= {AS_OF} + DAYS(1)), g as (select *, (epoch(at_) - epoch(lag(at_) over (partition by feed_id order by at_))) / 60 as gap from t),
    m as (select feed_id, median(gap) as gap, greatest((epoch({AS_OF}) - epoch(max(at_))) / 60, 0) as silence from g group by 1) select feed_id, gap, silence, least(greatest(round(case when silence <= 3 * gap then gap / 2 else silence / 4 end), 60), 129600)::bigint as minutes from m where gap is not null""", lambda m: C.intervals_from_dates(m.items, _now()))
add("str13_settle", f"""with o as (select id, case id % 4 when 0 then 'crawled' when 1 then 'failed' when 2 then 'throttled' else 'unchanged' end as outcome from feeds),
    x as (select f.id, f.status, f.error_count, f.interval_minutes, o.outcome, case when outcome = 'failed' then error_count + 1 when outcome = 'throttled' then error_count else 0 end as e from feeds f join o using (id))
    select id, case when outcome = 'failed' and e >= 10 then 'dead' when outcome = 'failed' then 'error' when outcome = 'throttled' then status else 'active' end as status, e as error_count,
    case when outcome = 'failed' then [60, 180, 360, 720, 1440][least(greatest(e, 1), 5)] when outcome = 'throttled' then 2 when id % 3 > 0 then 60 else least(greatest(2 * interval_minutes, 60), 1440) end::bigint as wait from x""",
    lambda m: C.settle(m.feeds, m.feeds.select("id", F.expr("case id % 4 when 0 then 'crawled' when 1 then 'failed' when 2 then 'throttled' else 'unchanged' end").alias("outcome"), F.lit(None).cast("long").alias("minutes"), (F.col("id") % 3).alias("new_items"), F.lit(90).alias("retry_after")), _now()).drop("next_fetch_at"))
POSTED = "select feed_id, case when id % 9 <> 0 then guid end as guid, case when id % 9 <> 0 then audio_url end as url, case when id % 9 <> 0 then title end as title from items"
add("cad02_content_signature", f"with o as (select id as feed_id from feeds), s as (select feed_id, array_to_string(list_sort(list_distinct(list(sha1(coalesce(guid, '') || chr(1) || coalesce(url, '') || chr(1) || coalesce(title, ''))))), ',') as k from ({POSTED}) where coalesce(guid, url, title) is not null group by 1) select o.feed_id, sha1(coalesce(k, '')) as signature from o left join s using (feed_id)",
    lambda m: C.content_signature(m.feeds.select(F.col("id").alias("feed_id")), m.items.select("feed_id", *[F.when(F.col("id") % 9 != 0, F.col(a)).alias(b) for a, b in (("guid", "guid"), ("audio_url", "url"), ("title", "title"))])))

HOURS = "epoch(timestamp '2001-01-01')"
SCALARS = [
    ("sca01_normalize_kind", "feeds", "id, case when lower(trim(category)) in ('blog','news','podcast','music','video','comic','live','reel') then lower(trim(category)) end as v", lambda: S.normalize_kind(F.col("category"))),
    ("sca12_apex_of", "feeds", "id, regexp_extract(regexp_extract(site_url, '^https?://([^/]+)', 1), '([^.]+\\.[^.]+)$', 1) as v", lambda: S.apex_of(S.host_of(F.col("site_url")))),
    ("sca17_backoff_minutes", "feeds", "id, [60,180,360,720,1440][least(greatest(error_count, 1), 5)] as v", lambda: S.backoff_minutes(F.col("error_count"))),
    ("sca21_billing_period", "feeds", "id, cast(case when day(created_at) >= 13 then make_date(year(created_at), month(created_at), 13) else make_date(year(created_at), month(created_at), 13) - interval 1 month end as date) as v", lambda: S.billing_period_start(F.col("created_at"))),
    ("sca24_item_key", "items", "id, case when cluster_key <> '' then 'c:' || cluster_key else 'g:' || feed_id::varchar || chr(10) || guid end as v", lambda: S.item_key(F.col("cluster_key"), F.col("feed_id").cast("string"), F.col("guid"))),
    ("sca45_monogram_hue", "feeds", "id, list_reduce(list_prepend(0::bigint, list_transform(string_split(slug, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) % 360) as v", lambda: S.hash31(F.col("slug"), 360)),
    ("sca65_rfc822", "feeds", "id, strftime(created_at, '%a, %d %b %Y %H:%M:%S') || ' GMT' as v", lambda: S.rfc822(F.col("created_at"))),
    ("sca67_esc", "texts", "doc_id as id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as v", lambda: S.escape_xml(F.col("title"))),
]
for _n, _r, _sql, _f in SCALARS:
    add(_n, f"select {_sql}" + ("" if " from " in _sql else f" from {_r}"), lambda m, r=_r, f=_f: getattr(m, r).select(F.expr("item_id" if r == "extracts" else "doc_id" if r == "texts" else "id").alias("id"), f().alias("v")))
