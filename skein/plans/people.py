"""Queries about who writes a feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import identity as I
from skein.operators import windows as W
from skein.operators import writes
from skein.plans.columns import N, pick
from skein.plans.reads import add
from skein.plans.verdicts import derived

HOSTED = "select id, " + pick(f"'https://User' || {N} || '.github.io/blog'", f"'http://a-' || {N} || '.substack.com'", "'https://docs.gitlab.io/'", f"'https://medium.com/@w.' || {N} || '/post-1'", "feed_url", f"'https://dev.to/d' || {N}", f"'https://www.substack.com/@s' || {N}", "'https://www.medium.com/about'", f"'https://x' || {N} || '.bearblog.dev/?q'") + " as url from feeds"
add("txt51_host_identity", "select id, " + pick(f"'github https://github.com/user' || {N}", f"'substack https://a-' || {N} || '.substack.com'", "null", f"'medium https://medium.com/@w.' || {N}", "null", f"'devto https://dev.to/d' || {N}", f"'substack https://substack.com/@s' || {N}", "null", f"'bearblog https://bearblog.dev/x' || {N}") + " as v from feeds",
    lambda m: derived(m, HOSTED, feeds=m.feeds).select("id", I.host_identity(F.array("url", "url")).alias("a")).select("id", F.when(F.size("a") > 0, F.array_join(F.transform("a", lambda x: F.concat_ws(" ", x["network"], x["url"])), ",")).alias("v")))
add("txt51_handles", "select id, " + pick(f"'user' || {N}", f"'a-' || {N}", "null", f"'w.' || {N}", "null", f"'d' || {N}", f"'s' || {N}", "null", f"'x' || {N}") + " as v from feeds",
    lambda m: derived(m, HOSTED, feeds=m.feeds).select("id", F.get(I.host_identity(F.array("url")), F.lit(0))["handle"].alias("v")))

#: What channels say of people: editors with addresses in the name, owners, teams, roles, nobody.
INPUTS = "select id as feed_id, n as pos, case n when 0 then " + pick("'ann' || cast(id as string) || '@x.org (Ann Bee)'", "'News Team'", "null", "'By Cy Dee, '", "'editor@x.org (Editor)'") + " else " + pick("'Ann Bee'", "'ann'", "'The Staff'", "'Eve Fox'", "null", "'cy' || cast(id as string) || '@home.example'", "'Site'") + """ end as name,
    case when n = 1 and id % 4 = 0 then 'Eve' || cast(id as string) || '@mail.example' end as email, case when id % 3 = 0 then 'https://Social.example/@p' || cast(id as string) || '/' when id % 3 = 1 then 'https://www.host.example/' end as url,
    case n when 0 then 'managing-editor' else 'itunes-owner' end as source, case n when 0 then 'owner' end as role, case n when 0 then 0.8 else 0.75 end as confidence from feeds, (select 0 as n union all select 1) k"""
MAIL = "nullif(lower(regexp_extract({0}, '([A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+)', 1)), '')"
NAMED = f"n as (select *, case when name like '%(Ann Bee)' or name = 'Ann Bee' then 'Ann Bee' when name like '%Cy Dee%' then 'Cy Dee,' when name in ('Eve Fox', 'ann', 'Site') then name end as person, {MAIL.format('coalesce(email, name)')} as mail, case when url like '%Social%' then 'https://social.example/@p' || feed_id::varchar else 'https://www.host.example/' end as site from ({INPUTS}) i)"
add("txt41_credit", f"with {NAMED} select feed_id, pos, person as name, mail as email, case when url is not null then site end as url from n where person is not null",
    lambda m: derived(m, INPUTS, feeds=m.feeds).select("feed_id", "pos", I.credit(F.col("name"), F.col("email"), F.col("url")).alias("c")).where("c is not null").select("feed_id", "pos", "c.*"))
add("txt39_feed_contacts", f"""with {NAMED}, l as (select feed_id, pos, 0 as k, 'mailto:' || mail as url, 'email' as network, source from n where person is null and mail is not null union all select feed_id, pos, 1, url, 'fediverse', source from n where person is null and url like '%Social%')
    select feed_id, url, network, source from l qualify row_number() over (partition by feed_id, url order by pos, k) = 1""", lambda m: I.feed_contacts(derived(m, INPUTS, feeds=m.feeds)))
SIGNED = "select feed_id, guid as pos, title, case id % 6 when 0 then title when 1 then 'Ann Bee and Cy Dee' when 2 then 'Order ' || cast(feed_id as string) when 3 then 'Gus Hill, News Team' when 4 then '' end as author from items"
add("txt38_feed_credits", f"""with {NAMED}, q as (select *, row_number() over (partition by feed_id order by pos, title) as k from ({SIGNED}) s), b as (select feed_id, 1000 + k as pos, unnest(case author when 'Ann Bee and Cy Dee' then ['Ann Bee', 'Cy Dee'] when 'Gus Hill, News Team' then ['Gus Hill'] else [] end) as name from q),
    c as (select feed_id, pos, person as name, mail as email, case when url is not null then site end as url, coalesce(role, 'author') as role, confidence::double as confidence from n where person is not null union all select feed_id, pos, name, null, null, 'author', 0.6 from b),
    d as (select * replace (case when name = 'ann' and bool_or(name = 'Ann Bee') over (partition by feed_id) then 'Ann Bee' else name end as name, case when name = 'ann' then pos + 5000 else pos end as pos) from c)
    select feed_id, name, max(confidence) as confidence, case when bool_or(role = 'owner') then 'owner' else 'author' end as role, min_by(email, case when coalesce(email, '') <> '' then pos end) as email, min_by(url, case when coalesce(url, '') <> '' then pos end) as url from d group by 1, 2""",
    lambda m: W.merge_credits(I.feed_credits(m.feeds.select(F.col("id").alias("feed_id"), "title"), derived(m, INPUTS, feeds=m.feeds).withColumn("confidence", F.col("confidence").cast("double")), derived(m, SIGNED, items=m.items))))
BIO = f"select id, '<a href=\"https://github.com/ann' || {N} || '\">x</a> {{{{\"u\":\"https://bsky.app/profile/b' || {N} || '.example\"}}}} <a href=\"https://github.com/ann' || {N} || '\">again</a> https://linktr.ee/@ann ' || case when id % 2 = 0 then 'https://m.example/@c' || {N} else site_url end as html from feeds"
add("txt36_links_of_bio", f"select id, case when id % 2 = 0 then ['github:ann' || {N}, 'bluesky:b' || {N} || '.example', 'fediverse:@c' || {N} || '@m.example'] else ['github:ann' || {N}, 'bluesky:b' || {N} || '.example'] end as v from feeds",
    lambda m: derived(m, BIO, feeds=m.feeds).select("id", F.transform(I.links_of_bio(F.col("html")), lambda t: F.concat_ws(":", t["network"], t["handle"])).alias("v")))
SHOWN = f"select id, site_url as url, '<img src=\"' || site_url || 'a' || {N} || '.png\"><IMG width=\"150\" src=\"' || site_url || 'small.png\"><img src=\"https://cdn.other.test/x.png\"><img src=\"' || site_url || 'static/y.png\"><img height=300 width=\"900\" src=\"' || replace(site_url, 'www', 'img') || 'b.png\"><img src=\"' || site_url || 'p/my-logo.png\"><img src=\"/c.png\">' as html from feeds"
add("txt59_figures", f"select id, [site_url || 'a' || {N} || '.png', replace(site_url, 'www', 'img') || 'b.png'] as v from feeds",
    lambda m: derived(m, SHOWN, feeds=m.feeds).select("id", I.figures(F.col("html"), F.col("url")).alias("v")))

CREDITED = f"{NAMED}, w as (select n.*, case when url is not null then site else lower(person) || '@host' || regexp_extract(feed_url, 'host(\\d+)', 1) || '.example' end as identity_key, coalesce(role, 'author') as part, row_number() over (partition by feed_id, person order by n.confidence desc, pos) as k from n join feeds f on f.id = n.feed_id where person is not null)"
PREPARED = "p as (select feed_id, identity_key, min_by(person, (-confidence, pos)) as name, min_by(mail, case when mail is not null then (-confidence, pos) end) as email, case when bool_or(part = 'owner') then 'owner' else min_by(part, (-confidence, pos)) end as role, max(confidence)::double as confidence from w group by 1, 2)"


def _prepared(m):
    inputs = derived(m, INPUTS, feeds=m.feeds).withColumn("confidence", F.col("confidence").cast("double"))
    credits = inputs.withColumn("c", I.credit(F.col("name"), F.col("email"), F.col("url"))).where("c is not null").select("feed_id", "c.*", F.coalesce("role", F.lit("author")).alias("role"), "confidence", "pos")
    return writes.prepare_credits(credits, m.feeds)


KNOWN = "select 'https://social.example/@p' || cast(id * 6 as string) as identity_key, name, case when id % 2 = 0 then email end as email, confidence from authors"
TIED = "select id as feed_id, 'https://social.example/@p' || cast(id as string) as identity_key, 'author' as role, cast(0.9 as double) as confidence from feeds where id % 6 = 0"
add("str30_prepare_credits", f"with {CREDITED}, {PREPARED} select feed_id, identity_key, name, email, role, confidence from p", lambda m: _prepared(m).select("feed_id", "identity_key", "name", "email", "role", "confidence"))
add("str36_store_credits", f"""with {CREDITED}, {PREPARED}, o as (select identity_key, min_by(name, (-confidence, feed_id)) as name, min_by(email, case when email is not null then (-confidence, feed_id) end) as email, max(confidence) as confidence from p group by 1), a as ({KNOWN})
    select identity_key, coalesce(a.name, o.name) as name, coalesce(a.email, o.email) as email, case when a.identity_key is null then o.confidence when o.identity_key is null then a.confidence else greatest(a.confidence, o.confidence) end as confidence from a full join o using (identity_key)""",
    lambda m: writes.store_credits(derived(m, KNOWN, authors=m.authors), derived(m, TIED, feeds=m.feeds), _prepared(m))[0])
add("dml16_credit_links", f"""with {CREDITED}, {PREPARED}, t as ({TIED}) select feed_id, identity_key, case when t.role = 'owner' or p.role = 'owner' then 'owner' else coalesce(t.role, p.role) end as role, case when t.feed_id is null then p.confidence when p.feed_id is null then t.confidence else greatest(t.confidence, p.confidence) end as confidence
    from t full join p using (feed_id, identity_key)""", lambda m: writes.store_credits(derived(m, KNOWN, authors=m.authors), derived(m, TIED, feeds=m.feeds), _prepared(m))[1])
NEW_TOPICS = "select id as feed_id, 'topic-new' as slug, 'new' as keyword, cast(1 as bigint) as count from feeds where id % 4 = 0 union all select id, 'topic-1', 'one', id % 7 from feeds where id % 4 = 0"
add("txt08_refresh_feed_keywords", f"with t as ({NEW_TOPICS}) select feed_id, slug, keyword, count from feed_keywords where feed_id not in (select feed_id from t) union all select * from t",
    lambda m: writes.replace_keywords(m.feed_keywords.select("feed_id", "slug", "keyword", "count"), derived(m, NEW_TOPICS, feeds=m.feeds)))
