"""Queries over answers of networks, searches and pictures, which one SQL text derives for both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import profiles as P
from skein.operators import cards
from skein.plans.columns import N, pick
from skein.plans.reads import add
from skein.plans.rules import part
from skein.plans.verdicts import derived

NETWORK = pick("'github'", "'gitlab'", "'codeberg'", "'fediverse'", "'github'", "'gitlab'", "'codeberg'", "'fediverse'", "'myspace'", "'github'")
#: Answers: whole ones, some without fields or with others, an empty search, and what is no JSON.
ANSWERS = f"select id, {NETWORK} as network, " + pick(
    f"'{{\"name\":\" Ann ' || {N} || '\",\"bio\":\"b\",\"avatar_url\":\"https://i.example/a\",\"type\":\"User\",\"blog\":\"ann' || {N} || '.example\",\"email\":\"a@b.org\",\"twitter_username\":\"ann\"}}'",
    f"'[{{\"name\":\"Bo ' || {N} || '\",\"website_url\":\"http://bo.example\",\"twitter\":\"@bo\",\"linkedin\":\"https://www.linkedin.com/in/bo/\"}}]'",
    f"'{{\"full_name\":\"Cy ' || {N} || '\",\"description\":\"d\",\"user_type\":1,\"website\":\"\"}}'",
    f"'{{\"display_name\":\"Di ' || {N} || '\",\"note\":\"<p>one</p><p>two &amp; three</p>\",\"avatar\":\"https://i.example/d\",\"url\":\"https://m.example/@di\",\"fields\":[{{\"value\":\"<a href=' || chr(92) || '\"https://di.example' || chr(92) || '\">x</a>\",\"verified_at\":\"2024\"}},{{\"value\":\" plain.example \"}},{{\"value\":\"\"}}]}}'",
    "'{\"type\":\"Organization\",\"name\":5}'", "'[]'", "'{\"user_type\":0}'", "'{\"group\":true,\"url\":\"https://m.example/@g\",\"fields\":[{\"value\":\"https://m.example/@g\"}]}'", "'{\"name\":\"x\"}'", "'no json'") + " as body from feeds"
NAMED = pick(f"'Ann ' || {N}", f"'Bo ' || {N}", f"'Cy ' || {N}", f"'Di ' || {N}", "'5'", "''", "''", "''", "''", "''")
LINKS = pick(
    f"'website https://ann' || {N} || '.example 0.8,email mailto:a@b.org 0.8,twitter https://x.com/ann 0.8'", "'website http://bo.example 0.8,twitter https://x.com/bo 0.8,linkedin https://www.linkedin.com/in/bo 0.8'", "''",
    "'https://di.example 0.95,plain.example 0.5,https://m.example/@di 0.6'", "''", "''", "''", "'https://m.example/@g 0.5'", "''", "''")
BIOS = pick("'b'", "''", "'d'", "'one two & three'", *["''"] * 6)
PERSONS = pick("'user'", "'user'", "'org'", "'user'", "'org'", "'unknown'", "'user'", "'org'", "'unknown'", "'unknown'")
add("txt52_identity_from_profile", f"select id, {NAMED} as name, {BIOS} as bio, {PERSONS} as kind, {LINKS} as links from feeds",
    lambda m: derived(m, ANSWERS.replace("{", "{{").replace("}", "}}"), feeds=m.feeds).select("id", P.identity_from_profile(F.col("network"), F.col("body")).alias("p")).select(
        "id", "p.name", "p.bio", "p.kind", F.array_join(F.transform("p.links", lambda x: F.concat_ws(" ", x["network"], x["url"], x["confidence"].cast("string"))), ",").alias("links")))

ACCOUNTS = "select id, " + pick(f"'github|ann' || {N}", f"'gitlab|@bo b' || {N}", f"'codeberg|~cy' || {N}", f"'fediverse|@di' || {N} || '@M.example'", "'fediverse|di'", "'twitter|eve'", "'github|'") + " as x from feeds"
add("txt53_profile_request", "select id, " + pick(f"'https://api.github.com/users/ann' || {N}", f"'https://gitlab.com/api/v4/users?username=bo%20b' || {N}", f"'https://codeberg.org/api/v1/users/cy' || {N}", f"'https://M.example/api/v1/accounts/lookup?acct=di' || {N}", "null", "null", "null") + " as url, "
    + pick("'application/vnd.github+json'", "'application/json'", "'application/json'", "'application/json'", "null", "null", "null") + " as accept from feeds",
    lambda m: derived(m, ACCOUNTS, feeds=m.feeds).select("id", P.profile_request(part(F.col("x"), 0), part(F.col("x"), 1)).alias("r")).select("id", "r.url", F.col("r.headers")["accept"].alias("accept")))

FOUND = "select id, " + pick(
    f"'{{\"organic_results\":[{{\"link\":\"https://github.com/ann' || {N} || '\"}},{{\"link\":\"https://x.com/ann\"}},{{\"title\":\"t\"}},{{\"link\":\"http://github.com/ann' || {N} || '/\"}},{{\"link\":\"https://github.com/bo/x\"}},{{\"link\":\"https://www.github.com/bo\"}}]}}'",
    "'{\"organic_results\":{}}'", "'[]'", "'x'", "null") + " as body from feeds"
add("txt66_links_from_search", "select id, " + pick(f"'ann' || {N} || ' https://github.com/ann' || {N} || ',bo https://www.github.com/bo'", "''", "''", "''", "''") + " as links from feeds",
    lambda m: derived(m, FOUND.replace("{", "{{").replace("}", "}}"), feeds=m.feeds).select("id", F.array_join(F.transform(P.links_from_search(F.lit("github"), F.col("body")), lambda x: F.concat_ws(" ", x["handle"], x["url"])), ",").alias("links")))

#: Pictures that feeds offer: a cover, one of the page, one for posts, some alike; and what is at their addresses.
OFFERED = f"""select id as feed_id, k as place, case k when 0 then 'cover' when 1 then 'og' else 'twitter' end as source,
    case when (id + k) % 7 = 0 or id % 11 = 0 then '' when id % 5 = 0 then 'https://i.example/p' || cast(id % 50 as string) else 'https://i.example/p' || cast((3 * id + k) % 90 as string) end as url from feeds, (select 0 as k union all select 1 union all select 2) s"""
AT = """select distinct 'https://i.example/p' || cast(id % 90 as string) as url, 'https://cdn.example/p' || cast(id % 90 as string) as probed_url, case id % 90 % 6 when 0 then 'svg' else 'png' end as type,
    id % 90 * 16 as width, case when id % 90 % 4 = 0 then 150 else id % 90 * 9 end as height from feeds where id % 90 % 8 <> 3"""
add("txt56_find_feed_card", f"""with o as (select * from ({OFFERED}) x where url <> ''), p as ({AT}), c as (select o.*, p.* exclude (url), case when type = 'svg' or width < 200 or height < 200 then 'none' when width >= 600 and height >= 315 then 'large' else 'small' end as fit from o join p using (url)),
    b as (select * from c qualify row_number() over (partition by feed_id order by case fit when 'large' then 0 when 'small' then 1 else 2 end, place) = 1)
    select f.id as feed_id, case when b.feed_id is not null then 'ok' when f.id % 2 = 0 and f.id not in (select feed_id from o) then 'error' else 'none' end as state, coalesce(probed_url, '') as url, coalesce(width, 0) as width, coalesce(height, 0) as height, coalesce(type, '') as type, coalesce(fit, 'none') as fit, coalesce(source, '') as source
    from feeds f left join b on b.feed_id = f.id""",
    lambda m: cards.find_cards(m.feeds.select(F.col("id").alias("feed_id"), (F.col("id") % 2 == 0).alias("page_failed")), derived(m, OFFERED, feeds=m.feeds), derived(m, AT, feeds=m.feeds)))
ENTRIES = "select feed_id, case when feed_id % 5 = 0 then 'video/vnd.apple.mpegurl' when id % 4 = 0 then null when feed_id % 3 = 0 then 'video/mp4' else audio_type end as type, case when id % 6 <> 0 then audio_seconds end as seconds from items"
add("sca57_kind_of_entries", f"""select feed_id, case when 2 * sum((coalesce(type, '') in ('application/vnd.apple.mpegurl', 'video/vnd.apple.mpegurl') or (coalesce(type, '') = '' and seconds is null))::int) > count(*) then 'live'
    when sum((coalesce(type, '') like 'video/%')::int) > sum((coalesce(type, '') like 'audio/%')::int) then 'video' else 'music' end as kind from ({ENTRIES}) e group by 1""", lambda m: cards.kind_of_entries(derived(m, ENTRIES, items=m.items), "feed_id"))
