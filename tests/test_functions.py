from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.operators import windows as W
from skein.streaming import cadence as C
from skein.streaming import rollups as R


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tokens(spark):
    t = lambda s: one(spark, T.tokenize(F.lit(s)))
    assert t("The quick brown fox is 42 a") == ["quick", "brown", "fox"]
    assert t("C++ and C# and self-hosted e-ink") == ["c++", "c#", "self-hosted", "e-ink"]
    assert t("Rust’s tooling & builds") == ["rusts", "tooling", "builds"]


def test_clusters(spark):
    k = lambda s: one(spark, T.cluster_key(F.lit(s)))
    assert k("Rust 2.0 released to general availability") == k("Released to general availability: Rust 2.0") is not None
    assert all(k(s) is None for s in ("Weeknotes", "Links", "Monthly update", "Hello world", "", "It is what it is"))


def test_stems_and_relevance(spark):
    assert [one(spark, T.stem(F.lit(w))) for w in ("huskies", "dogs", "boxes", "cat")] == ["husk", "dog", "box", "cat"]
    assert one(spark, T.relevance(F.lit("siberian huskies"), F.lit("Husky Diaries")))


def test_keywords(spark):
    rows = [("f", s) for s in ("Building a home lab", "My home lab again", "More home lab news", "Baking sourdough today")]
    got = T.extract_keywords(spark.createDataFrame(rows, "feed_id string, text string")).orderBy("rank").collect()
    assert (got[0].keyword, got[0].words, got[0]["count"]) == ("home lab", 2, 3) and all(r.keyword != "sourdough" for r in got)


def test_dedupe(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, ""), (6, "")], "id long, key string")
    assert sorted((r.id, r.duplicates) for r in W.dedupe_items(rows, "key", F.col("id")).collect()) == [(1, 2), (4, 0), (5, 0), (6, 0)]
    assert W.dedupe_items(rows.limit(0), "key", F.col("id")).count() == 0


def test_claim_slugs(spark):
    entries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id long, base string")
    taken = spark.createDataFrame([("a",), ("a-3",), ("c",)], "slug string")
    assert {r.id: r.slug for r in W.claim_slugs(entries, taken).collect()} == {1: "a-2", 2: "a-4", 3: "a-5", 4: "b"}


def test_spread_hosts(spark):
    feeds = spark.createDataFrame([(i, "big" if i < 100 else f"h{i}") for i in range(140)], "id long, h string")
    got = W.spread_hosts(feeds, F.col("h"), 40, 8, F.col("id")).collect()
    assert len(got) == 40 and sum(r.host == "big" for r in got) == 8 and len({r.host for r in got}) == 33
    assert len(W.spread_hosts(feeds.where("h = 'big'"), F.col("h"), 50, 8, F.col("id")).collect()) == 50


def test_rate_limit(spark):
    hits = spark.sql("select 'a' as identity, timestamp '2026-01-01 00:00:00' + make_dt_interval(0, 0, id * 20) as at from range(6)")
    got = sorted((r.at.hour * 60 + r.at.minute, r.allowed) for r in W.first_window_limit(hits, 2).collect())
    assert got == [(0, 1), (20, 1), (40, 0), (60, 1), (80, 1), (100, 0)]


def test_cadence(spark):
    now = F.expr("timestamp '2026-08-18 12:00:00'")

    def minutes(count, gap, ago):
        items = spark.sql(f"select 1 as feed_id, timestamp '2026-08-18 12:00:00' - make_dt_interval({ago} + cast(id as int) * {gap}) as published_at from range({count})")
        r = C.intervals_from_dates(items, now).first()
        return r and r.minutes

    assert 3 * 1440 <= minutes(10, 7, 1) <= 4 * 1440 and 660 <= minutes(10, 1, 0) <= 780
    assert minutes(10, 7, 800) == 129_600 and minutes(1, 7, 0) is None


def test_scalars(spark):
    assert one(spark, S.normalize_url(F.lit("Example.com/a#b"))) == "https://example.com/a"
    assert one(spark, S.normalize_url(F.lit("ftp://example.com"))) is None
    assert [one(spark, S.is_blocked_address(F.lit(x))) for x in ("10.0.0.1", "8.8.8.8", "172.20.0.1", "::1", "x")] == [True, False, True, True, True]
    assert one(spark, S.clamp_text(F.lit("one two three four"), 11)) == "one two…"
    assert one(spark, S.duration(F.lit("1:02:03"))) == 3723 and one(spark, S.duration(F.lit("x"))) is None
    assert one(spark, S.retry_after_seconds(F.lit("120"), F.current_timestamp())) == 120


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").coalesce(1)
    events.limit(400).write.parquet(str(tmp_path / "e"))
    events.subtract(events.limit(400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    batch = {(r.hour, r.event_type): (r.lines, r.amount) for r in R.hourly(events).collect()}
    got = R.run_to_table(R.hourly(R.events_stream(spark, str(tmp_path / "e"), 10)), "hours", "complete")
    assert {(r.hour, r.event_type): (r.lines, r.amount) for r in got.collect()} == batch


def test_entity_of_a_byte_order_mark(spark):
    codes = [0, 1, 65, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFEFF, 0xFFFE, 0xFFFF, 0x10000, 0x10FFFF, 0x110000]
    got = {r.c: r.v for r in spark.createDataFrame([(c,) for c in codes], "c long").select("c", S.entity(F.col("c")).alias("v")).collect()}
    assert got == {c: chr(c) if 0 < c < 0x110000 and not 0xD800 <= c < 0xE000 else None for c in codes}
