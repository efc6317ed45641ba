"""A stored full-text index: postings by bucket of the term, in segments to which texts are added.

A segment is a table partition; within it postings lie in folders by the term's bucket, so that a
query reads the buckets of its terms and no others, and sorted by term in files among which a
frequent term's postings are dealt out. Each segment has its own counts, which are summed when a
query ranks. Nothing is rewritten when texts are added.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.forms import unaccented
from skein.functions.porter import stems

#: The weights of BM25.
K1, B = 1.2, 0.75
#: Buckets of terms, files that a bucket's postings are dealt to, and the distance between one column's words and the next one's.
BUCKETS, FILES, GAP = 64, 4, 1 << 24
POSTINGS = "term string, id long, length int, positions array<int>, segment string, bucket int"
COUNTS = "segment string, docs long, words long"


def words_of(text: Column) -> Column:
    """Letters and digits in lower case without accents."""
    return F.filter(F.split(F.regexp_replace(unaccented(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}\p{Co}]+", " "), " "), lambda t: t != "")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def add(docs: DataFrame, path: str, id_col: str, *texts: str, buckets: int = BUCKETS, files: int = FILES) -> str:
    """Write texts as a new segment of the index below ``path`` and give its name.

    Of a text the positions of its stems are kept, column after column. Null texts are empty; rows
    with equal ids in one segment count as texts of their own and should not be there.
    """
    name = uuid.uuid4().hex
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.array(*[words_of(F.col(c)) for c in texts]).alias("columns"))
    d = d.withColumn("length", F.aggregate("columns", F.lit(0), lambda n, ws: n + F.size(ws)))
    spots = F.flatten(F.transform("columns", lambda ws, i: F.transform(ws, lambda w, k: F.struct(w.alias("word"), (i * GAP + k).cast("int").alias("at")))))
    # an inner explode is preceded by a filter on its array, for which the words would be made a second time
    rows = d.select("id", "length", F.explode_outer(spots).alias("spot")).select("id", "length", "spot.word", "spot.at").where("word is not null")
    own = rows.groupBy("word", "id", "length").agg(F.collect_list("at").alias("at"))
    # a word is stemmed once, however often it is there
    stemmed = rows.select("word").distinct().select("word", stems(F.array("word"))[0].alias("term"))
    found = own.join(stemmed, "word").groupBy("term", "id", "length").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("positions")).withColumn("bucket", bucket_of(F.col("term"), buckets))
    dealt = found.repartition(F.col("bucket"), F.pmod(F.hash("id"), F.lit(files))).sortWithinPartitions("bucket", "term")
    dealt.withColumn("segment", F.lit(name)).write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/postings")
    d.agg(F.lit(name).alias("segment"), F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).write.mode("append").parquet(f"{path}/counts")
    return name


def phrases_of(spark: SparkSession, query: str) -> list[list[str]]:
    """The query's parts at white space, each as the stems of its words: several make a phrase."""
    parts = [p for p in query.split() if p]
    if not parts:
        return []
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, part string").orderBy("i").select(stems(words_of(F.col("part"))).alias("terms"))
    return [r.terms for r in rows.collect() if r.terms]


def hits(spark: SparkSession, path: str, phrases: list[list[str]], buckets: int = BUCKETS) -> DataFrame:
    """(id, length, n array): how often each phrase is in each text that has any of its words; only the terms' buckets are read."""
    terms = sorted({t for p in phrases for t in p})
    index = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    named = spark.range(1).select(*[bucket_of(F.lit(t), buckets).alias(f"b{i}") for i, t in enumerate(terms)]).first()
    read = index.where(F.col("bucket").isin(sorted(set(named))) & F.col("term").isin(terms))
    own = read.groupBy("segment", "id", "length").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"t{i}") for i, t in enumerate(terms)])

    def count(phrase: list[str]) -> Column:
        back = lambda t, k: F.transform(F.col(f"t{terms.index(t)}"), lambda x: (x - k).cast("int"))
        at = F.col(f"t{terms.index(phrase[0])}")
        for k, t in enumerate(phrase[1:], 1):
            at = F.array_intersect(at, back(t, k))
        return F.coalesce(F.size(at), F.lit(0))

    counts = [F.when(F.size(F.col(f"t{terms.index(p[0])}")) >= 0, count(p)).otherwise(0) for p in phrases]
    return own.select("id", "length", F.array(*counts).alias("n"))


def matching(found: DataFrame, mode: str) -> DataFrame:
    return found.where((F.forall if mode == "all" else F.exists)("n", lambda n: n > 0))


def search(spark: SparkSession, path: str, query: str, mode: str = "all", limit: int | None = 40, buckets: int = BUCKETS) -> DataFrame:
    """(id, rank) of the texts with all (or any) of a query's phrases: BM25, negated so that the best is the smallest; equal ranks by id. A query without words finds nothing."""
    phrases = phrases_of(spark, query)
    if not phrases:
        return spark.createDataFrame([], "id long, rank double")
    found = hits(spark, path, phrases, buckets)
    docs, words = spark.read.schema(COUNTS).parquet(f"{path}/counts").agg(F.sum("docs"), F.sum("words")).first()
    having = found.agg(*[F.count_if(F.col("n")[i] > 0).alias(f"d{i}") for i in range(len(phrases))]).first()
    mean = (words or 0) / docs if docs else 0.0
    rank = F.lit(0.0)
    for i, df in enumerate(having):
        idf = max(math.log(((docs or 0) - df + 0.5) / (df + 0.5)), 0.0) or 1e-6
        rank = rank - F.lit(idf) * F.col("n")[i] * (K1 + 1) / (F.col("n")[i] + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    out = matching(found, mode).select("id", F.round(rank, 9).alias("rank")).orderBy("rank", "id")
    return out if limit is None else out.limit(limit)


def kind_counts(spark: SparkSession, path: str, query: str, kinds: DataFrame, mode: str = "all", buckets: int = BUCKETS) -> DataFrame:
    """(kind, posts, feeds): exact counts of what matches; ``kinds`` has id, kind and feed_id."""
    phrases = phrases_of(spark, query)
    ids = matching(hits(spark, path, phrases, buckets), mode).select("id") if phrases else spark.createDataFrame([], "id long")
    return kinds.join(ids, "id").groupBy("kind").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("feed_id").alias("feeds"))
