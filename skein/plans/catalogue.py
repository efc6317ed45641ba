"""All queries over the relational and text tables."""

from __future__ import annotations

from skein.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from skein.plans import alerts, columns, crawls, expressions, joins, media, mutations, people, profiles, reads, rollups, roundtrips, rules, sequences, texts, verdicts  # noqa: F401
from skein.sources.tables import table


@query(
    "category_stats",
    """
    with f as (select o_orderkey, o_orderpriority as category, o_orderstatus, o_orderdate, o_totalprice from orders),
         i as (select l_orderkey, count(*) as items from lineitem group by 1)
    select category, count(*) as feeds, count(*) filter (where o_orderstatus = 'O') as active,
           count(*) filter (where o_orderstatus = 'P') as pending, count(*) filter (where o_orderstatus = 'F') as errored,
           sum(coalesce(i.items, 0))::bigint as items, max(o_orderdate) as newest,
           count(*) * 1.0 / sum(count(*)) over () as share
    from f left join i on o_orderkey = l_orderkey group by category
    """,
)
def category_stats(spark, sf_dir):
    """Conditional counts, posts and share of each category."""
    from pyspark.sql import functions as F

    feeds, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    per_feed = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"))
    out = feeds.join(per_feed, feeds.o_orderkey == per_feed.l_orderkey, "left").groupBy(F.col("o_orderpriority").alias("category")).agg(
        F.count(F.lit(1)).alias("feeds"), F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_if(F.col("o_orderstatus") == "F").alias("errored"), F.sum(F.coalesce("items", F.lit(0))).alias("items"), F.max("o_orderdate").alias("newest"))
    total = out.agg(F.sum("feeds").alias("total"))
    return out.crossJoin(total).withColumn("share", F.col("feeds") * 1.0 / F.col("total")).drop("total")
