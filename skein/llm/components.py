"""Connected components as DataFrames: alternating large-star and small-star rounds.

Each round halves the height of the trees at least on average; every round's edges are written to
the shared folder, so a lost executor costs a part of one round. Nothing but two numbers per round
reaches the driver. The root of a large component is one key with all its leaves in the joins, which
adaptive execution splits (spark.sql.adaptive.skewJoin, on by default); its minimum is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges -> (id, component), one row for each node of an edge; component is the smallest id reachable.

    Rows with a null end and loops are left out; repeated edges do no harm; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    ).distinct()
    e = cut(e, "cc")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        after = _state(e)
        if after == before:
            break
        before = after
    e = e.groupBy("u").agg(F.min("v").alias("v"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
