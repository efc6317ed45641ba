"""Mutations as the next snapshot of a table: what a table format's MERGE would leave behind.

Each function takes the table and the change and gives the whole table after it; writing it over a
partition or a table is the caller's step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWEST_ITEMS, COMMENT_CHARS, CHANNEL_FAILURES = 50, 4000, 5


def insert_new(table: DataFrame, rows: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is not there are added, once each; others change nothing."""
    new = rows.select(table.columns).dropDuplicates(list(on)).join(table.select(*on), list(on), "left_anti")
    return table.unionByName(new)


def delete_where(table: DataFrame, condition: Column | str) -> DataFrame:
    """The table without the rows that meet a condition; unknown is not met."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti").select(table.columns)


def update_where(table: DataFrame, condition: Column | str, **values: Column) -> DataFrame:
    """New values where a condition is met; all see the old row."""
    condition = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
    return table.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def merge(table: DataFrame, rows: DataFrame, on: list[str], **rules: Column) -> DataFrame:
    """Full outer merge: a rule tells a column from old_<column> and new_<column>; without one the old value stays.

    Rows that are new take their own values; a key is in the result once.
    """
    rest = [c for c in table.columns if c not in on]
    a = table.select(*on, *[F.col(c).alias(f"old_{c}") for c in rest], F.lit(True).alias("_old"))
    b = rows.dropDuplicates(on).select(*on, *[F.col(c).alias(f"new_{c}") for c in rest], F.lit(True).alias("_new"))
    j = a.join(b, on, "full_outer")
    pick = lambda c: F.when(F.col("_old").isNull(), F.col(f"new_{c}")).when(F.col("_new").isNull(), F.col(f"old_{c}")).otherwise(rules.get(c, F.col(f"old_{c}")))
    return j.select(*on, *[pick(c).alias(c) for c in rest])


def fill(column: str) -> Column:
    """The old value, or the new one where there is none."""
    return F.coalesce(f"old_{column}", f"new_{column}")


def latest(column: str) -> Column:
    return F.col(f"new_{column}")


def prefer_new(column: str) -> Column:
    """The new value unless it is empty."""
    return F.coalesce(F.nullif(F.col(f"new_{column}"), F.lit("")), F.col(f"old_{column}"))


def highest(column: str) -> Column:
    """The larger of both; null if one is null, as the scalar maximum has it."""
    return F.when(F.col(f"old_{column}").isNotNull() & F.col(f"new_{column}").isNotNull(), F.greatest(f"old_{column}", f"new_{column}"))


def owner_wins(column: str = "role") -> Column:
    return F.when((F.col(f"old_{column}") == "owner") | (F.col(f"new_{column}") == "owner"), "owner").otherwise(F.col(f"old_{column}"))


def newest_items(items: DataFrame, n: int = NEWEST_ITEMS) -> DataFrame:
    """The newest posts of each feed that have an identifier."""
    from skein.operators.windows import top_per

    return top_per(items.where("guid is not null and guid <> ''"), "feed_id", n, F.col("published_at").desc_nulls_last(), F.col("id").desc())


def upsert_items(table: DataFrame, rows: DataFrame) -> DataFrame:
    """New posts come in; of known ones only what is missing is filled, titles and summaries never change."""
    return merge(table, newest_items(rows), ["feed_id", "guid"], published_at=fill("published_at"), audio_url=fill("audio_url"), audio_type=fill("audio_type"), cluster_key=fill("cluster_key"))


def enqueue(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries at the end of their lanes; one that is done goes back to the end, an open one stays where it is."""
    from pyspark.sql import Window

    last = queue.groupBy("user_id", "lane").agg(F.max("position").alias("last"))
    new = rows.dropDuplicates(["user_id", "lane", "item_id"]).join(queue.where("not done").select("user_id", "lane", "item_id"), ["user_id", "lane", "item_id"], "left_anti")
    new = new.join(last, ["user_id", "lane"], "left").withColumn("position", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("user_id", "lane").orderBy("id")))
    new = new.select("id", "user_id", "item_id", "lane", "position", F.lit(False).alias("done"))
    old = queue.select(new.columns)
    return old.join(new.select("user_id", "lane", "item_id"), ["user_id", "lane", "item_id"], "left_anti").select(new.columns).unionByName(new)


def move(queue: DataFrame, user_id: int, lane: str, entry_id: int, up: bool = True) -> DataFrame:
    """An open entry changes places with its neighbour."""
    from pyspark.sql import Window

    w = Window.orderBy("position", "id")
    own = queue.where((F.col("user_id") == user_id) & (F.col("lane") == lane) & ~F.col("done"))
    near = own.select("id", "position", (F.lag if up else F.lead)(F.struct("id", "position")).over(w).alias("other")).where((F.col("id") == entry_id) & F.col("other").isNotNull())
    swap = near.select("id", F.col("other.position").alias("_to")).unionByName(near.select(F.col("other.id").alias("id"), F.col("position").alias("_to")))
    return queue.join(swap, "id", "left").withColumn("position", F.coalesce("_to", "position")).drop("_to").select(queue.columns)


def move_all(queue: DataFrame, entries: DataFrame, up: bool = True) -> DataFrame:
    """Each of ``entries`` (user_id, lane, id), one a user's lane, changes places with its neighbour among the open ones."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "lane").orderBy("position", "id")
    own = queue.where(~F.col("done")).join(entries.select("user_id", "lane").distinct(), ["user_id", "lane"], "left_semi")
    near = own.select("id", "position", (F.lag if up else F.lead)(F.struct("id", "position")).over(w).alias("other")).join(entries.select("id"), "id", "left_semi").where("other is not null")
    swap = near.select("id", F.col("other.position").alias("_to")).unionByName(near.select(F.col("other.id").alias("id"), F.col("position").alias("_to")))
    return queue.join(swap, "id", "left").withColumn("position", F.coalesce("_to", "position")).drop("_to").select(queue.columns)
