"""How new feeds are looked for: which sources are due, what a pass takes, what came of it, and shapes of writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.windows import numbered


def due_sources(last_runs: DataFrame, every_hours: dict[str, int], now: Column) -> DataFrame:
    """(source, last_run) of sources whose interval has passed since their last run; those that never ran are due."""
    known = last_runs.sparkSession.createDataFrame(list(every_hours.items()), "source string, hours int")
    df = known.join(last_runs, "source", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("last_run")
    return df.where(F.col("last_run").isNull() | (age >= 3600 * F.col("hours"))).select("source", "last_run")


def source_schedule(runs: DataFrame) -> DataFrame:
    """(source, last_run, runs) of each source."""
    return runs.groupBy(F.col("provider").alias("source")).agg(F.max("created_at").alias("last_run"), F.count(F.lit(1)).alias("runs"))


def source_yield(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """(provider, feeds): accepted candidates by the source of their run."""
    accepted = candidates.where("status = 'accepted'").join(runs.select(F.col("id").alias("run_id"), "provider"), "run_id")
    return accepted.groupBy("provider").agg(F.count(F.lit(1)).alias("feeds"))


def new_hosts(candidates: DataFrame, feeds: DataFrame, host: Column) -> DataFrame:
    """Hosts of candidates that the directory does not have."""
    return candidates.select("host").distinct().join(feeds.select(host.alias("host")).distinct(), "host", "left_anti")


def rotate(rows: DataFrame, by: str, run: int, batch: int) -> DataFrame:
    """The batch of a run number in the order of ``by``, round and round: all rows where the batch is as large, none where it is not above zero."""
    if batch <= 0:
        return rows.where("false")
    total = rows.count()
    if batch >= total:
        return rows
    placed = numbered(rows, by)
    return placed.where(F.pmod(F.col("place") - (run * batch) % total, F.lit(total)) < batch).drop("place")


def refresh_runs(candidates: DataFrame) -> DataFrame:
    """(run_id, total, queued, done) of each run: done once nothing is queued."""
    queued = F.count_if(F.col("status") == "queued")
    return candidates.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), queued.alias("queued"), (queued == 0).alias("done"))


def statement_shape(sql: Column) -> Column:
    """What a statement writes and where, as ``verb table``; comments and white space do not count, reads are ``other ?``."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"\s+", " ")))
    verb = F.coalesce(F.nullif(F.regexp_extract(t, r"^(insert|update|delete|replace)", 1), F.lit("")), F.lit("other"))
    table = F.regexp_extract(t, r"^(?:insert (?:or \w+ )?into|update|delete from|replace into) ([a-z_]+)", 1)
    return F.concat(verb, F.lit(" "), F.coalesce(F.nullif(table, F.lit("")), F.lit("?")))
