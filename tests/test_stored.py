"""Changes in place against the next snapshot of the whole table; what is not touched keeps its files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from skein.operators import merges, stored

SCHEMA = "user_id long, slug string, alerts boolean"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "follows")
    first = spark.createDataFrame([(i % 40, f"t{i}", i % 2 == 0) for i in range(200)] + [(None, "t", True)], SCHEMA)
    stored.create(first, path, ["user_id"], parts=16)
    return path, first


def changed(spark, path, touched, step, tmp_path):
    return stored.change(spark, path, SCHEMA, ["user_id"], touched, step, str(tmp_path / "scratch"), parts=16)


@pytest.mark.parametrize("name", ["insert", "merge", "delete", "update"])
def test_a_change_gives_the_next_snapshot(spark, tmp_path, table, name):
    path, first = table
    new = spark.createDataFrame([(3, "t3", True), (3, "new", False), (77, "t1", True)], SCHEMA)
    steps = {
        "insert": lambda t: merges.insert_new(t, new, "user_id", "slug"),
        "merge": lambda t: merges.merge(t, new, ["user_id", "slug"], alerts=merges.latest("alerts")),
        "delete": lambda t: merges.delete_keys(t, new, "user_id"),
        "update": lambda t: merges.update_where(t, "user_id = 3", alerts=F.lit(False)),
    }
    before = files(path)
    numbers = changed(spark, path, new, steps[name], tmp_path)
    assert rows(stored.read(spark, path, SCHEMA)) == rows(steps[name](first))
    after = files(path)
    kept = {f for f in before if int(f.split("part=")[1].split("/")[0]) not in numbers}
    assert 0 < len(numbers) <= 2 and kept and all(after[f] == before[f] for f in kept)
    assert not set(before) - kept & set(after)


def test_a_partition_without_rows_goes(spark, tmp_path, table):
    path, first = table
    all_of = first.withColumn("part", stored.part_of(["user_id"], 16)).where("part = 5")
    assert changed(spark, path, all_of, lambda t: t.where("false"), tmp_path) in ([5], [])
    assert not glob.glob(f"{path}/part=5")
    assert rows(stored.read(spark, path, SCHEMA)) == rows(first.withColumn("part", stored.part_of(["user_id"], 16)).where("part <> 5").drop("part"))


def test_nothing_touched_and_strangers(spark, tmp_path, table):
    path, first = table
    before = files(path)
    assert changed(spark, path, first.where("false"), lambda t: t, tmp_path) == [] and files(path) == before
    with pytest.raises(ValueError):
        changed(spark, path, first.where("user_id = 3"), lambda t: first, tmp_path)
    assert files(path) == before
    assert changed(spark, path, first.where("user_id is null"), lambda t: t, tmp_path)
    assert rows(stored.read(spark, path, SCHEMA)) == rows(first)
