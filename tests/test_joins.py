"""Joins that keep to their time when keys are hot: salts by heat, and the as-of join by merging."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shopflow.operators import joins


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def half_hot(spark):
    """Half of the rows have key 1, and a tenth key 2."""
    key = F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 10 == 1, 2).otherwise(F.col("id") % 977)
    return spark.range(60_000).select("id", key.cast("long").alias("k"))


def test_hot_keys_are_found(half_hot):
    got = {r.hot_key: r.heat for r in joins.hot_keys(half_hot, "k", 16).collect()}
    assert set(got) == {1, 2} and abs(got[1] - 8) < 0.2 and abs(got[2] - 1.6) < 0.2


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salts_by_heat_change_nothing(spark, how):
    facts = spark.createDataFrame([(i, None if i % 9 == 0 else 5 if i % 2 else i % 4) for i in range(200)] + [(7, 5)] * 3, "id long, k long")
    dim = spark.createDataFrame([(5, "hot"), (5, "again"), (1, "one"), (None, "none"), (8, "unused")], "k long, name string")
    assert rows(joins.salted_by_heat(facts, dim, "k", 4, how=how).select("id", "k", "name")) == rows(facts.join(dim, "k", how).select("id", "k", "name"))
    with pytest.raises(ValueError):
        joins.salted_by_heat(facts, dim, "k", how="right")


def test_salted_tasks_are_even(spark, half_hot):
    """The largest task has at most twice the rows of the median one, and only hot keys are copied."""
    dim = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = joins.salted_by_heat(half_hot, dim, "k", 16)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == 16 and sum(sizes) == 60_000 and sizes[-1] <= 2 * sizes[8]


T0 = datetime(2024, 1, 1)


def history(r: random.Random, keys: list) -> list[tuple]:
    """Versions that touch or leave gaps, some of no length, some open."""
    out = []
    for k in keys:
        at = r.randint(0, 5)
        for i in range(r.randint(0, 6)):
            end = at + r.choice([0, 1, 2, 5])
            out.append((k, f"{k}-{i}", T0 + timedelta(hours=at), T0 + timedelta(hours=end)))
            at = end + r.choice([0, 0, 1])
        if r.random() < 0.5:
            out.append((k, f"{k}-open", T0 + timedelta(hours=at), None))
    return out


@pytest.mark.parametrize("tasks", [1, 4, 500])
def test_as_of_equals_valid_at(spark, tasks):
    """Instants of change, gaps, ties, nulls and facts before everything; with more tasks every key is hot and cut into slices."""
    r = random.Random(tasks)
    versions = history(r, list(range(8))) + [(None, "none", T0, None), (3, "never", None, None)]
    facts = [(i, r.choice([None, *range(10)]), r.choice([None, *(T0 + timedelta(hours=h / 2) for h in range(-4, 60))])) for i in range(300)]
    f = spark.createDataFrame(facts + facts[:5], "id long, k long, ts timestamp")
    h = spark.createDataFrame(versions, "k long, city string, valid_from timestamp, valid_to timestamp")
    got = joins.as_of(f, h, "k", "ts", tasks=tasks, slices=16)
    assert rows(got.select("id", "k", "ts", "city")) == rows(joins.valid_at(f, h, "k", "ts").select("id", "k", "ts", "city"))
    for empty in ((f.limit(0), h), (f, h.limit(0))):
        assert rows(joins.as_of(*empty, "k", "ts").select("id", "city")) == rows(joins.valid_at(*empty, "k", "ts").select("id", "city"))


def test_as_of_on_one_hot_key(spark):
    """100,000 facts and 10,000 versions of one key: seconds, and the key's rows are in many slices."""
    f = spark.range(100_000).select("id", F.lit(1).cast("long").alias("k"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") * 10)).alias("ts"))
    edge = lambda n: F.lit(T0) + F.make_dt_interval(secs=n * 100)
    h = spark.range(10_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("v"), edge(F.col("id")).alias("valid_from"), edge(F.col("id") + 1).alias("valid_to"))
    began = time.monotonic()
    got = joins.as_of(f, h, "k", "ts", tasks=4).agg(F.count("*").alias("n"), F.count_if(F.col("v") == F.floor(F.col("id") / 10)).alias("right")).first()
    assert (got.n, got.right) == (100_000, 100_000) and time.monotonic() - began < 60
