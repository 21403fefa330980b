"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _mark(df: DataFrame):
    return df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) for every node that has a link.

    Each round moves every node nearer to the least one it can see, by a minimum
    per node and a join; neighbours of a node are never gathered in one place.
    Null ends are no links; links of a node with itself, repeated and reversed links change nothing, and no links give no rows.
    Rounds are tables in the shared folder and end when one changes nothing.
    """
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = materialize(links, "links")
    before = _mark(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(small.unionByName(lowest.withColumnRenamed("m", "lo")).distinct(), "links")
        after = _mark(now)
        if tuple(after) == tuple(before):
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
