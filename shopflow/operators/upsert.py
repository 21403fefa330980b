"""Tables with a unique key: a block of changes rewrites only the buckets whose rows it changes.

A row's bucket is a hash of its key, and a folder ``_bucket=<n>``. Changes are
compared with the rows that are there before anything is written, so a block that is
replayed, or repeats what is known, rewrites nothing.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stored
from .collapse import latest
from .publish import Folder, finish, publish, recover, staging

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.hash(*keys), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is, a change that a crash left half done included."""
    finish(spark, path)
    return spark.read.parquet(path).drop("_bucket")


def _known(spark: SparkSession, path: str, buckets: int) -> DataFrame | None:
    """The table's rows, None for a new table; the number of buckets stays what it was."""
    recover(spark, path)
    folder = Folder(spark, path)
    made = [n for n in folder.names() if n.startswith("_buckets-")]
    if not made:
        folder.write(f"_buckets-{buckets}", ["."])
    elif made != [f"_buckets-{buckets}"]:
        raise ValueError(f"{path} has {made[0].removeprefix('_buckets-')} buckets, not {buckets}")
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _same(left: str, right: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def upsert(changes: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, version: list[str] = (), deleted: str | None = None) -> list[int]:
    """Insert or replace rows by key; returns the buckets that were rewritten.

    Of changes of one key the greatest version counts, and one that is older than what the table holds is left out; without
    versions the table's row gives way, and of several changes of a key any one is taken. Rows marked ``deleted`` go, or, where the version
    must be remembered, name no such column and keep them as rows. A null in a key is a value like another. Columns must be the table's.
    """
    spark = changes.sparkSession
    old = _known(spark, path, buckets)
    names = [c for c in changes.columns if c != deleted]
    if old is not None and sorted(old.drop("_bucket").columns) != sorted(names):
        raise ValueError(f"{path} has the columns {old.drop('_bucket').columns}, not {names}")
    new = latest(changes, keys, version[0], *version[1:]) if version else changes.dropDuplicates(keys)
    new = new.withColumn("_bucket", bucket_of(keys, buckets)).withColumn("_gone", F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)) if deleted else F.lit(False)).select(*names, "_bucket", "_gone")
    if old is None:
        old = spark.createDataFrame([], new.drop("_gone").schema)
        new = stored(new.filter(~F.col("_gone")), "changes")
    else:
        new = stored(new, "changes")
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        both = new.alias("n").join(old.filter(F.col("_bucket").isin(touched)).withColumn("_there", F.lit(True)).alias("o"), (F.col("n._bucket") == F.col("o._bucket")) & _same("n", "o", keys), "left")
        there = F.coalesce(F.col("o._there"), F.lit(False))
        differs = F.when(there, F.col("n._gone") | ~_same("n", "o", names)).otherwise(~F.col("n._gone"))
        if version:
            order = lambda side: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in version))
            differs = differs & (~there | (order("n") >= order("o")))
        new = stored(both.filter(differs).select("n.*"), "changed")
    rewritten = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    if not rewritten:
        return []
    kept = old.filter(F.col("_bucket").isin(rewritten)).alias("o").join(new.alias("n"), (F.col("n._bucket") == F.col("o._bucket")) & _same("n", "o", keys), "left_anti")
    rows = kept.select(*names, "_bucket").unionByName(new.filter(~F.col("_gone")).select(*names, "_bucket"))
    change, staged = staging(spark, path)
    # a bucket is one file, or several where it is more than a task should hold
    rows.hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").parquet(staged)
    publish(spark, path, change, [f"_bucket={b}" for b in rewritten])
    return rewritten


def build_incremental_by_key(source: DataFrame, path: str, keys: list[str], mark: str, buckets: int = BUCKETS, lookback=None, full_refresh: bool = False, transform=None) -> list[int]:
    """An incremental model with a unique key: rows of the source after the newest ``mark`` of the table (less ``lookback``, an
    interval) are transformed and put in its place by key. A full refresh starts anew. Returns the buckets that were rewritten.
    """
    spark, newest = source.sparkSession, None
    folder = Folder(spark, path)
    if full_refresh:
        folder.delete("")
    elif folder.exists():
        old = _known(spark, path, buckets)
        newest = None if old is None else old.agg(F.max(mark)).first()[0]
    if newest is not None:
        source = source.filter(F.col(mark) > F.lit(newest if lookback is None else newest - lookback).cast(source.schema[mark].dataType))
    return upsert(transform(source) if transform else source, path, keys, buckets, [mark])
