"""Scans: partitioned trees, single snapshots, CSV, databases, JSON queues, series, inventories."""

import re
import time
from collections import Counter
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_TIME = {"timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def read_tree(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Every partition of a Hive-style tree; the partition key becomes a column and is pruned by filters."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(root)


def read_snapshot(spark: SparkSession, root: str, ds: str, key: str = "dt", column: str = "_dt") -> DataFrame:
    """One snapshot directory; the date comes from the argument and not from the path."""
    return spark.read.parquet(f"{root}/{key}={ds}").withColumn(column, F.lit(ds).cast("date"))


def partition_values(df: DataFrame, key: str) -> dict[str, int]:
    """Values of a partition key with their number of files, from the names of the files that a table's scan has listed; nothing is read."""
    found = re.compile(f"/{re.escape(key)}=([^/]*)/")
    return dict(sorted(Counter(unquote(m[1]) for f in df.inputFiles() if (m := found.search(f))).items()))


def partitions(spark: SparkSession, root: str, key: str = "dt") -> DataFrame:
    """key, rows and files of each partition, from file names and Parquet footers.

    Counts are pushed into the reader, which needs Spark's newer Parquet source; a session of its own has that switched on.
    """
    own = spark.newSession()
    for name, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true"), ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        own.conf.set(name, value)
    df = own.read.parquet(root)
    counted = df.groupBy(key).agg(F.count("*").alias("rows"))
    # a row for each partition
    files = own.createDataFrame(list(partition_values(spark.read.parquet(root), key).items()), "_value string, files long")
    return counted.join(F.broadcast(files), F.col(key).cast("string") == F.col("_value"), "left").select(key, "rows", "files")


def latest_snapshot(df: DataFrame, as_of: str | None = None, column: str = "_dt") -> DataFrame:
    """The rows of one snapshot: the latest, or the latest up to ``as_of``.

    A full snapshot is landed every day, so reading all of them would count each
    order once a day. Dates come from the names of partitions; a day that was landed without rows counts.
    """
    dates = [d for d in partition_values(df, column) if d[:1].isdigit() and (as_of is None or d <= as_of)]
    return df.filter(F.col(column) == F.lit(max(dates)).cast("date")) if dates else df.limit(0)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line, by a declared schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_database(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, key: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 8, fetch: int = 2000, **options) -> DataFrame:
    """A database table in parallel ranges of ``key``, ``fetch`` rows at a time, only the columns asked for."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    df = reader.load()
    return df.select(*columns) if columns else df


def decode_events(value: Column, schema: T.StructType) -> Column:
    """A JSON message by field name: unknown fields are ignored, missing ones null, malformed messages all null."""
    return F.from_json(value, schema, JSON_TIME)


def read_queue(spark: SparkSession, path: str, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """A stream of JSON lines as ``value``; the file source stands in for a broker's topic."""
    limits = {"maxFilesPerTrigger": files_per_batch, "maxBytesPerTrigger": bytes_per_batch}
    return spark.readStream.format("text").options(**{k: v for k, v in limits.items() if v}).load(path)


def drain(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, most: int = 100_000, idle_seconds: float = 5.0) -> int:
    """Read a queue from where the last run stopped until nothing new comes for a while, or ``most`` messages have been
    read; returns how many. Batches are read whole, so a run passes the bound by less than two of them; the rest, and a batch
    that the stop interrupts, is read by the next run.
    """
    read, quiet_since = 0, time.monotonic()

    def counted(batch: DataFrame, batch_id: int) -> None:
        nonlocal read, quiet_since
        seen = Observation()
        act(batch.observe(seen, F.count(F.lit(1)).alias("n")), batch_id)
        read += seen.get["n"]
        quiet_since = time.monotonic()

    query = stream.writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        while query.isActive and read < most and time.monotonic() - quiet_since < idle_seconds:
            query.awaitTermination(0.2)
    finally:
        query.stop()
    if read < most and query.exception() is not None:
        raise query.exception()
    return read


def series(spark: SparkSession, n: int, name: str = "n") -> DataFrame:
    """1 to n."""
    return spark.range(1, n + 1).select(F.col("id").alias(name))
