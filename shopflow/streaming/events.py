"""The click stream: ingest, quarantine, windows, deduplication, late events, progress."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import decode_events


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """The event time as a zoned timestamp, which watermarks ask for."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append what is there now to a table and stop; the checkpoint remembers what was read."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def for_each_available(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = stream.writeStream.foreachBatch(act).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def split_malformed(values: DataFrame, schema: T.StructType, required: str) -> tuple[DataFrame, DataFrame]:
    """(good events, quarantined messages): a message that can't be parsed never stops the stream."""
    parsed = values.select("value", decode_events(F.col("value"), schema).alias("e"))
    good = F.col(f"e.{required}").isNotNull()
    return parsed.filter(good).select("e.*"), parsed.filter(~F.coalesce(good, F.lit(False))).select("value")


def per_window(events: DataFrame, length: str, step: str | None = None, *keys: str, column: str = "ts") -> DataFrame:
    """window_start, keys, events: tumbling, or hopping if a step is given."""
    return events.groupBy(F.window(column, length, step).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), *keys, "events")


def with_lateness(events: DataFrame, allowed: str, column: str = "ts") -> DataFrame:
    """Events later than the watermark less ``allowed`` are dropped by what follows."""
    return events.withWatermark(column, allowed)


def deduplicated(events: DataFrame, key: str, within: str, column: str = "ts") -> DataFrame:
    """The first of each key, remembered for ``within`` of event time, so state is bounded."""
    return events.withWatermark(column, within).dropDuplicatesWithinWatermark([key])


def route_late(batch: DataFrame, batch_id: int, on_time: str, late: str | None = None, column: str = "ts", allowed_seconds: int = 0, policy: str = "side") -> None:
    """Land a batch by its lateness against the newest event of the batches before it, which is read from the table itself.

    ``drop`` leaves late events out, ``side`` puts them in the table ``late``, ``update`` lands them with the others, so that
    a recomputation of their bucket counts them. Both tables keep a batch under its number: a replay replaces it.
    """
    if policy not in ("drop", "side", "update") or (policy == "side" and late is None):
        raise ValueError(f"no such policy, or no table for it: {policy}")
    spark, mark = batch.sparkSession, None
    if batch_id:
        try:
            mark = spark.read.parquet(on_time).filter(F.col("_batch_id") < batch_id).agg(F.max(column)).first()[0]
        except AnalysisException as e:  # no batch has landed yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    is_late: Column = F.lit(False) if mark is None else F.coalesce(F.col(column) < F.lit(mark) - F.expr(f"INTERVAL {allowed_seconds} SECONDS"), F.lit(False))
    targets = {on_time: (lambda b: b) if policy == "update" else (lambda b: b.filter(~is_late))}
    if policy == "side":
        targets[late] = lambda b: b.filter(is_late)
    publish(batch, targets, batch_id)


def publish(batch: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], batch_id: int) -> None:
    """One block of input to several tables, replay-safe: each table keeps the block under its number."""
    batch = batch.persist()
    try:
        for path, make in targets.items():
            out = make(batch).withColumn("_batch_id", F.lit(batch_id).cast("long"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(path)
    finally:
        batch.unpersist()


def lag(events: DataFrame, now: Column, column: str = "ts") -> DataFrame:
    """Newest event, seconds behind, and how late the latest-arriving event was."""
    behind = lambda c: F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))
    return events.agg(F.max(column).alias("max_ts"), behind(F.max(column)).alias("lag_seconds"), F.max(behind(F.col(column))).alias("max_lateness_seconds"))


def progress(table: DataFrame) -> DataFrame:
    """Rows of each micro-batch."""
    return table.groupBy("_batch_id").agg(F.count("*").alias("rows"))


def by_key(stream: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows of one key go to one partition, in order of arrival within a batch."""
    return stream.repartition(parts, key)
