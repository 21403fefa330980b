"""Change data: envelopes to versioned rows, landing, current state, typed replicas."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import first_non_zero
from ..operators.collapse import current_state
from ..operators.upsert import BUCKETS, read_table, upsert
from .events import for_each_available

ENVELOPE = "op string, source struct<table: string, ts_ms: bigint>, ts_ms bigint, before struct<id: bigint>, after struct<id: bigint>"


def decode(values: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """source_table, id, op, payload, _version, _deleted (and the tiebreak column) of envelopes in ``value``.

    A delete keeps what was before, anything else what is after; the payload is
    the record's own JSON. The version is the event's own time, or where that is
    missing or 0 the source's. Tombstones, messages without a key and malformed ones
    are left out; ``rejected`` gives them.
    """
    e = values.withColumn("e", F.from_json("value", ENVELOPE))
    gone = F.col("e.op") == "d"
    out = e.select(
        F.coalesce("e.source.table", F.lit("?")).alias("source_table"), F.when(gone, F.col("e.before.id")).otherwise(F.col("e.after.id")).alias("id"), F.col("e.op").alias("op"),
        F.when(gone, F.get_json_object("value", "$.before")).otherwise(F.get_json_object("value", "$.after")).alias("payload"),
        first_non_zero(F.col("e.ts_ms"), F.col("e.source.ts_ms")).alias("_version"), F.coalesce(gone, F.lit(False)).alias("_deleted"), *([tiebreak] if tiebreak else []),
    )
    return out.filter("id IS NOT NULL")


def rejected(values: DataFrame) -> DataFrame:
    e = values.withColumn("e", F.from_json("value", ENVELOPE))
    key = F.when(F.col("e.op") == "d", F.col("e.before.id")).otherwise(F.col("e.after.id"))
    return e.filter(key.isNull()).select("value")


def land(path: str):
    """For foreachBatch: a batch is one partition, so a replayed batch replaces itself. ``_position`` is the place in the batch."""

    def act(batch: DataFrame, batch_id: int) -> None:
        rows = decode(batch.withColumn("_position", F.monotonically_increasing_id()), "_position")
        rows.withColumn("_batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(path)

    return act


def current(landed: DataFrame, *tiebreak: str) -> DataFrame:
    """Live rows. Of changes of one version the last to arrive counts, in what ``land`` has written; elsewhere name the columns that decide."""
    tiebreak = tiebreak or tuple(c for c in ("_batch_id", "_position") if c in landed.columns)
    return current_state(landed, ["source_table", "id"], "_version", *tiebreak)


def counts(landed: DataFrame, *tiebreak: str) -> DataFrame:
    """Live rows of each source table."""
    return current(landed, *tiebreak).groupBy("source_table").agg(F.count("*").alias("live_rows"))


def replica(landed: DataFrame, table: str, schema: T.StructType, *tiebreak: str) -> DataFrame:
    """The typed rows of one source table, rebuilt from payloads."""
    rows = current(landed.filter(F.col("source_table") == table), *tiebreak)
    return rows.select(F.from_json("payload", schema).alias("r")).select("r.*")


def keep_current(values: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, position: str | None = None) -> None:
    """Carry the current state forward: what a stream of envelopes changes is put into a table by key, and nothing else is read or written.

    The table is the state, one row per key, so the stream holds none in memory. Versions decide, of equal ones the last to arrive:
    ``_arrived`` is the time of its batch, which a replay keeps. Within a batch the column ``position`` decides, such as a broker's
    offset; without one, or with ties in it, a delete and then the greatest payload. Deleted keys stay as rows, so that no
    older change brings them back. A replayed batch finds its rows there and rewrites nothing.
    """
    rows = decode(values, position).withColumn("_arrived", F.current_timestamp()).withColumn("_position", F.col(position) if position else F.lit(0))
    rows = rows.select("source_table", "id", "op", "payload", "_version", "_deleted", "_arrived", "_position")
    act = lambda batch, batch_id: upsert(batch, path, ["source_table", "id"], buckets, ["_version", "_arrived", "_position", "_deleted", "payload"])
    for_each_available(rows, act, checkpoint)


def kept(spark: SparkSession, path: str, table: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Live rows of a table that ``keep_current`` keeps; with a source table and a schema its typed rows."""
    rows = read_table(spark, path).filter(~F.col("_deleted"))
    if table is None:
        return rows
    return rows.filter(F.col("source_table") == table).select(F.from_json("payload", schema).alias("r")).select("r.*")
