"""Collapsing by key: latest versions, rollups from partial states, history of changes, tags."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .publish import Folder, publish, recover, staging

def latest(df: DataFrame, keys: list[str], version: str, *tiebreak: str | None) -> DataFrame:
    """One row per key: the greatest version, ties by ``tiebreak``. The rank filter also runs before the shuffle."""
    order = [F.col(c).desc_nulls_last() for c in (version, *tiebreak) if c]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def latest_values(df: DataFrame, keys: list[str], version: Column, columns: list[str]) -> DataFrame:
    """The same as an aggregate, for few columns."""
    return df.groupBy(*keys).agg(*(F.max_by(c, version).alias(c) for c in columns))


def current_state(df: DataFrame, keys: list[str], version: str, *tiebreak: str | None, deleted: str = "_deleted") -> DataFrame:
    """Live rows: collapse first, then drop deleted ones, or a deleted key would come back by an older version."""
    return latest(df, keys, version, *tiebreak).filter(~F.col(deleted).cast("boolean"))


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("raw_count"), F.count_distinct(key).alias("deduped_count"))


#: Size of quantile sketches: ranks are right to about 0.4 per cent.
QUANTILE_K = 800


def partials(df: DataFrame, keys: list[str], sums: dict[str, str] | None = None, distinct: dict[str, str] | None = None, quantiles: dict[str, str] | None = None) -> DataFrame:
    """States of one block of rows: counts and sums as numbers, distinct counts and quantiles as sketches."""
    states = [F.count("*").alias("count_state")]
    states += [F.sum(c).alias(f"{name}_state") for name, c in (sums or {}).items()]
    states += [F.hll_sketch_agg(c).alias(f"{name}_sketch") for name, c in (distinct or {}).items()]
    states += [F.kll_sketch_agg_double(F.col(c).cast("double"), QUANTILE_K).alias(f"{name}_kll") for name, c in (quantiles or {}).items()]
    return df.groupBy(*keys).agg(*states)


def merged(states: DataFrame, keys: list[str], sums: list[str] = (), distinct: list[str] = (), quantiles: dict[str, list[float]] | None = None) -> DataFrame:
    """The result of all blocks' states; of ``quantiles`` an array of the values at the given ranks, null without values."""
    out = [F.sum("count_state").alias("count")]
    out += [F.sum(f"{n}_state").alias(n) for n in sums]
    out += [F.hll_sketch_estimate(F.hll_union_agg(f"{n}_sketch")).alias(n) for n in distinct]
    for n, ranks in (quantiles or {}).items():
        state = F.kll_merge_agg_double(f"{n}_kll")
        values = F.kll_sketch_get_quantile_double(state, F.array(*(F.lit(float(r)) for r in ranks)))
        out.append(F.when(F.kll_sketch_get_n_double(state) > 0, values).alias(n))
    return states.groupBy(*keys).agg(*out)


def append_states(states: DataFrame, path: str, batch: int) -> None:
    """States of a block under its number: a block that is replayed replaces itself."""
    states.withColumn("_batch_id", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(path)


def split_at(df: DataFrame, column: str, boundary: Column) -> tuple[DataFrame, DataFrame]:
    """(back-fill, live): what a back-fill takes before the boundary and the stream from it on, without gap or overlap."""
    return df.filter(F.col(column) < boundary), df.filter(F.col(column) >= boundary)


def history_of(changes: DataFrame, key: str, ts: str, tracked: list[str], tiebreak: str | None = None) -> DataFrame:
    """Type-2 history from an ordered log: rows that change a tracked column, valid from their time to the next one's."""
    w = Window.partitionBy(key).orderBy(ts, *([tiebreak] if tiebreak else []))
    state = F.struct(*tracked)
    first = F.row_number().over(w) == 1
    kept = changes.withColumn("_new", first | ~state.eqNullSafe(F.lag(state).over(w))).filter("_new").drop("_new")
    out = kept.withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(w))
    return out.withColumn("is_current", F.col("valid_to").isNull())


def scd2_merge(history: DataFrame, snapshot: DataFrame, key: str, tracked: list[str], now: Column, close_missing: bool = False) -> DataFrame:
    """One step of a type-2 history: changed keys are closed at ``now`` and opened anew.

    Keys that are missing from the snapshot stay open unless ``close_missing``.
    """
    closed = history.filter(F.col("valid_to").isNotNull())
    open_ = history.filter(F.col("valid_to").isNull()).alias("o")
    both = open_.join(snapshot.alias("s"), F.col(f"o.{key}") == F.col(f"s.{key}"), "full")
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    gone, fresh = F.col(f"s.{key}").isNull(), F.col(f"o.{key}").isNull()
    ends = ~fresh & F.when(gone, F.lit(close_missing)).otherwise(~same)
    kind = history.schema["valid_to"].dataType
    old = both.filter(~fresh).select(*(F.col(f"o.{c}") for c in history.columns if c not in ("valid_to", "is_current")), F.when(ends, now).cast(kind).alias("valid_to"), (~ends).alias("is_current"))
    new = both.filter(~gone & (fresh | ~same)).select(F.col(f"s.{key}"), *(F.col(f"s.{c}") for c in tracked), now.cast(kind).alias("valid_from"), F.lit(None).cast(kind).alias("valid_to"), F.lit(True).alias("is_current"))
    return closed.unionByName(old).unionByName(new)


def scd2_merge_into(snapshot: DataFrame, path: str, key: str, tracked: list[str], now: Column, close_missing: bool = False) -> DataFrame:
    """``scd2_merge`` on a stored history, in place; returns the history.

    Open versions are in one folder and closed ones in another. A step reads and replaces the open ones, of which there is one for each key, and
    adds the versions that it closes; files of closed versions are never read or written again. ``recover`` makes a crash good.
    """
    spark = snapshot.sparkSession
    recover(spark, path)
    folder, kind = Folder(spark, path), snapshot.select(now.alias("now")).schema["now"].dataType
    old = [f for f in folder.files() if f.startswith("_open=true/")]
    if old:
        open_ = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/_open=true").drop("_open")
    else:
        open_ = snapshot.select(key, *tracked).limit(0).withColumns({"valid_from": now.cast(kind), "valid_to": F.lit(None).cast(kind), "is_current": F.lit(True)})
    merged_ = scd2_merge(open_, snapshot, key, tracked, now, close_missing).withColumn("_open", F.col("valid_to").isNull())
    change, staged = staging(spark, path)
    merged_.write.partitionBy("_open").parquet(staged)
    publish(spark, path, change, old)
    return spark.read.parquet(path).drop("_open")


def surrogate_key(*columns: Column) -> Column:
    """A stable key of a version: a hash of the natural key and when it became valid."""
    return F.md5(F.concat_ws(":", *(c.cast("string") for c in columns)))


def previous_value(changes: DataFrame, key: str, ts: str, column: str, tiebreak: str | None = None) -> DataFrame:
    """Type 3: the current value and the one before it."""
    w = Window.partitionBy(key).orderBy(ts, *([tiebreak] if tiebreak else []))
    history = changes.withColumn(f"previous_{column}", F.lag(column).over(w))
    return latest(history, [key], ts, tiebreak).select(key, column, f"previous_{column}")


def hybrid(history: DataFrame, key: str, column: str) -> DataFrame:
    """Type 6: every version with the current value beside its own."""
    now = history.filter("is_current").select(key, F.col(column).alias(f"current_{column}"))
    return history.join(now, key, "left")


def as_of_tag(log: DataFrame, tags: DataFrame, tag: str, keys: list[str], tiebreak: str | None = None) -> DataFrame:
    """The table as it was at a named version, while the log goes on."""
    version = tags.filter(F.col("tag") == tag).select(F.col("version").alias("_tagged"))
    return latest(log.join(F.broadcast(version.limit(1)), F.col("_version") <= F.col("_tagged")).drop("_tagged"), keys, "_version", tiebreak)
