"""Joins beyond the plain equi join."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import at_most
from ..sources.storage import stored

#: A side is broadcast on request only up to this many bytes.
BROADCAST_BYTES = 16 << 20


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Child rows whose parent is missing; null foreign keys are no violation."""
    keys = parent.select(F.col(key).alias(foreign)).distinct()
    return child.filter(F.col(foreign).isNotNull()).join(keys, foreign, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """How many ``orphans`` there are, as ``failures``: rows are counted by key before they move, and nothing is sorted."""
    if child.schema[foreign].dataType != parent.schema[key].dataType:
        return orphans(child, parent, foreign, key).agg(F.count("*").alias("failures"))
    own = child.select(F.col(foreign).alias("_key"), F.lit(1).cast("long").alias("_n"), F.lit(False).alias("_known"))
    known = parent.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_known"))
    by_key = own.unionByName(known).filter("_key IS NOT NULL").groupBy("_key").agg(F.sum("_n").alias("_n"), F.max("_known").alias("_known"))
    return by_key.filter(~F.col("_known")).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("failures"))


def valid_at(facts: DataFrame, history: DataFrame, key: str, ts: str, valid_from: str = "valid_from", valid_to: str = "valid_to", how: str = "left") -> DataFrame:
    """Each fact with the version of its key that was valid at its time.

    The equality on the key keeps this a hash or merge join, the interval is a
    residual condition. Intervals are half-open, so an instant of change belongs
    to the newer version only.
    """
    h = history.withColumnRenamed(key, "_key")
    inside = (F.col(ts) >= F.col(valid_from)) & (F.col(valid_to).isNull() | (F.col(ts) < F.col(valid_to)))
    return facts.join(h, (F.col(key) == F.col("_key")) & inside, how).drop("_key")


def salted(facts: DataFrame, dimension: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose hot keys are spread over ``salts`` tasks: facts get a salt, dimension rows one copy for each.

    For joins where adaptive skew handling does not apply, such as those that feed
    an aggregate on the key.
    """
    if how not in ("inner", "left"):
        raise ValueError("the salted side must be the left one")
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    right = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, key: str, tasks: int, share: float = 0.25, most: int = 1000) -> DataFrame:
    """hot_key, heat: the keys with more than ``share`` of an even task's rows when rows go to ``tasks`` of them, and how many even tasks' rows they have.

    Frequencies come from a sketch that is made before the shuffle, of ``16 * most`` counters: whatever is hot is among them, and a count may be too high by
    rows / (12 * most) at most. At most ``most`` rows, so the result may be broadcast. Null is never hot: it joins with nothing.
    """
    found = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {most}, {16 * most})").alias("top"), F.count("*").alias("rows"))
    counted = found.select(F.inline("top"), "rows").select(F.col("item").alias("hot_key"), (F.col("count") * tasks / F.col("rows")).alias("heat"))
    return counted.filter(F.col("heat") > share)


def salted_by_heat(facts: DataFrame, dimension: DataFrame, key: str, tasks: int | None = None, pieces: int = 8, how: str = "inner") -> DataFrame:
    """A join whose hot keys, and only they, are spread, in proportion to their rows.

    A hot key gets ``pieces`` salts for each even task's rows that it has, so that it spreads evenly whatever tasks its salts fall to;
    its rows of the dimension are copied as often. Other keys keep salt 0 and one copy. Keys are measured first, by one pass over the key column.
    """
    if how not in ("inner", "left"):
        raise ValueError("the salted side must be the left one")
    tasks = tasks or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(hot_keys(facts, key, tasks).select("hot_key", F.ceil(F.col("heat") * pieces).cast("int").alias("_salts")), "hot-keys")
    hot = F.broadcast(found)  # a bounded number of keys
    n = F.coalesce("_salts", F.lit(1))
    left = facts.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("_salt", F.pmod(F.xxhash64(*facts.columns, F.monotonically_increasing_id()), n).cast("int")).drop("hot_key", "_salts")
    right = dimension.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("hot_key", "_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def as_of(facts: DataFrame, history: DataFrame, key: str, ts: str, valid_from: str = "valid_from", valid_to: str = "valid_to", tasks: int | None = None, slices: int = 256) -> DataFrame:
    """``valid_at`` by merging: facts and versions in one order of time, each fact with the last version before it.

    The work is that of one sort, where a join by key compares each fact with all versions of its key. Versions of a key must not
    overlap, as histories' don't; gaps are allowed, and versions that end where they begin are never valid. A key with many rows is cut
    into slices of time, and a version goes to every slice that it touches; bounds of slices are quantiles of the facts' times. All facts are kept.
    """
    spark = facts.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(hot_keys(facts.unionByName(history.select(key), allowMissingColumns=True), key, tasks, share=1.0).select("hot_key"), "hot-keys")
    bounds = []
    if found.head(1):
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        wanted = [i / slices for i in range(1, slices)]
        bounds = sorted(set(facts.join(F.broadcast(found), F.col(key) == F.col("hot_key"), "left_semi").agg(F.percentile_approx(micros, wanted, 10_000)).first()[0] or []))

    slice_of = lambda time: at_most(bounds, F.unix_micros(time.cast("timestamp")))

    def dealt(rows: DataFrame, first: Column, last: Column | None = None) -> DataFrame:
        """With the slice of a row, 0 for keys that are not hot; or with all slices from the first to the last."""
        if not bounds:
            return rows.withColumn("_slice", F.lit(0))
        marked = rows.join(F.broadcast(found), F.col(key) == F.col("hot_key"), "left")
        hot = F.col("hot_key").isNotNull()
        if last is None:
            return marked.withColumn("_slice", F.when(hot, first).otherwise(0)).drop("hot_key")
        return marked.withColumn("_slice", F.explode(F.when(hot, F.sequence(first, last)).otherwise(F.array(F.lit(0))))).drop("hot_key")

    extra = [c for c in history.columns if c != key]
    version = F.struct(*(F.col(c) for c in extra))
    able = facts[key].isNotNull() & facts[ts].isNotNull()
    h = history.filter(F.col(key).isNotNull() & F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (F.col(valid_from) < F.col(valid_to))))
    ends = F.when(F.col(valid_to).isNull(), F.lit(len(bounds))).otherwise(slice_of(F.col(valid_to))) if bounds else F.lit(0)
    kind = facts.schema[ts].dataType
    f = dealt(facts.filter(able).select(key, F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(h.select(version.alias("v")).schema["v"].dataType).alias("_version")), slice_of(F.col("_ts")) if bounds else F.lit(0))
    v = dealt(h.select(key, F.col(valid_from).cast(kind).alias("_ts"), F.lit(0).alias("_kind"), F.lit(None).cast(f.schema["_fact"].dataType).alias("_fact"), version.alias("_version"), *([ends.alias("_last")] if bounds else [])), slice_of(F.col("_ts")) if bounds else F.lit(0), F.col("_last") if bounds else None).drop("_last")
    so_far = Window.partitionBy(key, "_slice").orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = v.unionByName(f).withColumn("_last", F.last("_version", ignorenulls=True).over(so_far)).filter("_kind = 1")
    until = F.col(f"_last.{valid_to}")
    valid = F.when(until.isNull() | (F.col("_ts") < until), F.col("_last"))
    out = merged.select("_fact.*", valid.alias("_last")).select(*facts.columns, *(F.col(f"_last.{c}").alias(c) for c in extra))
    return out.unionByName(facts.filter(~able), allowMissingColumns=True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hinted for broadcast if the optimizer's estimate of its bytes is small, else as it is; nothing is run for it.

    Without statistics the estimate comes from the bytes of the files, which are compressed: the bound leaves room for that.
    """
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most else df
