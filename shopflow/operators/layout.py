"""How rows are spread over a distribution key."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import at_most
from ..sources.storage import stored


def distribution(df: DataFrame, segment: Column) -> DataFrame:
    """segment, rows, and the ratio of the largest segment to the mean."""
    rows = df.groupBy(segment.alias("segment")).agg(F.count("*").alias("rows"))
    total = rows.agg((F.max("rows") / F.avg("rows")).alias("skew"))
    return rows.join(F.broadcast(total))


def hash_segment(key: str, n: int) -> Column:
    return F.pmod(F.hash(key), F.lit(n))


def dense_id(df: DataFrame, name: str, *order: str, keep: list[Column] | None = None) -> DataFrame:
    """1 to n in an order, without a window over all rows: ranges are sorted, and each begins after the rows of those before it.

    With ``keep`` only those columns, made of the sorted rows, are stored and given.
    """
    place, part = F.monotonically_increasing_id(), F.shiftright("_place", 33)
    kept = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(["*"] if keep is None else keep), place.alias("_place")), "numbered")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_start"))
    # a row for each partition of the range
    return kept.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_place", "_part", "_start")


def placed(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Adds ``_place``, the number of a row in its group's order from 0, and ``_rows``, the rows of its group, without a window over a group.

    Ranges of keys and order are sorted; a row's place is its place in the range and the rows of its group in the ranges before. A null is a key like another.
    """
    group, names = F.struct(*keys), df.columns
    at, part = F.monotonically_increasing_id(), F.shiftright("_at", 33)
    kept = stored(df.withColumn("_row", at).repartitionByRange(*keys, *order, "_row").sortWithinPartitions(*keys, *order, "_row").drop("_row").withColumn("_at", at).withColumn("_group", group), "placed")
    # a row for each group and range
    runs = kept.groupBy("_group", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(runs.select(F.col("_group").alias("_of"), F.col("_part").alias("_in"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_rows")), "starts")
    both = kept.join(starts, (F.col("_group") == F.col("_of")) & (part == F.col("_in")))
    return both.select(*names, (F.col("_at") + F.col("_shift")).alias("_place"), "_rows")


def exact_quantiles(df: DataFrame, keys: list[str], column: str, ranks: dict[str, float]) -> DataFrame:
    """Keys and, by name, the exact values at given ranks of a group, between two rows interpolated; nulls don't count, a group of nulls has no row.

    By sorted ranges and places in them: no group is gathered, whatever its size, and only the rows beside a rank go on.
    """
    value = F.col(column).cast("double")
    rows = placed(df.filter(F.col(column).isNotNull()).select(*keys, value.alias("_value")), keys, "_value")
    exact = {name: F.col("_rows").cast("double") * F.lit(p) - F.lit(p) for name, p in ranks.items()}
    ends = [end(x) for x in exact.values() for end in (F.floor, F.ceil)]
    beside = rows.filter(F.array_contains(F.array(*ends), F.col("_place")))

    def between(x: Column) -> Column:
        low, high = (F.max(F.when(F.col("_place") == end(x), F.col("_value"))) for end in (F.floor, F.ceil))
        return low + (high - low) * F.max(x - F.floor(x))

    return beside.groupBy(*keys).agg(*(between(x).alias(name) for name, x in exact.items()))


def with_curve(df: DataFrame, columns: list[str], name: str = "_curve", bits: int = 10) -> DataFrame:
    """Adds a row's place on a curve through all columns at once: the bits of its ranks, of each column in turn.

    Ranks are those of ``2 ** bits`` ranges of about as many rows, by approximate quantiles in one pass. Columns are numbers, dates or times; null has rank 0.
    """
    times = ("date", "timestamp", "timestamp_ntz")
    kind = lambda c: df.schema[c].dataType.typeName()
    if bad := [c for c in columns if kind(c) in ("string", "binary", "array", "map", "struct", "boolean")]:
        raise ValueError(f"no numbers or times: {bad}")
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kind(c) in times else F.col(c).cast("double")
    wanted = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*(F.percentile_approx(number(c), wanted, 10 * 2**bits).alias(c) for c in columns)).first()
    ranks = {f"_rank{j}": at_most(sorted(set(found[c] or [])), number(c)).cast("long") for j, c in enumerate(columns)}
    place = F.lit(0).cast("long")
    for j, rank in enumerate(ranks):
        for b in range(bits):
            place = place + F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + j)
    return df.withColumns(ranks).withColumn(name, place).drop(*ranks)


def write_clustered(df: DataFrame, path: str, *columns: str, files: int | None = None, bits: int = 10) -> None:
    """Files and row groups that hold a small range of each of several columns, so that a filter on any of them skips most."""
    rows = with_curve(df, list(columns), bits=bits)
    ranged = rows.repartitionByRange(files, "_curve") if files else rows.repartitionByRange("_curve")
    ranged.sortWithinPartitions("_curve", *columns).drop("_curve").write.mode("overwrite").parquet(path)


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of all columns for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
