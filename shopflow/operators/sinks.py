"""Writing tables: snapshots, partition replacement, appends, incremental builds and maintenance."""

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import differences
from .publish import Folder, publish, recover, staging


def swap(spark: SparkSession, new: str, target: str) -> None:
    """Put the directory ``new`` in the place of ``target``; the old one goes once the new one is there.

    A crash between the two renames leaves the old one under its hidden name; the next call puts it back first.
    """
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{target.rpartition('/')[0]}/_old-{target.rpartition('/')[2]}"
    restore(spark, target)
    fs.delete(path(old), True)
    if fs.exists(path(target)) and not fs.rename(path(target), path(old)):
        raise OSError(f"{target} can't be moved")
    if not fs.rename(path(new), path(target)):
        raise OSError(f"{new} can't be moved to {target}")
    fs.delete(path(old), True)


def restore(spark: SparkSession, target: str) -> bool:
    """Put back what a ``swap`` that was cut off has moved away; returns whether there was anything to do."""
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = path(f"{target.rpartition('/')[0]}/_old-{target.rpartition('/')[2]}")
    if fs.exists(path(target)) or not fs.exists(old):
        return False
    if not fs.rename(old, path(target)):
        raise OSError(f"{old} can't be moved back")
    return True


def write_snapshot(df: DataFrame, root: str, ds: str, key: str = "dt") -> None:
    """A full snapshot under ``key=<ds>``; writing the same date again replaces it."""
    df.write.mode("overwrite").parquet(f"{root}/{key}={ds}")


def replace_partitions(df: DataFrame, path: str, key: str = "_dt", day: str | None = None) -> None:
    """Replace exactly the partitions that ``df`` has rows of; running it twice changes nothing.

    With ``day`` that partition is replaced whatever ``df`` holds of it, also by no rows; rows of other days are not written.
    """
    if day is not None:
        own = df.filter(F.col(key) == F.lit(day).cast(df.schema[key].dataType)).drop(key)
        own.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{key}={day}")
        return
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def rebuild(df: DataFrame, path: str) -> DataFrame:
    """The whole table anew."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """A view: evaluated when read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_by_month(df: DataFrame, path: str, column: str) -> None:
    """Partitioned by the month of a date; readers filter by the date and prune by the month."""
    df.withColumn(f"{column}_month", F.date_format(column, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(f"{column}_month").parquet(path)


def write_sorted(df: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """Ranges of the keys in files and sorted inside, so that row groups can be skipped."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def append_stamped(df: DataFrame, path: str, now: Column | None = None, rows_per_file: int = 1_000_000) -> None:
    """A full reload as one more version: each row is stamped with when it was loaded."""
    df.withColumn("_loaded_at", F.current_timestamp() if now is None else now).write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(path)


def insert_by_name(df: DataFrame, wanted: T.StructType, path: str) -> None:
    """Append with columns matched by name, whatever their order; other definitions are refused."""
    if found := differences(df.select(*[c for c in wanted.names if c in df.columns]), wanted):
        raise ValueError(f"not the declared table: {found}")
    df.select(*wanted.names).write.mode("append").parquet(path)


def insert_if_absent(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The existing rows, and of the new ones those whose key is not there yet, one for each key."""
    return existing.unionByName(new.dropDuplicates(list(keys)).join(existing, list(keys), "left_anti").select(*existing.columns))


def ensure_table(spark: SparkSession, name: str, wanted: T.StructType, partition: str | None = None, path: str | None = None) -> None:
    """Create a table unless it is there; one that is there must have the declared definition."""
    if spark.catalog.tableExists(name):
        if found := differences(spark.table(name), wanted):
            raise ValueError(f"{name} differs from its definition: {found}")
        return
    by = f" PARTITIONED BY ({partition})" if partition else ""
    spark.sql(f"CREATE TABLE {name} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in wanted)}) USING parquet{by}" + (f" LOCATION '{path}'" if path else ""))


def insert_values(spark: SparkSession, name: str, *rows: tuple) -> None:
    """Append literal rows to a table, in the order of its columns."""
    spark.createDataFrame(list(rows), spark.table(name).schema).write.insertInto(name)


def add_column(spark: SparkSession, name: str, column: str, kind: str) -> None:
    """Add a column unless it is there; old rows read null."""
    if column not in spark.table(name).columns:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({column} {kind})")


def delete_where(df: DataFrame, condition: Column, target: str) -> DataFrame:
    """All rows but those that meet the condition, written to a new path (a table can't overwrite what it reads)."""
    df.filter(~F.coalesce(condition, F.lit(False))).write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)


def delete_in_place(spark: SparkSession, path: str, condition: Column) -> DataFrame:
    """``delete_where`` on a table's own path: what stays is written beside it and then put in its place."""
    beside = f"{path.rpartition('/')[0]}/_kept-{path.rpartition('/')[2]}"
    delete_where(spark.read.parquet(path), condition, beside)
    swap(spark, beside, path)
    return spark.read.parquet(path)


def since(source: DataFrame, column: str, mark) -> DataFrame:
    """Rows after a high-water mark; the filter reaches the scan."""
    return source if mark is None else source.filter(F.col(column) > F.lit(mark))


def build_incremental(spark: SparkSession, source: DataFrame, path: str, key: Column, name: str, aggregate, lookback_days: int = 0, full_refresh: bool = False, raw: str | None = None) -> None:
    """Recompute the days from the last one (less ``lookback_days``) onward and replace just those.

    ``aggregate`` takes the source with the day column ``name`` and returns a row per day. ``raw`` names the time column
    that the day is taken of: the same range on it reaches the scan.
    """
    newest = None
    if not full_refresh:
        try:
            newest = spark.read.parquet(path).agg(F.max(name)).first()[0]
        except Exception as e:  # noqa: BLE001  a first run has no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    rows = source.withColumn(name, key)
    if newest is not None:
        first = newest - timedelta(days=lookback_days)
        rows = rows.filter(F.col(name) >= F.lit(first))
        if raw is not None:
            rows = rows.filter(F.col(raw) >= F.lit(datetime.combine(first, time())).cast(source.schema[raw].dataType))
    mode = "static" if newest is None else "dynamic"  # a first or full build replaces the whole table
    aggregate(rows).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(name).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by a join key: two such tables join without a shuffle."""
    df.write.mode("overwrite").options(**({"path": path} if path else {})).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def compact(spark: SparkSession, path: str, target: str, file_bytes: int = 128 << 20, sizes: list[int] | None = None) -> int:
    """Rewrite small files as few of about ``file_bytes``; returns how many were aimed at."""
    df = spark.read.parquet(path)
    if sizes is None:
        sizes = [r[0] for r in df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).groupBy("f").agg(F.first("s").alias("s")).agg(F.sum("s")).collect()]
    files = max(1, -(-int(sum(s or 0 for s in sizes)) // file_bytes))
    df.repartition(files).write.mode("overwrite").parquet(target)
    return files


def bins(sizes: dict[str, int], file_bytes: int) -> list[list[str]]:
    """Files under half of ``file_bytes`` put together, largest first, each into the first bin that has room; bins of one file are left out."""
    made: list[tuple[int, list[str]]] = []
    for name, size in sorted(((n, s) for n, s in sizes.items() if 2 * s < file_bytes), key=lambda x: (-x[1], x[0])):
        at = next((i for i, (used, _) in enumerate(made) if used + size <= file_bytes), None)
        if at is None:
            made.append((size, [name]))
        else:
            made[at] = (made[at][0] + size, made[at][1] + [name])
    return [names for _, names in made if len(names) > 1]


def compact_small(spark: SparkSession, path: str, *order: str, file_bytes: int = 128 << 20) -> int:
    """Merge the small files of each partition, in place; returns how many files went.

    Files are packed into bins by their bytes, and a bin becomes one file whose rows are in ``order``, as those of sorted files were.
    Large files stay as they are. What replaces what is decided before any file moves, so a crash is made good by ``recover``.
    """
    recover(spark, path)
    folder, by_folder = Folder(spark, path), {}
    for name, size in folder.files().items():
        by_folder.setdefault(name.rpartition("/")[0], {})[name] = size
    packed = [names for sizes in by_folder.values() for names in bins(sizes, file_bytes)]
    if not packed:
        return 0
    keys = [x.split("=", 1)[0] for x in packed[0][0].split("/")[:-1]]
    small = [n for names in packed for n in names]
    short = lambda n: "/".join(folder.at(n).toUri().getRawPath().split("/")[-len(keys) - 1 :])  # noqa: E731  as Spark shows a file
    of = spark.createDataFrame([(short(n), i) for i, names in enumerate(packed) for n in names], "_name string, _bin int")
    rows = spark.read.option("basePath", path).parquet(*(f"{path.rstrip('/')}/{n}" for n in small)).withColumn("_file", F.substring_index("_metadata.file_path", "/", -len(keys) - 1))
    rows = rows.join(of, F.col("_file") == F.col("_name")).drop("_file", "_name")
    change, staged = staging(spark, path)
    binned = rows.repartitionById(len(packed), F.col("_bin")).sortWithinPartitions(*keys, *order).drop("_bin")
    (binned.write.partitionBy(*keys) if keys else binned.write).parquet(staged)
    publish(spark, path, change, small)
    return len(small)


def drop_before(spark: SparkSession, table: str, column: str, today: date, days: int) -> list[str]:
    """Retention: drop whole partitions older than ``days``, of external tables their files too; returns them."""
    cutoff = (today - timedelta(days=days)).isoformat()
    found = [dict(x.split("=", 1) for x in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = sorted({p[column] for p in found if p[column] < cutoff})
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    for day in old:  # with whatever partitions lie below it
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column}='{day}')")
        if about["Type"] == "EXTERNAL":
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{about['Location']}/{column}={day}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if old:
        spark.catalog.refreshTable(table)
    return [f"{column}={day}" for day in old]
