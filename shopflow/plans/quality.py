"""Data tests: each gives the offending rows and passes when there are none."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import orphan_count, orphans


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; null is not a value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return orphans(df, parent, column, key)


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Null passes."""
    return df.filter(~F.col(column).isin(values))


def non_negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0)


#: Tests that take (df, column, **parameters); others may be added.
TESTS: dict[str, Callable[..., DataFrame]] = {"not_null": not_null, "unique": unique, "relationships": relationships, "accepted_values": accepted_values, "non_negative": non_negative}


def report(models: dict[str, DataFrame], tests: list[tuple[str, str, str, dict]]) -> DataFrame:
    """test, model, column_name, failures of (test, model, column, parameters) rows.

    All not-null tests of a model are one aggregate over one scan of it, and all unique tests of it one count of (column, value), as
    text only where columns differ in type. Orphans are counted by key.
    """
    out = None
    nulls: dict[str, list[str]] = {}
    keys: dict[str, list[str]] = {}
    for test, model, column, _ in tests:
        if test == "not_null":
            nulls.setdefault(model, []).append(column)
        if test == "unique":
            keys.setdefault(model, []).append(column)
    for model, columns in keys.items():
        alike = len({models[model].schema[c].dataType.simpleString() for c in columns}) == 1
        values = [F.struct(F.lit(c).alias("column_name"), (F.col(c) if alike else F.col(c).cast("string")).alias("value")) for c in columns]
        pairs = models[model].select(F.inline(F.array(*values)) if len(values) > 1 else values[0].alias("v")).select("*" if len(values) > 1 else "v.*")
        twice = pairs.filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n")).filter("n > 1")
        counted = twice.groupBy().agg(*(F.count_if(F.col("column_name") == c).alias(c) for c in columns))
        part = counted.unpivot([], columns, "column_name", "failures").select(F.lit("unique").alias("test"), F.lit(model).alias("model"), "column_name", "failures")
        out = part if out is None else out.unionByName(part)
    for model, columns in nulls.items():
        counted = models[model].agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
        part = counted.unpivot([], columns, "column_name", "failures").select(F.lit("not_null").alias("test"), F.lit(model).alias("model"), "column_name", "failures")
        out = part if out is None else out.unionByName(part)
    for test, model, column, more in tests:
        if test not in ("not_null", "unique"):
            counted = orphan_count(models[model], more["parent"], column, more["key"]) if TESTS[test] is relationships else TESTS[test](models[model], column, **more).agg(F.count("*").alias("failures"))
            part = counted.select(F.lit(test).alias("test"), F.lit(model).alias("model"), F.lit(column).alias("column_name"), "failures")
            out = part if out is None else out.unionByName(part)
    return out


def freshness(df: DataFrame, column: str, now, warn_hours: float, error_hours: float) -> DataFrame:
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(F.col(column).cast("timestamp")))) / 3600
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass")
    return df.agg(age.alias("age_hours")).withColumn("status", status)


def reconcile(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """table_name, source_rows, target_rows, ok."""
    out = None
    for name, (source, target) in pairs.items():
        sides = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(target.select(F.lit(0).alias("s"), F.lit(1).alias("t")))
        part = sides.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("source_rows"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("target_rows"))
        part = part.select(F.lit(name).alias("table_name"), "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out


def must_reconcile(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> None:
    if bad := [r.asDict() for r in reconcile(pairs).filter(~F.col("ok")).collect()]:
        raise ValueError(f"row counts differ: {bad}")


def key_differences(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Keys missing from the target, and keys it has too many; a null key is found on no other side.

    Both tables' keys meet once, in as many parts as a shuffle has: parts are not put together by their packed bytes, which say little of
    the memory that keys take, and no key is gathered before it moves.
    """
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = source.select(key, F.lit(True).alias("_s"), F.lit(False).alias("_t")).unionByName(target.select(key, F.lit(False).alias("_s"), F.lit(True).alias("_t")))
    found = sides.repartition(parts, key).groupBy(key).agg(F.max("_s").alias("_s"), F.max("_t").alias("_t"))
    alone, none = F.col("_s") != F.col("_t"), F.col(key).isNull()
    side = F.array_compact(F.array(F.when(F.col("_s") & (alone | none), "missing"), F.when(F.col("_t") & (alone | none), "extra")))
    return found.filter(alone | none).select(key, F.explode(side).alias("side"))


def _sums(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Rows and an order-free sum of row hashes, by ``by``."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))


def _unequal(source: DataFrame, target: DataFrame, columns: list[str], part: Column) -> list[int]:
    """Numbers of the parts, null first as -1, whose checksums differ."""
    a, b = (_sums(df.withColumn("_part", F.coalesce(part, F.lit(-1))), columns, "_part") for df in (source, target))
    both = a.alias("a").join(b.alias("b"), "_part", "full")
    return sorted(r[0] for r in both.filter(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.h").eqNullSafe(F.col("b.h")))).select("_part").collect())


def segmented_differences(source: DataFrame, target: DataFrame, key: str, ranges: int = 64) -> DataFrame:
    """Keys that are missing from the target, that it has too many, or whose rows differ, found by checksums of ranges in two levels.

    Both tables are summed up by ``ranges`` ranges of a whole-number key, then the ranges that differ by as many smaller ones, and only rows
    of those are compared key by key. What is equal is read once: later passes filter by the ranges that differ, and the filters reach the scans. Equal rows
    may be repeated, a null key is a key like another; columns are the source's.
    """
    columns = source.columns
    target = target.select(*columns)
    ends = [df.agg(F.min(key), F.max(key)).first() for df in (source, target)]
    known = [x for r in ends for x in r if x is not None]
    low, high = (min(known), max(known)) if known else (0, 0)
    width = max(1, -(-(high - low + 1) // ranges))
    narrow = max(1, -(-width // ranges))
    at = F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    wide = F.floor(at / width).cast("long")

    def between(parts: list[int], size: int) -> Column:
        """Rows of some parts, as few ranges of the key."""
        out = F.col(key).isNull() if -1 in parts else F.lit(False)
        runs: list[list[int]] = []
        for p in (p for p in parts if p >= 0):
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        for first, last in runs:
            out = out | F.col(key).between(low + first * size, min(high, low + (last + 1) * size - 1))
        return out

    coarse = _unequal(source, target, columns, wide)
    source, target = (df.filter(between(coarse, width)) for df in (source, target))
    fine = F.floor(at / narrow).cast("long")
    parts = _unequal(source, target, columns, fine) if coarse else []
    source, target = (df.filter(between(parts, narrow) if len(parts) <= ranges else F.coalesce(fine, F.lit(-1)).isin(parts)) for df in (source, target))
    a, b = _sums(source, columns, key).alias("a"), _sums(target, columns, key).alias("b")
    both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    side = F.when(F.col("b.n").isNull(), "missing").when(F.col("a.n").isNull(), "extra").when((F.col("a.n") != F.col("b.n")) | ~F.col("a.h").eqNullSafe(F.col("b.h")), "changed")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), side.alias("side")).filter("side IS NOT NULL")


def contract(df: DataFrame, wanted) -> DataFrame:
    """column_name, bad_rows: rows whose value does not fit the declared type; -1 for a missing column."""
    have = [f.name for f in wanted if f.name in df.columns]
    checks = [F.count_if(F.col(f.name).isNotNull() & F.col(f.name).cast("string").try_cast(f.dataType).isNull()).alias(f.name) for f in wanted if f.name in have]
    found = df.agg(*checks, *(F.lit(-1).cast("long").alias(f.name) for f in wanted if f.name not in have))
    return found.unpivot([], [f.name for f in wanted], "column_name", "bad_rows")


def fingerprint(df: DataFrame) -> tuple:
    """Rows and an order-free sum of row hashes: equal before and after an idempotent re-run."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


class FailedTests(ValueError):
    pass


def build_and_test(steps: list[tuple[str, Callable[[dict], DataFrame], list[tuple[str, str, dict]]]], materialize) -> tuple[dict[str, DataFrame], list]:
    """Build models in order, each written and tested before the next; a failing test stops what is downstream.

    A step is (model, function of the models so far, tests as (test, column, parameters)).
    """
    models: dict[str, DataFrame] = {}
    results = []
    for name, make, tests in steps:
        models[name] = materialize(make(models), name)
        if tests:
            rows = report(models, [(t, name, c, p(models) if callable(p) else p) for t, c, p in tests]).collect()
            results += rows
            if bad := [r.asDict() for r in rows if r["failures"]]:
                raise FailedTests(f"{name}: {bad}")
    return models, results
