"""Scalar expressions whose meaning differs between engines, written once."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def start_of_month(c: Column) -> Column:
    return F.trunc(c, "MM")


def start_of_minute(c: Column) -> Column:
    return F.date_trunc("MINUTE", c)


def year_month(c: Column) -> Column:
    """202406 for any day of June 2024."""
    return F.year(c) * 100 + F.month(c)


def days_between(a: Column, b: Column) -> Column:
    """Day boundaries crossed from a to b, not whole periods of 24 hours."""
    return F.datediff(b.cast("date"), a.cast("date"))


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))


def element(items: Column, i: Column) -> Column:
    """1-based."""
    return F.element_at(items, i)


def first_non_zero(*columns: Column) -> Column:
    """The first that is neither null nor 0, else 0."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in columns), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded half up, on decimals."""
    return F.round(F.try_divide(part.cast("decimal(28,6)") * 100, whole.cast("decimal(28,6)")), digits)


def compact_json(row: Column) -> Column:
    """Compact JSON that keeps null fields."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def at_most(cuts: list, x: Column) -> Column:
    """How many of the sorted ``cuts`` are at most x, by halving; null gives 0."""
    if not cuts:
        return F.lit(0)
    values = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<long>" if isinstance(cuts[0], int) else "array<double>")  # one constant
    steps = F.array(*(F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)))
    ahead = lambda at, step: (at + step <= len(cuts)) & (F.get(values, at + step - 1) <= x)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))
