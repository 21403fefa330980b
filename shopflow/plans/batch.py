"""The daily batch: land snapshots, load them as partitions, build and test the models."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.sinks import replace_partitions, swap, write_snapshot
from ..sources.readers import latest_snapshot, read_snapshot
from . import models
from .quality import FailedTests, build_and_test


def load_checked(df: DataFrame, load: Callable[[DataFrame], None], key: str) -> int:
    """Load, and fail if there were no rows or a null key; both are counted by the load itself.

    ``load`` writes to a place that is not read yet, so a failure publishes nothing.
    """
    seen = Observation()
    load(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls")))
    got = seen.get
    if not got["rows"] or got["nulls"]:
        raise FailedTests(f"loaded {got['rows']} rows, {got['nulls']} without {key}")
    return got["rows"]


def snapshot(tables: dict[str, DataFrame], landing: str, ds: str) -> None:
    """Each source table as a full snapshot of the day, written under a hidden name and put in place once it has passed."""
    for name, df in tables.items():
        load_checked(df, lambda x, n=name: write_snapshot(x, f"{landing}/{n}", ds, key="_staged"), "id")
        swap(df.sparkSession, f"{landing}/{name}/_staged={ds}", f"{landing}/{name}/dt={ds}")


def load_partition(spark: SparkSession, names: list[str], landing: str, raw: str, ds: str) -> None:
    """The day's snapshots into the partitions of the raw tables; a second run replaces them."""
    for name in names:
        replace_partitions(read_snapshot(spark, f"{landing}/{name}", ds), f"{raw}/{name}", day=ds)


def build(spark: SparkSession, raw: str, marts: str, as_of: str | None = None) -> tuple[dict[str, DataFrame], list]:
    """Staging, facts and daily revenue of one snapshot, each written and tested before the next."""
    table = lambda name: latest_snapshot(spark.read.parquet(f"{raw}/{name}"), as_of).drop("_dt")

    def stored(df: DataFrame, name: str) -> DataFrame:
        if name.startswith("stg_"):
            return df  # staging is a view
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{marts}/{name}")
        return spark.read.parquet(f"{marts}/{name}")

    keyed = lambda c: [("not_null", c, {}), ("unique", c, {})]
    customer, order = (lambda m: {"parent": m["stg_customers"], "key": "customer_id"}), (lambda m: {"parent": m["stg_orders"], "key": "order_id"})
    steps = [
        ("stg_customers", lambda m: models.stg_customers(table("customers")), keyed("customer_id")),
        ("stg_orders", lambda m: models.stg_orders(table("orders")), [*keyed("order_id"), ("not_null", "customer_id", {}), ("relationships", "customer_id", customer), ("not_null", "status", {}), ("accepted_values", "status", {"values": ["pending", "paid", "shipped", "delivered", "cancelled"]})]),
        ("stg_order_items", lambda m: models.stg_order_items(table("order_items")), [*keyed("order_item_id"), ("not_null", "order_id", {}), ("relationships", "order_id", order)]),
        ("fct_orders", lambda m: models.fct_orders(m["stg_orders"], m["stg_customers"], m["stg_order_items"]), [*keyed("order_id"), ("not_null", "customer_id", {}), ("relationships", "customer_id", customer), ("not_null", "amount", {})]),
        ("daily_revenue", lambda m: models.daily_revenue(m["fct_orders"]), [*keyed("order_date"), ("not_null", "revenue", {})]),
    ]
    return build_and_test(steps, stored)


def run(spark: SparkSession, tables: dict[str, DataFrame], root: str, ds: str) -> tuple[dict[str, DataFrame], list]:
    """The whole day; running a date again leaves the same tables."""
    snapshot(tables, f"{root}/landing", ds)
    load_partition(spark, list(tables), f"{root}/landing", f"{root}/raw", ds)
    return build(spark, f"{root}/raw", f"{root}/marts")
