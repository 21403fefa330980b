"""The daily batch over a small shop: idempotent runs, one snapshot at a time, failures that stop it."""

import pytest
from pyspark.sql import functions as F

from shopflow.plans import batch
from shopflow.plans.quality import FailedTests, fingerprint

STATUS = ["pending", "paid", "shipped", "delivered", "cancelled"]


@pytest.fixture(scope="module")
def shop(spark):
    """The seed's formulas: customers, orders and three items for each order."""
    cities = F.array(*[F.lit(x) for x in ("Moscow", "Kazan", "Omsk", "Tver", "Perm")])
    customers = spark.range(1, 101).select("id", F.concat(F.lit("customer_"), "id").alias("name"), F.concat(F.lit("customer_"), "id", F.lit("@example.com")).alias("email"), F.element_at(cities, (1 + F.col("id") % 5).cast("int")).alias("city"), F.lit("2026-01-01").cast("timestamp").alias("created_at"))
    day = F.expr("timestamp '2026-03-13' + make_dt_interval(cast(id % 90 as int), cast(id % 24 as int))")
    orders = spark.range(1, 1001).select("id", (1 + F.col("id") % 100).alias("customer_id"), F.element_at(F.array(*[F.lit(x) for x in STATUS]), (1 + F.col("id") % 5).cast("int")).alias("status"), day.alias("order_ts"), (10 + F.col("id") % 490).cast("decimal(10,2)").alias("amount"))
    s = spark.range(1, 4).select(F.col("id").alias("s"))
    items = spark.range(1, 1001).crossJoin(s).select((3 * (F.col("id") - 1) + F.col("s")).alias("item"), F.col("id").alias("order_id"), F.concat(F.lit("product_"), 1 + (F.col("id") + F.col("s")) % 50).alias("product"), (1 + (F.col("id") + F.col("s")) % 5).cast("int").alias("quantity"), F.lit("5.25").cast("decimal(10,2)").alias("unit_price")).withColumnRenamed("item", "id")
    return {"customers": customers, "orders": orders, "order_items": items}


def test_two_days_and_a_rerun(spark, shop, tmp_path):
    root = str(tmp_path)
    found, results = batch.run(spark, shop, root, "2026-06-10")
    assert len(results) == 20 and all(r["failures"] == 0 for r in results)
    assert found["fct_orders"].count() == 1000 and found["fct_orders"].agg(F.sum("item_count")).first()[0] == 3000
    first = fingerprint(found["daily_revenue"])
    changed = shop | {"orders": shop["orders"].withColumn("amount", (F.col("amount") + 1).cast("decimal(10,2)"))}
    second = fingerprint(batch.run(spark, changed, root, "2026-06-11")[0]["daily_revenue"])
    assert second != first and spark.read.parquet(f"{root}/raw/orders").count() == 2000
    assert fingerprint(batch.run(spark, changed, root, "2026-06-11")[0]["daily_revenue"]) == second
    assert spark.read.parquet(f"{root}/raw/orders").count() == 2000
    assert fingerprint(batch.build(spark, f"{root}/raw", f"{root}/marts", as_of="2026-06-10")[0]["daily_revenue"]) == first
    total = found["fct_orders"].sparkSession.read.parquet(f"{root}/marts/daily_revenue").agg(F.sum("revenue")).first()[0]
    assert total == shop["orders"].filter("status != 'cancelled'").agg(F.sum("amount")).first()[0]


def test_empty_or_keyless_snapshots_are_refused(spark, shop, tmp_path):
    with pytest.raises(FailedTests):
        batch.run(spark, shop | {"orders": shop["orders"].limit(0)}, str(tmp_path), "2026-06-10")
    with pytest.raises(FailedTests):
        batch.run(spark, shop | {"customers": shop["customers"].withColumn("id", F.when(F.col("id") > 1, F.col("id")))}, str(tmp_path), "2026-06-10")


def test_a_failing_model_test_stops_the_marts(spark, shop, tmp_path):
    lost = shop["orders"].withColumn("status", F.when(F.col("id") == 7, "lost").otherwise(F.col("status")))
    with pytest.raises(FailedTests, match="accepted_values"):
        batch.run(spark, shop | {"orders": lost}, str(tmp_path), "2026-06-10")
    assert not (tmp_path / "marts").exists()
