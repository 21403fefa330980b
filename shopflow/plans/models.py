"""Staging and mart models: functions from DataFrames to DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stg_customers(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("id").alias("customer_id"), "name", "email", "city", "created_at")


def stg_orders(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("id").alias("order_id"), "customer_id", "status", "order_ts", F.to_date("order_ts").alias("order_date"), "amount")


def stg_order_items(items: DataFrame) -> DataFrame:
    total = (F.col("quantity") * F.col("unit_price")).cast("decimal(12,2)")
    return items.withColumnsRenamed({"id": "order_item_id"}).withColumn("line_total", total)


def fct_orders(orders: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order, with the customer's city and the order's items summed before the join; no items count as 0."""
    per_order = items.groupBy("order_id").agg(F.count("*").alias("item_count"), F.sum("line_total").alias("items_total"))
    return (
        orders.join(customers.select("customer_id", "city"), "customer_id", "left")
        .join(per_order, "order_id", "left")
        .select(
            "order_id", "customer_id", "city", "status", "order_ts", "order_date", "amount",
            F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"), F.coalesce("items_total", F.lit(0).cast("decimal(22,2)")).alias("items_total"),
        )
    )


def daily_revenue(facts: DataFrame, gross: bool = False) -> DataFrame:
    """order_date, orders, revenue; without cancelled orders unless gross."""
    rows = facts if gross else facts.filter(F.col("status") != "cancelled")
    return rows.groupBy("order_date").agg(F.count("*").alias("orders"), F.round(F.sum("amount"), 2).alias("revenue"))


def build(shop) -> tuple[DataFrame, DataFrame]:
    """(fct_orders, daily_revenue) from the relations."""
    facts = fct_orders(stg_orders(shop.orders), stg_customers(shop.customers), stg_order_items(shop.order_items))
    return facts, daily_revenue(facts)
