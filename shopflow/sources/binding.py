"""The benchmark tables as the shop's relations."""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import dense_id

STATUS_OF_PRIORITY = {"1-URGENT": "pending", "2-HIGH": "paid", "3-MEDIUM": "shipped", "4-NOT SPECIFIED": "delivered"}


class Shop:
    """Lazily read relations of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        since = F.expr("TIMESTAMP_NTZ '1992-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 365 AS int))")
        email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lit("@example.com"))
        return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), email.alias("email"), F.col("n_name").alias("city"), since.alias("created_at"))

    @cached_property
    def orders(self) -> DataFrame:
        status = F.lit("cancelled")
        for priority, name in STATUS_OF_PRIORITY.items():
            status = F.when(F.col("o_orderpriority") == priority, name).otherwise(status)
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), status.alias("status"),
            F.col("o_orderdate").alias("order_ts"), F.col("o_totalprice").cast("decimal(10,2)").alias("amount"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.order_items_of(self.table("lineitem"))

    def order_items_of(self, i: DataFrame, *keep: str) -> DataFrame:
        return self._priced(i).select(*self._item(), *keep)

    def _priced(self, i: DataFrame) -> DataFrame:
        p = self.table("part")
        return i.join(p, i["l_partkey"] == p["p_partkey"])

    @staticmethod
    def _item() -> list[Column]:
        return [
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("product_"), F.col("l_partkey").cast("string")).alias("product"),
            F.col("l_quantity").cast("int").alias("quantity"), F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
        ]

    @cached_property
    def numbered_items(self) -> DataFrame:
        """The items with an id: their number in the order of all columns, since the table has no key."""
        raw = self.table("lineitem")
        return dense_id(self._priced(raw).select(*raw.columns, "p_retailprice"), "id", *raw.columns, keep=self._item())

    @cached_property
    def hashed_items(self) -> DataFrame:
        """The items with a hash of their whole row as id, which no sort is needed for: two rows have one id only if they are equal."""
        raw = self.table("lineitem")
        return self.order_items_of(raw, F.md5(F.to_json(F.struct(*raw.columns))).alias("id"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").cast("string").alias("event_id"), "user_id", "event_type", "ts", "props")


#: The same relations in SQL, for oracles: to be followed by a comma or a SELECT.
BIND = """WITH customers AS (
  SELECT c.c_custkey AS id, c.c_name AS name, concat(lower(replace(c.c_name, '#', '_')), '@example.com') AS email, n.n_name AS city,
         TIMESTAMP '1992-01-01' + INTERVAL 1 DAY * (c.c_custkey % 365) AS created_at
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
), shop_orders AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'pending' WHEN '2-HIGH' THEN 'paid' WHEN '3-MEDIUM' THEN 'shipped' WHEN '4-NOT SPECIFIED' THEN 'delivered' ELSE 'cancelled' END AS status,
         o_orderdate AS order_ts, CAST(o_totalprice AS DECIMAL(10,2)) AS amount FROM orders
), order_items AS (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, concat('product_', CAST(l.l_partkey AS VARCHAR)) AS product,
         CAST(l.l_quantity AS INT) AS quantity, CAST(p.p_retailprice AS DECIMAL(10,2)) AS unit_price
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
), clicks AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, event_type, ts, props FROM events
)"""
