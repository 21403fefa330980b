"""The shop's reports: revenue, customers, cadence, cohorts, events, history, change data, data tests."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import days_between, percent, start_of_month
from ..operators import collapse, layout, sinks
from ..operators.joins import valid_at
from ..sources.binding import Shop
from ..sources.storage import scratch, stored
from ..streaming import cdc, events as stream
from . import models, quality
from .registry import query

NOW = datetime(2024, 2, 1)
FACTS = """, f AS (
  SELECT o.id AS order_id, o.customer_id, c.city, o.status, o.order_ts, CAST(o.order_ts AS DATE) AS order_date, o.amount,
         coalesce(i.n, 0) AS item_count, coalesce(i.t, 0) AS items_total
  FROM shop_orders o LEFT JOIN customers c ON c.id = o.customer_id
  LEFT JOIN (SELECT order_id, count(*) AS n, sum(CAST(quantity * unit_price AS DECIMAL(12,2))) AS t FROM order_items GROUP BY order_id) i ON i.order_id = o.id
), net AS (
  SELECT order_date, count(*) AS orders, round(sum(amount), 2) AS revenue FROM f WHERE status <> 'cancelled' GROUP BY order_date
), days AS (
  SELECT order_date AS day, count(*) AS orders, sum(amount) AS revenue FROM f GROUP BY order_date
)"""


def money(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 2).cast("double")


def daily(shop: Shop) -> DataFrame:
    """day, orders, revenue over all orders."""
    return shop.orders.groupBy(F.to_date("order_ts").alias("day")).agg(F.count("*").alias("orders"), F.sum("amount").alias("revenue"))


@query(FACTS + "SELECT order_id, customer_id, city, status, order_ts, order_date, CAST(amount AS DOUBLE) AS amount, CAST(item_count AS BIGINT) AS item_count, CAST(items_total AS DOUBLE) AS items_total FROM f")
def fct_orders(shop):
    return models.build(shop)[0].withColumns({"amount": money("amount"), "items_total": money("items_total")})


@query(FACTS + "SELECT order_date, orders, CAST(revenue AS DOUBLE) AS revenue FROM net")
def daily_revenue(shop):
    return models.build(shop)[1].withColumn("revenue", money("revenue"))


@query(FACTS + "SELECT day AS order_date, orders, CAST(round(revenue, 2) AS DOUBLE) AS revenue FROM days")
def daily_revenue_gross(shop):
    return models.daily_revenue(models.stg_orders(shop.orders), gross=True).withColumn("revenue", money("revenue"))


@query(FACTS + "SELECT city, count(*) AS orders, CAST(round(sum(amount)) AS DOUBLE) AS revenue FROM f GROUP BY city")
def revenue_by_city(shop):
    facts = models.build(shop)[0]
    return facts.groupBy("city").agg(F.count("*").alias("orders"), F.round(F.sum("amount")).cast("double").alias("revenue")).orderBy(F.desc("revenue"), "city")


@query(FACTS + "SELECT a.order_date, CAST(a.revenue AS DOUBLE) AS revenue, CAST((SELECT sum(b.revenue) FROM net b WHERE b.order_date <= a.order_date) AS DOUBLE) AS cum_revenue FROM net a")
def cum_revenue(shop):
    w = Window.orderBy("order_date")  # over days, not orders
    return models.build(shop)[1].select("order_date", money("revenue").alias("revenue"), money(F.sum("revenue").over(w)).alias("cum_revenue"))


@query(FACTS + ", n AS (SELECT *, row_number() OVER (ORDER BY order_date) AS r FROM net) SELECT a.order_date, round(avg(CAST(b.revenue AS DOUBLE)), 4) AS ma7 FROM n a JOIN n b ON b.r BETWEEN a.r - 6 AND a.r GROUP BY a.order_date")
def ma7_revenue(shop):
    w = Window.orderBy("order_date").rowsBetween(-6, 0)
    return models.build(shop)[1].select("order_date", F.round(F.avg(F.col("revenue").cast("double")).over(w), 4).alias("ma7"))


def spent(shop: Shop) -> DataFrame:
    return shop.orders.groupBy("customer_id").agg(F.sum("amount").alias("total_spent"))


@query(", s AS (SELECT customer_id, sum(amount) AS t FROM shop_orders GROUP BY customer_id) SELECT customer_id, CAST(t AS DOUBLE) AS total_spent, CAST((SELECT count(DISTINCT x.t) + 1 FROM s x WHERE x.t > s.t) AS BIGINT) AS rnk FROM s ORDER BY t DESC, customer_id LIMIT 10")
def q1_top_customers(shop):
    top = spent(shop).orderBy(F.desc("total_spent"), "customer_id").limit(10)  # ten rows are ranked, not all customers
    return top.select("customer_id", money("total_spent").alias("total_spent"), F.dense_rank().over(Window.orderBy(F.desc(top["total_spent"]))).cast("long").alias("rnk"))


@query(", s AS (SELECT customer_id, sum(amount) AS t FROM shop_orders GROUP BY customer_id), r AS (SELECT *, dense_rank() OVER (ORDER BY t DESC) AS k FROM s) SELECT customer_id, CAST(t AS DOUBLE) AS total_spent FROM r WHERE k <= 10")
def q1_top_ranks_ties(shop):
    totals = spent(shop)
    top = totals.select("total_spent").distinct().orderBy(F.desc("total_spent")).limit(10)
    return totals.join(F.broadcast(top), "total_spent", "left_semi").select("customer_id", money("total_spent").alias("total_spent"))


@query(", s AS (SELECT c.city, o.customer_id, min(c.name) AS name, sum(o.amount) AS t FROM shop_orders o JOIN customers c ON c.id = o.customer_id GROUP BY ALL) SELECT city, arg_min(customer_id, (-t, customer_id)) AS customer_id, arg_min(name, (-t, customer_id)) AS name, CAST(max(t) AS DOUBLE) AS total_spent FROM s GROUP BY city")
def q2_top_customer_per_city(shop):
    who = spent(shop).join(shop.customers, F.col("customer_id") == F.col("id"))
    w = Window.partitionBy("city").orderBy(F.desc("total_spent"), "customer_id")
    return who.withColumn("r", F.row_number().over(w)).filter("r = 1").select("city", "customer_id", "name", money("total_spent").alias("total_spent"))


@query(FACTS + "SELECT a.day, CAST(a.revenue AS DOUBLE) AS daily_revenue, CAST((SELECT sum(b.revenue) FROM days b WHERE b.day <= a.day) AS DOUBLE) AS running_total FROM days a")
def q3_running_total(shop):
    return daily(shop).select("day", money("revenue").alias("daily_revenue"), money(F.sum("revenue").over(Window.orderBy("day"))).alias("running_total"))


@query(FACTS + ", n AS (SELECT *, row_number() OVER (ORDER BY day) AS r FROM days) SELECT a.day, a.orders AS orders_that_day, round(avg(b.orders), 4) AS ma7 FROM n a JOIN n b ON b.r BETWEEN a.r - 6 AND a.r GROUP BY a.day, a.orders")
def q4_ma7_orders(shop):
    w = Window.orderBy("day").rowsBetween(-6, 0)
    return daily(shop).select("day", F.col("orders").alias("orders_that_day"), F.round(F.avg("orders").over(w), 4).alias("ma7"))


@query(FACTS + "SELECT a.day, a.orders AS orders_that_day, round(avg(b.orders), 4) AS ma7 FROM days a JOIN days b ON b.day BETWEEN a.day - 6 AND a.day GROUP BY a.day, a.orders")
def q4_ma7_calendar(shop):
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily(shop).select("day", F.col("orders").alias("orders_that_day"), F.round(F.avg("orders").over(w), 4).alias("ma7"))


@query(FACTS + ", n AS (SELECT *, row_number() OVER (ORDER BY day) AS r FROM days) SELECT a.day, CAST(a.revenue AS DOUBLE) AS daily_revenue, CAST(coalesce(b.revenue, a.revenue) AS DOUBLE) AS prev_daily_revenue, CAST(a.revenue - coalesce(b.revenue, a.revenue) AS DOUBLE) AS delta FROM n a LEFT JOIN n b ON b.r = a.r - 1")
def q5_day_over_day(shop):
    w = Window.orderBy("day")
    out = daily(shop).withColumn("prev", F.coalesce(F.lag("revenue").over(w), F.col("revenue")))
    return out.select("day", money("revenue").alias("daily_revenue"), money("prev").alias("prev_daily_revenue"), money(F.col("revenue") - F.col("prev")).alias("delta"))


def gaps(shop: Shop) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy("order_ts", "id")
    return shop.orders.select("customer_id", days_between(F.lag("order_ts").over(w), F.col("order_ts")).alias("gap"))


GAPS = ", g AS (SELECT customer_id, date_diff('day', lag(order_ts) OVER (PARTITION BY customer_id ORDER BY order_ts, id), order_ts) AS gap FROM shop_orders)"


@query(GAPS + "SELECT customer_id, count(*) AS orders_count, round(avg(gap), 6) AS avg_gap_days FROM g GROUP BY customer_id HAVING count(*) >= 2 ORDER BY round(avg(gap), 6), customer_id LIMIT 10")
def q6_order_cadence(shop):
    per = gaps(shop).groupBy("customer_id").agg(F.count("*").alias("orders_count"), F.round(F.avg("gap"), 6).alias("avg_gap_days"))
    return per.filter("orders_count >= 2").orderBy("avg_gap_days", "customer_id").limit(10)


@query(", m AS (SELECT CAST(date_trunc('month', order_ts) AS DATE) AS month, sum(amount) AS r FROM shop_orders GROUP BY 1), p AS (SELECT *, lag(r) OVER (ORDER BY month) AS q FROM m) SELECT month, CAST(r AS DOUBLE) AS monthly_revenue, CAST(q AS DOUBLE) AS prev_month_revenue, CAST(round(CAST((r - q) * 100 AS DOUBLE) / CAST(q AS DOUBLE), 1) AS DOUBLE) AS growth_pct FROM p")
def q7_mom_growth(shop):
    months = shop.orders.groupBy(start_of_month(F.col("order_ts")).alias("month")).agg(F.sum("amount").alias("r"))
    out = months.withColumn("q", F.lag("r").over(Window.orderBy("month")))
    growth = F.round(F.try_divide(((F.col("r") - F.col("q")) * 100).cast("double"), F.col("q").cast("double")), 1)
    return out.select("month", money("r").alias("monthly_revenue"), money("q").alias("prev_month_revenue"), growth.alias("growth_pct"))


@query("SELECT customer_id, CAST(min(order_ts) AS DATE) AS first_order_day, CAST(max(amount) AS DOUBLE) AS biggest_amount, CAST(arg_max(order_ts, (amount, -id)) AS DATE) AS biggest_order_day FROM shop_orders GROUP BY customer_id ORDER BY max(amount) DESC, customer_id LIMIT 10")
def q8_first_and_biggest(shop):
    big = F.struct("amount", (-F.col("id")).alias("tie"))
    per = shop.orders.groupBy("customer_id").agg(F.to_date(F.min("order_ts")).alias("first_order_day"), F.max("amount").alias("biggest_amount"), F.to_date(F.max_by("order_ts", big)).alias("biggest_order_day"))
    return per.orderBy(F.desc("biggest_amount"), "customer_id").limit(10).withColumn("biggest_amount", money("biggest_amount"))


@query(", s AS (SELECT c.city, sum(o.amount) AS r FROM shop_orders o JOIN customers c ON c.id = o.customer_id GROUP BY c.city) SELECT city, CAST(r AS DOUBLE) AS city_revenue, CAST(round(CAST(r * 100 AS DOUBLE) / CAST((SELECT sum(r) FROM s) AS DOUBLE), 1) AS DOUBLE) AS pct_of_total FROM s")
def q9_city_share(shop):
    per = shop.orders.join(shop.customers.select(F.col("id").alias("cid"), "city"), F.col("customer_id") == F.col("cid")).groupBy("city").agg(F.sum("amount").alias("r"))
    total = per.agg(F.sum("r").alias("total"))
    share = F.round((F.col("r") * 100).cast("double") / F.col("total").cast("double"), 1)
    return per.join(F.broadcast(total)).select("city", money("r").alias("city_revenue"), share.alias("pct_of_total")).orderBy(F.desc("pct_of_total"), "city")


@query(FACTS + ", p AS (SELECT day, revenue, sum(revenue) OVER (ORDER BY revenue DESC, day ROWS UNBOUNDED PRECEDING) AS run, (SELECT sum(revenue) FROM days) AS total FROM days) SELECT day, CAST(revenue AS DOUBLE) AS daily_revenue, round(CAST(run * 100 AS DOUBLE) / CAST(total AS DOUBLE), 4) AS running_pct, (SELECT count(*) + 1 FROM p WHERE run * 2 < total) AS days_to_half FROM p")
def q10_pareto_days(shop):
    days = daily(shop)
    total = days.agg(F.sum("revenue").alias("total"))
    w = Window.orderBy(F.desc("revenue"), "day").rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumn("run", F.sum("revenue").over(w)).join(F.broadcast(total))
    half = run.agg((F.count_if(F.col("run") * 2 < F.col("total")) + 1).alias("days_to_half"))
    return run.join(F.broadcast(half)).select("day", money("revenue").alias("daily_revenue"), F.round((F.col("run") * 100).cast("double") / F.col("total").cast("double"), 4).alias("running_pct"), "days_to_half")


@query(", c AS (SELECT customer_id, min(order_ts) AS t FROM shop_orders GROUP BY customer_id) SELECT CAST(date_trunc('month', t) AS DATE) AS cohort_month, count(*) AS customers FROM c GROUP BY 1")
def q11_signup_cohorts(shop):
    first = shop.orders.groupBy("customer_id").agg(F.min("order_ts").alias("t"))
    return first.groupBy(start_of_month(F.col("t")).alias("cohort_month")).agg(F.count("*").alias("customers"))


@query(", r AS (SELECT CAST(order_ts AS DATE) AS day, row_number() OVER (PARTITION BY customer_id ORDER BY order_ts, id) AS k FROM shop_orders) SELECT day, count(*) FILTER (WHERE k = 1) AS new_orders, count(*) FILTER (WHERE k > 1) AS repeat_orders FROM r GROUP BY day")
def q12_new_vs_repeat(shop):
    w = Window.partitionBy("customer_id").orderBy("order_ts", "id")
    ranked = shop.orders.select(F.to_date("order_ts").alias("day"), F.row_number().over(w).alias("k"))
    return ranked.groupBy("day").agg(F.count_if(F.col("k") == 1).alias("new_orders"), F.count_if(F.col("k") > 1).alias("repeat_orders"))


@query(", p AS (SELECT product, sum(quantity * unit_price) AS r FROM order_items GROUP BY product) SELECT product, CAST(r AS DOUBLE) AS product_revenue, round(CAST(r * 100 AS DOUBLE) / CAST((SELECT sum(r) FROM p) AS DOUBLE), 4) AS pct_of_total FROM p ORDER BY r DESC, product LIMIT 5")
def q13_product_leaderboard(shop):
    per = shop.order_items.groupBy("product").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("r"))
    total = per.agg(F.sum("r").alias("total"))
    top = per.orderBy(F.desc("r"), "product").limit(5)
    return top.join(F.broadcast(total)).select("product", money("r").alias("product_revenue"), F.round((F.col("r") * 100).cast("double") / F.col("total").cast("double"), 4).alias("pct_of_total"))


@query(GAPS + "SELECT customer_id, count(*) FILTER (WHERE gap <= 7) AS fast_reorders FROM g GROUP BY customer_id ORDER BY 2 DESC, 1 LIMIT 10")
def q14_fast_reorders(shop):
    return gaps(shop).groupBy("customer_id").agg(F.count_if(F.col("gap") <= 7).alias("fast_reorders")).orderBy(F.desc("fast_reorders"), "customer_id").limit(10)


@query("SELECT event_type, count(*) AS events FROM clicks GROUP BY event_type")
def events_by_type(shop):
    return shop.events.groupBy("event_type").agg(F.count("*").alias("events")).orderBy(F.desc("events"))


@query("SELECT event_type, count(*) AS events FROM clicks GROUP BY event_type")
def events_by_type_rollup(shop):
    """From states of three blocks, the last of them replayed."""
    path, rows = scratch(shop.spark, "rollup"), shop.events.withColumn("block", F.dayofmonth("ts") % 3)
    for batch in (0, 1, 2, 2):
        collapse.append_states(collapse.partials(rows.filter(F.col("block") == batch), ["event_type"]), path, batch)
    return collapse.merged(shop.spark.read.parquet(path), ["event_type"]).withColumnRenamed("count", "events")


def _windowed(shop: Shop, length: str, step: str | None = None) -> DataFrame:
    return stream.per_window(stream.timed(shop.events), length, step).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT date_trunc('minute', ts) AS window_start, count(*) AS events FROM clicks GROUP BY 1")
def events_per_minute(shop):
    return _windowed(shop, "1 minute")


@query(", w AS (SELECT unnest([time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE FOR i IN [0, 1, 2, 3, 4]]) AS window_start FROM clicks) SELECT window_start, count(*) AS events FROM w GROUP BY 1")
def events_hopping_5m_1m(shop):
    return _windowed(shop, "5 minutes", "1 minute")


@query("SELECT CAST(ts AS DATE) AS d, count(*) AS events FROM clicks GROUP BY 1")
def events_daily_incremental(shop):
    """Two builds, the second incremental with a lookback for late events."""
    path, count = scratch(shop.spark, "events-daily"), lambda rows: rows.groupBy("d").agg(F.count("*").alias("events"))
    early = shop.events.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).filter(~((F.col("ts") >= F.lit("2024-01-14").cast("timestamp_ntz")) & (F.col("event_id").cast("long") % 2 == 0)))
    for source in (early, shop.events):
        sinks.build_incremental(shop.spark, source, path, F.to_date("ts"), "d", count, lookback_days=3, raw="ts")
    return shop.spark.read.parquet(path).select(F.col("d").cast("date").alias("d"), "events")


@query("SELECT (SELECT count(*) FROM clicks) + (SELECT count(*) FROM clicks WHERE CAST(event_id AS BIGINT) % 5 = 0) AS raw_count, (SELECT count(*) FROM clicks) AS deduped_count")
def events_dedup_report(shop):
    again = shop.events.filter(F.col("event_id").cast("long") % 5 == 0)
    return collapse.duplicate_report(shop.events.unionByName(again), "event_id")


@query("SELECT max(ts) AS max_ts, CAST(date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01') AS BIGINT) AS lag_seconds, CAST(date_diff('second', date_trunc('second', min(ts)), TIMESTAMP '2024-02-01') AS BIGINT) AS max_lateness_seconds FROM clicks")
def event_lag(shop):
    return stream.lag(stream.timed(shop.events), F.lit(NOW)).withColumn("max_ts", F.col("max_ts").cast("timestamp_ntz"))


@query("SELECT count(*) AS purchases FROM clicks WHERE event_type = 'purchase'")
def purchase_count(shop):
    return shop.events.filter(F.col("event_type") == "purchase").agg(F.count("*").alias("purchases"))


@query(FACTS + "SELECT order_date, CAST(revenue AS DOUBLE) AS revenue, n_name AS nation FROM net, nation WHERE n_nationkey = 1 ORDER BY order_date LIMIT 3")
def federated_cross(shop):
    """The first days of the mart beside a row of another catalog."""
    one = shop.table("nation").filter(F.col("n_nationkey") == 1).select(F.col("n_name").alias("nation"))
    first = models.build(shop)[1].orderBy("order_date").limit(3)
    return first.crossJoin(F.broadcast(one)).select("order_date", money("revenue").alias("revenue"), "nation")


@query("SELECT c.city, count(*) AS orders FROM shop_orders o JOIN customers c ON c.id = o.customer_id GROUP BY c.city")
def city_order_counts(shop):
    return shop.orders.join(shop.customers.select(F.col("id").alias("cid"), "city"), F.col("customer_id") == F.col("cid")).groupBy("city").agg(F.count("*").alias("orders"))


@query(", s AS (SELECT CAST(id % 8 AS INTEGER) AS segment, count(*) AS rows FROM shop_orders GROUP BY 1) SELECT segment, rows, round((SELECT max(rows) / avg(rows) FROM s), 6) AS skew FROM s")
def distribution_report(shop):
    return layout.distribution(shop.orders, (F.col("id") % 8).cast("int")).withColumn("skew", F.round("skew", 6))


def change_log(shop: Shop) -> DataFrame:
    """Envelopes made of orders: creates, updates, deletes, duplicates and re-inserts. The source's clock runs backwards, and
    creates have no time of their own."""
    o = shop.orders
    record = lambda status: F.struct("id", "customer_id", status.alias("status"), F.col("amount").cast("string").alias("amount"))
    none = F.lit(None)

    def made(rows: DataFrame, op: str, step: int, status: Column) -> DataFrame:
        before, after = (record(status), none.cast("struct<id: bigint>")) if op == "d" else (none.cast("struct<id: bigint>"), record(status))
        source = F.struct(F.lit("orders").alias("table"), (F.col("id") * 10 + (9 - step if step else 0)).alias("ts_ms"))
        own = (F.col("id") * 10 + step if step else F.lit(0)).cast("long").alias("ts_ms")
        return rows.select("id", F.to_json(F.struct(F.lit(op).alias("op"), before.alias("before"), after.alias("after"), source.alias("source"), own)).alias("value"))

    log = made(o, "c", 0, F.col("status")).unionByName(made(o.filter("id % 3 = 0"), "u", 1, F.lit("shipped")))
    log = log.unionByName(made(o.filter("id % 10 = 0"), "d", 2, F.col("status"))).unionByName(made(o.filter("id % 50 = 0"), "c", 3, F.lit("pending")))
    return log.unionByName(log.filter("id % 4 = 0")).select("value")


@query("SELECT 'orders' AS source_table, count(*) AS live_rows FROM shop_orders WHERE id % 10 <> 0 OR id % 50 = 0")
def cdc_current_counts(shop):
    return cdc.counts(cdc.decode(change_log(shop)))


def moves(shop: Shop) -> DataFrame:
    """A customer's orders as a log of the cities they were sent to."""
    n = shop.table("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("city"))
    return shop.orders.withColumn("k", F.col("id") % 3).join(F.broadcast(n), "k").select("customer_id", "id", "order_ts", "city")


HISTORY = """, log AS (
  SELECT customer_id, id, order_ts, n_name AS city FROM shop_orders JOIN nation ON n_nationkey = id % 3
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_ts, id) AS k FROM log
), kept AS (
  SELECT a.* FROM seen a LEFT JOIN seen b ON b.customer_id = a.customer_id AND b.k = a.k - 1 WHERE b.city IS NULL OR b.city <> a.city
), h AS (
  SELECT customer_id, city, order_ts AS valid_from, lead(order_ts) OVER (PARTITION BY customer_id ORDER BY order_ts, id) AS valid_to FROM kept
)"""


def _history(shop: Shop) -> DataFrame:
    return collapse.history_of(moves(shop), "customer_id", "order_ts", ["city"], "id").select("customer_id", "city", "valid_from", "valid_to", "is_current")


@query(HISTORY + "SELECT *, valid_to IS NULL AS is_current FROM h")
def scd2_customers(shop):
    return _history(shop)


@query(HISTORY + "SELECT o.id AS order_id, o.customer_id, h.city FROM shop_orders o LEFT JOIN h ON h.customer_id = o.customer_id AND o.order_ts >= h.valid_from AND (h.valid_to IS NULL OR o.order_ts < h.valid_to)")
def fct_orders_asof(shop):
    orders = shop.orders.select(F.col("id").alias("order_id"), "customer_id", "order_ts")
    return valid_at(orders, _history(shop).select("customer_id", "city", "valid_from", "valid_to"), "customer_id", "order_ts").select("order_id", "customer_id", "city")


@query("SELECT 'main' AS ref, count(*) + 1 AS rows FROM shop_orders UNION ALL SELECT 'base', count(*) FROM shop_orders")
def tag_vs_main(shop):
    """A tag at version 1, then one more row at version 2."""
    one = shop.orders.agg((F.max("id") + 1).alias("id")).withColumn("_version", F.lit(2).cast("long"))
    log = shop.orders.select("id", F.lit(1).cast("long").alias("_version")).unionByName(one)
    tags = shop.spark.range(1).select(F.lit("base").alias("tag"), F.lit(1).cast("long").alias("version"))
    head = collapse.latest(log, ["id"], "_version").agg(F.count("*").alias("rows")).select(F.lit("main").alias("ref"), "rows")
    return head.unionByName(collapse.as_of_tag(log, tags, "base", ["id"]).agg(F.count("*").alias("rows")).select(F.lit("base").alias("ref"), "rows"))


def tests(found: dict) -> list[tuple[str, str, str, dict]]:
    """The twenty data tests of staging and marts."""
    customer, order = {"parent": found["stg_customers"], "key": "customer_id"}, {"parent": found["stg_orders"], "key": "order_id"}
    return [
        ("not_null", "stg_customers", "customer_id", {}), ("unique", "stg_customers", "customer_id", {}),
        ("not_null", "stg_orders", "order_id", {}), ("unique", "stg_orders", "order_id", {}), ("not_null", "stg_orders", "customer_id", {}),
        ("relationships", "stg_orders", "customer_id", customer), ("not_null", "stg_orders", "status", {}),
        ("accepted_values", "stg_orders", "status", {"values": ["pending", "paid", "shipped", "delivered", "cancelled"]}),
        ("not_null", "stg_order_items", "order_item_id", {}), ("unique", "stg_order_items", "order_item_id", {}), ("not_null", "stg_order_items", "order_id", {}), ("relationships", "stg_order_items", "order_id", order),
        ("not_null", "fct_orders", "order_id", {}), ("unique", "fct_orders", "order_id", {}), ("not_null", "fct_orders", "customer_id", {}), ("relationships", "fct_orders", "customer_id", customer), ("not_null", "fct_orders", "amount", {}),
        ("not_null", "daily_revenue", "order_date", {}), ("unique", "daily_revenue", "order_date", {}), ("not_null", "daily_revenue", "revenue", {}),
    ]


def tested_models(shop: Shop) -> dict[str, DataFrame]:
    facts, net = models.build(shop)
    facts = stored(facts, "fct-orders")
    return {
        "stg_customers": models.stg_customers(shop.customers), "stg_orders": models.stg_orders(shop.orders),
        "stg_order_items": models.stg_order_items(shop.hashed_items), "fct_orders": facts, "daily_revenue": models.daily_revenue(facts),
    }


_DQ = {
    ("stg_customers", "customer_id"): "SELECT id AS v FROM customers", ("stg_orders", "order_id"): "SELECT id AS v FROM shop_orders", ("stg_orders", "customer_id"): "SELECT customer_id AS v FROM shop_orders",
    ("stg_orders", "status"): "SELECT status AS v FROM shop_orders", ("stg_order_items", "order_item_id"): "SELECT md5(CAST(lineitem AS VARCHAR)) AS v FROM lineitem", ("stg_order_items", "order_id"): "SELECT l_orderkey AS v FROM lineitem",
    ("fct_orders", "order_id"): "SELECT order_id AS v FROM f", ("fct_orders", "customer_id"): "SELECT customer_id AS v FROM f", ("fct_orders", "amount"): "SELECT amount AS v FROM f",
    ("daily_revenue", "order_date"): "SELECT order_date AS v FROM net", ("daily_revenue", "revenue"): "SELECT revenue AS v FROM net",
}


def _dq_sql() -> str:
    parts = []
    for test, model, column, _ in tests({"stg_customers": None, "stg_orders": None}):
        source = _DQ[model, column]
        parent = "customers" if column == "customer_id" else "shop_orders"
        bad = {
            "not_null": f"SELECT count(*) FROM ({source}) WHERE v IS NULL",
            "unique": f"SELECT count(*) FROM (SELECT v FROM ({source}) WHERE v IS NOT NULL GROUP BY v HAVING count(*) > 1)",
            "relationships": f"SELECT count(*) FROM ({source}) WHERE v IS NOT NULL AND v NOT IN (SELECT id FROM {parent})",
            "accepted_values": f"SELECT count(*) FROM ({source}) WHERE v NOT IN ('pending', 'paid', 'shipped', 'delivered', 'cancelled')",
        }[test]
        parts.append(f"SELECT '{test}' AS test, '{model}' AS model, '{column}' AS column_name, ({bad}) AS failures")
    return FACTS + " UNION ALL ".join(parts)


@query(_dq_sql())
def dq_report(shop):
    found = tested_models(shop)
    return quality.report(found, tests(found))


@query("SELECT 'customers' AS table_name, count(*) AS source_rows, count(*) AS target_rows, true AS ok FROM customer UNION ALL SELECT 'orders', count(*), count(*), true FROM orders UNION ALL SELECT 'order_items', count(*), count(*), true FROM lineitem")
def reconcile(shop):
    """Sources against targets that were loaded twice and collapsed by key."""
    twice = lambda df, key: collapse.latest(df.withColumn("_v", F.lit(1)).unionByName(df.withColumn("_v", F.lit(2))), [key], "_v")
    return quality.reconcile({"customers": (shop.table("customer"), twice(shop.customers.select("id"), "id")), "orders": (shop.table("orders"), twice(shop.orders.select("id"), "id")), "order_items": (shop.table("lineitem"), twice(shop.hashed_items.select("id"), "id"))})
