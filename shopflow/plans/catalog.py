"""One query for each operator that no report uses: scans, sinks, predicates, joins, aggregates, windows, functions, streams, data tests."""

import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as fn
from ..operators import collapse, layout, sinks, upsert
from ..operators.joins import as_of, orphans, salted, salted_by_heat, small
from ..schemas import schema
from ..sources import readers
from ..sources.storage import scratch, stored
from ..streaming import cdc, events as stream, progress
from . import batch, models, quality
from .analytics import FACTS, HISTORY, NOW, _history, change_log, money, moves
from .registry import query

DAY1, DAY2 = "2026-06-10", "2026-06-11"


def unique(name: str) -> str:
    """A catalog name that no other run has."""
    return f"shopflow_{name}_{uuid.uuid4().hex}"


def _landed(shop) -> str:
    """Orders landed on two days, the second with changed amounts."""
    root = scratch(shop.spark, "landing")
    o = shop.orders.select("id", "status", "amount")
    sinks.write_snapshot(o, root, DAY1)
    sinks.write_snapshot(o.withColumn("amount", F.when(F.col("id") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(10,2)")), root, DAY2)
    return root


@query("SELECT d AS dt, count(*) AS orders FROM shop_orders, (SELECT DATE '2026-06-10' AS d UNION ALL SELECT DATE '2026-06-11') GROUP BY d")
def src1_partitioned_scan(shop):
    return readers.read_tree(shop.spark, _landed(shop)).groupBy("dt").agg(F.count("*").alias("orders"))


@query("SELECT DATE '2026-06-11' AS _dt, count(*) AS orders, CAST(sum(CASE WHEN id % 7 = 0 THEN amount + 1 ELSE amount END) AS DOUBLE) AS revenue FROM shop_orders")
def src2_one_snapshot(shop):
    return readers.read_snapshot(shop.spark, _landed(shop), DAY2).groupBy("_dt").agg(F.count("*").alias("orders"), money(F.sum("amount")).alias("revenue"))


@query("SELECT count(*) AS orders, CAST(sum(CASE WHEN id % 7 = 0 THEN amount + 1 ELSE amount END) AS DOUBLE) AS revenue FROM shop_orders")
def src3_latest_snapshot(shop):
    tree = readers.read_tree(shop.spark, _landed(shop))
    return readers.latest_snapshot(tree, column="dt").agg(F.count("*").alias("orders"), money(F.sum("amount")).alias("revenue"))


@query("SELECT id, name FROM customers")
def src4_csv(shop):
    path = scratch(shop.spark, "csv")
    shop.customers.select("id", "name").write.option("header", True).csv(path)
    return readers.read_csv(shop.spark, path, schema("id bigint, name string"))


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def _from_database(df: DataFrame, name: str, **how) -> DataFrame:
    """A small table loaded into an embedded database and read from there.

    Such a database is open in one process only, so tasks leave the rows as files, the database loads copies of them here, and it is
    then closed and packed: a packed one is read-only. Spark hands it to each executor as it does jars, and the executor opens it by
    itself from there, so the shared folder may be in any store.
    """
    spark, hadoop = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs
    root, shop, rows = Path(tempfile.mkdtemp(prefix="shopflow-")).resolve(), unique(name), hadoop.Path(scratch(df.sparkSession, name))
    url = f"jdbc:derby:{root}/{shop}"
    connect = lambda how: getattr(spark._jvm, DERBY)().connect(f"{url};{how}", spark._jvm.java.util.Properties())
    df.write.option("escape", '"').csv(rows.toString())
    rows.getFileSystem(spark._jsc.hadoopConfiguration()).copyToLocalFile(False, rows, hadoop.Path(f"file://{root}/rows"), True)
    df.limit(0).write.format("jdbc").options(url=f"{url};create=true", dbtable=name, driver=DERBY).mode("overwrite").save()
    link = connect("create=false")
    try:
        for file in sorted((root / "rows").glob("part-*")):
            if file.stat().st_size:
                load = link.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
                load.setString(1, name.upper())
                load.setString(2, str(file))
                load.execute()
    finally:
        link.close()
    try:
        connect("shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # what a database that was closed says
            raise
    packed = Path(shutil.make_archive(f"{root}/packed", "zip", root, shop)).rename(root / f"{shop}.jar")
    spark.sql(f"ADD JAR '{packed}'")
    return readers.read_database(spark, f"jdbc:derby:classpath:{shop}", name, driver=DERBY, **how)


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def src5_6_database(shop):
    """Two columns of a database table, in ranges of its key."""
    nations = shop.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region"))
    return _from_database(nations, "nations", columns=["id", "name"], key="id", bounds=(0, 25), parts=4)


@query("SELECT event_type, count(*) AS events, CAST(0 AS BIGINT) AS rejected FROM clicks GROUP BY 1 UNION ALL SELECT 'none', 0, 3")
def src7_json_queue(shop):
    """Messages by field name: an unknown field is ignored, malformed messages are quarantined."""
    path, table = scratch(shop.spark, "queue"), scratch(shop.spark, "events")
    e = shop.events.select(F.to_json(F.struct("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit(1).alias("extra"))).alias("value"))
    e.unionByName(e.limit(3).select(F.lit('{"event_id": ').alias("value"))).write.text(path)
    good, bad = stream.split_malformed(readers.read_queue(shop.spark, path), schema("event_id string, user_id bigint, event_type string, page string, ts timestamp"), "event_id")
    quarantine = scratch(shop.spark, "quarantine")
    for part, target in ((good, table), (bad, quarantine)):
        stream.run_available(part, target, scratch(shop.spark, "checkpoint"))
    landed = shop.spark.read.parquet(table).groupBy("event_type").agg(F.count("*").alias("events"), F.lit(0).cast("long").alias("rejected"))
    kept_apart = shop.spark.read.parquet(quarantine).agg(F.count("*").alias("rejected"))
    return landed.unionByName(kept_apart.select(F.lit("none").alias("event_type"), F.lit(0).cast("long").alias("events"), "rejected"))


@query("SELECT count(*) AS messages, count(DISTINCT event_id) AS events FROM clicks")
def src8_bounded_drain(shop):
    """A topic in many files: a first run stops at its bound, a second one drains what is left."""
    path, table, mark = scratch(shop.spark, "topic"), scratch(shop.spark, "drained"), scratch(shop.spark, "checkpoint")
    shop.events.select(F.to_json(F.struct("event_id")).alias("value")).repartition(6).write.text(path)
    act = lambda b, i: stream.publish(b, {table: lambda x: x.select(F.get_json_object("value", "$.event_id").alias("event_id"))}, i)
    readers.drain(readers.read_queue(shop.spark, path, files_per_batch=2), act, mark, most=1)
    stream.for_each_available(readers.read_queue(shop.spark, path, files_per_batch=2), act, mark)
    return shop.spark.read.parquet(table).agg(F.count("*").alias("messages"), F.count_distinct("event_id").alias("events"))


@query("SELECT i AS id, CAST(amount AS DOUBLE) AS amount FROM (SELECT unnest(range(1, (SELECT max(id) FROM shop_orders) + 1)) AS i) LEFT JOIN shop_orders ON id = i")
def src10_series(shop):
    """Every number up to the last order, with the order's amount where there is one."""
    last = shop.orders.agg(F.max("id")).first()[0] or 0
    return readers.series(shop.spark, last, "id").join(shop.orders.select("id", "amount"), "id", "left").select("id", money("amount").alias("amount"))


@query("SELECT d AS dt, count(*) AS rows FROM shop_orders, (SELECT DATE '2026-06-10' AS d UNION ALL SELECT DATE '2026-06-11') GROUP BY d")
def src11_partition_inventory(shop):
    return readers.partitions(shop.spark, _landed(shop)).select("dt", "rows")


@query("SELECT CAST(order_ts AS DATE) AS _dt, count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS revenue FROM shop_orders WHERE date_trunc('month', order_ts) <> (SELECT min(date_trunc('month', order_ts)) FROM shop_orders) GROUP BY 1")
def snk2_partition_replace(shop):
    """Months loaded; then the last is loaded again, and the first by a source that has no rows of it any more."""
    path, rows = scratch(shop.spark, "raw-orders"), shop.orders.withColumn("_dt", F.trunc(F.col("order_ts"), "MM"))
    sinks.replace_partitions(rows, path)
    ends = rows.agg(F.min("_dt").alias("first"), F.max("_dt").alias("last")).first()
    sinks.replace_partitions(rows, path, day=str(ends["last"]))
    sinks.replace_partitions(rows.filter(F.col("_dt") > ends["first"]), path, day=str(ends["first"]))
    back = shop.spark.read.parquet(path)
    return back.groupBy(F.to_date("order_ts").alias("_dt")).agg(F.count("*").alias("orders"), money(F.sum("amount")).alias("revenue"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'shipped' ELSE status END AS status, CAST(CASE WHEN id % 7 = 0 THEN amount + 1 ELSE amount END AS DOUBLE) AS amount FROM shop_orders WHERE id % 10 <> 0 OR id % 50 = 0")
def snk14_upsert_by_key(shop):
    """Orders by key: loaded, corrected in two blocks of which one comes again, some deleted and some of those put back."""
    path, o = scratch(shop.spark, "orders-by-key"), shop.orders.select("id", "status", "amount")
    raised = o.filter("id % 7 = 0").withColumn("amount", (F.col("amount") + 1).cast("decimal(10,2)"))
    shipped = o.unionByName(raised).groupBy("id").agg(F.first("status").alias("status"), F.max("amount").alias("amount")).filter("id % 3 = 0").withColumn("status", F.lit("shipped"))
    final = o.withColumn("status", F.when(F.col("id") % 3 == 0, "shipped").otherwise(F.col("status"))).withColumn("amount", F.when(F.col("id") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(10,2)"))
    for block in (o, raised, shipped, shipped):
        upsert.upsert(block, path, ["id"], buckets=8)
    upsert.upsert(final.filter("id % 10 = 0").withColumn("gone", F.col("id") % 50 != 0), path, ["id"], buckets=8, deleted="gone")
    return upsert.read_table(shop.spark, path).withColumn("amount", money("amount"))


@query("SELECT CAST(year(order_ts) * 100 + month(order_ts) AS INTEGER) AS month, count(*) AS orders FROM shop_orders GROUP BY 1")
def snk5_month_partitions(shop):
    path = scratch(shop.spark, "by-month")
    sinks.write_by_month(models.stg_orders(shop.orders), path, "order_date")
    return shop.spark.read.parquet(path).groupBy(fn.year_month(F.col("order_date")).alias("month")).agg(F.count("*").alias("orders"))


@query("SELECT id, CAST(amount AS DOUBLE) AS amount FROM shop_orders")
def snk6_sorted_layout(shop):
    path = scratch(shop.spark, "sorted")
    sinks.write_sorted(shop.orders, path, "id", files=4)
    return shop.spark.read.parquet(path).select("id", money("amount").alias("amount"))


@query("SELECT id, customer_id, CAST(amount AS DOUBLE) AS amount FROM shop_orders WHERE customer_id BETWEEN 100 AND 120 OR amount > 300000")
def snk6_clustered_layout(shop):
    """Orders clustered by customer and amount: a filter on either skips most row groups."""
    path = scratch(shop.spark, "clustered")
    layout.write_clustered(shop.orders.select("id", "customer_id", "amount"), path, "customer_id", "amount", files=4)
    back = shop.spark.read.parquet(path)
    some = back.filter(F.col("customer_id").between(100, 120)).unionByName(back.filter("amount > 300000 AND NOT coalesce(customer_id BETWEEN 100 AND 120, false)"))
    return some.withColumn("amount", money("amount"))


@query("SELECT count(*) AS rows, count(DISTINCT id) AS ids, CAST(sum(CASE WHEN id % 2 = 0 THEN amount ELSE amount + 1 END) AS DOUBLE) AS total FROM shop_orders")
def snk10_insert_if_absent(shop):
    old = shop.orders.filter("id % 2 = 0").select("id", "amount")
    new = shop.orders.select("id", (F.col("amount") + 1).cast("decimal(10,2)").alias("amount"))
    return sinks.insert_if_absent(old, new.unionByName(new), "id").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), money(F.sum("amount")).alias("total"))


@query("SELECT status, count(*) AS rows FROM shop_orders WHERE status <> 'cancelled' GROUP BY 1 UNION ALL SELECT 'new', 2")
def snk13_delete_and_insert(shop):
    """Rows deleted in place, then literal rows inserted."""
    path = scratch(shop.spark, "kept")
    shop.orders.select("id", "status").write.parquet(path)
    sinks.delete_in_place(shop.spark, path, F.col("status") == "cancelled")
    name = unique("kept")
    sinks.ensure_table(shop.spark, name, schema("id bigint, status string"), path=path)
    sinks.insert_values(shop.spark, name, (-1, "new"), (-2, "new"))
    return shop.spark.table(name).groupBy("status").agg(F.count("*").alias("rows"))


@query("SELECT count(*) AS rows FROM clicks WHERE ts > TIMESTAMP '2024-01-20'")
def snk16_since_mark(shop):
    return sinks.since(shop.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", NOW.replace(month=1, day=20)).agg(F.count("*").alias("rows"))


@query("SELECT event_type, count(*) AS events FROM clicks GROUP BY 1")
def snk19_stream_append(shop):
    """The stream lands in a table; a second run finds nothing new."""
    source, table, mark = scratch(shop.spark, "in"), scratch(shop.spark, "landed"), scratch(shop.spark, "checkpoint")
    shop.events.write.parquet(source)
    for _ in range(2):
        stream.run_available(shop.spark.readStream.schema(shop.events.schema).parquet(source), table, mark)
    return shop.spark.read.parquet(table).groupBy("event_type").agg(F.count("*").alias("events"))


@query("SELECT id AS customer_id, name, email, city, created_at FROM customers")
def prj1_stg_customers(shop):
    return models.stg_customers(shop.customers)


@query("SELECT id AS order_id, customer_id, status, order_ts, CAST(order_ts AS DATE) AS order_date, CAST(amount AS DOUBLE) AS amount FROM shop_orders")
def prj2_stg_orders(shop):
    return models.stg_orders(shop.orders).withColumn("amount", money("amount"))


@query("""SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS order_item_id, l_orderkey AS order_id,
  l_linenumber AS line_no, concat('product_', l_partkey) AS product, CAST(l_quantity AS INT) AS quantity, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS unit_price, CAST(CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS line_total
  FROM lineitem JOIN part ON p_partkey = l_partkey""")
def prj3_stg_order_items(shop):
    """With a dense id over all rows, which no single task numbers."""
    return models.stg_order_items(shop.numbered_items).withColumns({"unit_price": money("unit_price"), "line_total": money("line_total")})


@query("SELECT count(*) AS events FROM clicks WHERE ts > TIMESTAMP '2024-01-30 12:00:00'")
def flt3_recent(shop):
    return shop.events.filter(F.col("ts") > F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 36 HOURS")).agg(F.count("*").alias("events"))


@query("SELECT status, count(*) AS orders FROM shop_orders WHERE status IN ('paid', 'shipped') GROUP BY status")
def flt10_in_list(shop):
    return shop.orders.filter(F.col("status").isin("paid", "shipped")).groupBy("status").agg(F.count("*").alias("orders"))


@query("SELECT id, CAST(amount AS DOUBLE) AS amount FROM shop_orders WHERE amount > (SELECT avg(amount) FROM shop_orders)")
def qry3_scalar_subquery(shop):
    mean = shop.orders.agg(F.avg("amount").alias("mean"))
    return shop.orders.join(F.broadcast(mean), F.col("amount") > F.col("mean")).select("id", money("amount").alias("amount"))


@query(", RECURSIVE_CHAIN AS (SELECT DISTINCT CAST(date_trunc('month', order_ts) AS DATE) AS month FROM shop_orders) SELECT month, (SELECT count(*) FROM RECURSIVE_CHAIN b WHERE b.month < a.month) AS depth FROM RECURSIVE_CHAIN a")
def qry4_recursive(shop):
    """Months as a chain, each reached from the one before it."""
    months = shop.orders.select(fn.start_of_month(F.col("order_ts")).alias("month")).distinct()
    linked = stored(months.select("month", F.lag("month").over(Window.orderBy("month")).alias("before")), "months")
    name = unique("months")
    linked.createOrReplaceTempView(name)
    return shop.spark.sql(f"""WITH RECURSIVE chain(month, depth) AS (
        SELECT month, 0L FROM {name} WHERE before IS NULL
        UNION ALL SELECT m.month, c.depth + 1 FROM chain c JOIN {name} m ON m.before = c.month
    ) SELECT month, depth FROM chain""")


@query("SELECT id AS order_id, s, 3 * (id - 1) + s AS item_id FROM shop_orders, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS s)")
def jon4_cross_series(shop):
    """Three items for each order; their ids are a closed form and need no global window."""
    lines = readers.series(shop.spark, 3, "s")
    return shop.orders.select(F.col("id").alias("order_id")).crossJoin(F.broadcast(lines)).withColumn("item_id", 3 * (F.col("order_id") - 1) + F.col("s"))


@query("SELECT id, customer_id FROM shop_orders WHERE customer_id % 10 = 0")
def jon6_orphans(shop):
    known = shop.customers.filter("id % 10 <> 0")
    return orphans(shop.orders.select("id", "customer_id"), known, "customer_id", "id")


@query("SELECT o.id, c.city FROM shop_orders o JOIN customers c ON c.id = o.customer_id")
def jon7_broadcast(shop):
    cities = small(shop.customers.select(F.col("id").alias("customer_id"), "city"))
    return shop.orders.join(cities, "customer_id").select("id", "city")


@query(", o AS (SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE customer_id END AS customer_id FROM shop_orders) SELECT c.city, count(*) AS orders FROM o JOIN customers c ON c.id = o.customer_id GROUP BY c.city")
def jon11_salted(shop):
    """Half of the orders belong to one customer."""
    hot = shop.orders.select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("customer_id")).cast("long").alias("customer_id"))
    return salted(hot, shop.customers.select(F.col("id").alias("customer_id"), "city"), "customer_id").groupBy("city").agg(F.count("*").alias("orders"))


@query(", o AS (SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE customer_id END AS customer_id FROM shop_orders) SELECT c.city, count(*) AS orders FROM o JOIN customers c ON c.id = o.customer_id GROUP BY c.city")
def jon11_salted_by_heat(shop):
    """The same, but only the keys found to be hot are salted, each by its share of the rows."""
    hot = shop.orders.select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("customer_id")).cast("long").alias("customer_id"))
    return salted_by_heat(hot, shop.customers.select(F.col("id").alias("customer_id"), "city"), "customer_id").groupBy("city").agg(F.count("*").alias("orders"))


@query(HISTORY + "SELECT o.id AS order_id, o.customer_id, h.city FROM shop_orders o LEFT JOIN h ON h.customer_id = o.customer_id AND o.order_ts >= h.valid_from AND (h.valid_to IS NULL OR o.order_ts < h.valid_to)")
def jon9_as_of_by_merging(shop):
    """Orders and versions in one order of time, each order with the last version before it."""
    orders = shop.orders.select(F.col("id").alias("order_id"), "customer_id", "order_ts")
    return as_of(orders, _history(shop).select("customer_id", "city", "valid_from", "valid_to"), "customer_id", "order_ts").select("order_id", "customer_id", "city")


@query(FACTS + "SELECT r_name AS region, count(*) AS orders, CAST(round(sum(amount), 2) AS DOUBLE) AS revenue FROM f JOIN nation ON n_name = city JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def jon12_three_sources(shop):
    """A mart table, a source database and a raw table in one plan."""
    nations = _from_database(shop.table("nation").select("n_name", F.col("n_regionkey").cast("int")), "nations")
    facts = models.build(shop)[0].join(small(nations), F.col("city") == F.col("n_name")).join(shop.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return facts.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("orders"), money(F.sum("amount")).alias("revenue"))


@query("SELECT status, round(avg(CAST(amount AS DOUBLE)), 4) AS mean, CAST(min(amount) AS DOUBLE) AS low, CAST(max(amount) AS DOUBLE) AS high, min(customer_id) AS some_customer, arg_min(id, (amount, id)) AS cheapest, arg_max(id, (amount, id)) AS dearest, count(DISTINCT customer_id) AS customers FROM shop_orders GROUP BY status")
def agg3_7_statistics(shop):
    by = F.struct("amount", "id")
    return shop.orders.groupBy("status").agg(
        F.round(F.avg(F.col("amount").cast("double")), 4).alias("mean"), F.min("amount").cast("double").alias("low"), F.max("amount").cast("double").alias("high"),
        F.min("customer_id").alias("some_customer"), F.min_by("id", by).alias("cheapest"), F.max_by("id", by).alias("dearest"), F.count_distinct("customer_id").alias("customers"),
    )


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS sketched, true AS near FROM clicks GROUP BY ALL")
def agg8_approximate_distinct(shop):
    """Users by day and type: exact, by a sketch, which is exact while it is small (to 128 values here), and whether both estimates are within five per cent."""
    got = shop.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("b"))
    close = lambda c: F.abs(F.col(c) - F.col("users")) <= 0.05 * F.col("users") + 1
    sketched = F.when(F.col("users") <= 128, F.col("b")).otherwise(F.col("users"))
    return got.select("day", "event_type", "users", sketched.alias("sketched"), (close("a") & close("b")).alias("near"))


@query("SELECT status, round(quantile_cont(CAST(amount AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST(amount AS DOUBLE), 0.9), 4) AS p90 FROM shop_orders GROUP BY status")
def agg9_quantiles(shop):
    """Exact, by sorted ranges: no status is gathered in one task."""
    found = layout.exact_quantiles(shop.orders.select("status", "amount"), ["status"], "amount", {"median": 0.5, "p90": 0.9})
    return found.select("status", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


@query("SELECT status, count(*) AS orders, true AS median_near, true AS p90_near FROM shop_orders GROUP BY status")
def rol3_quantile_states(shop):
    """Quantile states of four blocks, one of them replayed, merged on read: the rows below each value are within one per cent of the rank."""
    path, rows = scratch(shop.spark, "quantile-states"), shop.orders.select("id", "status", "amount")
    for block in (0, 1, 2, 3, 3):
        collapse.append_states(collapse.partials(rows.filter(F.col("id") % 4 == block), ["status"], quantiles={"amount": "amount"}), path, block)
    ranks = {"median": 0.5, "p90": 0.9}
    found = collapse.merged(shop.spark.read.parquet(path), ["status"], quantiles={"amount": list(ranks.values())}).select("status", *(F.get("amount", i).alias(n) for i, n in enumerate(ranks)))
    both, amount = rows.join(F.broadcast(found), "status"), F.col("amount").cast("double")  # a row for each status
    near = lambda n, p: ((F.count_if(amount < F.col(n)) <= (p + 0.01) * F.count("*")) & (F.count_if(amount <= F.col(n)) >= (p - 0.01) * F.count("*"))).alias(f"{n}_near")
    return both.groupBy("status").agg(F.count("*").alias("orders"), *(near(n, p) for n, p in ranks.items()))


@query("SELECT month(order_ts) % 2 AS odd, count(*) AS orders, CASE WHEN count(*) FILTER (WHERE amount < 0) = 0 THEN CAST(NULL AS DOUBLE) ELSE 1.0 END AS guarded, round(count(*) FILTER (WHERE status = 'paid') / count(*), 6) AS paid_share FROM shop_orders GROUP BY 1")
def agg13_guarded_ratio(shop):
    none = F.count_if(F.col("amount") < 0)
    return shop.orders.groupBy((F.month("order_ts") % 2).cast("long").alias("odd")).agg(F.count("*").alias("orders"), fn.ratio(F.count("*").cast("double"), none.cast("double")).alias("guarded"), F.round(fn.ratio(F.count_if(F.col("status") == "paid").cast("double"), F.count("*").cast("double")), 6).alias("paid_share"))


LOG = """, log AS (
  SELECT id, id * 10 AS v, 'c' AS op, status FROM shop_orders UNION ALL SELECT id, id * 10 + 1, 'u', 'shipped' FROM shop_orders WHERE id % 3 = 0
  UNION ALL SELECT id, id * 10 + 2, 'd', status FROM shop_orders WHERE id % 10 = 0 UNION ALL SELECT id, id * 10 + 3, 'c', 'pending' FROM shop_orders WHERE id % 50 = 0
), top AS (SELECT id, max(v) AS v FROM log GROUP BY id)"""


@query(LOG + "SELECT DISTINCT log.id, log.op, log.v AS _version FROM log JOIN top ON log.id = top.id AND log.v = top.v")
def lat1_latest_version(shop):
    return collapse.latest(cdc.decode(change_log(shop)), ["id"], "_version").select("id", "op", "_version")


@query(LOG + "SELECT DISTINCT log.id, log.op FROM log JOIN top ON log.id = top.id AND log.v = top.v")
def lat2_latest_by_aggregate(shop):
    return collapse.latest_values(cdc.decode(change_log(shop)), ["id"], F.col("_version"), ["op"]).select("id", "op")


@query(LOG + "SELECT log.id, log.status FROM log JOIN top ON log.id = top.id AND log.v = top.v WHERE log.op <> 'd' GROUP BY ALL")
def str13_typed_replica(shop):
    rows = cdc.replica(cdc.decode(change_log(shop)), "orders", schema("id bigint, customer_id bigint, status string, amount string"))
    return rows.select("id", "status")


def _queued(messages: DataFrame, path: str, least: int) -> int:
    """Messages as a topic's files: as many as a shuffle has parts, ``least`` at least, so that none grows with the topic; returns how many."""
    files = max(least, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    messages.repartition(files).write.text(path)
    return files


@query(LOG + "SELECT log.id, log.status FROM log JOIN top ON log.id = top.id AND log.v = top.v WHERE log.op <> 'd' GROUP BY ALL")
def str12_13_kept_state(shop):
    """The same rows, but from a state that a stream carries forward, batch by batch; a second run finds nothing new."""
    source, path, mark = scratch(shop.spark, "envelopes"), scratch(shop.spark, "current"), scratch(shop.spark, "checkpoint")
    files = _queued(change_log(shop), source, 4)
    for _ in range(2):
        cdc.keep_current(readers.read_queue(shop.spark, source, files_per_batch=-(-files // 2)), path, mark, buckets=8)
    return cdc.kept(shop.spark, path, "orders", schema("id bigint, customer_id bigint, status string, amount string")).select("id", "status")


@query(LOG + "SELECT 'orders' AS source_table, count(*) FILTER (WHERE op = 'd') AS deletes, count(*) AS records FROM (SELECT * FROM log UNION ALL SELECT * FROM log WHERE id % 4 = 0)")
def str11_cdc_landing(shop):
    """Envelopes landed by a stream; the same batch landed again replaces itself."""
    source, path = scratch(shop.spark, "envelopes"), scratch(shop.spark, "cdc")
    files = _queued(change_log(shop), source, 3)
    act = cdc.land(path)
    stream.for_each_available(readers.read_queue(shop.spark, source, files_per_batch=-(-2 * files // 3)), lambda b, i: (act(b, i), act(b, i)), scratch(shop.spark, "checkpoint"))
    return shop.spark.read.parquet(path).groupBy("source_table").agg(F.count_if(F.col("_deleted")).alias("deletes"), F.count("*").alias("records"))


@query("SELECT event_type, count(*) AS events, round(sum(CAST(props ->> '$.k' AS DOUBLE)), 2) AS k_total, count(DISTINCT user_id) AS users, true AS users_near FROM clicks GROUP BY 1")
def rol1_additive(shop):
    rows = shop.events.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    parts = [collapse.partials(rows.filter(F.dayofmonth("ts") % 2 == d), ["event_type"], sums={"k_total": "k"}, distinct={"users": "user_id"}) for d in (0, 1)]
    out = collapse.merged(parts[0].unionByName(parts[1]), ["event_type"], ["k_total"], ["users"])
    exact = rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    near = (F.abs(F.col("users") - F.col("exact")) <= 0.05 * F.col("exact")).alias("users_near")
    return out.join(exact, "event_type").select("event_type", F.col("count").alias("events"), F.round("k_total", 2).alias("k_total"), F.col("exact").alias("users"), near)


@query("SELECT CAST(ts AS DATE) AS d, count(*) AS events FROM clicks GROUP BY 1")
def rol5_split_backfill(shop):
    """Back-fill before a boundary and the live part from it on give each event once."""
    old, live = collapse.split_at(shop.events, "ts", F.lit("2024-01-15 10:00:00").cast("timestamp_ntz"))
    parts = [collapse.partials(x.withColumn("d", F.to_date("ts")), ["d"]) for x in (old, live)]
    return collapse.merged(parts[0].unionByName(parts[1]), ["d"]).withColumnRenamed("count", "events")


@query("SELECT c.city, CAST(round(sum(o.amount), 2) AS DOUBLE) AS revenue FROM shop_orders o JOIN customers c ON c.id = o.customer_id GROUP BY 1")
def rol6_side_table(shop):
    path = scratch(shop.spark, "city-revenue")
    joined = shop.orders.join(shop.customers.select(F.col("id").alias("customer_id"), "city"), "customer_id")
    return sinks.rebuild(joined.groupBy("city").agg(F.sum("amount").alias("revenue")), path).select("city", money("revenue").alias("revenue"))


SNAPSHOTS = ("1996-01-01", "1997-07-01", "1999-01-01", "2000-07-01")


@query(HISTORY + f""", d AS (SELECT CAST(unnest({list(SNAPSHOTS)}) AS TIMESTAMP) AS day), s AS (SELECT customer_id, day, arg_max(city, (order_ts, id)) AS city FROM log JOIN d ON order_ts < day GROUP BY ALL),
  n AS (SELECT *, lag(city) OVER (PARTITION BY customer_id ORDER BY day) AS before FROM s), c AS (SELECT customer_id, city, day FROM n WHERE before IS NULL OR before <> city)
SELECT customer_id, city, day AS valid_from, lead(day) OVER (PARTITION BY customer_id ORDER BY day) AS valid_to, lead(day) OVER (PARTITION BY customer_id ORDER BY day) IS NULL AS is_current FROM c""")
def scd1_snapshot_merge(shop):
    """Where customers were at four dates, merged one after the other into a stored history; closed versions stay as they were written."""
    path, log = scratch(shop.spark, "history"), moves(shop)
    for day in SNAPSHOTS:
        at = F.lit(day).cast("timestamp_ntz")
        seen = collapse.latest_values(log.filter(F.col("order_ts") < at), ["customer_id"], F.struct("order_ts", "id"), ["city"])
        history = collapse.scd2_merge_into(seen, path, "customer_id", ["city"], at)
    return history.select("customer_id", "city", "valid_from", "valid_to", "is_current")


@query(HISTORY + ", b AS (SELECT customer_id, city, lag(city) OVER (PARTITION BY customer_id ORDER BY order_ts, id) AS previous_city, row_number() OVER (PARTITION BY customer_id ORDER BY order_ts DESC, id DESC) AS r FROM log) SELECT customer_id, city, previous_city FROM b WHERE r = 1")
def scd4_previous_value(shop):
    return collapse.previous_value(moves(shop), "customer_id", "order_ts", "city", "id")


@query(HISTORY + "SELECT md5(concat(CAST(customer_id AS VARCHAR), ':', strftime(valid_from, '%Y-%m-%d'))) AS sk, customer_id FROM h")
def scd5_surrogate_key(shop):
    return _history(shop).select(collapse.surrogate_key(F.col("customer_id"), F.date_format("valid_from", "yyyy-MM-dd")).alias("sk"), "customer_id")


@query(HISTORY + "SELECT h.customer_id, h.city, h.valid_from, c.city AS current_city FROM h JOIN h c ON c.customer_id = h.customer_id AND c.valid_to IS NULL")
def scd6_hybrid(shop):
    return collapse.hybrid(_history(shop), "customer_id", "city").select("customer_id", "city", "valid_from", "current_city")


@query(", d AS (SELECT status, CAST(order_ts AS DATE) AS day, count(*) AS n FROM shop_orders GROUP BY ALL) SELECT status, day, n, row_number() OVER w AS rn, rank() OVER (PARTITION BY status ORDER BY n DESC) AS rk, dense_rank() OVER (PARTITION BY status ORDER BY n DESC) AS dr FROM d WINDOW w AS (PARTITION BY status ORDER BY n DESC, day)")
def win1_3_ranks(shop):
    d = shop.orders.groupBy("status", F.to_date("order_ts").alias("day")).agg(F.count("*").alias("n"))
    ties = Window.partitionBy("status").orderBy(F.desc("n"))
    strict = Window.partitionBy("status").orderBy(F.desc("n"), "day")
    return d.select("status", "day", "n", F.row_number().over(strict).cast("long").alias("rn"), F.rank().over(ties).cast("long").alias("rk"), F.dense_rank().over(ties).cast("long").alias("dr"))


@query("SELECT id, customer_id, coalesce(lag(id, 2) OVER w, 0) AS two_before, lead(id) OVER w AS next_id, first_value(id) OVER w AS first_id, last_value(id) OVER (PARTITION BY customer_id ORDER BY order_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM shop_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_ts, id)")
def win5_13_neighbours(shop):
    w = Window.partitionBy("customer_id").orderBy("order_ts", "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return shop.orders.select("id", "customer_id", F.lag("id", 2, 0).over(w).alias("two_before"), F.lead("id").over(w).alias("next_id"), F.first_value("id").over(whole).alias("first_id"), F.last_value("id").over(whole).alias("last_id"))


@query("SELECT id, CAST(sum(amount) OVER (PARTITION BY customer_id) AS DOUBLE) AS customer_total, CAST(sum(amount) OVER (PARTITION BY customer_id ORDER BY order_ts, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM shop_orders")
def win12_group_totals(shop):
    all_, so_far = Window.partitionBy("customer_id"), Window.partitionBy("customer_id").orderBy("order_ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return shop.orders.select("id", money(F.sum("amount").over(all_)).alias("customer_total"), money(F.sum("amount").over(so_far)).alias("running"))


@query("SELECT status, count(*) AS orders FROM shop_orders GROUP BY status")
def set1_bag_union(shop):
    old, live = collapse.split_at(shop.orders, "order_ts", F.lit("1998-06-01").cast("timestamp_ntz"))
    return old.unionByName(live).groupBy("status").agg(F.count("*").alias("orders"))


@query("SELECT id, 'missing' AS side FROM shop_orders WHERE id % 100 = 0 UNION ALL SELECT -id, 'extra' FROM shop_orders WHERE id % 100 = 50")
def set2_key_differences(shop):
    ids = shop.orders.select("id")
    return quality.key_differences(ids, ids.filter("id % 100 <> 0").unionByName(ids.filter("id % 100 = 50").select((-F.col("id")).alias("id"))), "id")


@query("SELECT id, 'missing' AS side FROM shop_orders WHERE id % 1000 = 7 UNION ALL SELECT -id, 'extra' FROM shop_orders WHERE id % 1000 = 8 UNION ALL SELECT id, 'changed' FROM shop_orders WHERE id % 1000 = 9")
def set2_segmented_differences(shop):
    """Missing, additional and changed orders, found by checksums of ranges; only ranges that differ are compared by row."""
    o = shop.orders.select("id", "status", "amount")
    kept = o.filter("id % 1000 <> 7").withColumn("status", F.when(F.col("id") % 1000 == 9, "lost").otherwise(F.col("status")))
    return quality.segmented_differences(o, kept.unionByName(o.filter("id % 1000 = 8").withColumn("id", -F.col("id"))), "id")


@query("""SELECT event_id, CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month, date_trunc('minute', ts) AS minute, time_bucket(INTERVAL 5 MINUTE, ts) AS five,
  CAST(year(ts) * 100 + month(ts) AS INTEGER) AS ym, CAST(date_diff('day', ts, TIMESTAMP '2024-02-01') AS BIGINT) AS days_left, ts + INTERVAL 90 MINUTE AS later,
  CAST(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01') AS BIGINT) AS seconds_left, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, DATE '1970-01-01' AS epoch FROM clicks""")
def fn1_8_dates(shop):
    ts, later = F.col("ts"), F.lit(NOW).cast("timestamp_ntz")
    five = F.window(ts, "5 minutes")["start"].cast("timestamp_ntz")
    rows = shop.events.select(
        "event_id", "ts", F.to_date(ts).alias("day"), fn.start_of_month(ts).alias("month"), fn.start_of_minute(ts).cast("timestamp_ntz").alias("minute"), fn.year_month(ts).alias("ym"),
        fn.days_between(ts, later).cast("long").alias("days_left"), (ts + F.expr("INTERVAL 90 MINUTES")).alias("later"), fn.seconds_between(ts, later).alias("seconds_left"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("shown"), F.lit("1970-01-01").cast("date").alias("epoch"),
    )
    return rows.withColumn("five", five).drop("ts")


@query("""SELECT id, concat('order_', CAST(id AS VARCHAR)) AS label, ['a', 'b', 'c', 'd', 'e'][1 + id % 5] AS letter, CAST(round(amount, 1) AS DOUBLE) AS rounded, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE status END, 'none') AS filled,
  md5(concat(CAST(id AS VARCHAR), ':', status)) AS key, TRY_CAST(CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE 'x' END AS BIGINT) AS parsed, CAST(status = 'paid' AS INTEGER) AS is_paid,
  CASE WHEN id % 4 <> 0 THEN id % 4 WHEN id % 6 <> 0 THEN id % 6 ELSE 0 END AS first_set, CASE status WHEN 'cancelled' THEN 'before' ELSE 'after' END AS side FROM shop_orders""")
def fn9_21_scalars(shop):
    i = F.col("id")
    letters = F.array(*[F.lit(x) for x in "abcde"])
    return shop.orders.select(
        "id", F.concat(F.lit("order_"), i.cast("string")).alias("label"), fn.element(letters, (1 + i % 5).cast("int")).alias("letter"), F.round("amount", 1).cast("double").alias("rounded"),
        F.coalesce(F.when(i % 3 != 0, F.col("status")), F.lit("none")).alias("filled"), F.md5(F.concat_ws(":", i.cast("string"), "status")).alias("key"),
        F.when(i % 2 == 0, i.cast("string")).otherwise("x").try_cast("bigint").alias("parsed"), (F.col("status") == "paid").cast("int").alias("is_paid"),
        fn.first_non_zero(i % 4, i % 6).alias("first_set"), F.when(F.col("status") == "cancelled", "before").otherwise("after").alias("side"),
    )


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, concat('{\"k\":', CAST(props ->> '$.k' AS VARCHAR), ',\"missing\":null}') AS encoded FROM clicks")
def fn16_17_json(shop):
    k = F.from_json("props", "k bigint")["k"]
    return shop.events.select("event_id", k.alias("k"), fn.compact_json(F.struct(k.alias("k"), F.lit(None).cast("string").alias("missing"))).alias("encoded"))


@query("SELECT count(*) AS n, true AS in_range, true AS unique_ids FROM shop_orders")
def fn23_24_random(shop):
    rows = shop.orders.select(F.rand(7).alias("r"), F.uuid().alias("u"))
    return rows.agg(F.count("*").alias("n"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"), (F.approx_count_distinct("u") > 0.9 * F.count("*")).alias("unique_ids"))


def _stream(shop, parts: int = 4) -> DataFrame:
    """Events as files of a queue, the order of time broken between files, read as a stream."""
    source = scratch(shop.spark, "events")
    e = stream.timed(shop.events)
    e.withColumn("part", F.col("event_id").cast("long") % parts).write.partitionBy("part").parquet(source)
    return shop.spark.readStream.schema(e.withColumn("part", F.lit(1).cast("long")).schema).parquet(source)


def _complete(shop, counted: DataFrame) -> DataFrame:
    """The result table of a complete-mode stream."""
    path = scratch(shop.spark, "result")
    stream.for_each_available(counted, lambda b, i: b.write.mode("overwrite").parquet(path), scratch(shop.spark, "checkpoint"), "complete")
    return shop.spark.read.parquet(path).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events FROM clicks GROUP BY ALL")
def str3_tumbling(shop):
    return _complete(shop, stream.per_window(_stream(shop), "1 hour", None, "event_type"))


@query(", w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE FOR i IN [0, 1]]) AS window_start FROM clicks) SELECT window_start, count(*) AS events FROM w GROUP BY 1")
def str4_hopping(shop):
    return _complete(shop, stream.per_window(_stream(shop), "1 hour", "30 minutes"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS events FROM clicks GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM clicks) - INTERVAL 10 MINUTE")
def str5_watermark(shop):
    """Append mode gives a window once the watermark has passed it; the last ones stay open."""
    source, path = scratch(shop.spark, "events"), scratch(shop.spark, "closed")
    e = stream.timed(shop.events)
    e.write.parquet(source)  # all files are one micro-batch
    counted = stream.per_window(stream.with_lateness(shop.spark.readStream.schema(e.schema).parquet(source), "10 minutes"), "1 hour")
    stream.run_available(counted, path, scratch(shop.spark, "checkpoint"))
    return shop.spark.read.parquet(path).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS events FROM clicks GROUP BY 1")
def str7_deduplicated(shop):
    """Every fifth event arrives twice."""
    source, path = scratch(shop.spark, "events"), scratch(shop.spark, "unique")
    e = stream.timed(shop.events)
    e.unionByName(e.filter(F.col("event_id").cast("long") % 5 == 0)).write.parquet(source)
    stream.run_available(stream.deduplicated(shop.spark.readStream.schema(e.schema).parquet(source), "event_id", "40 days"), path, scratch(shop.spark, "checkpoint"))
    return shop.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("events"))


@query("SELECT event_type, count(*) AS events FROM clicks GROUP BY 1")
def str9_stream_rollup(shop):
    """Each micro-batch appends its own states; reading merges them."""
    path = scratch(shop.spark, "states")
    stream.for_each_available(_stream(shop), lambda b, i: collapse.append_states(collapse.partials(b, ["event_type"]), path, i), scratch(shop.spark, "checkpoint"))
    return collapse.merged(shop.spark.read.parquet(path), ["event_type"]).withColumnRenamed("count", "events")


@query("SELECT count(*) AS rows FROM clicks")
def str15_progress(shop):
    source, path, mark = scratch(shop.spark, "in"), scratch(shop.spark, "out"), scratch(shop.spark, "checkpoint")
    act = lambda b, i: stream.publish(b, {path: lambda x: x}, i)
    for half in (0, 1):  # new files between two runs
        shop.events.filter(F.col("event_id").cast("long") % 2 == half).write.mode("append").parquet(source)
        stream.for_each_available(shop.spark.readStream.schema(shop.events.schema).parquet(source), act, mark)
    return stream.progress(shop.spark.read.parquet(path)).agg(F.sum("rows").alias("rows"))


@query(""", b AS (SELECT *, (dayofmonth(ts) - 1) // 8 AS batch FROM clicks), m AS (SELECT batch AS batch_id, count(*) AS rows, max(ts) AS newest FROM b GROUP BY 1),
  w AS (SELECT *, date_trunc('milliseconds', max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 10 MINUTE AS watermark FROM m)
SELECT batch_id, rows, CAST(date_diff('second', date_trunc('second', newest), TIMESTAMP '2024-02-01') AS BIGINT) AS lag_seconds, watermark,
  (SELECT count(DISTINCT time_bucket(INTERVAL 1 HOUR, ts)) FROM b WHERE b.batch <= w.batch_id AND (w.watermark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > w.watermark)) AS state_rows FROM w""")
def str14_17_live_progress(shop):
    """Rows, lag, watermark and rows of state of each micro-batch, as the running stream reports them; a batch is one file."""
    source = scratch(shop.spark, "days")
    e = stream.timed(shop.events)
    for batch in range(4):  # files are read in the order they were written in
        e.filter(F.floor((F.dayofmonth("ts") - 1) / 8) == batch).coalesce(1).write.mode("append").parquet(source)
    files = shop.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counted = stream.per_window(stream.with_lateness(progress.observed(files), "10 minutes"), "1 hour")
    with progress.Progress(shop.spark) as reports:
        stream.run_available(counted, scratch(shop.spark, "closed"), scratch(shop.spark, "checkpoint"))
        records = progress.lagging(reports.flush(scratch(shop.spark, "reports")), NOW)
    return records.filter("rows > 0").select("batch_id", "rows", "lag_seconds", F.col("watermark").cast("timestamp_ntz").alias("watermark"), "state_rows")


@query("SELECT CAST(sum(rows) AS BIGINT) AS rows, count(*) > 1 AS spread FROM (SELECT id % 8, count(*) AS rows FROM shop_orders GROUP BY 1)")
def dst1_hash_segments(shop):
    return layout.distribution(shop.orders, layout.hash_segment("id", 8)).agg(F.sum("rows").alias("rows"), (F.count("*") > 1).alias("spread"))


@query("SELECT 'non_negative' AS test, 'orders' AS model, 'amount' AS column_name, count(*) AS failures FROM shop_orders WHERE id % 11 = 0 UNION ALL SELECT 'accepted_values', 'orders', 'status', count(*) FROM shop_orders WHERE id % 13 = 0 UNION ALL SELECT 'not_null', 'orders', 'customer_id', count(*) FROM shop_orders WHERE id % 17 = 0 UNION ALL SELECT 'unique', 'orders', 'id', count(*) FROM shop_orders WHERE id % 19 = 0")
def dq5_seeded_faults(shop):
    """Copies with faults of each kind; every one is found."""
    o = shop.orders
    bad = o.select(
        "id", F.when(F.col("id") % 17 != 0, F.col("customer_id")).alias("customer_id"), F.when(F.col("id") % 13 == 0, "lost").otherwise(F.col("status")).alias("status"),
        F.when(F.col("id") % 11 == 0, -F.col("amount") - 1).otherwise(F.col("amount")).alias("amount"),
    )
    bad = bad.unionByName(o.filter("id % 19 = 0").select("id", F.lit(1).cast("long").alias("customer_id"), F.lit("paid").alias("status"), F.lit(1).cast("decimal(11,2)").alias("amount")))
    return quality.report({"orders": bad}, [("non_negative", "orders", "amount", {}), ("accepted_values", "orders", "status", {"values": ["pending", "paid", "shipped", "delivered", "cancelled"]}), ("not_null", "orders", "customer_id", {}), ("unique", "orders", "id", {})])


@query("SELECT round(date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01') / 3600, 6) AS age_hours, 'warn' AS status FROM clicks")
def dq6_freshness(shop):
    return quality.freshness(stream.timed(shop.events), "ts", NOW, warn_hours=12, error_hours=48).withColumn("age_hours", F.round("age_hours", 6))


@query("SELECT 'id' AS column_name, 0 AS bad_rows UNION ALL SELECT 'status', count(*) FROM shop_orders UNION ALL SELECT 'gone', -1")
def dq9_contract(shop):
    rows = shop.orders.select("id", "status")
    return quality.contract(rows, schema("id bigint, status int, gone string"))


@query("SELECT count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS revenue FROM shop_orders WHERE status = 'paid'")
def snk4_view(shop):
    """A staging view, evaluated when it is read."""
    view = sinks.as_view(models.stg_orders(shop.orders), unique("stg_orders"))
    return view.filter(F.col("status") == "paid").agg(F.count("*").alias("orders"), money(F.sum("amount")).alias("revenue"))


@query("SELECT s AS load, count(*) AS orders, CAST(sum(amount + s) AS DOUBLE) AS revenue FROM shop_orders, (SELECT unnest([0, 1]) AS s) GROUP BY s")
def snk7_8_versioned_appends(shop):
    """Two full reloads, each stamped, in files of a bounded number of rows; columns are matched by name."""
    path = scratch(shop.spark, "reloads")
    for load in (0, 1):
        rows = shop.orders.select((F.col("amount") + load).cast("decimal(11,2)").alias("amount"), "id")
        sinks.append_stamped(rows, path, F.lit(NOW.replace(hour=load)), rows_per_file=5_000)
    back = shop.spark.read.parquet(path)
    return back.groupBy(F.hour("_loaded_at").alias("load")).agg(F.count("*").alias("orders"), money(F.sum("amount")).alias("revenue"))


def _table(shop, name: str, wanted, **how) -> str:
    """A new table; its files are in the scratch folder."""
    sinks.ensure_table(shop.spark, unique_name := unique(name), wanted, path=scratch(shop.spark, name), **how)
    return unique_name


@query("SELECT id, customer_id, CASE WHEN id % 2 = 0 THEN status END AS note FROM shop_orders")
def snk9_11_12_declared_table(shop):
    """A table declared twice, filled by column names in another order, widened, and filled again."""
    wanted = schema("id bigint, customer_id bigint")
    name = _table(shop, "declared", wanted)
    sinks.ensure_table(shop.spark, name, wanted)
    odd, even = shop.orders.filter("id % 2 = 1"), shop.orders.filter("id % 2 = 0")
    path = _location(shop, name)
    sinks.insert_by_name(odd.select("customer_id", "id"), wanted, path)
    sinks.add_column(shop.spark, name, "note", "string")
    sinks.add_column(shop.spark, name, "note", "string")
    sinks.insert_by_name(even.select(F.col("status").alias("note"), "customer_id", "id"), schema("id bigint, customer_id bigint, note string"), path)
    shop.spark.catalog.refreshTable(name)
    return shop.spark.table(name)


def _location(shop, name: str) -> str:
    rows = shop.spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Location'")
    return rows.first()["data_type"]


@query("SELECT o.id, c.city FROM shop_orders o JOIN customers c ON c.id = o.customer_id")
def snk17_jon10_bucketed_join(shop):
    """Both sides bucketed by the key once: joins of them move nothing."""
    orders, customers = unique("orders_by_customer"), unique("customers")
    for name, rows in ((orders, shop.orders.select("id", "customer_id")), (customers, shop.customers.select(F.col("id").alias("customer_id"), "city"))):
        sinks.write_bucketed(rows, name, "customer_id", 8, scratch(shop.spark, name))
    return shop.spark.table(orders).join(shop.spark.table(customers).hint("merge"), "customer_id").select("id", "city")


@query("SELECT id, status, CAST(amount AS DOUBLE) AS amount FROM shop_orders")
def snk18_compaction(shop):
    """The small files of each partition packed into few, in the order of ids; nothing is lost."""
    path = scratch(shop.spark, "small-files")
    shop.orders.select("id", "status", "amount").repartition(6).sortWithinPartitions("id").write.partitionBy("status").parquet(path)
    sinks.compact_small(shop.spark, path, "id")
    return shop.spark.read.parquet(path).select("id", "status", money("amount").alias("amount"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events FROM clicks WHERE CAST(ts AS DATE) >= DATE '2024-01-20' GROUP BY ALL")
def snk21_retention(shop):
    """Partitions of two levels; whole days beyond twelve go."""
    name, path = unique("event_days"), scratch(shop.spark, "event-days")
    days = shop.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("events")).withColumn("day", F.col("day").cast("string"))
    days.repartition("day").write.partitionBy("day", "event_type").option("path", path).saveAsTable(name)
    sinks.drop_before(shop.spark, name, "day", NOW.date(), 12)
    return shop.spark.table(name).select(F.col("day").cast("date").alias("day"), "event_type", "events")


@query("SELECT count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS revenue FROM shop_orders")
def flt4_partition_filter(shop):
    """One landed day; the other day's files are not listed."""
    tree = readers.read_tree(shop.spark, _landed(shop))
    return tree.filter(F.col("dt") == F.lit(DAY1).cast("date")).agg(F.count("*").alias("orders"), money(F.sum("amount")).alias("revenue"))


@query("SELECT row_number() OVER (ORDER BY order_ts, id) AS n, id FROM shop_orders")
def win4_dense_id(shop):
    return layout.dense_id(shop.orders.select("order_ts", "id"), "n", "order_ts", "id").select("n", "id")


@query(""", late AS (SELECT count(*) FILTER (WHERE CAST(event_id AS BIGINT) % 2 = 1 AND ts < (SELECT max(ts) FROM clicks WHERE CAST(event_id AS BIGINT) % 2 = 0) - INTERVAL 1 HOUR) AS n, count(*) AS every FROM clicks)
SELECT 'drop' AS policy, every - n AS landed, CAST(0 AS BIGINT) AS set_aside FROM late UNION ALL SELECT 'side', every - n, n FROM late UNION ALL SELECT 'update', every, 0 FROM late""")
def str8_late_policies(shop):
    """Two batches, the second with events up to a month late; each batch arrives twice."""
    out = None
    parts = [stream.timed(shop.events.filter(F.col("event_id").cast("long") % 2 == half)) for half in (0, 1)]
    for policy in ("drop", "side", "update"):
        path, aside = scratch(shop.spark, policy), scratch(shop.spark, "late")
        for number in (0, 1, 1):
            stream.route_late(parts[number], number, path, aside if policy == "side" else None, allowed_seconds=3600, policy=policy)
        counted = lambda p: shop.spark.read.parquet(p).agg(F.count("*").alias("n"))
        apart = counted(aside) if policy == "side" else shop.spark.range(1).select(F.lit(0).cast("long").alias("n"))
        part = counted(path).select(F.lit(policy).alias("policy"), F.col("n").alias("landed")).join(F.broadcast(apart.select(F.col("n").alias("set_aside"))))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT user_id, count(*) AS events, CAST(1 AS BIGINT) AS partitions FROM clicks GROUP BY user_id")
def str16_keyed_partitions(shop):
    """Events of each user, and the partitions that they went to over all batches."""
    path = scratch(shop.spark, "by-user")
    act = lambda b, i: stream.publish(stream.by_key(b, "user_id", 8).withColumn("p", F.spark_partition_id()), {path: lambda x: x.groupBy("user_id", "p").agg(F.count("*").alias("n"))}, i)
    stream.for_each_available(_stream(shop).drop("part"), act, scratch(shop.spark, "checkpoint"))
    return shop.spark.read.parquet(path).groupBy("user_id").agg(F.sum("n").alias("events"), F.count_distinct("p").alias("partitions"))


@query("SELECT count(*) AS rows, count(DISTINCT status) AS statuses FROM shop_orders")
def dst3_statistics(shop):
    """What the optimizer knows of a table after it has been analyzed."""
    name = unique("analyzed")
    shop.orders.select("id", "status").write.option("path", scratch(shop.spark, name)).saveAsTable(name)
    layout.analyze(shop.spark, name)
    rows = shop.spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Statistics'").select(F.regexp_extract("data_type", "([0-9]+) rows", 1).cast("long").alias("rows"))
    about = shop.spark.sql(f"DESCRIBE EXTENDED {name} status").filter("info_name = 'distinct_count'").select(F.col("info_value").cast("long").alias("statuses"))
    return rows.join(F.broadcast(about))


@query(FACTS + "SELECT order_date, CAST(orders AS BIGINT) AS orders, CAST(revenue AS DOUBLE) AS revenue FROM net")
def dq8_10_11_daily_batch(shop):
    """The whole day run twice: snapshots checked and put in place, partitions loaded, models built and tested in order."""
    root = scratch(shop.spark, "day")
    tables = {"customers": shop.customers, "orders": shop.orders, "order_items": shop.numbered_items}
    first = quality.fingerprint(batch.run(shop.spark, tables, root, DAY1)[0]["fct_orders"])
    found, _ = batch.run(shop.spark, tables, root, DAY1)
    if quality.fingerprint(found["fct_orders"]) != first:
        raise quality.FailedTests("a second run changed the facts")
    return found["daily_revenue"].withColumn("revenue", money("revenue"))
