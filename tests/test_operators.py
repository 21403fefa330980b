"""Operators on tiny tables: ties, nulls, duplicates, gaps, empty input; plans; maintenance of tables."""

import random
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopflow.functions import expressions as fn
from shopflow.operators import collapse, joins, layout, sinks
from shopflow.plans import models, quality
from shopflow.schemas import SCHEMAS, differences, schema
from shopflow.sources import readers
from shopflow.streaming import cdc, events


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def versions(spark):
    return lambda data: spark.createDataFrame(data, "k long, v long, seq long, x string, _deleted boolean")


def test_collapse_comes_before_the_deleted_filter(versions):
    df = versions([(1, 1, 0, "a", False), (1, 2, 1, "b", True), (2, 5, 0, "c", False), (2, 5, 1, "d", False)])
    assert [(r.k, r.x) for r in collapse.current_state(df, ["k"], "v", "seq").collect()] == [(2, "d")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5)), max_size=25), st.randoms(use_true_random=False))
def test_collapse_is_idempotent_and_order_free(spark, data, shuffle):
    data = [(k, v, i, str(i), False) for i, (k, v) in enumerate(data)]
    make = lambda x: spark.createDataFrame(x, "k long, v long, seq long, x string, _deleted boolean")
    one = collapse.latest(make(data), ["k"], "v", "seq")
    other = list(data)
    shuffle.shuffle(other)
    want = {k: max((v, s, x) for kk, v, s, x, _ in data if kk == k) for k in {d[0] for d in data}}
    assert {r.k: (r.v, r.seq, r.x) for r in one.collect()} == want
    assert rows(collapse.latest(make(other + data), ["k"], "v", "seq")) == rows(one) == rows(collapse.latest(one, ["k"], "v", "seq"))


def test_partials_merge_to_the_direct_result(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("x"), (F.col("id") % 50).alias("u"))
    for i in (0, 1, 2, 1):
        collapse.append_states(collapse.partials(df.filter(F.col("x") % 3 == i), ["k"], {"total": "x"}, {"users": "u"}), f"{tmp_path}/s", i)
    got = collapse.merged(spark.read.parquet(f"{tmp_path}/s"), ["k"], ["total"], ["users"])
    want = df.groupBy("k").agg(F.count("*"), F.sum("x"), F.count_distinct("u"))
    assert rows(got) == rows(want)


def test_scd2_step(spark):
    t = lambda d: datetime(2024, 1, d)
    history = spark.createDataFrame([(1, "a", t(1), None, True), (2, "b", t(1), None, True), (3, None, t(1), None, True), (4, "z", t(1), t(2), False)], "k long, city string, valid_from timestamp, valid_to timestamp, is_current boolean")
    snapshot = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (5, "e")], "k long, city string")
    now = F.lit(t(9))
    got = collapse.scd2_merge(history, snapshot, "k", ["city"], now)
    assert rows(got) == rows(spark.createDataFrame([(1, "a", t(1), None, True), (2, "b", t(1), t(9), False), (2, "c", t(9), None, True), (3, None, t(1), None, True), (4, "z", t(1), t(2), False), (5, "e", t(9), None, True)], got.select("k", "city", "valid_from", "valid_to", "is_current").schema).select(*got.columns))
    gone = collapse.scd2_merge(history, snapshot.filter("k != 1"), "k", ["city"], now, close_missing=True)
    assert gone.filter("k = 1 AND valid_to IS NOT NULL").count() == 1
    assert collapse.scd2_merge(history.limit(0), snapshot, "k", ["city"], now).count() == 4


def test_history_intervals_touch_and_do_not_overlap(spark):
    r = random.Random(1)
    log = [(r.randint(0, 5), datetime(2024, 1, 1 + i // 4), i, r.choice(["a", "b", None])) for i in range(80)]
    h = collapse.history_of(spark.createDataFrame(log, "k long, ts timestamp, seq long, city string"), "k", "ts", ["city"], "seq").collect()
    for k in {x[0] for x in log}:
        own = sorted((x for x in h if x.k == k), key=lambda x: x.seq)
        assert all(a.valid_to == b.valid_from and a.city != b.city for a, b in zip(own, own[1:])) and own[-1].valid_to is None and sum(x.is_current for x in own) == 1


def test_versions_valid_at_the_instant_of_a_change(spark):
    t = lambda d: datetime(2024, 1, d)
    history = spark.createDataFrame([(1, "old", t(1), t(5)), (1, "new", t(5), None)], "k long, city string, valid_from timestamp, valid_to timestamp")
    facts = spark.createDataFrame([(1, t(5)), (1, t(4)), (2, t(1))], "k long, ts timestamp")
    got = joins.valid_at(facts, history, "k", "ts")
    assert sorted((r.k, r.ts.day, r.city) for r in got.collect()) == [(1, 4, "old"), (1, 5, "new"), (2, 1, None)]
    assert "NestedLoop" not in plan(got)


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    for how in ("inner", "left"):
        assert rows(joins.salted(facts, dim, "k", 8, how).select("k", "id", "name")) == rows(facts.join(dim, "k", how).select("k", "id", "name"))
    with pytest.raises(ValueError):
        joins.salted(facts, dim, "k", how="right")


def test_broadcast_only_what_is_known_to_be_small(spark):
    big, dim = spark.range(1000), spark.range(100)  # 800 bytes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(big.join(joins.small(dim, 800), "id")) and "BroadcastHashJoin" not in plan(big.join(joins.small(dim, 799), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orphans_ignore_null_keys(spark):
    child, parent = spark.createDataFrame([(1,), (9,), (None,)], "p long"), spark.createDataFrame([(1,), (None,)], "id long")
    assert rows(joins.orphans(child, parent, "p", "id")) == [(9,)]


def test_snapshots_are_not_counted_twice(spark, tmp_path):
    root = str(tmp_path / "orders")
    df = spark.range(10).select("id")
    sinks.write_snapshot(df, root, "2026-06-10")
    sinks.write_snapshot(df.limit(7), root, "2026-06-11")
    sinks.write_snapshot(df, root, "2026-06-11")
    tree = readers.read_tree(spark, root)
    assert tree.count() == 20 and readers.latest_snapshot(tree, column="dt").count() == 10
    assert readers.latest_snapshot(tree, "2026-06-10", "dt").select("dt").first().dt == date(2026, 6, 10)
    one = readers.read_snapshot(spark, root, "2026-06-10")
    assert "dt" not in one.columns and one.count() == 10
    assert "PartitionFilters: [isnotnull(dt" in plan(tree.filter("dt = DATE '2026-06-10'"))


def test_partition_replacement_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(20).select("id", (F.col("id") % 2).cast("string").alias("_dt"))
    sinks.replace_partitions(df, path)
    before = quality.fingerprint(spark.read.parquet(path))
    sinks.replace_partitions(df.filter("_dt = '1'"), path)
    assert quality.fingerprint(spark.read.parquet(path)) == before


def test_incremental_build_equals_full_build(spark, tmp_path):
    path = str(tmp_path / "days")
    source = spark.range(100).select(F.expr("timestamp '2024-01-01' + make_dt_interval(cast(id / 10 as int))").alias("ts"))
    make = lambda r: r.groupBy("d").agg(F.count("*").alias("n"))
    for part in (source.limit(45), source, source):
        sinks.build_incremental(spark, part, path, F.to_date("ts"), "d", make, lookback_days=1)
    assert rows(spark.read.parquet(path).select(F.col("d").cast("date"), "n")) == rows(source.groupBy(F.to_date("ts")).count())
    sinks.build_incremental(spark, source.limit(10), path, F.to_date("ts"), "d", make, full_refresh=True)
    assert spark.read.parquet(path).count() == 1


def test_insert_by_name_and_refusal(spark, tmp_path):
    wanted = schema("id bigint, name string")
    df = spark.createDataFrame([("a", 1)], "name string, id long")
    sinks.insert_by_name(df, wanted, f"{tmp_path}/t")
    assert rows(spark.read.parquet(f"{tmp_path}/t").select("id", "name")) == [(1, "a")]
    with pytest.raises(ValueError):
        sinks.insert_by_name(df.withColumn("id", F.col("id").cast("string")), wanted, f"{tmp_path}/t")
    assert differences(df, wanted) == [] and differences(df.drop("id"), wanted) == ["missing id bigint"]


def test_table_definition_columns_and_retention(spark):
    name = "shopflow_t1"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    wanted = schema("id bigint, d string")
    sinks.ensure_table(spark, name, wanted, "d")
    sinks.ensure_table(spark, name, wanted, "d")
    with pytest.raises(ValueError):
        sinks.ensure_table(spark, name, schema("id string, d string"))
    spark.sql(f"INSERT INTO {name} VALUES (1, '2024-01-01'), (2, '2024-01-20')")
    sinks.add_column(spark, name, "extra", "int")
    sinks.add_column(spark, name, "extra", "int")
    assert rows(spark.table(name).select("id", "extra")) == [(1, None), (2, None)]
    assert sinks.drop_before(spark, name, "d", date(2024, 1, 21), 7) == ["d=2024-01-01"]
    assert spark.table(name).count() == 1
    spark.sql(f"DROP TABLE {name}")


def test_bucketed_join_needs_no_exchange(spark):
    for t in ("shopflow_b1", "shopflow_b2"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
        sinks.write_bucketed(spark.range(1000).withColumn("x", F.lit(1)), t, "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("shopflow_b1").join(spark.table("shopflow_b2"), "id")
        assert "Exchange" not in plan(joined) and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("ANALYZE TABLE shopflow_b1 COMPUTE STATISTICS FOR ALL COLUMNS")
    for t in ("shopflow_b1", "shopflow_b2"):
        spark.sql(f"DROP TABLE {t}")


def test_compaction_and_sorted_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartition(20).write.parquet(path)
    assert sinks.compact(spark, path, f"{tmp_path}/few", 1 << 20) == 1
    assert len(list((tmp_path / "few").glob("*.parquet"))) == 1 and spark.read.parquet(f"{tmp_path}/few").count() == 1000
    sinks.write_sorted(spark.range(1000).select((999 - F.col("id")).alias("id")), f"{tmp_path}/sorted", "id", files=2)
    assert "PushedFilters: [IsNotNull(id), LessThan(id,10)]" in plan(spark.read.parquet(f"{tmp_path}/sorted").filter("id < 10"))


def test_append_stamps_and_months(spark, tmp_path):
    for now in (datetime(2024, 1, 1), datetime(2024, 1, 2)):
        sinks.append_stamped(spark.range(3), f"{tmp_path}/t", F.lit(now))
    assert collapse.latest(spark.read.parquet(f"{tmp_path}/t"), ["id"], "_loaded_at").count() == 3
    sinks.write_by_month(spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 2, 5),)], "d date"), f"{tmp_path}/m", "d")
    assert sorted(p.name for p in (tmp_path / "m").glob("d_month=*")) == ["d_month=2024-01", "d_month=2024-02"]


def test_database_scan(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    spark.range(1, 101).select("id", F.col("id").cast("string").alias("name"), F.lit(1).alias("unused")).write.format("jdbc").options(url=f"{url};create=true", dbtable="T", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = readers.read_database(spark, url, "T", ["id", "name"], "id", (1, 101), 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.count() == 100 and got.rdd.getNumPartitions() == 4 and got.columns == ["id", "name"]


def test_csv_and_series(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,name\n1,alpha\n2,beta\n3,gamma\n")
    assert readers.read_csv(spark, str(tmp_path), schema("id bigint, name string")).count() == 3
    assert rows(readers.series(spark, 3)) == [(1,), (2,), (3,)] and readers.series(spark, 0).count() == 0


def test_messages_that_cannot_be_read_are_kept_apart(spark):
    lines = ['{"event_id":"1","user_id":3,"ts":"2024-01-01 10:00:00","new":1}', '{"event_id":"2"', '{"user_id":4}', "", '{"event_id":"5","ts":"01.02.2024"}']
    good, bad = events.split_malformed(spark.createDataFrame([(x,) for x in lines], "value string"), SCHEMAS["events"], "event_id")
    got = {r.event_id: r for r in good.collect()}
    assert set(got) == {"1", "5"} and got["1"].ts == datetime(2024, 1, 1, 10) and got["5"].ts is None and got["1"].page is None
    assert bad.count() == 3


def test_late_events_by_policy(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1, h)
    batches = [[(1, t(10)), (2, t(12))], [(3, t(9)), (4, t(13)), (6, None)], [(5, t(13))]]
    for policy, landed in (("side", [1, 2, 4, 5, 6]), ("drop", [1, 2, 4, 5, 6]), ("update", [1, 2, 3, 4, 5, 6])):
        for number in (0, 1, 1, 2, 1):  # replays change nothing
            events.route_late(spark.createDataFrame(batches[number], "id long, ts timestamp"), number, f"{tmp_path}/{policy}", f"{tmp_path}/late" if policy == "side" else None, allowed_seconds=3600, policy=policy)
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{policy}").collect()) == landed
    assert rows(spark.read.parquet(f"{tmp_path}/late").select("id")) == [(3,)]
    with pytest.raises(ValueError):
        events.route_late(spark.createDataFrame(batches[0], "id long, ts timestamp"), 0, f"{tmp_path}/x", policy="lose")


def test_a_day_without_rows_replaces_its_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-02")], "id long, _dt string").withColumn("_dt", F.col("_dt").cast("date"))
    path = f"{tmp_path}/t"
    sinks.replace_partitions(df, path)
    for _ in range(2):
        sinks.replace_partitions(df.limit(0), path, day="2024-01-01")
    assert rows(spark.read.parquet(path).select("id")) == [(3,)]
    sinks.replace_partitions(df, path, day="2024-01-01")
    assert rows(spark.read.parquet(path).select("id")) == [(1,), (2,), (3,)]


def test_delete_in_place_and_dense_ids(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i % 5 else i) for i in range(50)] * 2, "id long, k string, v long")
    df.write.parquet(f"{tmp_path}/t")
    assert sinks.delete_in_place(spark, f"{tmp_path}/t", F.col("v") > 10).count() == 100 - 14
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    got = layout.dense_id(df, "n", "k", "id").collect()
    assert sorted(r.n for r in got) == list(range(1, 101))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.n)] == sorted((r.k, r.id) for r in got)
    assert layout.dense_id(df.limit(0), "n", "id").count() == 0


def test_the_events_own_time_comes_before_the_sources(spark):
    lines = ['{"op":"u","after":{"id":1,"v":"new"},"source":{"table":"t","ts_ms":10},"ts_ms":99}', '{"op":"u","after":{"id":1,"v":"old"},"source":{"table":"t","ts_ms":90},"ts_ms":98}', '{"op":"c","after":{"id":2},"source":{"table":"t","ts_ms":5},"ts_ms":0}', '{"op":"d","before":{"id":2},"source":{"table":"t","ts_ms":5}}']
    rows_ = cdc.decode(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, at long"), "at")
    assert sorted((r.id, r._version) for r in rows_.collect()) == [(1, 98), (1, 99), (2, 5), (2, 5)]
    assert [(r.id, r.payload) for r in cdc.current(rows_, "at").collect()] == [(1, '{"id":1,"v":"new"}')]
    assert cdc.current(rows_.withColumnRenamed("at", "_position")).count() == 1


def test_change_data_cases(spark):
    lines = [
        '{"op":"c","before":null,"after":{"id":1,"v":"a","n":null},"source":{"table":"t","ts_ms":10}}', '{"op":"d","before":{"id":1},"after":null,"source":{"table":"t","ts_ms":11}}',
        '{"op":"c","before":null,"after":{"id":1,"v":"b"},"source":{"table":"t","ts_ms":12}}', '{"op":"u","after":{"id":2,"v":"x"},"source":{"ts_ms":0},"ts_ms":7}', '{"op":"c","after":{"v":1}}', None, "oops", "null",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r.source_table, r.id, r._version): r for r in cdc.decode(df).collect()}
    assert set(got) == {("t", 1, 10), ("t", 1, 11), ("t", 1, 12), ("?", 2, 7)} and got["t", 1, 10].payload == '{"id":1,"v":"a","n":null}' and got["t", 1, 11]._deleted
    assert cdc.rejected(df).count() == 4
    live = cdc.current(cdc.decode(df))
    assert sorted((r.id, r.op) for r in live.collect()) == [(1, "c"), (2, "u")]
    assert rows(cdc.replica(cdc.decode(df), "t", schema("id bigint, v string").add("w", "string"))) == [(1, "b", None)]
    assert cdc.counts(cdc.decode(df.limit(0))).count() == 0


def test_stream_runs_continue_from_their_checkpoint(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in ("0", "1"):
        spark.range(5).select(F.lit(part).alias("value")).write.mode("append").text(source)
        events.run_available(readers.read_queue(spark, source), table, mark)
    assert spark.read.parquet(table).count() == 10


def test_failing_tests_stop_the_build(spark):
    made = []

    def make(name, df):
        return lambda _: (made.append(name), df)[1]

    keep = lambda df, name: df
    good, bad = spark.createDataFrame([(1, 5)], "id long, n long"), spark.createDataFrame([(1, -5), (1, 2), (None, 1)], "id long, n long")
    steps = [("a", make("a", good), [("not_null", "id", {}), ("relationships", "id", lambda m: {"parent": m["a"], "key": "id"})]), ("b", make("b", bad), [("non_negative", "n", {}), ("unique", "id", {}), ("not_null", "id", {})]), ("c", make("c", good), [])]
    with pytest.raises(quality.FailedTests) as e:
        quality.build_and_test(steps, keep)
    assert made == ["a", "b"] and str(e.value).count("'failures': 1") == 3
    assert len(quality.build_and_test(steps[:1], keep)[1]) == 2


def test_reconciliation_and_freshness(spark):
    a, b = spark.range(3), spark.range(2)
    with pytest.raises(ValueError):
        quality.must_reconcile({"t": (a, b)})
    quality.must_reconcile({"t": (a, a), "e": (a.limit(0), b.limit(0))})
    assert rows(quality.key_differences(a, b, "id")) == [(2, "missing")]
    at = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp")
    assert [quality.freshness(at, "t", datetime(2024, 1, 1, h), 2, 5).first().status for h in (1, 3, 6)] == ["pass", "warn", "error"]
    assert quality.freshness(at.limit(0), "t", datetime(2024, 1, 1), 2, 5).first().status == "error"


def test_orders_without_items_count_zero(spark):
    orders = models.stg_orders(spark.createDataFrame([(1, 7, "paid", datetime(2024, 1, 1), 5.0), (2, 8, "cancelled", datetime(2024, 1, 1), 6.0), (3, 7, None, datetime(2024, 1, 1), 7.0)], "id long, customer_id long, status string, order_ts timestamp, amount double").withColumn("amount", F.col("amount").cast("decimal(10,2)")))
    customers = models.stg_customers(spark.createDataFrame([(7, "n", "e", "c", None)], "id long, name string, email string, city string, created_at timestamp"))
    items = models.stg_order_items(spark.createDataFrame([(1, 1, "p", 2)], "order_id long, line_no long, product string, quantity int").withColumn("unit_price", F.lit("1.50").cast("decimal(10,2)")))
    facts = models.fct_orders(orders, customers, items)
    assert sorted((r.order_id, r.city, r.item_count, float(r.items_total)) for r in facts.collect()) == [(1, "c", 1, 3.0), (2, None, 0, 0.0), (3, "c", 0, 0.0)]
    assert [(r.orders, float(r.revenue)) for r in models.daily_revenue(facts).collect()] == [(1, 5.0)] and models.daily_revenue(facts, gross=True).first().orders == 3


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    ts = lambda s: F.lit(s).cast("timestamp")
    assert value(fn.days_between(ts("2024-01-01 23:59:00"), ts("2024-01-02 00:01:00"))) == 1
    assert value(fn.first_non_zero(F.lit(0), F.lit(None).cast("int"), F.lit(4))) == 4 and value(fn.first_non_zero(F.lit(0))) == 0
    assert value(fn.ratio(F.lit(1), F.lit(0))) is None and float(value(fn.percent(F.lit(1), F.lit(8)))) == 12.5
    assert value(fn.compact_json(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b")))) == '{"a":1,"b":null}'


def test_orphans_are_counted_by_key(spark):
    child = spark.createDataFrame([(1,), (1,), (7,), (7,), (8,), (None,)], "k bigint")
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id bigint")
    tests = [("relationships", "m", "k", {"parent": parent, "key": "id"}), ("unique", "m", "k", {})]
    found = quality.report({"m": child}, tests)
    assert sorted((r["test"], r["failures"]) for r in found.collect()) == [("relationships", 3), ("unique", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "as string" not in plan
    texts = parent.select(F.col("id").cast("string").alias("id"))
    assert joins.orphan_count(child, texts, "k", "id").first()[0] == 3 and joins.orphan_count(child.limit(0), parent, "k", "id").first()[0] == 0


def test_numbered_rows_store_what_is_kept(spark):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a")], "k int, v string")
    got = layout.dense_id(df, "n", "k", "v", keep=[F.upper("v").alias("v")])
    assert rows(got.select("n", "v")) == [(1, "A"), (2, "Z"), (3, "B")] and got.columns == ["v", "n"]


def test_key_differences_meet_once(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "id bigint") for v in ([1, 1, 2, None], [2, 3, 3, None, None]))
    found = quality.key_differences(a, b, "id")
    shown = plan(found)
    assert shown.count("Exchange") == 1 and "REPARTITION_BY_NUM" in shown and "Sort" not in shown
    assert rows(found) == rows(spark.createDataFrame([(1, "missing"), (3, "extra"), (None, "missing"), (None, "extra")], "id bigint, side string"))
