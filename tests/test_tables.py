"""Tables that change in place: upserts by key, kept state, compaction, clustering, recovery after a crash."""

import json
import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shopflow.operators import collapse, layout, publish, sinks, upsert
from shopflow.plans import catalog, quality
from shopflow.sources import readers
from shopflow.streaming import cdc, events, progress


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path) -> set[str]:
    return {str(p) for p in Path(path).rglob("*.parquet") if not p.name.startswith(".")}


def test_upserts_equal_a_full_build(spark, tmp_path):
    """Blocks with late, repeated and deleted rows; the table is the latest version of each key after every block."""
    r, path, log = random.Random(2), f"{tmp_path}/t", []
    for block in range(4):
        new = [(r.choice([None, *range(60)]), r.randint(0, 9), len(log) + i, r.choice(["a", "b", None]), r.random() < 0.2) for i in range(40)]
        log += new
        df = spark.createDataFrame(new, "k long, v long, seq long, x string, gone boolean")
        upsert.upsert(df, path, ["k"], 8, ["v", "seq"])
        best = {k: max((x for x in log if x[0] == k), key=lambda x: x[1:3]) for k in {x[0] for x in log}}
        assert rows(upsert.read_table(spark, path)) == sorted(best.values(), key=str)
    assert upsert.upsert(df, path, ["k"], 8, ["v", "seq"]) == []


def test_only_buckets_with_changes_are_rewritten(spark, tmp_path):
    path, df = f"{tmp_path}/t", spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("x"))
    assert len(upsert.upsert(df, path, ["k"], 16)) == 16
    before = files(path)
    one = df.filter("k = 7").withColumn("x", F.lit("new"))
    rewritten = upsert.upsert(one.unionByName(df.filter("k < 500 AND k <> 7")), path, ["k"], 16)
    assert len(rewritten) == 1 and len(files(path) & before) == len(before) - 1
    assert upsert.upsert(one, path, ["k"], 16) == [] and rows(upsert.read_table(spark, path)) == rows(one.unionByName(df.filter("k <> 7")))
    assert upsert.upsert(one.withColumn("gone", F.lit(True)), path, ["k"], 16, deleted="gone") == rewritten
    assert rows(upsert.read_table(spark, path)) == rows(df.filter("k <> 7"))
    with pytest.raises(ValueError):
        upsert.upsert(one, path, ["k"], 8)
    with pytest.raises(ValueError):
        upsert.upsert(one.withColumn("more", F.lit(1)), path, ["k"], 16)


def test_upserts_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "k long, x string")
    assert upsert.upsert(none, f"{tmp_path}/t", ["k"], 4) == []
    assert upsert.upsert(spark.createDataFrame([(None, "a"), (1, None)], none.schema), f"{tmp_path}/t", ["k"], 4) != []
    assert upsert.upsert(none, f"{tmp_path}/t", ["k"], 4) == [] and rows(upsert.read_table(spark, f"{tmp_path}/t")) == [(1, None), (None, "a")]


@pytest.mark.parametrize("moves", [0, 1, 3])
def test_a_crash_while_files_move_is_made_good(spark, tmp_path, monkeypatch, moves):
    path, df = f"{tmp_path}/t", spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("x"))
    upsert.upsert(df, path, ["k"], 4)
    move, left = publish.Folder.move, [moves + 1]  # the list of a change is moved into place first

    def failing(self, a, b):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("no more")
        move(self, a, b)

    monkeypatch.setattr(publish.Folder, "move", failing)
    with pytest.raises(OSError):
        upsert.upsert(df.withColumn("x", F.lit("new")), path, ["k"], 4)
    monkeypatch.undo()
    assert rows(upsert.read_table(spark, path)) == [(k, "new") for k in sorted(range(100), key=lambda k: str((k, "new")))]
    assert not [n for n in publish.Folder(spark, path).names() if n.startswith(("_staged", "_pending"))]


def test_an_undecided_change_is_forgotten(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/t", spark.range(10).select(F.col("id").alias("k"), F.lit("old").alias("x"))
    upsert.upsert(df, path, ["k"], 2)
    monkeypatch.setattr(upsert, "publish", lambda *a: (_ for _ in ()).throw(OSError("before the decision")))
    with pytest.raises(OSError):
        upsert.upsert(df.withColumn("x", F.lit("new")), path, ["k"], 2)
    assert rows(upsert.read_table(spark, path)) == rows(df)
    left = [n for n in publish.Folder(spark, path).names() if n.startswith("_staged")]
    assert len(left) == 1  # a reader can't know that its writer is gone
    assert publish.recover(spark, path) == 0 and not [n for n in publish.Folder(spark, path).names() if n.startswith("_staged")]
    with pytest.raises(OSError):
        publish.publish(spark, path, left[0].removeprefix("_staged-"), ["_bucket=0"])
    assert rows(upsert.read_table(spark, path)) == rows(df)


def test_incremental_by_key_equals_a_full_build(spark, tmp_path):
    t = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    source = [(k, t(d), f"{k}-{d}") for d in range(9) for k in range(20) if (k + d) % 3 == 0]
    df = lambda keep: spark.createDataFrame([x for x in source if keep(x)], "k long, at timestamp, x string")
    path = f"{tmp_path}/t"
    upsert.build_incremental_by_key(df(lambda x: x[1] < t(4)), path, ["k"], "at", 8)
    upsert.build_incremental_by_key(df(lambda x: True), path, ["k"], "at", 8, timedelta(days=1))
    step = rows(upsert.read_table(spark, path))
    assert upsert.build_incremental_by_key(df(lambda x: True), path, ["k"], "at", 8, timedelta(days=1)) == []
    upsert.build_incremental_by_key(df(lambda x: True), path, ["k"], "at", 8, full_refresh=True)
    assert step == rows(upsert.read_table(spark, path)) == sorted(({x[0]: x for x in source}).values(), key=str)


def test_a_swap_that_was_cut_off(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/_old-t")  # the table, moved away, and no new one in its place
    assert sinks.restore(spark, f"{tmp_path}/t") and not sinks.restore(spark, f"{tmp_path}/t")
    sinks.delete_in_place(spark, f"{tmp_path}/t", F.col("id") == 1)
    (tmp_path / "t").rename(tmp_path / "_old-t")
    spark.range(9).write.parquet(f"{tmp_path}/new")
    sinks.swap(spark, f"{tmp_path}/new", f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 9 and not (tmp_path / "_old-t").exists()


def test_state_kept_by_a_stream_equals_the_collapsed_log(spark, tmp_path):
    """After each batch of a log with late, repeated and contradicting changes, deletes and malformed messages."""
    r, source, n = random.Random(6), tmp_path / "log", 0
    source.mkdir()
    stream = lambda: readers.read_queue(spark, str(source))
    for batch in range(4):
        lines = ["", "{", json.dumps({"op": "u", "ts_ms": 3})]
        for _ in range(40):
            k, v, op = r.randint(0, 12), r.randint(1, 9), r.choice("cuud")
            side = {"id": k, "x": r.choice("abc")}
            lines.append(json.dumps({"op": op, "ts_ms": v, "source": {"table": r.choice(["a", "b"])}, ("before" if op == "d" else "after"): side}))
        (source / f"{batch}.json").write_text("\n".join(lines + lines[-5:]))
        for _ in range(2):  # the second run has nothing to read
            cdc.keep_current(stream(), f"{tmp_path}/kept", f"{tmp_path}/mark", buckets=4)
        events.for_each_available(stream(), cdc.land(f"{tmp_path}/landed"), f"{tmp_path}/mark2")
        names = ("source_table", "id", "op", "payload", "_version")
        want = cdc.current(spark.read.parquet(f"{tmp_path}/landed"), "_batch_id", "_deleted", "payload").select(*names)
        assert rows(cdc.kept(spark, f"{tmp_path}/kept").select(*names)) == rows(want)
        n += 1
    before = files(f"{tmp_path}/kept")
    (source / "old.json").write_text(json.dumps({"op": "c", "ts_ms": 0, "source": {"table": "a", "ts_ms": 1}, "after": {"id": 1, "x": "late"}}))
    cdc.keep_current(stream(), f"{tmp_path}/kept", f"{tmp_path}/mark", buckets=4)
    assert n == 4 and files(f"{tmp_path}/kept") == before  # older than what is there: nothing is rewritten


def test_quantile_states_and_exact_quantiles(spark):
    r = random.Random(8)
    data = [(k, r.choice([None, r.random() * 100])) for k in ("a", "b", None) for _ in range(r.randint(1, 400))] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, x double").repartition(3)
    ranks = {"low": 0.0, "median": 0.5, "p90": 0.9, "high": 1.0}
    got = layout.exact_quantiles(df, ["k"], "x", ranks)
    want = df.filter("x IS NOT NULL").groupBy("k").agg(*(F.percentile("x", p).alias(n) for n, p in ranks.items()))
    show = lambda d: sorted(((x.k, *(round(x[n], 9) for n in ranks)) for x in d.collect()), key=str)
    assert show(got) == show(want)
    states = [collapse.partials(df.filter(c), ["k"], quantiles={"x": "x"}) for c in ("x < 30", "x >= 30 OR x IS NULL")]
    merged = {x.k: x.x for x in collapse.merged(states[0].unionByName(states[1]), ["k"], quantiles={"x": list(ranks.values())}).collect()}
    assert merged["none"] is None and merged["one"] == [5.0] * 4
    for k, low, median, p90, high in show(want):
        own = sorted(x for kk, x in data if kk == k and x is not None)
        assert (merged[k][0], merged[k][3]) == (own[0], own[-1]) and abs(sum(x <= merged[k][1] for x in own) / len(own) - 0.5) < 0.02 + 1 / len(own)


def test_places_split_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, 1).otherwise(F.col("id")).alias("k"), F.lit(0).alias("x"))
    got = layout.placed(df, ["k"], "x")
    assert got.filter("k = 1").agg(F.count_distinct("_place"), F.max("_place"), F.min("_rows")).first() == (4900, 4899, 4900)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0


def groups_read(path: str, column: str, low: float, high: float) -> tuple[int, int]:
    """(row groups whose range of a column meets low to high, all row groups)."""
    met = every = 0
    for f in files(path):
        about = pq.ParquetFile(f).metadata
        at = about.schema.names.index(column)
        for i in range(about.num_row_groups):
            s = about.row_group(i).column(at).statistics
            every, met = every + 1, met + (s.min <= high and s.max >= low)
    return met, every


def test_clustering_serves_filters_on_either_column(spark, tmp_path):
    """A tenth of the values of either column is in at most a third of the row groups; sorting serves one of them only."""
    df = spark.range(60_000).select("id", (F.xxhash64("id") % 1000).cast("int").alias("a"), F.when(F.col("id") % 50 != 0, (F.xxhash64("id", F.lit(1)) % 1000).cast("double")).alias("b"))
    write = lambda how, path: (spark.conf.set("parquet.block.size", str(1 << 15)), how(path), spark.conf.unset("parquet.block.size"))
    write(lambda p: layout.write_clustered(df, p, "a", "b", files=16, bits=6), f"{tmp_path}/c")
    write(lambda p: sinks.write_sorted(df, p, "a", "b", files=16), f"{tmp_path}/s")
    assert rows(spark.read.parquet(f"{tmp_path}/c")) == rows(df)
    for column in ("a", "b"):
        met, every = groups_read(f"{tmp_path}/c", column, 100, 300)
        assert every >= 16 and 3 * met <= every, (column, met, every)
    met, every = groups_read(f"{tmp_path}/s", "b", 100, 300)
    assert met == every
    with pytest.raises(ValueError):
        layout.write_clustered(df.withColumn("x", F.lit("text")), f"{tmp_path}/no", "a", "x")
    layout.write_clustered(df.limit(0), f"{tmp_path}/none", "a", "b", files=2)
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0


def test_small_files_are_packed_in_order(spark, tmp_path):
    """Of each partition the small files become few, in order; a large one stays, and a crash is made good."""
    path = f"{tmp_path}/t"
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "a b").otherwise("c=d").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    df.filter("id >= 2000").coalesce(1).sortWithinPartitions("id").write.partitionBy("k").parquet(path)
    large = files(path)
    df.filter("id < 2000").repartition(7).sortWithinPartitions("id").write.mode("append").partitionBy("k").parquet(path)
    assert sinks.compact_small(spark, path, "id", file_bytes=60_000) == 14
    left = files(path)
    assert large & left == {f for f in large if Path(f).stat().st_size > 30_000} and len(left) <= 6
    for f in left:
        ids = pq.read_table(f, columns=["id"])["id"].to_pylist()
        assert ids == sorted(ids)
    assert rows(spark.read.parquet(path).select("id", "k", "x")) == rows(df) and sinks.compact_small(spark, path, "id", file_bytes=1) == 0


def test_bins_have_room():
    sizes = {f"f{i}": s for i, s in enumerate([90, 40, 30, 30, 20, 10, 10, 5, 60])}
    made = sinks.bins(sizes, 100)
    assert all(sum(sizes[n] for n in names) <= 100 and len(names) > 1 for names in made)
    assert sorted(n for names in made for n in names) == ["f1", "f2", "f3", "f4", "f5", "f6", "f7"] and sinks.bins({"one": 3}, 100) == []


def test_partitions_and_the_latest_snapshot_come_from_metadata(spark, tmp_path):
    root = f"{tmp_path}/t"
    for ds, n in (("2026-06-09", 5), ("2026-06-10", 10), ("2026-06-11", 0)):
        sinks.write_snapshot(spark.range(n), root, ds)
    counted = readers.partitions(spark, root)
    assert "PushedAggregation: [COUNT(*)]" in counted._jdf.queryExecution().toString()
    assert [(str(r.dt), r.rows, r.files > 0) for r in counted.orderBy("dt").collect()] == [("2026-06-09", 5, True), ("2026-06-10", 10, True)]
    tree = readers.read_tree(spark, root)
    before = spark.sparkContext.statusTracker()
    jobs = len(before.getJobIdsForGroup())
    assert sorted(readers.partition_values(tree, "dt")) == ["2026-06-09", "2026-06-10", "2026-06-11"]
    last = readers.latest_snapshot(tree, column="dt")
    assert len(before.getJobIdsForGroup()) == jobs  # nothing ran
    assert last.count() == 0 and readers.latest_snapshot(tree, "2026-06-10", "dt").count() == 10 and readers.latest_snapshot(tree, "2020-01-01", "dt").count() == 0
    assert "PartitionFilters: [isnotnull(dt" in readers.latest_snapshot(tree, "2026-06-10", "dt")._jdf.queryExecution().toString()


def test_differences_by_segments(spark):
    """Missing, extra, changed and repeated rows, null keys; what is equal is left out of the later passes."""
    r = random.Random(5)
    base = [(k, f"x{k}") for k in range(-500, 3000, 3)] + [(None, "n"), (7, "again"), (7, "again")]
    gone, new, other = r.sample(range(10, 3000, 3), 4), [2, 4001, -9000], r.sample(range(-500, 0, 3), 3)
    target = [(k, x + "!" if k in other else x) for k, x in base if k not in gone] + [(k, "new") for k in new]
    target.remove((7, "again"))
    make = lambda data: spark.createDataFrame(data, "k long, x string").repartition(3)
    got = {(x.k, x.side) for x in quality.segmented_differences(make(base), make(target).select("x", "k"), "k", ranges=8).collect()}
    assert got == {(k, "missing") for k in gone} | {(k, "extra") for k in new} | {(k, "changed") for k in other} | {(7, "changed")}
    for a, b in ((base, base), ([], []), ([], base), (base, []), ([(None, "a")], [(None, "b")]), ([(2**63 - 1, "a"), (-(2**63), "b")], [(2**63 - 1, "a")])):
        want = {(k, "missing" if k not in dict(b) else "extra" if k not in dict(a) else "changed") for k in {*dict(a), *dict(b)} if sorted(x for x in a if x[0] == k) != sorted(x for x in b if x[0] == k)}
        assert {tuple(x) for x in quality.segmented_differences(make(a), make(b), "k", ranges=8).collect()} == want


def test_equal_segments_are_read_once(spark, tmp_path):
    spark.range(100_000).select("id", (F.col("id") % 7).alias("x")).repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    found = quality.segmented_differences(a, a.withColumn("x", F.when(F.col("id") == 77_777, 9).otherwise(F.col("x"))), "id")
    assert [tuple(r) for r in found.collect()] == [(77_777, "changed")]
    filters = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter (" in x and "id#" in x]
    edge = lambda s, sign, best: best(int(x) for x in re.findall(rf"id#\d+L {sign} (\d+)", s))
    assert len(filters) == 2 and all(edge(s, "<=", min) - edge(s, ">=", max) < 100 for s in filters)


def test_reports_of_a_running_stream(spark, tmp_path):
    """Rows, newest event, watermark and state of each batch; reports that were written are let go of."""
    t0 = datetime(2024, 1, 1)
    data = [[(0, 0), (1, 70)], [(2, 30), (3, 200)], [(4, 10)]]  # minutes; the last comes too late
    source = f"{tmp_path}/in"
    for part in data:
        spark.createDataFrame([(i, t0 + timedelta(minutes=m)) for i, m in part], "id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    read = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    counted = events.per_window(events.with_lateness(progress.observed(read), "10 minutes"), "1 hour")
    with progress.Progress(spark) as reports:
        events.run_available(counted, f"{tmp_path}/out", f"{tmp_path}/mark")
    table = reports.flush(f"{tmp_path}/reports")
    assert reports.table().count() == 0 and reports not in spark.streams._jsqm.listListeners()
    got = [r for r in progress.lagging(table, t0 + timedelta(minutes=300)).orderBy("batch_id").collect() if r.rows]
    assert [(r.batch_id, r.rows, r.lag_seconds, r.watermark) for r in got] == [(0, 2, 230 * 60, None), (1, 2, 100 * 60, t0 + timedelta(minutes=60)), (2, 1, 100 * 60, t0 + timedelta(minutes=190))]
    assert [r.state_rows for r in got] == [2, 2, 1] and [r.late_rows for r in got] == [0, 0, 1]


def test_a_stored_history_keeps_its_closed_versions_as_they_are(spark, tmp_path):
    """Each step equals a merge of whole tables, and no file of closed versions is written again."""
    r, path = random.Random(9), f"{tmp_path}/h"
    whole = spark.createDataFrame([], "k long, city string, valid_from timestamp, valid_to timestamp, is_current boolean")
    closed: set[str] = set()
    for step in range(4):
        now = F.lit(datetime(2024, 1, 1 + step))
        snapshot = spark.createDataFrame([(k, r.choice(["a", "b", None])) for k in range(20) if r.random() < 0.8], "k long, city string")
        whole = spark.createDataFrame(collapse.scd2_merge(whole, snapshot, "k", ["city"], now, close_missing=step == 2).collect(), whole.schema)
        got = collapse.scd2_merge_into(snapshot, path, "k", ["city"], now, close_missing=step == 2)
        assert rows(got.select(*whole.columns)) == rows(whole)
        now_closed = {f for f in files(path) if "_open=false" in f}
        assert closed <= now_closed
        closed = now_closed
    assert len(closed) >= 2


def test_kept_state_is_only_in_the_table(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [json.dumps({"op": "c", "ts_ms": v, "source": {"table": "a"}, "after": {"id": k}}) for k in range(20) for v in (2, 1)]
    (tmp_path / "log" / "1.json").write_text("\n".join(lines))
    cdc.keep_current(readers.read_queue(spark, str(tmp_path / "log")), f"{tmp_path}/kept", f"{tmp_path}/mark", buckets=2)
    assert cdc.kept(spark, f"{tmp_path}/kept").filter("_version = 2").count() == 20 and not (tmp_path / "mark" / "state").exists()


def test_a_large_bucket_is_several_files(spark, tmp_path):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "16k")
    try:
        upsert.upsert(spark.range(0, 20_000, 1, 8).withColumn("x", F.sha2(F.col("id").cast("string"), 256)), f"{tmp_path}/t", ["id"], 1)
    finally:
        spark.conf.unset(name)
    assert len(list((tmp_path / "t" / "_bucket=0").glob("*.parquet"))) > 1 and upsert.read_table(spark, f"{tmp_path}/t").distinct().count() == 20_000


def test_a_topic_has_as_many_files_as_a_shuffle_has_parts(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert catalog._queued(spark.range(900).select(F.col("id").cast("string").alias("value")), f"{tmp_path}/q", 3) == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(list((tmp_path / "q").glob("part-*"))) == 9 and spark.read.text(f"{tmp_path}/q").distinct().count() == 900
