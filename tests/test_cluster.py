"""What only shows with executors in processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

from shopflow.plans import catalog

SF, ROOT = "/root/testdata/sf0.001", Path(__file__).resolve().parent.parent

ON_A_CLUSTER = """
import sys
from shopflow.plans import QUERIES
from shopflow.session import session
shared, sf = sys.argv[1:]
spark = session(**{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://" + shared})
print("found", QUERIES["src5_6_database"](spark, sf).count(), QUERIES["jon12_three_sources"](spark, sf).count())
spark.stop()
"""


def test_a_database_is_read_by_executors(tmp_path):
    (tmp_path / "work").mkdir()
    done = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path / "shared"), SF], cwd=tmp_path / "work", env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert "found 25 5" in done.stdout, done.stderr[-3000:]


def test_values_survive_the_database(spark):
    rows = [(1, 'a "quoted", text'), (2, None), (3, ""), (4, "two\nlines"), (5, "é \\ 'x'")]
    df = spark.createDataFrame(rows, "id bigint, name string")
    assert sorted(map(tuple, catalog._from_database(df, "texts", key="id", bounds=(1, 6), parts=2).collect())) == rows
    assert catalog._from_database(df.limit(0), "texts").count() == 0


IN_A_STORE = ON_A_CLUSTER.replace('"file://" + shared', '"viewfs://store/shared", "spark.hadoop.fs.viewfs.mounttable.store.link./shared": "file://" + shared')


def test_a_database_needs_no_local_shared_folder(tmp_path):
    for folder in ("work", "shared"):
        (tmp_path / folder).mkdir()
    done = subprocess.run([sys.executable, "-c", IN_A_STORE, str(tmp_path / "shared"), SF], cwd=tmp_path / "work", env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert "found 25 5" in done.stdout, done.stderr[-3000:]
