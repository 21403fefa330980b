"""Folders and tables that every executor can see."""

import tempfile
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a bitmap of ids, at least (2 MB) and at most (128 MB); between them 16 or more for each id.
BITS, MOST_BITS = 1 << 24, 1 << 30
#: Bytes of an Arrow batch that goes to a Python worker: long texts make short batches.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only where that is unset, a local one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shopflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths of the tables written so far and not released, in order.
_written: list[str] = []


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage and lets several consumers share one computation; a lost
    executor costs only the tasks it ran. Results that are computed when read may
    need such tables; once a result is stored, ``release`` deletes them.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> int:
    """Delete the tables written since a mark, but for the last of them if that is to be kept; returns how many."""
    end = len(_written) - keep_last
    paths = _written[since:end]
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _written[since:end]
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; from now on the session hands it to Python in batches of bounded bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merged_runs(spans: DataFrame, key: str) -> DataFrame:
    """Adds run: spans [start, end) of one key that touch or overlap have one number. One sort; nothing is gathered."""
    in_order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col("start") > reach)
    return spans.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(in_order)).drop("_new")


def bitmap(ids: DataFrame, column: str = "id") -> bytes:
    """A bitmap of 64-bit ids, sized by their number up to a bound; other ids may share a bit, so it can only rule ids out."""
    bits = min(MOST_BITS, max(BITS, 1 << (16 * ids.count()).bit_length()))
    at = F.col(column).bitwiseAND(bits - 1) + 1
    rows = ids.select(at.alias("v")).filter("v IS NOT NULL").groupBy(F.expr("bitmap_bucket_number(v)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("bytes")).toLocalIterator()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["bytes"], np.uint8)
    return out.tobytes()


def is_set(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _rows(batches, shared, wanted: bool):
    bits = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        yield batch.filter(pa.array(is_set(bits, batch.column(batch.num_columns - 1).to_numpy()) == wanted))


def with_key(documents: DataFrame, name: str = "_row_key") -> DataFrame:
    """Adds what tells rows apart: rows of one doc_id and different texts, and rows without an id, have keys of their own; those come last."""
    return documents.withColumn(name, F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text")))


def without(documents: DataFrame, drop: DataFrame, once: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The documents whose key is not in ``drop``; of the rows of each key in ``once`` one stays.

    Texts are shuffled only for documents that a bitmap of bounded size cannot
    rule out. Rows with a null key stay.
    """
    names = documents.columns
    keys = lambda df, name: materialize(df.select(key).filter(F.col(key).isNotNull()).distinct(), name)
    drop = keys(drop, "drop")
    touched = drop
    if once is not None:
        once = keys(once, "once")
        touched = drop.unionByName(once)
    shared = documents.sparkSession.sparkContext.broadcast(bitmap(touched.select(F.xxhash64(key).alias("id"))))
    rows = documents.withColumn("_at", F.xxhash64(key))
    part = lambda wanted: rows.mapInArrow(partial(_rows, shared=shared, wanted=wanted), rows.schema).select(*names)
    unsure = part(True).join(drop, key, "left_anti").select(*names)
    if once is not None:
        single = unsure.join(once, key, "left_semi").dropDuplicates([key])
        unsure = unsure.join(once, key, "left_anti").unionByName(single).select(*names)
    return part(False).unionByName(unsure)
