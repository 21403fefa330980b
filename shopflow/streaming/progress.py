"""What a running stream reports of itself, as a table: rows, lag, watermark and state of every micro-batch."""

import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

RECORD = "query string, run string, batch_id long, rows long, newest timestamp, watermark timestamp, state_rows long, late_rows long, seconds double, at timestamp"
_NAME = "shopflow_progress"


def _time(text: str | None) -> datetime | None:
    """A time of Spark's reports, null for the beginning of time, which stands for none."""
    if not text:
        return None
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return found if found > datetime.fromtimestamp(0, timezone.utc) else None


def observed(stream: DataFrame, column: str = "ts") -> DataFrame:
    """A stream that reports its rows and its newest event with each batch, at no cost of a pass of its own."""
    return stream.observe(_NAME, F.count(F.lit(1)).alias("rows"), F.max(column).cast("timestamp").alias("newest"))


class Progress(StreamingQueryListener):
    """Keeps a record of each micro-batch of all queries of a session, between ``with``'s beginning and end.

    A record is a few hundred bytes; ``flush`` appends what is held to a table and lets go of it, so a long run holds little.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.records, self._lock = spark, [], threading.Lock()

    def __enter__(self) -> "Progress":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure) -> None:
        self._settled()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(_NAME)
        rows, newest = (seen["rows"], seen["newest"]) if seen is not None else (p.numInputRows, None)
        states = p.stateOperators
        record = (p.name, str(p.runId), p.batchId, rows, newest, _time(p.eventTime.get("watermark")), sum(s.numRowsTotal for s in states), sum(s.numRowsDroppedByWatermark for s in states), p.batchDuration / 1000, _time(p.timestamp))
        with self._lock:
            self.records.append(record)

    def _settled(self) -> None:
        """Waits for reports that are under way."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)

    def table(self) -> DataFrame:
        """The records held."""
        self._settled()
        with self._lock:
            return self.spark.createDataFrame(list(self.records), RECORD)

    def flush(self, path: str) -> DataFrame:
        """Append the records to a table, and return the table."""
        held = self.table()
        held.coalesce(1).write.mode("append").parquet(path)
        with self._lock:
            del self.records[: held.count()]
        return self.spark.read.parquet(path)


def lagging(records: DataFrame, now) -> DataFrame:
    """Adds lag_seconds: how far the newest event so far of a query was behind ``now`` after each batch."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("query", "run").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("lag_seconds", F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("newest").over(so_far)))
