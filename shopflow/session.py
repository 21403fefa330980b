"""The Spark session the library expects."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "shopflow", **settings) -> SparkSession:
    """A session in UTC, with AQE, microsecond timestamps and dynamic partition overwrite."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
