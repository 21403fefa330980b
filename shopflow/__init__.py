"""Shop analytics on Spark: tables, models, queries, rollups, streams and data tests."""
