"""Queries by name, each with its oracle."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.binding import BIND, Shop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, bind: bool = True):
    """Register a function of a ``Shop``. The oracle follows the relations of ``BIND``: ``, x AS (...) SELECT`` or ``SELECT``."""

    def register(f: Callable[[Shop], DataFrame]):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Shop(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"{BIND}\n{sql}" if bind else sql
        return f

    return register
