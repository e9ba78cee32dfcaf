"""Registry of queries over the test tables, with the DuckDB text each is compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.checks.tables import Tables, duckdb_sql

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Output types both engines show alike: decimals as doubles, dates as text, small ints as bigint."""
    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        return c
    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, *, like: str | None = None):
    """Register a query; `sql` is its DuckDB counterpart, with view names in braces, or that of the query `like`."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        elif like is not None:
            ORACLES[name] = ORACLES[like]
        return fn
    return register


def runnable(fn: Callable[[Tables], DataFrame]):
    def run(spark, sf_dir: str) -> DataFrame:
        return plain(fn(Tables(spark, sf_dir)))
    return run
