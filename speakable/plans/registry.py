"""Query registry: each entry is a Spark query and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and floats as DOUBLE, the types the oracle returns."""
    wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    return df.select(
        *[F.col(f"`{n}`").cast(wide[t]).alias(n) if t in wide else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its oracle if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain_types(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
