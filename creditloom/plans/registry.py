"""Registered queries and, where SQL can state them, the same queries in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.columns import col

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round measures, so that the order of additions does not show."""
    return df.withColumns({name: F.round(col(name), digits) for name in names})
