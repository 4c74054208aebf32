"""Registered queries: a function of (session, table folder), and SQL for the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``dates`` are returned as text, which all engines compare alike."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return run

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a number of decimals both engines agree on; minus zero becomes zero."""
    return df.select(*[(F.round(f"`{f.name}`", places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def r(expression: str, name: str, places: int = 6) -> str:
    """The same in SQL."""
    return f"round(CAST({expression} AS DOUBLE), {places}) + 0.0 AS {name}"
