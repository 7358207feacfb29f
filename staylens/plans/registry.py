"""Registered queries and their SQL, filled by the modules of this package.

Results carry dates and times as text (2024-01-31, 2024-01-31 12:00:00), which every client reads alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FORMATS = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}


def as_text(df: DataFrame) -> DataFrame:
    """``df`` with its date and time columns as text."""
    return df.withColumns({c: F.date_format(c, FORMATS[kind]) for c, kind in df.dtypes if kind in FORMATS})


def query(sql: str | None = None, dates: Sequence[str] = (), stamps: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a function (spark, folder) under its name, with the SQL that gives the same rows.

    ``dates`` and ``stamps`` name the columns of the SQL that hold dates and times.
    """
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, folder: as_text(f(spark, folder))
        if sql:
            texts = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in stamps]
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(texts)}) FROM ({sql}) AS result" if texts else sql
        return f

    return add
