"""Latest rows, previous observations, streaks and as-of joins. Ties always end at a named id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions import dates, numbers


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def zero_streaks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Running length of the current run of zeros at each row."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    runs = df.withColumn("_run", F.sum(F.when(F.col(value) == 0, 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("streak", F.sum(F.when(F.col(value) == 0, 1).otherwise(0)).over(inside)).drop("_run")


def recent_all_below(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, n: int, threshold: float) -> DataFrame:
    """For each key whether its latest ``n`` rows exist and are all below ``threshold``."""
    latest = top_per_key(df.filter(F.col(value).isNotNull()), keys, order, n)
    return latest.groupBy(*keys).agg(
        F.count("*").alias("runs"), ((F.count("*") == n) & F.every(F.col(value) < threshold)).alias("alert"))


def previous_month(series: DataFrame, value: str) -> DataFrame:
    """As-of value of the latest month strictly before each month of a (year, month, value) series."""
    index = dates.month_index(F.col("year"), F.col("month"))
    before = Window.orderBy("_index").rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("_index", index).withColumn("prior", F.last(value, ignorenulls=True).over(before)).drop("_index")


def year_over_year(series: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``series`` with last_year and yoy_pct by a join on year - 1; gaps in the series stay gaps."""
    past = series.select(*keys, (F.col("year") + 1).alias("year"), "month", F.col(value).alias("last_year"))
    joined = series.join(past, [*keys, "year", "month"], "left")
    return joined.withColumn("yoy_pct", numbers.half_up(numbers.pct_change(F.col(value), F.col("last_year")), 4))


def prior_declines(yoy: DataFrame, months: int, limit: float) -> DataFrame:
    """For each month how many of the ``months`` calendar months before it had a yoy_pct below ``limit``."""
    index = Window.orderBy("_index").rangeBetween(-months, -1)
    marked = yoy.withColumn("_index", dates.month_index(F.col("year"), F.col("month")))
    return marked.withColumn("weak_months", F.coalesce(F.sum(F.when(F.col("yoy_pct") < limit, 1).otherwise(0)).over(index), F.lit(0))).drop("_index")
