"""The four kinds of quantile the market questions use, and outlier trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.numbers import half_up


def linear_percentile(x: Column | str, p: float) -> Column:
    """Exact percentile with linear interpolation, to six digits."""
    return half_up(F.percentile(x, p).cast("double"), 6)


def at_share(x: str, share: float) -> Column:
    """The value at floor(n * share) of n sorted values, for n up to 10^11: the discrete percentile a trifle above the share."""
    return F.expr(f"percentile_disc({share + 1e-12:.13f}) WITHIN GROUP (ORDER BY `{x}`)")


def upper_median(x: str) -> Column:
    """Of an even number of values the greater middle one."""
    return at_share(x, 0.5)


def upper_of(values: Column) -> Column:
    """The upper median of a sorted array, null for an empty one."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def nearest_quartile(x: str, share: float) -> Column:
    """The value at floor(n * share); under four values the least or the greatest."""
    few = F.min(x) if share < 0.5 else F.max(x)
    return F.when(F.count(x) < 4, few).otherwise(at_share(x, share))


def iqr_trim(df: DataFrame, keys: Sequence[str], value: str, tie: str, keep: int = 5) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles of their key.

    A key of at most ``keep`` rows stays whole; where fewer would be left, its lowest ``keep`` rows stay
    and nothing counts as removed. Adds n_removed.
    """
    group = Window.partitionBy(*keys)
    quartiles = df.groupBy(*keys).agg(linear_percentile(value, 0.25).alias("_q1"), linear_percentile(value, 0.75).alias("_q3"), F.count("*").alias("_n"))
    marked = df.join(quartiles, list(keys))
    span = 1.5 * (F.col("_q3") - F.col("_q1"))
    inside = (F.col(value) >= F.col("_q1") - span) & (F.col(value) <= F.col("_q3") + span)
    marked = marked.withColumn("_in", inside.cast("int")).withColumn("_left", F.sum("_in").over(group))
    marked = marked.withColumn("_rank", F.row_number().over(group.orderBy(F.col(value).asc_nulls_last(), tie)))
    whole = F.col("_n") <= keep
    thin = ~whole & (F.col("_left") < keep)
    kept = marked.filter(whole | (thin & (F.col("_rank") <= keep)) | (~whole & ~thin & (F.col("_in") == 1)))
    removed = F.when(whole | thin, F.lit(0).cast("long")).otherwise(F.col("_n") - F.col("_left"))
    return kept.withColumn("n_removed", removed).drop("_q1", "_q3", "_n", "_in", "_left", "_rank")
