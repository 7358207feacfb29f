"""Merges of a batch into a table. Plain Parquet has no row updates: a merge is a new table to swap in."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.operators.latest import first_per_key


def last_write_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of both, the batch before the table and within a batch the first in ``order``."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return first_per_key(both, keys, [F.desc("_batch"), *order]).drop("_batch")


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """Full merge by key with a rule for each column.

    overwrite: the batch's value; fill: the batch's value unless null; keep: the table's value unless
    null; greatest, least, sum: of both, nulls aside. Columns of one side only come over as they are.
    """
    a, b = old.alias("a"), new.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b.withColumn("_new", F.lit(True)).alias("b"), same, "full_outer")
    out = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    for column, rule in rules.items():
        x, y = F.col(f"a.{column}"), F.col(f"b.{column}")
        made = {
            "overwrite": F.when(F.col("b._new"), y).otherwise(x), "fill": F.coalesce(y, x), "keep": F.coalesce(x, y),
            "greatest": F.greatest(x, y), "least": F.least(x, y), "sum": F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)),
        }[rule]
        out.append(made.alias(column))
    return joined.select(*out)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key the table does not hold."""
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti")


def guarded(old: DataFrame, new: DataFrame, keys: Sequence[str], total: str, parts: Sequence[str],
            tolerance: float = 0.10, drop: float = 0.35, large: float = 50_000.0) -> DataFrame:
    """What a batch of totals with parts would do to a table: rows of keys, both totals and decision.

    rejected_parts: the parts do not add up to the total within ``tolerance``; rejected_drop: a total over
    ``large`` would fall by more than ``drop``; kept_detail: a total alone would replace a full breakdown;
    insert and update otherwise.
    """
    full = [F.col(f"b.{p}").isNotNull() for p in parts]
    all_parts = full[0]
    for x in full[1:]:
        all_parts = all_parts & x
    held = F.col(f"a.{parts[0]}").isNotNull()
    for p in parts[1:]:
        held = held & F.col(f"a.{p}").isNotNull()
    added = sum((F.col(f"b.{p}") for p in parts[1:]), F.col(f"b.{parts[0]}"))
    was, now = F.col(f"a.{total}"), F.col(f"b.{total}")
    decision = (
        F.when(all_parts & (F.abs(added - now) > tolerance * now), "rejected_parts").when(was.isNull(), "insert")
        .when((was > large) & (now < was * (1 - drop)), "rejected_drop").when(held & ~all_parts, "kept_detail").otherwise("update")
    )
    joined = new.alias("b").join(old.alias("a"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "left")
    return joined.select(*[F.col(f"b.{k}").alias(k) for k in keys], was.alias("old_total"), now.alias("new_total"), decision.alias("decision"))


def seen_again(old: DataFrame, batch: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Counter merge: seen_count grows by the rows of the batch, first and last sighting widen."""
    met = batch.groupBy(*keys).agg(F.count("*").alias("seen_count"), F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))
    return merged(old, met, keys, {"seen_count": "sum", "first_seen_at": "least", "last_seen_at": "greatest"})


def retention(df: DataFrame, date_column: str, stamp: str, as_of: str, past_days: int = 7, stale_days: int = 90) -> tuple[Column, Column]:
    """Two delete rules as flags: nights long past, and rows not collected for long."""
    return (
        F.col(date_column) < F.date_sub(F.lit(as_of).cast("date"), past_days),
        F.col(stamp) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {stale_days} DAYS"),
    )


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones and return its path; readers switch by path, so none sees half a table."""
    version = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(version)
    return version
