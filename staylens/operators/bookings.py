"""Presumed bookings: stays that were quoted and then ran out, read from a log of quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions import dates, numbers
from staylens.operators.upserts import insert_if_absent

#: what makes a stay: its observations follow each other
STAY = ["listing_id", "checkin", "checkout"]
#: fixed value: days of quotes that a run reads
LOOKBACK_DAYS = 14


def infer_bookings(quotes: DataFrame, as_of: Column, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Quotes of the look-back that turned unavailable right after a priced quote of the same stay that was not.

    ``quotes``: id, listing_id, checkin, checkout, collected_at, status, nightly, subtotal, total. Quotes of one moment follow by
    id. The quote before must have a status, a total and a nightly rate above zero. Rows: the stay, nightly, subtotal and total of
    the quote before, last_seen_at, first_gone_at, gap_hours, confidence (48 and 168 hours), source_id and gone_id. One window by
    stay serves all six earlier values; a listing with many stays is split by them.
    """
    before = Window.partitionBy(*STAY).orderBy("collected_at", "id")
    recent = quotes.filter(F.col("collected_at") >= as_of.cast("timestamp_ntz") - F.expr(f"INTERVAL {lookback_days} DAYS"))
    seen = recent.withColumns({f"prev_{c}": F.lag(c).over(before) for c in ("id", "collected_at", "status", "nightly", "subtotal", "total")})
    flips = seen.filter("status = 'unavailable' AND prev_status <> 'unavailable' AND prev_total IS NOT NULL AND prev_nightly > 0")
    hours = dates.hours_between(F.col("prev_collected_at"), F.col("collected_at"))
    return flips.select(
        *STAY, F.col("prev_nightly").alias("nightly"), F.col("prev_subtotal").alias("subtotal"), F.col("prev_total").alias("total"), F.col("prev_collected_at").alias("last_seen_at"),
        F.col("collected_at").alias("first_gone_at"), numbers.half_up(hours, 4).alias("gap_hours"), numbers.gap_confidence(hours).alias("confidence"),
        F.col("prev_id").alias("source_id"), F.col("id").alias("gone_id"))


def new_bookings(flips: DataFrame, held: DataFrame) -> DataFrame:
    """Flips that a table of bookings does not hold yet: one stay may be booked again, but not from the same quote."""
    return insert_if_absent(held, flips, [*STAY, "last_seen_at"])
