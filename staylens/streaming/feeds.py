"""Structured Streaming forms of the append-only feeds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from staylens.operators.bookings import STAY

#: rows that the stream of bookings gives
BOOKINGS = (
    "listing_id long, checkin date, checkout date, nightly long, subtotal long, total long, last_seen_at timestamp, first_gone_at timestamp, gap_hours double, confidence string, "
    "source_id long, gone_id long")
#: the last quote of a stay
LAST = "id long, collected_at timestamp, status string, nightly long, subtotal long, total long"
#: the state store that keeps expiring values; the session must name it
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landing(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 50) -> DataFrame:
    """Stream of the Parquet files that arrive in a landing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def activity(quotes: DataFrame, late: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Rows and listings per tumbling window; rows later than ``late`` drop out."""
    return quotes.withWatermark("seen_at", late).groupBy(F.window("seen_at", width)).agg(
        F.count("*").alias("n"), F.approx_count_distinct("listing_id").alias("n_listings")).select(F.col("window.start").alias("day"), "n", "n_listings")


class _Stay(StatefulProcessor):
    """The last quote of one stay, and the bookings that follow from each next one."""

    def __init__(self, keep_days: float):
        self.keep_ms = int(keep_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST, self.keep_ms or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["collected_at", "id"], kind="stable")[["id", "collected_at", "status", "nightly", "subtotal", "total"]]
        held = self.last.get() if self.last.exists() else None
        if held is not None:
            new = pd.concat([pd.DataFrame([tuple(held)], columns=new.columns).astype({"collected_at": new["collected_at"].dtype}), new], ignore_index=True)
        past = new.shift(1)
        gone = (new["status"] == "unavailable") & past["status"].notna() & (past["status"] != "unavailable") & past["total"].notna() & (past["nightly"] > 0)
        found, before = new[gone], past[gone]
        hours = (found["collected_at"] - before["collected_at"]).dt.total_seconds() / 3_600
        whole = lambda x: x.astype("float64").astype("Int64")
        yield pd.DataFrame({
            **{k: pd.Series([v] * len(found), index=found.index, dtype=object) for k, v in zip(STAY, key, strict=True)}, **{c: whole(before[c]) for c in ("nightly", "subtotal", "total")},
            "last_seen_at": before["collected_at"], "first_gone_at": found["collected_at"], "gap_hours": (hours * 10_000 + 0.5) // 1 / 10_000,
            "confidence": pd.cut(hours, [-1, 48, 168, float("inf")], labels=["high", "medium", "low"]).astype(object), "source_id": whole(before["id"]), "gone_id": whole(found["id"])})
        end = new.iloc[-1]
        self.last.update((int(end["id"]), end["collected_at"].to_pydatetime(), *(None if pd.isna(end[c]) else end[c] if c == "status" else int(end[c]) for c in ("status", "nightly", "subtotal", "total"))))

    def close(self) -> None:
        pass


def booking_flips(quotes: DataFrame, keep_days: float = 14) -> DataFrame:
    """Booking inference on a stream of quotes, with the columns of the batch form (``bookings.infer_bookings``).

    The state of a stay is its last quote, which expires ``keep_days`` after it was written (0: never), so stays that nobody quotes any
    more leave no state. Rows of one micro-batch are put in order of time; across batches they count as they arrive. Only a stay's
    rows of one micro-batch are held in memory. The session's state store must be the one that ``STORE`` names.
    """
    rows = quotes.select(*STAY, "id", F.col("collected_at").cast("timestamp").alias("collected_at"), "status", *[F.col(c).cast("long").alias(c) for c in ("nightly", "subtotal", "total")])
    return rows.groupBy(*STAY).transformWithStateInPandas(_Stay(keep_days), BOOKINGS, "append", "ProcessingTime")


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append what a table does not hold yet by key, once for all files at hand; a repeated batch adds nothing.

    The table must stand, if only with no rows. Only keys that a batch may repeat are read from it: those of its files whose
    statistics reach into the batch's range of the first key.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            ends = batch.agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high")).first()
            if ends["low"] is not None or not batch.isEmpty():
                held = batch.sparkSession.read.schema(batch.schema).parquet(path).select(*keys).filter(F.col(keys[0]).between(F.lit(ends["low"]), F.lit(ends["high"])))
                batch.dropDuplicates(keys).join(held, keys, "left_anti").write.mode("append").parquet(path)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def create(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table to append to; one that stands already stays as it is."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
