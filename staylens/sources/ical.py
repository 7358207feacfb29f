"""iCalendar source: VEVENT blocks as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row an event: the columns of ``texts`` and uid, summary, status, start, end, error.

    Folded lines are joined. The end is DTEND, else DTSTART and DURATION in weeks and days, else the next
    day; an event without DTSTART has an error instead.
    """
    unfolded = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))
    rows = texts.select(*[c for c in texts.columns if c != text], F.explode(blocks).alias("block"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("block", rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)), F.lit(""))
    day = lambda name: F.to_date(F.substring(field(name), 1, 8), "yyyyMMdd")
    weeks = F.coalesce(F.regexp_extract(field("DURATION"), r"P(\d+)W", 1).try_cast("int"), F.lit(0))
    days = F.coalesce(F.regexp_extract(field("DURATION"), r"P(?:\d+W)?(\d+)D", 1).try_cast("int"), F.lit(0))
    start, length = day("DTSTART"), weeks * 7 + days
    return rows.select(
        *[c for c in rows.columns if c != "block"], field("UID").alias("uid"), field("SUMMARY").alias("summary"), F.lower(field("STATUS")).alias("status"), start.alias("start"),
        F.coalesce(day("DTEND"), F.date_add(start, F.when(length > 0, length).otherwise(1).cast("int"))).alias("end"), F.when(start.isNull(), "missing DTSTART").alias("error"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of all calendar files under ``path``, with the file's name."""
    return events(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text")))
