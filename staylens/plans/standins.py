"""The market tables as views of the test schema: listings, calendar, quotes, monthly series.

Each adapter is given as a DataFrame and as the SQL of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions.numbers import half_up
from staylens.sources.tables import table

#: two brands stand for the market's calibrated neighbourhoods
CALIBRATED = {"Brand#1": "Zona Romantica", "Brand#2": "Amapas"}
HOOD_SQL = "CASE p_brand " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CALIBRATED.items()) + " ELSE p_brand END"
AS_OF = "1998-06-01"
EVENTS_AS_OF = "2024-01-31"

LISTINGS = f"""listings AS (
  SELECT p_partkey AS id, {HOOD_SQL} AS hood, p_type AS building, CAST(p_size % 4 + 1 AS INTEGER) AS bedrooms,
    CAST(1 + (p_size % 5) * 0.5 AS DOUBLE) AS bathrooms, CAST((p_partkey * 37) % 700 AS DOUBLE) AS beach_m,
    CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(150 + p_size * 40 AS DOUBLE) END AS sqft,
    CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(3 + (p_partkey % 20) * 0.1 AS DOUBLE) END AS rating,
    string_split(p_name, ' ') AS amenities, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_cents,
    CAST(0.6 + (p_partkey % 40) * 0.01 AS DOUBLE) AS confidence
  FROM part)"""

CALENDAR = """calendar AS (
  SELECT l_partkey AS listing_id, CAST(l_shipdate AS DATE) AS day, l_returnflag = 'N' AS available, l_linestatus AS platform,
    CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price_cents, l_orderkey AS batch, l_linenumber AS line
  FROM lineitem)"""

QUOTES = """quotes AS (
  SELECT event_id AS id, user_id AS listing_id, ts AS seen_at, CASE WHEN event_type = 'error' THEN 'unavailable' ELSE 'available' END AS status,
    event_type AS kind, CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount, props FROM events)"""

MONTHLY = """monthly AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS orders,
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
  FROM orders GROUP BY 1, 2)"""


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return listing_rows(table(spark, folder, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))


def listing_rows(part: DataFrame) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return part.select(
        key.alias("id"), F.expr(HOOD_SQL).alias("hood"), F.col("p_type").alias("building"), (size % 4 + 1).cast("int").alias("bedrooms"),
        (1 + (size % 5) * 0.5).cast("double").alias("bathrooms"), ((key * 37) % 700).cast("double").alias("beach_m"),
        F.when(size % 7 != 0, (150 + size * 40).cast("double")).alias("sqft"),
        F.when(key % 9 != 0, (F.lit(3) + (key % 20) * F.lit(0.1)).cast("double")).alias("rating"),
        F.split("p_name", " ").alias("amenities"), half_up(F.col("p_retailprice") * 100).alias("price_cents"),
        (F.lit(0.6) + (key % 40) * F.lit(0.01)).cast("double").alias("confidence"))


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_partkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber"]
    return table(spark, folder, "lineitem", columns).select(
        F.col("l_partkey").alias("listing_id"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_returnflag") == "N").alias("available"),
        F.col("l_linestatus").alias("platform"), half_up(F.col("l_extendedprice") / F.col("l_quantity") * 100).alias("price_cents"),
        F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("line"))


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("listing_id"), F.col("ts").alias("seen_at"),
        F.when(F.col("event_type") == "error", "unavailable").otherwise("available").alias("status"), F.col("event_type").alias("kind"),
        half_up(F.col("value") * 100).alias("amount"), "props")


def stay_quote_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log of quotes by stay: three windows a listing, some quotes without status or price."""
    third = (F.col("event_id") % 3).cast("int")
    q = table(spark, folder, "events", ["event_id", "user_id", "ts", "event_type", "value"]).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("listing_id"), F.date_add(F.lit("2024-03-01").cast("date"), third * 7).alias("checkin"),
        F.date_add(F.lit("2024-03-03").cast("date"), third * 8).alias("checkout"), F.col("ts").alias("collected_at"),
        F.when(F.col("event_type") == "error", "unavailable").when(F.col("event_type") != "signup", "available").alias("status"),
        F.when(F.col("event_type") != "click", half_up(F.col("value") * 100)).alias("total"))
    q = q.withColumn("subtotal", F.col("total") - half_up(F.col("total") / 10))
    return q.withColumn("nightly", half_up(F.col("subtotal") / F.datediff("checkout", "checkin")))


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders", ["o_orderdate", "o_totalprice"]).groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count("*").alias("orders"), F.sum(half_up(F.col("o_totalprice") * 100)).alias("cents"))
