"""Forward demand, quotes made from calendars, fees, stay values, page verdicts and yearly rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions import dates
from staylens.functions.numbers import half_up, pct_change, ratio
from staylens.operators.latest import year_over_year
from staylens.plans.market import forward
from staylens.plans.registry import query
from staylens.plans.standins import AS_OF, CALENDAR, LISTINGS, MONTHLY, calendar, listings, monthly
from staylens.sources.tables import table

#: fixed values: offsets of the recommended band over the comparables' median by lead time
BANDS = {"early": (15, 20), "mid": (10, 15), "late": (0, 10), "very_late": (-5, 0)}
#: fixed values: a calibration older than this many days, or a ratio from this on, suppresses a recommendation
STALE_DAYS, FLAT_BELOW = 14, 1.03
#: fixed values: tax and service rates of made-up quotes
TAX, SERVICE = 0.19, 0.10


def lead_bucket(days: Column) -> Column:
    return F.when(days >= 60, "early").when(days >= 30, "mid").when(days >= 15, "late").otherwise("very_late")


def band(bucket: Column, median: Column) -> tuple[Column, Column, Column]:
    """Low, high and the price to apply: low at least 1, high at least low, the rounded middle."""
    offset = lambda k: F.when(bucket == "early", BANDS["early"][k]).when(bucket == "mid", BANDS["mid"][k]).when(bucket == "late", BANDS["late"][k]).otherwise(BANDS["very_late"][k])
    low = F.greatest(F.lit(1), half_up(median + offset(0)))
    high = F.greatest(low, half_up(median + offset(1)))
    return low, high, half_up((low + high) / 2)


def calibration_gate(snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Rows (hood, run_at date or null, ratio) with ok and the first reason against."""
    age = F.datediff(as_of, "run_at")
    reason = (F.when(F.col("run_at").isNull(), "no_snapshots_in_folder").when(age > STALE_DAYS, "snapshot_stale").when(F.col("ratio").isNull(), "ratio_missing_for_hood")
              .when(F.col("ratio") >= FLAT_BELOW, "ratio_above_threshold"))
    return snapshots.withColumn("age_days", age).withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def stay_quotes(stays: DataFrame, days: DataFrame, keys: Sequence[str] = ("listing_id", "stay")) -> DataFrame:
    """Quotes of stay windows, named by ``keys``, from calendar nights (listing_id, day, price_cents, available).

    A quote needs every night: priced for its subtotal, open to be available. Taxes are 19 %.
    """
    nights = stays.withColumn("day", F.explode(dates.nights(F.col("checkin"), F.col("checkout"))))
    met = nights.join(days, ["listing_id", "day"], "left").groupBy(*keys).agg(
        F.count("*").alias("n_nights"), F.count("price_cents").alias("n_priced"), F.count_if(F.col("available")).alias("n_open"),
        F.sum("price_cents").alias("cents"))
    full = F.col("n_priced") == F.col("n_nights")
    subtotal = F.when(full, F.col("cents"))
    return met.select(
        *keys, "n_nights", "n_priced", F.when(F.col("n_priced") < F.col("n_nights"), "unknown").when(F.col("n_open") == F.col("n_nights"), "available").otherwise("unavailable").alias("status"),
        half_up(ratio(F.col("cents"), F.col("n_priced"))).alias("nightly"), subtotal.alias("subtotal"), half_up(subtotal * TAX).alias("taxes"), (subtotal + half_up(subtotal * TAX)).alias("total"))


@query(f"""WITH {LISTINGS}, {CALENDAR}, m AS (SELECT hood, day, median(c.price_cents / 100.0) AS med, DATE_DIFF('day', DATE '{AS_OF}', day) AS lead FROM calendar c JOIN listings ON listings.id = listing_id WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 75 GROUP BY hood, day),
b AS (SELECT *, CASE WHEN lead >= 60 THEN 'early' WHEN lead >= 30 THEN 'mid' WHEN lead >= 15 THEN 'late' ELSE 'very_late' END AS bucket FROM m),
l AS (SELECT *, CAST(greatest(1, floor(med + CASE bucket WHEN 'early' THEN 15 WHEN 'mid' THEN 10 WHEN 'late' THEN 0 ELSE -5 END + 0.5)) AS BIGINT) AS low FROM b),
h AS (SELECT *, CAST(greatest(low, floor(med + CASE bucket WHEN 'early' THEN 20 WHEN 'mid' THEN 15 WHEN 'late' THEN 10 ELSE 0 END + 0.5)) AS BIGINT) AS high FROM l)
SELECT hood, day, bucket, low, high, CAST(floor((low + high) / 2.0 + 0.5) AS BIGINT) AS apply FROM h""", dates=["day"])
def forward_demand_band(spark: SparkSession, folder: str) -> DataFrame:
    """Recommended band of each neighbourhood and coming night by lead time."""
    days = forward(calendar(spark, folder), 0, 75).join(listings(spark, folder).select("id", "hood"), F.col("id") == F.col("listing_id"))
    m = days.groupBy("hood", "day").agg(F.median(F.col("price_cents") / 100.0).alias("med"))
    m = m.withColumn("bucket", lead_bucket(F.datediff("day", F.lit(AS_OF).cast("date"))))
    low, high, middle = band(F.col("bucket"), F.col("med"))
    return m.select("hood", "day", "bucket", low.alias("low"), high.alias("high"), middle.alias("apply"))


@query(f"""WITH {LISTINGS}, {CALENDAR}, s AS (SELECT hood, max(CASE WHEN day <= DATE '{AS_OF}' AND hood NOT LIKE '%3' THEN day END) AS run_at, floor(median(CASE WHEN day < DATE '{AS_OF}' AND day >= DATE '{AS_OF}' - 20 THEN c.price_cents END) / median(c.price_cents) * 10000 + 0.5) / 10000 AS ratio FROM calendar c JOIN listings ON listings.id = listing_id GROUP BY hood)
SELECT hood, run_at IS NOT NULL AND DATE '{AS_OF}' - run_at <= 14 AND ratio IS NOT NULL AND ratio < 1.03::DOUBLE AS ok, CASE WHEN run_at IS NULL THEN 'no_snapshots_in_folder' WHEN DATE '{AS_OF}' - run_at > 14 THEN 'snapshot_stale' WHEN ratio IS NULL THEN 'ratio_missing_for_hood' WHEN ratio >= 1.03::DOUBLE THEN 'ratio_above_threshold' END AS reason FROM s""")
def calibration_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gate of each neighbourhood: its newest night as the run, prices of 20 days over all prices as the ratio; some have no run."""
    day, x = F.lit(AS_OF).cast("date"), F.col("price_cents")
    days = calendar(spark, folder).join(listings(spark, folder).select("id", "hood"), F.col("id") == F.col("listing_id"))
    recent = (F.col("day") < day) & (F.col("day") >= F.date_sub(day, 20))
    snapshots = days.groupBy("hood").agg(F.max(F.when((F.col("day") <= day) & ~F.col("hood").like("%3"), F.col("day"))).alias("run_at"), half_up(ratio(F.median(F.when(recent, x)), F.median(x)), 4).alias("ratio"))
    return calibration_gate(snapshots, day).select("hood", "ok", "reason")


@query(f"""WITH {CALENDAR}, one AS (SELECT listing_id, day, min(price_cents) AS price_cents, bool_and(available) AS available FROM calendar GROUP BY 1, 2),
s AS (SELECT listing_id, day AS checkin, day + 1 + CAST(listing_id % 2 AS INTEGER) AS checkout FROM one WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 90),
n AS (SELECT listing_id, checkin, CAST(unnest(generate_series(checkin, checkout - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
q AS (SELECT n.listing_id, checkin, count(*) AS n_nights, count(price_cents) AS n_priced, count(*) FILTER (WHERE available) AS n_open, CAST(sum(price_cents) AS BIGINT) AS cents FROM n LEFT JOIN one ON one.listing_id = n.listing_id AND one.day = n.day GROUP BY 1, 2)
SELECT listing_id, checkin AS stay, n_nights, n_priced, CASE WHEN n_priced < n_nights THEN 'unknown' WHEN n_open = n_nights THEN 'available' ELSE 'unavailable' END AS status, CAST(floor(cents::DOUBLE / n_priced + 0.5) AS BIGINT) AS nightly,
  CASE WHEN n_priced = n_nights THEN cents END AS subtotal, CAST(CASE WHEN n_priced = n_nights THEN floor(cents * 0.19::DOUBLE + 0.5) END AS BIGINT) AS taxes, CAST(CASE WHEN n_priced = n_nights THEN cents + floor(cents * 0.19::DOUBLE + 0.5) END AS BIGINT) AS total FROM q""", dates=["stay"])
def quotes_from_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of one and two nights from the calendar, complete ones only with a total."""
    one = calendar(spark, folder).groupBy("listing_id", "day").agg(F.min("price_cents").alias("price_cents"), F.every("available").alias("available"))
    stays = forward(one, 0, 90).select("listing_id", F.col("day").alias("stay"), F.col("day").alias("checkin"), F.date_add("day", (1 + F.col("listing_id") % 2).cast("int")).alias("checkout"))
    return stay_quotes(stays, one)


@query(f"""WITH {LISTINGS}, {CALENDAR}, d AS (SELECT hood, bedrooms, c.price_cents AS p FROM calendar c JOIN listings ON listings.id = listing_id WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 14)
SELECT hood, bedrooms, count(*) AS n, CASE WHEN count(*) >= 5 THEN CAST(floor(median(p) * 7 + 0.5) AS BIGINT) END AS week_value FROM d GROUP BY 1, 2""")
def stay_value_card(spark: SparkSession, folder: str) -> DataFrame:
    """What a week is worth: median night times seven, nothing under five samples."""
    days = forward(calendar(spark, folder), 0, 14).join(listings(spark, folder).select("id", "hood", "bedrooms"), F.col("id") == F.col("listing_id"))
    return days.groupBy("hood", "bedrooms").agg(F.count("*").alias("n"), F.when(F.count("*") >= 5, half_up(F.median("price_cents") * 7)).alias("week_value"))


@query("""WITH v AS (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 429 ELSE 200 END AS status, html FROM pages)
SELECT CASE WHEN status = 404 THEN 'delisted' WHEN status = 429 THEN 'blocked' WHEN length(html) < 500 THEN 'unusable' ELSE 'ok' END AS verdict, count(*) AS n FROM v GROUP BY 1""")
def prune_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    from staylens.sources.pages import usability

    status = F.when(F.col("page_id") % 17 == 0, 404).when(F.col("page_id") % 13 == 0, 429).otherwise(200)
    return table(spark, folder, "pages", ["page_id", "html"]).groupBy(usability(status, F.col("html")).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT a.year, a.category, a.n, floor(a.n / 2500.0 * 100 * 100 + 0.5) / 100 AS per_100k, CASE WHEN b.n IS NULL THEN 'N/A' ELSE CAST(CAST(floor((a.n - b.n)::DOUBLE / b.n * 1000 + 0.5) AS BIGINT) AS VARCHAR) END AS change_per_mille
FROM y a LEFT JOIN y b ON b.category = a.category AND b.year = a.year - 1""")
def yearly_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a category per 100,000 inhabitants and their change, N/A in the first year."""
    y = table(spark, folder, "orders", ["o_orderdate", "o_orderpriority"]).groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))
    past = y.select((F.col("year") + 1).alias("year"), "category", F.col("n").alias("past"))
    change = half_up(ratio(F.col("n") - F.col("past"), F.col("past")) * 1000)
    return y.join(past, ["year", "category"], "left").select("year", "category", "n", half_up(F.col("n") / 2500.0 * 100, 2).alias("per_100k"), F.coalesce(change.cast("string"), F.lit("N/A")).alias("change_per_mille"))


@query(f"""WITH {MONTHLY}, t AS (SELECT max_by(orders, year * 12 + month) AS latest, max_by(year, year * 12 + month) AS y, max_by(month, year * 12 + month) AS m FROM monthly)
SELECT latest, p.orders AS last_year, floor((latest - p.orders)::DOUBLE / p.orders * 100 * 100 + 0.5) / 100 AS change, CASE WHEN (latest - p.orders)::DOUBLE / p.orders * 100 > 5 THEN 'growing' WHEN (latest - p.orders)::DOUBLE / p.orders * 100 >= -5 THEN 'stable'
  WHEN (latest - p.orders)::DOUBLE / p.orders * 100 >= -10 THEN 'softening' ELSE 'declining' END AS label FROM t JOIN monthly p ON p.year = t.y - 1 AND p.month = t.m""")
def dashboard_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Latest month, the same month a year before, and the label of the change."""
    yoy = year_over_year(monthly(spark, folder).select("year", "month", "orders"), "orders")
    last = yoy.orderBy(F.desc("year"), F.desc("month")).limit(1)
    change = pct_change(F.col("orders"), F.col("last_year"))
    label = F.when(change > 5, "growing").when(change >= -5, "stable").when(change >= -10, "softening").otherwise("declining")
    return last.select(F.col("orders").alias("latest"), "last_year", half_up(change, 2).alias("change"), label.alias("label"))
