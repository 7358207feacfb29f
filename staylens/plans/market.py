"""Live market, coverage, freshness and work-queue questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions import dates
from staylens.functions.numbers import half_up, ratio, trend_label
from staylens.operators.latest import first_per_key, top_per_key
from staylens.plans.registry import query
from staylens.plans.standins import AS_OF, CALENDAR, EVENTS_AS_OF, LISTINGS, MONTHLY, QUOTES, calendar, listings, monthly, quotes
from staylens.sources.tables import table


def open_nights() -> Column:
    return F.count_if(F.col("available"))


def forward(days: DataFrame, start: int, end: int, as_of: str = AS_OF) -> DataFrame:
    """Nights in [as_of + start, as_of + end)."""
    base = F.lit(as_of).cast("date")
    return days.filter((F.col("day") >= F.date_add(base, start)) & (F.col("day") < F.date_add(base, end)))


@query(f"""WITH {LISTINGS}, {CALENDAR}
SELECT day, count(*) AS nights, count(*) FILTER (WHERE available) AS open_nights,
  floor(count(*) FILTER (WHERE available) / nullif(count(*), 0)::DOUBLE * 10000 + 0.5) / 10000 AS open_rate
FROM calendar JOIN listings ON listings.id = listing_id
WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 30 GROUP BY day""", dates=["day"])
def availability_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Share of open nights for each of the next 30 days."""
    days = forward(calendar(spark, folder), 0, 30)
    joined = days.join(listings(spark, folder).select("id"), F.col("id") == F.col("listing_id"))
    return joined.groupBy("day").agg(F.count("*").alias("nights"), open_nights().alias("open_nights"), half_up(ratio(open_nights(), F.count("*")), 4).alias("open_rate"))


@query(f"""WITH {LISTINGS}, {CALENDAR}
SELECT hood, day, count(*) AS nights, floor(count(*) FILTER (WHERE available) / nullif(count(*), 0)::DOUBLE * 10000 + 0.5) / 10000 AS open_rate
FROM calendar JOIN listings ON listings.id = listing_id
WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 30 GROUP BY hood, day""", dates=["day"])
def availability_trend_by_group(spark: SparkSession, folder: str) -> DataFrame:
    days = forward(calendar(spark, folder), 0, 30)
    joined = days.join(listings(spark, folder).select("id", "hood"), F.col("id") == F.col("listing_id"))
    return joined.groupBy("hood", "day").agg(F.count("*").alias("nights"), half_up(ratio(open_nights(), F.count("*")), 4).alias("open_rate"))


@query(f"""WITH {LISTINGS}, {CALENDAR}
SELECT hood, count(DISTINCT listing_id) AS n_listings, count(*) AS nights FROM calendar JOIN listings ON listings.id = listing_id
WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 90 GROUP BY hood HAVING count(DISTINCT listing_id) >= 5
ORDER BY n_listings DESC, hood LIMIT 8""")
def group_menu_having(spark: SparkSession, folder: str) -> DataFrame:
    """The eight groups with the most listings in the window, of those with at least five."""
    days = forward(calendar(spark, folder), 0, 90)
    joined = days.join(listings(spark, folder).select("id", "hood"), F.col("id") == F.col("listing_id"))
    grouped = joined.groupBy("hood").agg(F.countDistinct("listing_id").alias("n_listings"), F.count("*").alias("nights"))
    return grouped.filter("n_listings >= 5").orderBy(F.desc("n_listings"), "hood").limit(8)


@query(f"""WITH {CALENDAR}, w AS (
  SELECT count(*) FILTER (WHERE day < DATE '{AS_OF}' + 30) AS n30, count(*) FILTER (WHERE day >= DATE '{AS_OF}' + 30) AS n60,
    count(*) FILTER (WHERE day < DATE '{AS_OF}' + 30 AND available) AS a30, count(*) FILTER (WHERE day >= DATE '{AS_OF}' + 30 AND available) AS a60,
    count(DISTINCT CASE WHEN day < DATE '{AS_OF}' + 30 THEN listing_id END) AS listings30,
    CAST(sum(CASE WHEN day < DATE '{AS_OF}' + 30 THEN price_cents END) AS BIGINT) AS c30, CAST(sum(CASE WHEN day >= DATE '{AS_OF}' + 30 THEN price_cents END) AS BIGINT) AS c60
  FROM calendar WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 60)
SELECT n30, n60, listings30, floor(a30::DOUBLE / n30 * 10000 + 0.5) / 10000 AS open30, floor(a60::DOUBLE / n60 * 10000 + 0.5) / 10000 AS open60,
  floor(c30::DOUBLE / n30 / 100 * 100 + 0.5) / 100 AS price30, floor(c60::DOUBLE / n60 / 100 * 100 + 0.5) / 100 AS price60,
  CASE WHEN a30::DOUBLE / n30 - a60::DOUBLE / n60 > 0.05 THEN 'rising' WHEN a30::DOUBLE / n30 - a60::DOUBLE / n60 < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM w""")
def live_market_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Both forward windows in one pass over the calendar, with their trend."""
    near = F.col("day") < F.date_add(F.lit(AS_OF).cast("date"), 30)
    w = forward(calendar(spark, folder), 0, 60).agg(
        F.count_if(near).alias("n30"), F.count_if(~near).alias("n60"), F.count_if(near & F.col("available")).alias("a30"), F.count_if(~near & F.col("available")).alias("a60"),
        F.countDistinct(F.when(near, F.col("listing_id"))).alias("listings30"), F.sum(F.when(near, F.col("price_cents"))).alias("c30"), F.sum(F.when(~near, F.col("price_cents"))).alias("c60"))
    a, b = ratio(F.col("a30"), F.col("n30")), ratio(F.col("a60"), F.col("n60"))
    return w.select("n30", "n60", "listings30", half_up(a, 4).alias("open30"), half_up(b, 4).alias("open60"),
                    half_up(ratio(F.col("c30"), F.col("n30")) / 100, 2).alias("price30"), half_up(ratio(F.col("c60"), F.col("n60")) / 100, 2).alias("price60"), trend_label(a - b, 0.05).alias("trend"))


@query(f"""WITH {CALENDAR} SELECT platform, count(*) AS nights, count(DISTINCT listing_id) AS n_listings,
  floor(CAST(sum(price_cents) AS BIGINT)::DOUBLE / count(*) + 0.5) / 100 AS avg_price, CAST(max(day) AS DATE) AS last_day FROM calendar GROUP BY platform""", dates=["last_day"])
def by_source(spark: SparkSession, folder: str) -> DataFrame:
    return calendar(spark, folder).groupBy("platform").agg(
        F.count("*").alias("nights"), F.countDistinct("listing_id").alias("n_listings"),
        (F.floor(ratio(F.sum("price_cents"), F.count("*")) + 0.5) / 100.0).alias("avg_price"), F.max("day").alias("last_day"))


@query(f"""WITH {LISTINGS} SELECT bedrooms, bathrooms, count(*) AS n, floor(CAST(sum(price_cents) AS BIGINT)::DOUBLE / count(*) + 0.5) / 100 AS avg_price
FROM listings GROUP BY 1, 2 ORDER BY n DESC, bedrooms, bathrooms LIMIT 6""")
def by_two_keys_top6(spark: SparkSession, folder: str) -> DataFrame:
    grouped = listings(spark, folder).groupBy("bedrooms", "bathrooms").agg(F.count("*").alias("n"), (F.floor(ratio(F.sum("price_cents"), F.count("*")) + 0.5) / 100.0).alias("avg_price"))
    return grouped.orderBy(F.desc("n"), "bedrooms", "bathrooms").limit(6)


@query(f"""WITH {CALENDAR}, recent AS (SELECT DISTINCT listing_id FROM calendar WHERE day >= DATE '{AS_OF}' - 7 AND day < DATE '{AS_OF}' AND price_cents > 0),
open AS (SELECT DISTINCT listing_id FROM calendar WHERE day >= DATE '{AS_OF}' AND available), {LISTINGS}
SELECT CASE WHEN grouping(building) = 1 THEN 'ALL' ELSE building END AS building, count(*) AS n_listings, count(*) FILTER (WHERE r.listing_id IS NOT NULL) AS priced,
  count(*) FILTER (WHERE o.listing_id IS NOT NULL) AS open, floor(count(*) FILTER (WHERE r.listing_id IS NOT NULL) / count(*)::DOUBLE * 1000 + 0.5) / 10 AS priced_pct
FROM listings LEFT JOIN recent r ON r.listing_id = id LEFT JOIN open o ON o.listing_id = id GROUP BY GROUPING SETS ((building), ())""")
def coverage_with_all_row(spark: SparkSession, folder: str) -> DataFrame:
    """Listings with recent prices and open nights per building type, and for all."""
    days, base = calendar(spark, folder), F.lit(AS_OF).cast("date")
    recent = days.filter((F.col("day") >= F.date_sub(base, 7)) & (F.col("day") < base) & (F.col("price_cents") > 0)).select(F.col("listing_id").alias("r")).distinct()
    open_ = days.filter((F.col("day") >= base) & F.col("available")).select(F.col("listing_id").alias("o")).distinct()
    joined = listings(spark, folder).select("id", "building").join(recent, F.col("id") == F.col("r"), "left").join(open_, F.col("id") == F.col("o"), "left")
    priced = F.count("r")
    return joined.rollup("building").agg(
        F.grouping("building").alias("g"), F.count("*").alias("n_listings"), priced.alias("priced"), F.count("o").alias("open"),
        (F.floor(ratio(priced, F.count("*")) * 1000 + 0.5) / 10.0).alias("priced_pct")).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col("building")).alias("building"), "n_listings", "priced", "open", "priced_pct")


@query(f"""WITH {CALENDAR}, {QUOTES}, facts AS (
  SELECT 'calendar' AS source, listing_id, price_cents AS amount, available FROM calendar
  UNION ALL SELECT 'quote', listing_id, amount, status = 'available' FROM quotes)
SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS n_rows, count(DISTINCT listing_id) AS n_listings,
  count(*) FILTER (WHERE amount IS NULL) AS no_price, count(*) FILTER (WHERE amount <= 0) AS bad_price, count(*) FILTER (WHERE amount BETWEEN 1 AND 1999) AS under_20,
  count(*) FILTER (WHERE amount BETWEEN 2000 AND 99999) AS normal, count(*) FILTER (WHERE amount >= 100000) AS over_1000, count(*) FILTER (WHERE available) AS open
FROM facts GROUP BY GROUPING SETS ((source), ())""")
def quality_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """Price buckets of two feeds in one union, with a total row."""
    a = calendar(spark, folder).select(F.lit("calendar").alias("source"), "listing_id", F.col("price_cents").alias("amount"), "available")
    b = quotes(spark, folder).select(F.lit("quote").alias("source"), "listing_id", "amount", (F.col("status") == "available").alias("available"))
    x = F.col("amount")
    out = a.unionByName(b).rollup("source").agg(
        F.grouping("source").alias("g"), F.count("*").alias("n_rows"), F.countDistinct("listing_id").alias("n_listings"), F.count_if(x.isNull()).alias("no_price"), F.count_if(x <= 0).alias("bad_price"),
        F.count_if(x.between(1, 1999)).alias("under_20"), F.count_if(x.between(2000, 99999)).alias("normal"), F.count_if(x >= 100000).alias("over_1000"), F.count_if(F.col("available")).alias("open"))
    return out.withColumn("source", F.when(F.col("g") == 1, "ALL").otherwise(F.col("source"))).drop("g")


def latest_period(series: DataFrame, year: int, month: int) -> DataFrame:
    """The exact month, else the latest of its year, else the latest of all."""
    return series.orderBy(
        F.desc((F.col("year") == year) & (F.col("month") == month)), F.desc(F.col("year") == year), F.desc("year"), F.desc("month")).limit(1)


@query(f"""WITH {MONTHLY} SELECT year, month, orders, cents FROM monthly
ORDER BY (year = 2001 AND month = 12) DESC, (year = 2001) DESC, year DESC, month DESC LIMIT 1""")
def latest_period_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return latest_period(monthly(spark, folder), 2001, 12).select("year", "month", "orders", "cents")


@query(f"""WITH {LISTINGS}, {CALENDAR} SELECT id, hood FROM listings WHERE NOT EXISTS (
  SELECT 1 FROM calendar WHERE listing_id = id AND day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 60)""")
def anti_never_quoted(spark: SparkSession, folder: str) -> DataFrame:
    return listings(spark, folder).select("id", "hood").join(forward(calendar(spark, folder), 0, 60), F.col("id") == F.col("listing_id"), "left_anti")


@query(f"""WITH {LISTINGS}, {CALENDAR} SELECT listing_id, count(*) AS nights, max(day) AS last_day FROM calendar
WHERE listing_id IN (SELECT id FROM listings WHERE bedrooms = 2 AND beach_m <= 100) GROUP BY listing_id""", dates=["last_day"])
def semi_cohort(spark: SparkSession, folder: str) -> DataFrame:
    cohort = listings(spark, folder).filter("bedrooms = 2 AND beach_m <= 100").select("id")
    return calendar(spark, folder).join(cohort, F.col("listing_id") == F.col("id"), "left_semi").groupBy("listing_id").agg(F.count("*").alias("nights"), F.max("day").alias("last_day"))


@query(f"""WITH {LISTINGS}, {CALENDAR}, r AS (SELECT listing_id, day, price_cents, row_number() OVER (PARTITION BY listing_id ORDER BY day DESC, batch DESC, line DESC) AS k FROM calendar WHERE available)
SELECT id, hood, day AS last_open_day, r.price_cents AS last_open_price FROM listings LEFT JOIN r ON listing_id = id AND k = 1""", dates=["last_open_day"])
def lateral_top1(spark: SparkSession, folder: str) -> DataFrame:
    """For every listing its newest open night, if it has one."""
    newest = first_per_key(calendar(spark, folder).filter("available"), ["listing_id"], [F.desc("day"), F.desc("batch"), F.desc("line")])
    return listings(spark, folder).select("id", "hood").join(
        newest.select("listing_id", F.col("day").alias("last_open_day"), F.col("price_cents").alias("last_open_price")), F.col("id") == F.col("listing_id"), "left").drop("listing_id")


@query(f"""WITH {QUOTES}, p AS (SELECT (SELECT max(seen_at) FROM quotes) AS last_at, (SELECT max(seen_at) FROM quotes WHERE status = 'available') AS last_open,
  (SELECT count(*) FROM quotes WHERE seen_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY) AS last_day)
SELECT last_at, last_open, last_day, CAST(floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(last_at)) / 3.6e9) AS BIGINT) AS age_hours,
  CASE WHEN floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(last_at)) / 3.6e9) > 48 THEN 'fail' WHEN floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(last_at)) / 3.6e9) > 26 THEN 'warn' ELSE 'ok' END AS alert FROM p""", stamps=["last_at", "last_open"])
def scalar_subquery_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Freshness probe of the quote log: newest rows, activity of a day, alert tier."""
    from staylens.functions.numbers import alert

    now = F.lit(f"{EVENTS_AS_OF} 00:00:00").cast("timestamp_ntz")
    probe = quotes(spark, folder).agg(
        F.max("seen_at").alias("last_at"), F.max(F.when(F.col("status") == "available", F.col("seen_at"))).alias("last_open"), F.count_if(F.col("seen_at") >= now - F.expr("INTERVAL 1 DAY")).alias("last_day"))
    age = F.floor(dates.hours_between(F.col("last_at"), now))
    return probe.withColumn("age_hours", age).withColumn("alert", alert(age, 26, 48))


@query(f"""WITH {CALENDAR}, {QUOTES} SELECT source, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day FROM (
  SELECT 'calendar' AS source, day FROM calendar UNION ALL SELECT 'quote', CAST(seen_at AS DATE) FROM quotes) GROUP BY source""", dates=["first_day", "last_day"])
def union_all_facts(spark: SparkSession, folder: str) -> DataFrame:
    a = calendar(spark, folder).select(F.lit("calendar").alias("source"), "day")
    b = quotes(spark, folder).select(F.lit("quote").alias("source"), F.col("seen_at").cast("date").alias("day"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"""WITH {CALENDAR}, {QUOTES} SELECT count(*) AS n_keys FROM (SELECT listing_id FROM calendar WHERE day >= DATE '{AS_OF}' UNION SELECT listing_id FROM quotes)""")
def union_distinct_keys(spark: SparkSession, folder: str) -> DataFrame:
    a = calendar(spark, folder).filter(F.col("day") >= F.lit(AS_OF).cast("date")).select("listing_id")
    return a.union(quotes(spark, folder).select("listing_id")).distinct().agg(F.count("*").alias("n_keys"))


@query(f"""WITH {LISTINGS} SELECT id, hood, price_cents FROM listings ORDER BY price_cents DESC, id LIMIT 20 OFFSET 40""")
def offset_page(spark: SparkSession, folder: str) -> DataFrame:
    return listings(spark, folder).select("id", "hood", "price_cents").orderBy(F.desc("price_cents"), "id").offset(40).limit(20)


@query(f"""WITH {LISTINGS}, {CALENDAR}, last AS (SELECT listing_id, max(day) AS last_day FROM calendar WHERE day < DATE '{AS_OF}' GROUP BY 1)
SELECT id, last_day, rating FROM listings LEFT JOIN last ON listing_id = id ORDER BY last_day ASC NULLS FIRST, rating DESC NULLS LAST, id LIMIT 50""", dates=["last_day"])
def nulls_first_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Stalest listings first: never priced before the rest, the better rated before the unrated."""
    last = calendar(spark, folder).filter(F.col("day") < F.lit(AS_OF).cast("date")).groupBy("listing_id").agg(F.max("day").alias("last_day"))
    joined = listings(spark, folder).select("id", "rating").join(last, F.col("id") == F.col("listing_id"), "left")
    return joined.orderBy(F.asc_nulls_first("last_day"), F.desc_nulls_last("rating"), "id").limit(50).select("id", "last_day", "rating")


@query(f"""WITH {LISTINGS}, {CALENDAR}, f AS (SELECT listing_id, count(*) AS n, max(day) AS last_day FROM calendar GROUP BY 1)
SELECT id, CASE WHEN f.n IS NULL THEN 0 WHEN sqft IS NULL AND rating IS NULL THEN 1 WHEN sqft IS NULL THEN 2 WHEN rating IS NULL THEN 3 ELSE 4 END AS priority,
  COALESCE(last_day, DATE '1970-01-01') AS last_day FROM listings LEFT JOIN f ON listing_id = id ORDER BY priority, last_day, id LIMIT 100""", dates=["last_day"])
def queue_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Enrichment queue: what lacks most first, then what was seen longest ago."""
    seen = calendar(spark, folder).groupBy("listing_id").agg(F.count("*").alias("n"), F.max("day").alias("seen"))
    joined = listings(spark, folder).join(seen, F.col("id") == F.col("listing_id"), "left")
    rank = (F.when(F.col("n").isNull(), 0).when(F.col("sqft").isNull() & F.col("rating").isNull(), 1).when(F.col("sqft").isNull(), 2).when(F.col("rating").isNull(), 3).otherwise(4))
    return joined.select("id", rank.alias("priority"), F.coalesce("seen", F.lit("1970-01-01").cast("date")).alias("last_day")).orderBy("priority", "last_day", "id").limit(100)


@query("""SELECT event_type AS status, CAST(user_id % 3 AS BIGINT) AS region, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2""", stamps=["last_at"])
def queue_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("status"), (F.col("user_id") % 3).alias("region")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


@query(f"""WITH {CALENDAR} SELECT platform, count(*) FILTER (WHERE day < DATE '{AS_OF}' - 7) AS past, count(*) FILTER (WHERE day >= DATE '{AS_OF}' - 7) AS kept FROM calendar GROUP BY platform""")
def retention_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Dry run of the retention rule on past nights."""
    past = F.col("day") < F.date_sub(F.lit(AS_OF).cast("date"), 7)
    return calendar(spark, folder).groupBy("platform").agg(F.count_if(past).alias("past"), F.count_if(~past).alias("kept"))


@query(f"""WITH {LISTINGS} SELECT hood, CAST(count(*) AS BIGINT) AS n, count(sqft) AS has_sqft, count(rating) AS has_rating,
  count(*) FILTER (WHERE beach_m <= 100) AS near, count(*) FILTER (WHERE beach_m > 100 AND beach_m <= 500) AS middle, count(*) FILTER (WHERE beach_m > 500) AS far FROM listings GROUP BY hood""")
def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("beach_m")
    return listings(spark, folder).groupBy("hood").agg(
        F.count("*").alias("n"), F.count("sqft").alias("has_sqft"), F.count("rating").alias("has_rating"),
        F.count_if(m <= 100).alias("near"), F.count_if((m > 100) & (m <= 500)).alias("middle"), F.count_if(m > 500).alias("far"))


@query("""SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part
UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages""")
def source_registry_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = [table(spark, folder, t).agg(F.lit(t).alias("name"), F.count("*").alias("n_rows")) for t in ("orders", "lineitem", "part", "events", "pages")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"""WITH {LISTINGS}, s AS (SELECT hood, bedrooms, bathrooms, id, CAST(row_number() OVER (PARTITION BY hood ORDER BY (sqft IS NOT NULL) DESC, (rating IS NOT NULL) DESC, price_cents DESC, id) AS INTEGER) AS rank FROM listings)
SELECT hood, rank, id FROM s WHERE rank <= 3""")
def rank_samples_per_group(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc(F.col("sqft").isNotNull()), F.desc(F.col("rating").isNotNull()), F.desc("price_cents"), F.asc("id")]
    return top_per_key(listings(spark, folder), ["hood"], order, 3).select("hood", "rank", "id")


@query("""SELECT r_name AS region, c_mktsegment AS segment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS negative,
  CAST(sum(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def segments_by_region(spark: SparkSession, folder: str) -> DataFrame:
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.sum(half_up(F.col("c_acctbal") * 100)).alias("cents"))


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 10 GROUP BY 1, 2""")
def optional_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Conjunction of the filters that were given; absent ones add no predicate."""
    given = {"l_linenumber": 1, "l_returnflag": None}
    df = table(spark, folder, "lineitem")
    for column, value in given.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.filter("l_quantity >= 10").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH {MONTHLY}, a AS (SELECT year, CAST(sum(cents) AS BIGINT) AS cents FROM monthly GROUP BY 1)
SELECT CAST(max_by(year, year) AS INTEGER) AS last_year, CAST(max_by(cents, year) AS BIGINT) AS last_cents FROM a""")
def latest_value_by_year(spark: SparkSession, folder: str) -> DataFrame:
    yearly = monthly(spark, folder).groupBy("year").agg(F.sum("cents").alias("cents"))
    return yearly.agg(F.max("year").alias("last_year"), F.max_by("cents", "year").alias("last_cents"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def pivot_by_status(spark: SparkSession, folder: str) -> DataFrame:
    wide = table(spark, folder, "orders", ["o_orderdate", "o_orderstatus"]).groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("year", *[F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) for x in ("F", "O", "P")])


@query(f"""WITH {CALENDAR} SELECT day - CAST(dayofweek(day) AS INTEGER) AS week, count(*) AS nights, CAST(sum(price_cents) AS BIGINT) AS cents FROM calendar
WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 90 GROUP BY 1""", dates=["week"])
def weekly_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks that start on Sunday."""
    return forward(calendar(spark, folder), 0, 90).groupBy(dates.week_start_sunday(F.col("day")).alias("week")).agg(F.count("*").alias("nights"), F.sum("price_cents").alias("cents"))
