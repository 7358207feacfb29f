"""Market signals: dashboard deltas and momentum, trend labels, totals and weighted means, freshness probes, pending months, commentary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions import dates, numbers
from staylens.functions.numbers import half_up, ratio
from staylens.plans.market import forward
from staylens.plans.registry import query
from staylens.plans.standins import AS_OF, CALENDAR, EVENTS_AS_OF, LISTINGS, MONTHLY, calendar, listings, monthly
from staylens.sources.tables import table

#: fixed values: changes that count as a trend, shares of open nights that count as high and moderate
TREND, OPEN_HIGH, OPEN_MODERATE = 0.05, 0.65, 0.5
#: fixed values: weights of occupancy, arrivals and rate in the momentum, and where it turns
MOMENTUM, POSITIVE_FROM, MIXED_FROM = (0.35, 0.45, 0.20), 2.0, -5.0
#: fixed values: ages in hours of the freshness rules
BASELINE_FAIL_H, QUOTE_FAIL_H, QUOTE_WARN_H, SYNTH_WARN_H, CALENDAR_FAIL_H = 72, 48, 30, 36, 168


# ---- rental signals

def demand_trend(delta: Column) -> Column:
    """More open nights mean less demand."""
    return F.when(delta > TREND, "decreasing").when(delta < -TREND, "increasing").when(delta.isNotNull(), "stable").otherwise("unknown")


def availability_level(share: Column) -> Column:
    return F.when(share > OPEN_HIGH, "high").when(share >= OPEN_MODERATE, "moderate").when(share.isNotNull(), "low").otherwise("unknown")


def pricing_trend(now: Column, past: Column) -> Column:
    change = F.when(past > 0, ratio(now - past, past))
    return F.when(change > TREND, "increasing").when(change < -TREND, "softening").when(change.isNotNull(), "stable").otherwise("unknown")


@query(f"""WITH {LISTINGS}, {CALENDAR}, d AS (SELECT hood, day >= DATE '{AS_OF}' AS recent, available, c.price_cents AS p FROM calendar c JOIN listings ON listings.id = listing_id WHERE (day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 30) OR (day >= DATE '{AS_OF}' - 30 AND day < DATE '{AS_OF}')),
a AS (SELECT hood, count(*) FILTER (WHERE recent AND available) / nullif(count(*) FILTER (WHERE recent), 0)::DOUBLE AS r, count(*) FILTER (WHERE NOT recent AND available) / nullif(count(*) FILTER (WHERE NOT recent), 0)::DOUBLE AS q,
  CAST(sum(p) FILTER (WHERE recent) AS BIGINT) / nullif(count(*) FILTER (WHERE recent), 0)::DOUBLE AS rp, CAST(sum(p) FILTER (WHERE NOT recent) AS BIGINT) / nullif(count(*) FILTER (WHERE NOT recent), 0)::DOUBLE AS qp FROM d GROUP BY hood)
SELECT hood, CASE WHEN r - q > 0.05::DOUBLE THEN 'decreasing' WHEN r - q < -0.05::DOUBLE THEN 'increasing' WHEN r - q IS NOT NULL THEN 'stable' ELSE 'unknown' END AS demand, CASE WHEN r > 0.65::DOUBLE THEN 'high' WHEN r >= 0.5::DOUBLE THEN 'moderate' WHEN r IS NOT NULL THEN 'low' ELSE 'unknown' END AS level,
  CASE WHEN (rp - qp) / qp > 0.05::DOUBLE THEN 'increasing' WHEN (rp - qp) / qp < -0.05::DOUBLE THEN 'softening' WHEN (rp - qp) / qp IS NOT NULL THEN 'stable' ELSE 'unknown' END AS pricing, floor((rp - qp) / qp * 10000 + 0.5) / 10000 AS pricing_change FROM a""")
def rental_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Demand, availability and pricing labels of each neighbourhood: the coming 30 nights against the 30 before."""
    days = forward(calendar(spark, folder), -30, 30).join(listings(spark, folder).select("id", "hood"), F.col("id") == F.col("listing_id"))
    recent = F.col("day") >= F.lit(AS_OF).cast("date")
    share = lambda when: ratio(F.count_if(when & F.col("available")), F.count_if(when))
    mean = lambda when: ratio(F.sum(F.when(when, F.col("price_cents"))), F.count_if(when))
    a = days.groupBy("hood").agg(share(recent).alias("r"), share(~recent).alias("q"), mean(recent).alias("rp"), mean(~recent).alias("qp"))
    return a.select("hood", demand_trend(F.col("r") - F.col("q")).alias("demand"), availability_level(F.col("r")).alias("level"), pricing_trend(F.col("rp"), F.col("qp")).alias("pricing"),
                    half_up(ratio(F.col("rp") - F.col("qp"), F.col("qp")), 4).alias("pricing_change"))


# ---- dashboard

def percent_change(now: Column, past: Column) -> Column:
    """Change in percent to two digits; a past of zero counts as one."""
    return half_up((now - past) / F.greatest(past.cast("double"), F.lit(1.0)) * 100, 2)


def momentum(occupancy: Column, arrivals: Column, rate: Column) -> Column:
    score = reduce(lambda a, b: a + b, [x * w for x, w in zip((occupancy, arrivals, rate), MOMENTUM, strict=True)])
    return F.when(score >= POSITIVE_FROM, "positive").when(score >= MIXED_FROM, "mixed").when(score.isNotNull(), "pressure")


_DASH_SQL = """m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS arrivals, count(DISTINCT o_custkey) AS active, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1, 2),
x AS (SELECT *, floor(filled / arrivals::DOUBLE * 10000 + 0.5) / 100 AS occupancy, floor(cents / arrivals::DOUBLE + 0.5) / 100 AS rate, floor(urgent / arrivals::DOUBLE * 10000000 + 0.5) / 100 AS incidents FROM m),
d AS (SELECT l.year, l.month, l.occupancy, floor((l.occupancy - p.occupancy) * 100 + 0.5) / 100 AS occupancy_change, l.rate, floor((l.rate - p.rate) * 100 + 0.5) / 100 AS rate_change, l.active, floor((l.active - p.active) / greatest(p.active, 1)::DOUBLE * 100 * 100 + 0.5) / 100 AS active_change,
  l.arrivals, floor((l.arrivals - p.arrivals) / greatest(p.arrivals, 1)::DOUBLE * 100 * 100 + 0.5) / 100 AS arrivals_change, l.incidents, CASE WHEN p.incidents > 0 THEN floor((l.incidents - p.incidents) / p.incidents * 100 * 100 + 0.5) / 100 ELSE 0 END AS incidents_change
  FROM x l LEFT JOIN x p ON p.year = l.year - 1 AND p.month = l.month)"""


def dashboard_months(spark: SparkSession, folder: str) -> DataFrame:
    """Five readings of every month with their changes from a year before: points, amounts, percent."""
    orders = table(spark, folder, "orders", ["o_orderdate", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    m = orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count("*").alias("arrivals"), F.count_distinct("o_custkey").alias("active"), F.sum(half_up(F.col("o_totalprice") * 100)).alias("cents"),
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    x = m.select("year", "month", "arrivals", "active", (half_up(ratio(F.col("filled"), F.col("arrivals")) * 10_000) / 100).alias("occupancy"), (half_up(ratio(F.col("cents"), F.col("arrivals"))) / 100).alias("rate"),
                 (half_up(ratio(F.col("urgent"), F.col("arrivals")) * 10_000_000) / 100).alias("incidents"))
    measures = ("arrivals", "active", "occupancy", "rate", "incidents")
    past = x.select((F.col("year") + 1).alias("year"), "month", *[F.col(c).alias(f"past_{c}") for c in measures])
    j = x.join(past, ["year", "month"], "left")
    c = F.col
    return j.select(
        "year", "month", "occupancy", half_up(c("occupancy") - c("past_occupancy"), 2).alias("occupancy_change"), "rate", half_up(c("rate") - c("past_rate"), 2).alias("rate_change"),
        "active", percent_change(c("active"), c("past_active")).alias("active_change"), "arrivals", percent_change(c("arrivals"), c("past_arrivals")).alias("arrivals_change"), "incidents",
        F.when(c("past_incidents") > 0, half_up((c("incidents") - c("past_incidents")) / c("past_incidents") * 100, 2)).otherwise(0.0).alias("incidents_change"))


@query(f"WITH {_DASH_SQL} SELECT * FROM d ORDER BY year DESC, month DESC LIMIT 1")
def dashboard_full(spark: SparkSession, folder: str) -> DataFrame:
    """The newest month's readings and changes."""
    return dashboard_months(spark, folder).orderBy(F.desc("year"), F.desc("month")).limit(1)


@query(f"""WITH {_DASH_SQL}, s AS (SELECT year, month, occupancy_change * 0.35::DOUBLE + arrivals_change * 0.45::DOUBLE + rate_change * 0.2::DOUBLE AS score FROM d)
SELECT year, month, CASE WHEN score >= 2 THEN 'positive' WHEN score >= -5 THEN 'mixed' WHEN score IS NOT NULL THEN 'pressure' END AS momentum FROM s""")
def market_momentum(spark: SparkSession, folder: str) -> DataFrame:
    """Momentum label of every month."""
    c = F.col
    return dashboard_months(spark, folder).select("year", "month", momentum(c("occupancy_change"), c("arrivals_change"), c("rate_change")).alias("momentum"))


# ---- totals and means

@query(f"""WITH {MONTHLY} SELECT a.year, CAST(sum(a.orders) AS BIGINT) AS ytd, CAST(sum(p.orders) AS BIGINT) AS prior, count(p.orders) AS matching FROM monthly a LEFT JOIN monthly p ON p.year = a.year - 1 AND p.month = a.month GROUP BY a.year""")
def ytd_matching(spark: SparkSession, folder: str) -> DataFrame:
    """Each year so far, and the year before over the same months only."""
    m = monthly(spark, folder).select("year", "month", "orders")
    past = m.select((F.col("year") + 1).alias("year"), "month", F.col("orders").alias("past"))
    return m.join(past, ["year", "month"], "left").groupBy("year").agg(F.sum("orders").alias("ytd"), F.sum("past").alias("prior"), F.count("past").alias("matching"))


@query("""WITH o AS (SELECT o_orderpriority AS category, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders),
g AS (SELECT CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(year) = 0 THEN 'month' ELSE 'total' END AS kind, category, year, month, count(*) AS n FROM o GROUP BY GROUPING SETS ((category), (year, month), ()))
SELECT kind, category, year, month, n, CASE WHEN kind <> 'month' THEN floor(n / (SELECT count(DISTINCT year * 12 + month) FROM o)::DOUBLE * 10 + 0.5) / 10 END AS per_month FROM g""")
def category_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals by category, by month and of all, with the mean of a month; one pass over grouping sets."""
    o = table(spark, folder, "orders", ["o_orderdate", "o_orderpriority"]).select(F.col("o_orderpriority").alias("category"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    g = o.groupingSets([[F.col("category")], [F.col("year"), F.col("month")], []], "category", "year", "month").agg(F.count("*").alias("n"), F.grouping("category").alias("gc"), F.grouping("year").alias("gy"))
    kind = F.when(F.col("gc") == 0, "category").when(F.col("gy") == 0, "month").otherwise("total")
    months = o.select("year", "month").distinct().agg(F.count("*").alias("months"))
    return g.withColumn("kind", kind).join(months).select("kind", "category", "year", "month", "n", F.when(F.col("kind") != "month", half_up(ratio(F.col("n"), F.col("months")), 1)).alias("per_month"))


@query(f"""WITH {LISTINGS}, s AS (SELECT hood, bedrooms, count(*) AS n, CAST(sum(price_cents) AS BIGINT) / count(*)::DOUBLE AS rate FROM listings GROUP BY 1, 2)
SELECT hood, CAST(sum(n) AS BIGINT) AS n, floor(sum(floor(rate * n + 0.5)) / sum(n) + 0.5) / 100 AS weighted_rate FROM s GROUP BY hood""")
def weighted_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rate of a neighbourhood from its segments' means, weighted by their listings."""
    s = listings(spark, folder).groupBy("hood", "bedrooms").agg(F.count("*").alias("n"), ratio(F.sum("price_cents"), F.count("*")).alias("rate"))
    return s.groupBy("hood").agg(F.sum("n").alias("n"), (half_up(ratio(F.sum(half_up(F.col("rate") * F.col("n"))), F.sum("n"))) / 100).alias("weighted_rate"))


@query(f"""WITH {LISTINGS}, {CALENDAR}, h AS (SELECT hood, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, floor(CAST(sum(c.price_cents) AS BIGINT) / count(*)::DOUBLE + 0.5) AS rate FROM calendar c JOIN listings ON listings.id = listing_id GROUP BY 1, 2, 3)
SELECT year, month, count(*) AS hoods, CAST(floor(sum(rate) / count(*) / 100 + 0.5) AS BIGINT) AS mean_rate FROM h GROUP BY 1, 2""")
def mean_rate_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the neighbourhoods' rates in each month, in whole units."""
    days = calendar(spark, folder).join(listings(spark, folder).select("id", "hood"), F.col("id") == F.col("listing_id"))
    h = days.groupBy("hood", F.year("day").alias("year"), F.month("day").alias("month")).agg(half_up(ratio(F.sum("price_cents"), F.count("*"))).alias("rate"))
    return h.groupBy("year", "month").agg(F.count("*").alias("hoods"), half_up(F.sum("rate") / F.count("*") / 100).alias("mean_rate"))


@query(f"""WITH {LISTINGS} SELECT hood, floor(sum(COALESCE(sqft, 0)) / count(*) * 100 + 0.5) / 100 AS mean_with_nulls, floor(sum(sqft) / count(sqft) * 100 + 0.5) / 100 AS mean_known FROM listings GROUP BY hood""")
def means_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Mean in which nulls are zero and count, beside the mean of what is known."""
    x = F.col("sqft")
    return listings(spark, folder).groupBy("hood").agg(half_up(F.sum(F.coalesce(x, F.lit(0.0))) / F.count("*"), 2).alias("mean_with_nulls"), half_up(ratio(F.sum(x), F.count(x)), 2).alias("mean_known"))


# ---- freshness probes

def baseline_level(total: Column, age: Column, stale7: Column, stale14: Column) -> Column:
    return (F.when(total == 0, "warn").when(age.isNull() | (age > BASELINE_FAIL_H), "fail").when(stale14 * 2 >= total, "fail").when(stale7 * 3 >= total, "warn").otherwise("ok"))


def quote_level(total: Column, age: Column, last_day: Column, stale14: Column) -> Column:
    """fail only where nothing came in a day and the newest is old; all else is a warning at most."""
    return (F.when(total == 0, "warn").when((last_day == 0) & (age.isNull() | (age > QUOTE_FAIL_H)), "fail").when((age > QUOTE_WARN_H) | (stale14 > 0), "warn").otherwise("ok"))


def synthetic_level(total: Column, age: Column, stale14: Column) -> Column:
    return (F.when(total == 0, "warn").when(age.isNull() | (age > QUOTE_FAIL_H), "fail").when(stale14 * 2 >= total, "fail").when((stale14 > 0) | (age > SYNTH_WARN_H), "warn").otherwise("ok"))


def calendar_level(total: Column, age: Column) -> Column:
    return F.when(total == 0, "warn").when(age.isNull() | (age > CALENDAR_FAIL_H), "fail").when(age > SYNTH_WARN_H, "warn").otherwise("ok")


#: probe, rule, days that its clock stands behind the newest stand-in events
PROBES = [("airbnb_baseline", "baseline", 1), ("airbnb_quotes", "quote", 2), ("pvrpv_quotes", "synthetic", 0), ("vrbo_quotes", "synthetic", 3), ("vrbo_scrape", "synthetic", 1), ("airbnb_calendar", "calendar", 5)]
_PROBES_SQL = " UNION ALL ".join(f"SELECT '{n}' AS probe, '{r}' AS rule, TIMESTAMP '{EVENTS_AS_OF}' + INTERVAL {d} DAY AS now_" for n, r, d in PROBES)


@query(f"""WITH p AS ({_PROBES_SQL}), u AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS seen FROM events GROUP BY 1),
a AS (SELECT probe, rule, now_, count(*) AS total, count(*) FILTER (WHERE seen IS NULL OR seen < now_ - INTERVAL 7 DAY) AS stale7, count(*) FILTER (WHERE seen IS NULL OR seen < now_ - INTERVAL 14 DAY) AS stale14, count(*) FILTER (WHERE seen >= now_ - INTERVAL 1 DAY) AS last_day, CAST(floor((epoch_us(now_) - epoch_us(max(seen))) / 3.6e9) AS BIGINT) AS age FROM p, u GROUP BY 1, 2, 3)
SELECT probe, total, stale7, stale14, last_day, age AS age_hours, CASE WHEN total = 0 THEN 'warn' WHEN rule = 'baseline' THEN CASE WHEN age IS NULL OR age > 72 OR stale14 * 2 >= total THEN 'fail' WHEN stale7 * 3 >= total THEN 'warn' ELSE 'ok' END
  WHEN rule = 'quote' THEN CASE WHEN last_day = 0 AND (age IS NULL OR age > 48) THEN 'fail' WHEN age > 30 OR stale14 > 0 THEN 'warn' ELSE 'ok' END
  WHEN rule = 'synthetic' THEN CASE WHEN age IS NULL OR age > 48 OR stale14 * 2 >= total THEN 'fail' WHEN stale14 > 0 OR age > 36 THEN 'warn' ELSE 'ok' END ELSE CASE WHEN age IS NULL OR age > 168 THEN 'fail' WHEN age > 36 THEN 'warn' ELSE 'ok' END END AS level FROM a""")
def freshness_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Six probes of one cohort, each with its own rule and clock, from one pass over the log."""
    seen = table(spark, folder, "events", ["user_id", "event_type", "ts"]).groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("seen"))
    clocks = {n: F.lit(f"{EVENTS_AS_OF} 00:00:00").cast("timestamp_ntz") + F.expr(f"INTERVAL {d} DAYS") for n, _, d in PROBES}
    old = lambda now, d: F.col("seen").isNull() | (F.col("seen") < now - F.expr(f"INTERVAL {d} DAYS"))
    counted = seen.agg(*[F.struct(
        F.lit(n).alias("probe"), F.lit(r).alias("rule"), F.count("*").alias("total"), F.count_if(old(clocks[n], 7)).alias("stale7"), F.count_if(old(clocks[n], 14)).alias("stale14"),
        F.count_if(F.col("seen") >= clocks[n] - F.expr("INTERVAL 1 DAYS")).alias("last_day"), F.floor(dates.hours_between(F.max("seen"), clocks[n])).alias("age_hours")).alias(n) for n, r, _ in PROBES])
    a = counted.select(F.explode(F.array(*[F.col(n) for n, _, _ in PROBES])).alias("x")).select("x.*")
    c = F.col
    level = (F.when(c("rule") == "baseline", baseline_level(c("total"), c("age_hours"), c("stale7"), c("stale14"))).when(c("rule") == "quote", quote_level(c("total"), c("age_hours"), c("last_day"), c("stale14")))
             .when(c("rule") == "synthetic", synthetic_level(c("total"), c("age_hours"), c("stale14"))).otherwise(calendar_level(c("total"), c("age_hours"))))
    return a.select("probe", "total", "stale7", "stale14", "last_day", "age_hours", level.alias("level"))


#: fixed values: days after which a detail is stale, hours after which a partial one is read again
STALE_AFTER_D, PARTIAL_AFTER_H = 30, 6


@query(f"""WITH {LISTINGS}, {CALENDAR}, e AS (SELECT listing_id, max(day) AS at_ FROM calendar WHERE day <= DATE '{AS_OF}' AND listing_id % 6 <> 0 GROUP BY 1),
r AS (SELECT id, CASE WHEN at_ IS NULL THEN 0 WHEN at_ < DATE '{AS_OF}' - 30 AND hood IN ('Zona Romantica', 'Amapas') THEN 1 WHEN at_ < DATE '{AS_OF}' - 30 THEN 2 WHEN id % 3 = 0 AND at_ < DATE '{AS_OF}' THEN 3 ELSE 4 END AS rank FROM listings LEFT JOIN e ON listing_id = id)
SELECT id, rank FROM r""")
def enrichment_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """What to read next: never read, stale in the first tier, stale, partial, the rest."""
    day = F.lit(AS_OF).cast("date")
    seen = calendar(spark, folder).filter((F.col("day") <= day) & (F.col("listing_id") % 6 != 0)).groupBy("listing_id").agg(F.max("day").alias("at"))
    x = listings(spark, folder).select("id", "hood").join(seen, F.col("id") == F.col("listing_id"), "left")
    stale, partial = F.col("at") < F.date_sub(day, STALE_AFTER_D), (F.col("id") % 3 == 0) & (dates.hours_between(F.col("at").cast("timestamp_ntz"), day.cast("timestamp_ntz")) > PARTIAL_AFTER_H)
    return x.select("id", F.when(F.col("at").isNull(), 0).when(stale & F.col("hood").isin("Zona Romantica", "Amapas"), 1).when(stale, 2).when(partial, 3).otherwise(4).alias("rank"))


# ---- pending months, events, commentary

@query(f"""WITH {MONTHLY}, w AS (SELECT 2001 AS year, unnest(range(1, 11)) AS month) SELECT CAST(w.year AS INTEGER) AS year, CAST(w.month AS INTEGER) AS month FROM w LEFT JOIN monthly m ON m.year = w.year AND m.month = w.month WHERE m.orders IS NULL""")
def pending_months(spark: SparkSession, folder: str) -> DataFrame:
    """Months of the year up to October 2001 that have no official figure yet."""
    wanted = spark.range(1, 11).select(F.lit(2001).alias("year"), F.col("id").cast("int").alias("month"))
    return wanted.join(monthly(spark, folder).select("year", "month"), ["year", "month"], "left_anti")


def signed_percent(x: Column) -> Column:
    """A percentage with sign and one digit, rounded half up."""
    tenths = half_up(x * 10)
    size = F.abs(tenths)
    return F.concat(F.when(tenths < 0, "-").otherwise("+"), F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"), F.lit("%"))


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MESES = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]


def commentary(year: Column, month: Column, change: Column) -> tuple[Column, Column]:
    """A sentence on a month's change in English and Spanish, or on there being none to compare with."""
    name = lambda names: F.concat(F.element_at(F.array(*[F.lit(x) for x in names]), month), F.lit(" "), year.cast("string"))
    pct = signed_percent(change)
    en = F.when(change.isNull(), F.concat(name(MONTHS), F.lit(" has no month before to compare with."))).when(change < -15, F.concat(name(MONTHS), F.lit(": traffic "), pct, F.lit(" year over year, a shock."))).otherwise(F.concat(name(MONTHS), F.lit(": traffic "), pct, F.lit(" year over year, within the season.")))
    es = F.when(change.isNull(), F.concat(name(MESES), F.lit(" no tiene mes anterior con que comparar."))).when(change < -15, F.concat(name(MESES), F.lit(": tráfico "), pct, F.lit(" interanual, un choque."))).otherwise(F.concat(name(MESES), F.lit(": tráfico "), pct, F.lit(" interanual, dentro de la temporada.")))
    return en, es


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


@query(f"""WITH {MONTHLY}, y AS (SELECT a.year, a.month, (a.orders - p.orders) / p.orders::DOUBLE * 100 AS c FROM monthly a LEFT JOIN monthly p ON p.year = a.year - 1 AND p.month = a.month),
t AS (SELECT *, CAST(floor(c * 10 + 0.5) AS BIGINT) AS z FROM y), s AS (SELECT *, CASE WHEN z < 0 THEN '-' ELSE '+' END || (abs(z) // 10) || '.' || (abs(z) % 10) || '%' AS pct FROM t)
SELECT year, month, {_list(MONTHS)}[month] || ' ' || year || CASE WHEN c IS NULL THEN ' has no month before to compare with.' WHEN c < -15 THEN ': traffic ' || pct || ' year over year, a shock.' ELSE ': traffic ' || pct || ' year over year, within the season.' END AS en,
  {_list(MESES)}[month] || ' ' || year || CASE WHEN c IS NULL THEN ' no tiene mes anterior con que comparar.' WHEN c < -15 THEN ': tráfico ' || pct || ' interanual, un choque.' ELSE ': tráfico ' || pct || ' interanual, dentro de la temporada.' END AS es FROM s""")
def month_commentary(spark: SparkSession, folder: str) -> DataFrame:
    """Commentary of every month in two languages."""
    m = monthly(spark, folder).select("year", "month", "orders")
    past = m.select((F.col("year") + 1).alias("year"), "month", F.col("orders").alias("past"))
    en, es = commentary(F.col("year"), F.col("month"), ratio(F.col("orders") - F.col("past"), F.col("past")) * 100)
    return m.join(past, ["year", "month"], "left").select("year", "month", en.alias("en"), es.alias("es"))


# ---- seeds of the discovery queue

#: fixed values: weights of the seed priority
SOURCES, WINDOWS = {"airbnb": 2, "vrbo": 1}, {"next_weekend": 4, "+14": 3, "+30": 2, "+60": 1}
STAYS, GUESTS, BEDROOMS = {3: 3, 5: 2, 7: 1}, {2: 3, 4: 2, 6: 1}, ["studio", "1", "2", "3", "4plus"]


def seeds(buckets: DataFrame) -> DataFrame:
    """All search seeds of buckets (bucket, bucket_priority) as a product of small dimensions, with their priority."""
    def dimension(values: dict) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in values.items()]))

    x = buckets
    for name, values in (("source", SOURCES), ("checkin", WINDOWS), ("stay", STAYS), ("guests", GUESTS)):
        x = x.withColumn(name, dimension(values))
    x = x.withColumn("bedrooms", F.explode(F.array(*[F.lit(b) for b in BEDROOMS])))
    priority = F.col("bucket_priority") * 1000 + F.col("source.w") * 100 + F.col("checkin.w") * 10 + F.col("stay.w") + F.col("guests.w")
    return x.select("bucket", *[F.col(f"{c}.k").alias(c) for c in ("source", "checkin", "stay", "guests")], "bedrooms", priority.cast("long").alias("priority"))


_SEEDS_SQL = """b AS (SELECT hood AS bucket, length(hood) + ascii(hood) % 7 AS bp FROM (SELECT DISTINCT hood FROM listings)), """ + ", ".join(
    f"{n}_d(k, w) AS (VALUES " + ", ".join(f"({repr(k)}, {w})" for k, w in v.items()) + ")" for n, v in (("source", SOURCES), ("checkin", WINDOWS), ("stay", STAYS), ("guests", GUESTS))) + """,
sd AS (SELECT bucket, source_d.k AS source, checkin_d.k AS checkin, stay_d.k AS stay, guests_d.k AS guests, bedrooms, CAST(bp * 1000 + source_d.w * 100 + checkin_d.w * 10 + stay_d.w + guests_d.w AS BIGINT) AS priority
  FROM b, source_d, checkin_d, stay_d, guests_d, (SELECT unnest(['studio', '1', '2', '3', '4plus']) AS bedrooms))"""


def _buckets(spark: SparkSession, folder: str) -> DataFrame:
    hoods = listings(spark, folder).select(F.col("hood").alias("bucket")).distinct()
    return hoods.withColumn("bucket_priority", F.length("bucket") + F.ascii("bucket") % 7)


@query(f"WITH {LISTINGS}, {_SEEDS_SQL} SELECT * FROM sd")
def seed_generation(spark: SparkSession, folder: str) -> DataFrame:
    """All search seeds with their priority."""
    return seeds(_buckets(spark, folder))


@query(f"WITH {LISTINGS}, {_SEEDS_SQL} SELECT bucket, source, count(*) AS n, max(priority) AS highest, min(priority) AS lowest FROM sd GROUP BY 1, 2")
def seed_summary(spark: SparkSession, folder: str) -> DataFrame:
    return seeds(_buckets(spark, folder)).groupBy("bucket", "source").agg(F.count("*").alias("n"), F.max("priority").alias("highest"), F.min("priority").alias("lowest"))


@query(f"""WITH {LISTINGS}, {_SEEDS_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY priority DESC, source, checkin, stay, guests, bedrooms) AS INTEGER) AS position FROM sd) SELECT * FROM r WHERE position <= 10""")
def seed_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten seeds of every bucket in the queue's order: priority, then six names and numbers."""
    order = Window.partitionBy("bucket").orderBy(F.desc("priority"), "source", "checkin", "stay", "guests", "bedrooms")
    return seeds(_buckets(spark, folder)).withColumn("position", F.row_number().over(order)).filter("position <= 10")


# ---- calendars and units

@query(f"""WITH {MONTHLY} SELECT year, month, year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS key, CASE WHEN month IN (11, 12, 1, 2, 3, 4) THEN 'high' WHEN month IN (5, 10) THEN 'shoulder' ELSE 'low' END AS season, CAST(day(last_day(make_date(year, month, 1))) AS INTEGER) AS days,
  floor(((orders % 400) / 10.0::DOUBLE * 9 / 5 + 32) * 10 + 0.5) / 10 AS fahrenheit, floor((cents % 30000) / 100.0::DOUBLE / 25.4::DOUBLE * 100 + 0.5) / 100 AS inches, CAST(floor(orders * 10.7639::DOUBLE + 0.5) AS BIGINT) AS sqft FROM monthly""")
def month_table(spark: SparkSession, folder: str) -> DataFrame:
    """Months of the series with their key, season and length, and readings in the other units."""
    y, m = F.col("year"), F.col("month")
    first = F.make_date(y, m, F.lit(1))
    return monthly(spark, folder).select(
        "year", "month", dates.month_key(y, m).alias("key"), dates.season(first).alias("season"), dates.days_in_month(first).alias("days"), numbers.celsius_to_f((F.col("orders") % 400) / F.lit(10.0)).alias("fahrenheit"),
        numbers.mm_to_inches((F.col("cents") % 30_000) / F.lit(100.0)).alias("inches"), numbers.sqm_to_sqft(F.col("orders")).alias("sqft"))


@query(f"""WITH {LISTINGS}, {CALENDAR}, n AS (SELECT id, (SELECT max(day) FROM calendar c WHERE c.listing_id = l.id AND day < DATE '{AS_OF}') AS last_day, (SELECT c.price_cents FROM calendar c WHERE c.listing_id = l.id AND day < DATE '{AS_OF}' ORDER BY day DESC, batch DESC, line DESC LIMIT 1) AS last_cents FROM listings l) SELECT * FROM n""", dates=["last_day"])
def correlated_latest(spark: SparkSession, folder: str) -> DataFrame:
    """For every listing its newest past night and that night's price; both subqueries as one aggregate and a join."""
    past = calendar(spark, folder).filter(F.col("day") < F.lit(AS_OF).cast("date"))
    newest = past.groupBy(F.col("listing_id").alias("id")).agg(F.max("day").alias("last_day"), F.max_by("price_cents", F.struct("day", "batch", "line")).alias("last_cents"))
    return listings(spark, folder).select("id").join(newest, "id", "left")


@query(f"""WITH {LISTINGS}, {CALENDAR} SELECT id, count(c.day) AS open_nights FROM listings LEFT JOIN calendar c ON c.listing_id = id AND c.available AND c.day >= DATE '{AS_OF}' GROUP BY id""")
def join_with_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Open nights of every listing; the filter stands in the join, so listings without any stay."""
    open_ = calendar(spark, folder).filter(F.col("available") & (F.col("day") >= F.lit(AS_OF).cast("date"))).groupBy(F.col("listing_id").alias("id")).agg(F.count("*").alias("n"))
    return listings(spark, folder).select("id").join(open_, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("open_nights"))


@query(f"""WITH {CALENDAR} SELECT platform, count(*) FILTER (WHERE day < DATE '{AS_OF}' - 7) AS past, count(*) FILTER (WHERE DATE '{AS_OF}' - CAST(batch % 120 AS INTEGER) < DATE '{AS_OF}' - 90) AS stale, count(*) FILTER (WHERE NOT (day < DATE '{AS_OF}' - 7 OR DATE '{AS_OF}' - CAST(batch % 120 AS INTEGER) < DATE '{AS_OF}' - 90)) AS kept FROM calendar GROUP BY platform""")
def retention_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Dry run of both retention rules: nights long past, and rows not collected for long."""
    from staylens.operators.upserts import retention

    collected = F.date_sub(F.lit(AS_OF).cast("date"), (F.col("batch") % 120).cast("int")).cast("timestamp_ntz")
    past, stale = retention(calendar(spark, folder), "day", "collected", AS_OF)
    return calendar(spark, folder).withColumn("collected", collected).groupBy("platform").agg(F.count_if(past).alias("past"), F.count_if(stale).alias("stale"), F.count_if(~(past | stale)).alias("kept"))
