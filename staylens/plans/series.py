"""Monthly series, observation logs and seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions import dates
from staylens.functions.numbers import clamp, half_up, pct_change, ratio
from staylens.operators import latest, upserts
from staylens.operators.overlays import MONTH_FACTORS
from staylens.plans.market import forward
from staylens.plans.registry import query
from staylens.plans.standins import AS_OF, CALENDAR, MONTHLY, QUOTES, calendar, monthly, quotes

#: fixed values: monthly traffic factors of the airport, January to December
TRAFFIC_FACTORS = [1.08, 1.05, 1.10, 1.02, 0.96, 0.90, 0.88, 0.89, 0.87, 0.95, 1.00, 1.15]
MAX_SWING = 0.15
#: fixed values: threshold of an anomaly, of a weak month before it, and default weights
ANOMALY_BELOW, WEAK_BELOW, WEAK_MONTHS = -15.0, -8.0, 2
ANOMALY_WEIGHT, RECOVERY_WEIGHT = 0.30, 0.70
#: fixed values: weights of traffic and of prices in structural and mixed months
STRUCTURAL, MIXED = (0.8, 0.85), (0.7, 0.75)
#: stand-in market events over the test data's years (slug, first day, last day, shock first, shock last, recovery end, priority, premium, weights, active)
EVENTS = [
    ("storm", "1997-09-05", "1997-09-20", "1997-08-20", "1997-09-30", "1997-12-31", 80, 0.12, '{"airportDemand": 0.4, "pricingDemand": 0.5}', True),
    ("festival", "1998-06-03", "1998-06-10", None, None, None, 100, 0.18, None, True),
    ("fair", "1998-06-08", "1998-06-20", None, None, None, 50, 0.08, None, True),
    ("outage", "2001-08-01", "2001-08-31", None, None, "2001-12-31", 50, 0.05, "not json", True),
    ("quake", "1999-05-07", None, "1999-04-20", "1999-05-20", "1999-07-31", 60, 0.0, None, True),
    ("cancelled", "1998-06-04", "1998-06-30", None, None, None, 200, 0.5, None, False),
]
EVENT_SCHEMA = "slug string, start string, end string, shock_start string, shock_end string, recovery_end string, priority int, premium double, weights string, active boolean"
EVENTS_SQL = "events_dim AS (SELECT slug, CAST(s AS DATE) AS s, COALESCE(CAST(e AS DATE), CAST(s AS DATE)) AS e, CAST(ss AS DATE) AS ss, CAST(se AS DATE) AS se, CAST(re AS DATE) AS re, priority, premium, CASE slug WHEN 'storm' THEN 0.4 ELSE 0.3 END AS w_air, CASE slug WHEN 'storm' THEN 0.5 ELSE 0.3 END AS w_price FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in e[:8]) + ")" for e in EVENTS if e[9]) + ") AS t(slug, s, e, ss, se, re, priority, premium))"


def events(spark: SparkSession) -> DataFrame:
    """Active market events: dates parsed, one without last day ends when it begins, weights read from JSON, malformed JSON as none."""
    weights = F.from_json("weights", "airportDemand double, pricingDemand double, recoveryDemand double")
    df = spark.createDataFrame(EVENTS, EVENT_SCHEMA).filter("active").withColumn("end", F.coalesce("end", "start"))
    for c in ("start", "end", "shock_start", "shock_end", "recovery_end"):
        df = df.withColumn(c, F.to_date(c))
    return df.withColumn("w", weights).select(
        "slug", "start", "end", "shock_start", "shock_end", "recovery_end", "priority", "premium",
        F.coalesce("w.airportDemand", F.lit(ANOMALY_WEIGHT)).alias("airport_weight"), F.coalesce("w.pricingDemand", F.lit(ANOMALY_WEIGHT)).alias("pricing_weight"),
        F.coalesce("w.recoveryDemand", F.lit(RECOVERY_WEIGHT)).alias("recovery_weight"))


def month_factor(month: Column, factors: list[float] = MONTH_FACTORS) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in factors]), month)


def phases(months: DataFrame, happenings: DataFrame) -> DataFrame:
    """Month x event pairs with the phase: direct impact before booking shock before recovery."""
    start = F.make_date("year", "month", F.lit(1))
    end = F.last_day(start)
    direct = dates.overlaps(F.col("start"), F.col("end"), start, end)
    shock = F.coalesce(dates.overlaps(F.col("shock_start"), F.col("shock_end"), start, end), F.lit(False))
    recovery = F.coalesce(dates.overlaps(F.col("end"), F.col("recovery_end"), start, end), F.lit(False))
    phase = F.when(direct, "direct_impact").when(shock, "booking_shock").when(recovery, "recovery")
    # events are a few hundred rows at most: the range condition runs against a broadcast
    joined = months.join(F.broadcast(happenings), direct | shock | recovery)
    return joined.withColumn("phase", phase)


@query(f"""WITH {QUOTES} SELECT listing_id, kind, id, amount FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, kind ORDER BY seen_at DESC, id DESC) AS k FROM quotes) WHERE k = 1""")
def distinct_on_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest.first_per_key(quotes(spark, folder), ["listing_id", "kind"], [F.desc("seen_at"), F.desc("id")]).select("listing_id", "kind", "id", "amount")


@query(f"""WITH {MONTHLY} SELECT a.year, a.month, a.orders, b.orders AS last_year, floor((a.orders - b.orders)::DOUBLE / b.orders * 100 * 10000 + 0.5) / 10000 AS yoy_pct
FROM monthly a LEFT JOIN monthly b ON b.year = a.year - 1 AND b.month = a.month""")
def yoy_self_join(spark: SparkSession, folder: str) -> DataFrame:
    return latest.year_over_year(monthly(spark, folder).select("year", "month", "orders"), "orders")


YOY_SQL = f"""{MONTHLY}, yoy AS (SELECT a.year, a.month, a.orders, floor((a.orders - b.orders)::DOUBLE / b.orders * 100 * 10000 + 0.5) / 10000 AS yoy_pct
FROM monthly a LEFT JOIN monthly b ON b.year = a.year - 1 AND b.month = a.month), weak AS (SELECT *, COALESCE(sum(CASE WHEN yoy_pct < -8 THEN 1 ELSE 0 END)
  OVER (ORDER BY year * 12 + month RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS weak_months FROM yoy)"""


@query(f"WITH {YOY_SQL} SELECT year, month, yoy_pct, weak_months FROM weak")
def prior_two_months(spark: SparkSession, folder: str) -> DataFrame:
    yoy = latest.year_over_year(monthly(spark, folder).select("year", "month", "orders"), "orders")
    return latest.prior_declines(yoy, 2, WEAK_BELOW).select("year", "month", "yoy_pct", "weak_months")


@query("""WITH d AS (SELECT event_type AS kind, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE value > 100) AS hits FROM events GROUP BY 1, 2),
r AS (SELECT *, hits::DOUBLE / n AS rate, row_number() OVER (PARTITION BY kind ORDER BY day DESC) AS k FROM d)
SELECT kind, count(*) AS runs, count(*) = 3 AND bool_and(rate < 0.5) AS alert FROM r WHERE k <= 3 GROUP BY kind""")
def alert_consecutive_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Alert where the latest three daily runs all stay under half."""
    from staylens.sources.tables import table

    runs = table(spark, folder, "events").groupBy(F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("day")).agg(
        ratio(F.count_if(F.col("value") > 100), F.count("*")).alias("rate"))
    return latest.recent_all_below(runs, ["kind"], [F.desc("day")], "rate", 3, 0.5)


@query(f"""WITH {QUOTES}, z AS (SELECT listing_id, id, seen_at, CASE WHEN status = 'unavailable' THEN 0 ELSE 1 END AS new FROM quotes),
g AS (SELECT *, sum(new) OVER (PARTITION BY listing_id ORDER BY seen_at, id) AS run FROM z)
SELECT id, listing_id, CAST(sum(1 - new) OVER (PARTITION BY listing_id, run ORDER BY seen_at, id) AS BIGINT) AS streak FROM g""")
def zero_streaks(spark: SparkSession, folder: str) -> DataFrame:
    seen = quotes(spark, folder).select("listing_id", "id", "seen_at", F.when(F.col("status") == "unavailable", 0).otherwise(1).alias("new"))
    return latest.zero_streaks(seen, ["listing_id"], [F.col("seen_at"), F.col("id")], "new").select("id", "listing_id", "streak")


@query(f"""WITH {CALENDAR}, d AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE available) AS o, row_number() OVER (ORDER BY day) AS k FROM calendar WHERE day >= DATE '{AS_OF}' AND day < DATE '{AS_OF}' + 30 GROUP BY day)
SELECT count(*) AS days, CASE WHEN count(*) >= 8 THEN floor(sum(CASE WHEN k <= 7 THEN o END)::DOUBLE / sum(CASE WHEN k <= 7 THEN n END) * 10000 + 0.5) / 10000 END AS near,
  CASE WHEN count(*) >= 8 THEN floor(sum(o)::DOUBLE / sum(n) * 10000 + 0.5) / 10000 END AS full_window FROM d""")
def near_term_vs_full(spark: SparkSession, folder: str) -> DataFrame:
    daily = forward(calendar(spark, folder), 0, 30).groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("available")).alias("o"))
    ranked = daily.withColumn("k", F.row_number().over(Window.orderBy("day")))
    first = F.col("k") <= 7
    near = half_up(ratio(F.sum(F.when(first, F.col("o"))), F.sum(F.when(first, F.col("n")))), 4)
    return ranked.agg(F.count("*").alias("days"), F.when(F.count("*") >= 8, near).alias("near"), F.when(F.count("*") >= 8, half_up(ratio(F.sum("o"), F.sum("n")), 4)).alias("full_window"))


@query(f"""WITH {MONTHLY}, y AS (SELECT a.month, floor(avg(a.orders::DOUBLE / b.orders) * 1000000 + 0.5) / 1000000 AS growth FROM monthly a JOIN monthly b ON b.year = a.year - 1 AND b.month = a.month GROUP BY a.month),
m AS (SELECT unnest(range(1, 13))::INTEGER AS month)
SELECT 2001 AS year, m.month, p.orders AS last_year, CAST(floor(p.orders * (SELECT floor(avg(growth) * 1000000 + 0.5) / 1000000 FROM y) + 0.5) AS BIGINT) AS nowcast
FROM m JOIN monthly p ON p.year = 2000 AND p.month = m.month WHERE NOT EXISTS (SELECT 1 FROM monthly q WHERE q.year = 2001 AND q.month = m.month)""")
def nowcast_months(spark: SparkSession, folder: str) -> DataFrame:
    """Months of the last year not published yet: last year's month times the mean growth."""
    series = monthly(spark, folder).select("year", "month", "orders")
    growth = latest.year_over_year(series, "orders").filter("last_year IS NOT NULL").groupBy("month").agg(half_up(F.avg(ratio(F.col("orders"), F.col("last_year"))), 6).alias("g"))
    factor = growth.agg(half_up(F.avg("g"), 6).alias("factor"))
    months = spark.range(1, 13).select(F.lit(2001).alias("year"), F.col("id").cast("int").alias("month"))
    missing = months.join(series, ["year", "month"], "left_anti")
    past = series.filter("year = 2000").select("month", F.col("orders").alias("last_year"))
    return missing.join(past, "month").crossJoin(F.broadcast(factor)).select("year", "month", "last_year", half_up(F.col("last_year") * F.col("factor")).alias("nowcast"))


@query(f"""WITH {EVENTS_SQL}, {MONTHLY}, m AS (SELECT year, month, make_date(year, month, 1) AS a, last_day(make_date(year, month, 1)) AS b FROM monthly)
SELECT year, month, slug, CASE WHEN s <= b AND e >= a THEN 'direct_impact' WHEN ss <= b AND se >= a THEN 'booking_shock' ELSE 'recovery' END AS phase
FROM m JOIN events_dim ON (s <= b AND e >= a) OR (ss <= b AND se >= a) OR (e <= b AND re >= a)""")
def event_month_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return phases(monthly(spark, folder).select("year", "month"), events(spark)).select("year", "month", "slug", "phase")


def classify(yoy: DataFrame, happenings: DataFrame) -> DataFrame:
    """Anomaly class of each month of a year-over-year series, with demand weights.

    Order of rules: recovery without impact, change above the threshold or unknown, large drop without
    event (structural after two weak months), drop with event (mixed after two weak months, else shock).
    """
    weak = latest.prior_declines(yoy, WEAK_MONTHS, WEAK_BELOW)
    hit = F.col("phase") != "recovery"
    matched = phases(weak.select("year", "month"), happenings).groupBy("year", "month").agg(
        F.count_if(hit).alias("impacts"), F.count_if(~hit).alias("recoveries"),
        F.min_by(F.struct("slug", "phase", "airport_weight", "pricing_weight"), F.when(hit, F.struct("start", "slug"))).alias("impact"),
        F.min_by(F.struct("slug", "recovery_weight"), F.when(~hit, F.struct("start", "slug"))).alias("fading"))
    x = weak.join(matched, ["year", "month"], "left").fillna(0, ["impacts", "recoveries"])
    known, structural = F.col("impacts") > 0, F.col("weak_months") >= 2
    fading = (F.col("recoveries") > 0) & ~known
    calm = F.col("yoy_pct").isNull() | (F.col("yoy_pct") >= ANOMALY_BELOW)
    kind = (F.when(fading, "recovery").when(calm, "normal").when(~known & structural, "structural").when(~known, "normal").when(structural, "mixed").otherwise("shock"))
    label = F.col("kind")
    return x.withColumn("kind", kind).select(
        "year", "month", "yoy_pct", "weak_months", "kind",
        F.when(label == "recovery", F.col("fading.slug")).when(label.isin("mixed", "shock"), F.col("impact.slug")).alias("event"),
        F.when(label == "recovery", F.col("fading.recovery_weight")).when(label == "structural", STRUCTURAL[0]).when(label == "mixed", MIXED[0]).when(label == "shock", F.col("impact.airport_weight")).otherwise(1.0).alias("airport_weight"),
        F.when(label == "recovery", F.col("fading.recovery_weight")).when(label == "structural", STRUCTURAL[1]).when(label == "mixed", MIXED[1]).when(label == "shock", F.col("impact.pricing_weight")).otherwise(1.0).alias("pricing_weight"),
        label.isin("structural", "mixed", "shock").alias("caution"))


@query(f"""WITH {EVENTS_SQL}, {YOY_SQL}, m AS (SELECT *, make_date(year, month, 1) AS a, last_day(make_date(year, month, 1)) AS b FROM weak),
p AS (SELECT year, month, slug, s, w_air, w_price, (s <= b AND e >= a) OR COALESCE(ss <= b AND se >= a, FALSE) AS hit FROM m JOIN events_dim ON (s <= b AND e >= a) OR (ss <= b AND se >= a) OR (e <= b AND re >= a)),
g AS (SELECT year, month, count(*) FILTER (WHERE hit) AS impacts, count(*) FILTER (WHERE NOT hit) AS recoveries, arg_min(slug, s) FILTER (WHERE hit) AS i_slug, arg_min(w_air, s) FILTER (WHERE hit) AS i_air,
  arg_min(w_price, s) FILTER (WHERE hit) AS i_price, arg_min(slug, s) FILTER (WHERE NOT hit) AS r_slug FROM p GROUP BY 1, 2),
k AS (SELECT m.year, m.month, yoy_pct, weak_months, i_slug, i_air, i_price, r_slug, CASE WHEN COALESCE(recoveries, 0) > 0 AND COALESCE(impacts, 0) = 0 THEN 'recovery' WHEN yoy_pct IS NULL OR yoy_pct >= -15 THEN 'normal'
  WHEN COALESCE(impacts, 0) = 0 AND weak_months >= 2 THEN 'structural' WHEN COALESCE(impacts, 0) = 0 THEN 'normal' WHEN weak_months >= 2 THEN 'mixed' ELSE 'shock' END AS kind FROM m LEFT JOIN g ON g.year = m.year AND g.month = m.month)
SELECT year, month, yoy_pct, weak_months, kind, CASE WHEN kind = 'recovery' THEN r_slug WHEN kind IN ('mixed', 'shock') THEN i_slug END AS event,
  CAST(CASE kind WHEN 'recovery' THEN 0.7 WHEN 'structural' THEN 0.8 WHEN 'mixed' THEN 0.7 WHEN 'shock' THEN i_air ELSE 1 END AS DOUBLE) AS airport_weight,
  CAST(CASE kind WHEN 'recovery' THEN 0.7 WHEN 'structural' THEN 0.85 WHEN 'mixed' THEN 0.75 WHEN 'shock' THEN i_price ELSE 1 END AS DOUBLE) AS pricing_weight, kind IN ('structural', 'mixed', 'shock') AS caution FROM k""")
def anomaly_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(latest.year_over_year(monthly(spark, folder).select("year", "month", "orders"), "orders"), events(spark))


def estimate(series: DataFrame, targets: DataFrame) -> DataFrame:
    """Projection of open months (year, month, days_elapsed): run rate of the month before and last year's pace in equal parts.

    The projection is scaled to the full month and by the month's traffic factor within 15 %; months that
    are published come back as they are.
    """
    first = F.make_date("year", "month", F.lit(1))
    days = dates.days_in_month(first).cast("double")
    known = series.select("year", "month", "value")
    t = targets.withColumn("index", dates.month_index(F.col("year"), F.col("month"))).withColumn("days", days)
    official = known.withColumnRenamed("value", "official")
    last_year = known.select((F.col("year") + 1).alias("year"), "month", F.col("value").alias("last_year"), dates.days_in_month(F.make_date("year", "month", F.lit(1))).alias("ly_days"))
    before = known.select(dates.month_index(F.col("year"), F.col("month")).alias("p_index"), F.col("value").alias("prior"), dates.days_in_month(F.make_date("year", "month", F.lit(1))).alias("p_days"))
    prior = t.select("index").distinct().join(before, F.col("p_index") < F.col("index")).groupBy("index").agg(F.max_by(F.struct("prior", "p_days"), "p_index").alias("p")).select("index", "p.prior", "p.p_days")
    x = t.join(official, ["year", "month"], "left").join(last_year, ["year", "month"], "left").join(prior, "index", "left").filter("official IS NOT NULL OR prior IS NOT NULL OR last_year IS NOT NULL")
    rate, pace = F.col("prior") / F.col("p_days") * F.col("days_elapsed"), F.col("last_year") / F.col("ly_days") * F.col("days_elapsed")
    blend = F.when(rate.isNotNull() & pace.isNotNull(), 0.5 * rate + 0.5 * pace).otherwise(F.coalesce(rate, pace))
    swing = clamp(month_factor(F.col("month"), TRAFFIC_FACTORS), 1 - MAX_SWING, 1 + MAX_SWING)
    projected = F.coalesce(F.col("official").cast("long"), half_up(blend / (F.col("days_elapsed") / F.col("days")) * swing))
    return x.withColumn("projected", projected).select(
        "year", "month", F.coalesce(F.col("official").cast("long"), half_up(blend)).alias("to_date"), "projected",
        F.when(F.col("official").isNotNull(), "official").otherwise("estimated").alias("status"),
        F.when(F.col("official").isNotNull() | (F.col("days_elapsed") > 20), "high").when(F.col("days_elapsed") > 7, "medium").otherwise("low").alias("confidence"),
        half_up(pct_change(F.col("projected"), F.col("last_year")), 4).alias("vs_last_year"),
        F.when(F.col("official").isNull(), half_up(pct_change(F.col("projected"), F.col("prior")), 4)).alias("vs_prior"))


TRAFFIC_SQL = "list_extract([" + ", ".join(f"CAST({x} AS DOUBLE)" for x in TRAFFIC_FACTORS) + "], t.month)"


@query(f"""WITH {MONTHLY}, t(year, month, el) AS (VALUES (2001, 7, 31), (2001, 8, 5), (2001, 9, 12), (2001, 10, 25)),
x AS (SELECT t.year, t.month, el, day(last_day(make_date(t.year, t.month, 1)))::DOUBLE AS days, o.orders AS official, l.orders AS ly, day(last_day(make_date(t.year - 1, t.month, 1))) AS ly_days,
  (SELECT max_by(orders, year * 12 + month) FROM monthly m WHERE m.year * 12 + m.month < t.year * 12 + t.month) AS prior,
  (SELECT max_by(day(last_day(make_date(year, month, 1))), year * 12 + month) FROM monthly m WHERE m.year * 12 + m.month < t.year * 12 + t.month) AS p_days, greatest(0.85, least(1.15, {TRAFFIC_SQL})) AS swing
  FROM t LEFT JOIN monthly o ON o.year = t.year AND o.month = t.month LEFT JOIN monthly l ON l.year = t.year - 1 AND l.month = t.month),
b AS (SELECT *, CASE WHEN ly IS NULL THEN prior::DOUBLE / p_days * el ELSE 0.5 * (prior::DOUBLE / p_days * el) + 0.5 * (ly::DOUBLE / ly_days * el) END AS blend FROM x),
p AS (SELECT *, COALESCE(official, CAST(floor(blend / (el / days) * swing + 0.5) AS BIGINT)) AS projected FROM b)
SELECT year, month, COALESCE(official, CAST(floor(blend + 0.5) AS BIGINT)) AS to_date, projected, CASE WHEN official IS NOT NULL THEN 'official' ELSE 'estimated' END AS status,
  CASE WHEN official IS NOT NULL OR el > 20 THEN 'high' WHEN el > 7 THEN 'medium' ELSE 'low' END AS confidence, floor((projected - ly)::DOUBLE / ly * 100 * 10000 + 0.5) / 10000 AS vs_last_year,
  CASE WHEN official IS NULL THEN floor((projected - prior)::DOUBLE / prior * 100 * 10000 + 0.5) / 10000 END AS vs_prior FROM p""")
def airport_estimate(spark: SparkSession, folder: str) -> DataFrame:
    targets = spark.createDataFrame([(2001, 7, 31), (2001, 8, 5), (2001, 9, 12), (2001, 10, 25)], "year int, month int, days_elapsed int")
    return estimate(monthly(spark, folder).select("year", "month", F.col("orders").alias("value")), targets)


@query(f"""WITH {QUOTES}, d AS (SELECT listing_id, count(*) AS n, min(seen_at) AS a, max(seen_at) AS b FROM quotes WHERE seen_at >= TIMESTAMP '2024-01-16' GROUP BY 1),
o AS (SELECT listing_id, count(*) AS n, min(seen_at) AS a, max(seen_at) AS b FROM quotes WHERE seen_at < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT COALESCE(o.listing_id, d.listing_id) AS listing_id, COALESCE(o.n, 0) + COALESCE(d.n, 0) AS seen_count, least(COALESCE(o.a, d.a), COALESCE(d.a, o.a)) AS first_seen_at, greatest(COALESCE(o.b, d.b), COALESCE(d.b, o.b)) AS last_seen_at
FROM o FULL JOIN d ON o.listing_id = d.listing_id""", stamps=["first_seen_at", "last_seen_at"])
def upsert_seen_count(spark: SparkSession, folder: str) -> DataFrame:
    q = quotes(spark, folder)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old = q.filter(F.col("seen_at") < cut).groupBy("listing_id").agg(F.count("*").alias("seen_count"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))
    return upserts.seen_again(old, q.filter(F.col("seen_at") >= cut), ["listing_id"], "seen_at")


SPLIT_SQL = f"""{CALENDAR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY listing_id, day, batch % 2 ORDER BY batch DESC, line DESC) AS k FROM calendar),
olds AS (SELECT * FROM ranked WHERE batch % 2 = 0 AND k = 1), news AS (SELECT *, CASE WHEN available THEN price_cents END AS p FROM ranked WHERE batch % 2 = 1 AND k = 1)"""


def _old_new(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    days = calendar(spark, folder)
    order = [F.desc("batch"), F.desc("line")]
    return (latest.first_per_key(days.filter("batch % 2 = 0"), ["listing_id", "day"], order), latest.first_per_key(days.filter("batch % 2 = 1"), ["listing_id", "day"], order))


@query(f"""WITH {SPLIT_SQL} SELECT COALESCE(n.listing_id, o.listing_id) AS listing_id, COALESCE(n.day, o.day) AS day, CASE WHEN n.day IS NOT NULL THEN n.price_cents ELSE o.price_cents END AS price_cents,
  CASE WHEN n.day IS NOT NULL THEN n.batch ELSE o.batch END AS batch FROM olds o FULL JOIN news n ON n.listing_id = o.listing_id AND n.day = o.day""", dates=["day"])
def upsert_lww(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return upserts.last_write_wins(old, new, ["listing_id", "day"], [F.desc("batch"), F.desc("line")]).select("listing_id", "day", "price_cents", "batch")


@query(f"""WITH {SPLIT_SQL} SELECT COALESCE(n.listing_id, o.listing_id) AS listing_id, COALESCE(n.day, o.day) AS day, COALESCE(n.p, o.price_cents) AS price_cents, CASE WHEN n.day IS NOT NULL THEN n.available ELSE o.available END AS available
FROM olds o FULL JOIN news n ON n.listing_id = o.listing_id AND n.day = o.day""", dates=["day"])
def upsert_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """Prices are only filled, other fields overwritten."""
    old, new = _old_new(spark, folder)
    new = new.withColumn("price_cents", F.when(F.col("available"), F.col("price_cents")))
    return upserts.merged(old, new, ["listing_id", "day"], {"price_cents": "fill", "available": "overwrite"})


@query(f"""WITH {SPLIT_SQL} SELECT COALESCE(n.listing_id, o.listing_id) AS listing_id, COALESCE(n.day, o.day) AS day, greatest(o.price_cents, n.price_cents) AS price_cents, COALESCE(o.platform, n.platform) AS platform
FROM olds o FULL JOIN news n ON n.listing_id = o.listing_id AND n.day = o.day""", dates=["day"])
def upsert_greatest(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return upserts.merged(old, new, ["listing_id", "day"], {"price_cents": "greatest", "platform": "keep"})


@query(f"""WITH {SPLIT_SQL} SELECT n.listing_id, n.day, n.price_cents FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.listing_id = n.listing_id AND o.day = n.day)""", dates=["day"])
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return upserts.insert_if_absent(old, new, ["listing_id", "day"]).select("listing_id", "day", "price_cents")


@query(f"""WITH {MONTHLY}, o AS (SELECT year + 1 AS year, month, orders AS total, CASE WHEN month % 3 = 0 THEN orders // 2 END AS a, CASE WHEN month % 3 = 0 THEN orders - orders // 2 END AS b FROM monthly),
n AS (SELECT year, month, CASE WHEN month = 5 THEN orders // 2 ELSE orders END AS total, CASE WHEN month % 2 = 0 THEN orders // 3 END AS a, CASE WHEN month % 2 = 0 THEN (CASE WHEN month = 4 THEN orders ELSE orders - orders // 3 END) END AS b FROM monthly)
SELECT n.year, n.month, o.total AS old_total, n.total AS new_total, CASE WHEN n.a IS NOT NULL AND n.b IS NOT NULL AND abs(n.a + n.b - n.total) > 0.1 * n.total THEN 'rejected_parts' WHEN o.total IS NULL THEN 'insert'
  WHEN o.total > 50 AND n.total < o.total * 0.65 THEN 'rejected_drop' WHEN o.a IS NOT NULL AND o.b IS NOT NULL AND NOT (n.a IS NOT NULL AND n.b IS NOT NULL) THEN 'kept_detail' ELSE 'update' END AS decision
FROM n LEFT JOIN o ON o.year = n.year AND o.month = n.month""")
def upsert_guarded(spark: SparkSession, folder: str) -> DataFrame:
    m = monthly(spark, folder).select("year", "month", "orders")
    x, third, even = F.col("orders"), F.col("month") % 3 == 0, F.col("month") % 2 == 0
    half = F.floor(x / 2)
    old = m.select((F.col("year") + 1).alias("year"), "month", x.alias("total"), F.when(third, half).alias("a"), F.when(third, x - half).alias("b"))
    new = m.select("year", "month", F.when(F.col("month") == 5, half).otherwise(x).alias("total"), F.when(even, F.floor(x / 3)).alias("a"),
                   F.when(even, F.when(F.col("month") == 4, x).otherwise(x - F.floor(x / 3))).alias("b"))
    return upserts.guarded(old, new, ["year", "month"], "total", ["a", "b"], large=50.0)
