"""What surrounds comparables: the first scoring version, drivers and reasons, fees, seasonal sweep, positioning, stay prices, forward demand."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions import dates, numbers
from staylens.functions.numbers import half_up
from staylens.operators import matches, stats
from staylens.operators.latest import first_per_key
from staylens.plans import comps
from staylens.plans.offers import STALE_DAYS, FLAT_BELOW, band, lead_bucket
from staylens.plans.registry import query
from staylens.plans.series import MONTH_FACTORS, month_factor
from staylens.plans.standins import AS_OF, CALENDAR, LISTINGS, calendar, listings
from staylens.sources.tables import table

#: fixed values: weights of the first scoring version, what a missing size or rating adds to others, and its scales
V1_WEIGHTS = {"beach": 25, "sqft": 20, "bath": 15, "amenities": 25, "rating": 15}
V1_NO_SQFT, V1_NO_RATING = {"beach": 12, "bath": 8}, {"beach": 8, "amenities": 7}
V1_BEACH_SCALE, V1_SQFT_SCALE, V1_PRICE_BAR, V1_CONFIDENCE = 400.0, 0.75, 1_000, 0.85
#: fixed values: labels of the score's parts in their order
DRIVERS = [("beach", "beach_distance"), ("amenities", "amenities"), ("sqft", "sqft"), ("bath", "bathrooms"), ("rating", "rating"), ("beach_tier", "beach_tier"), ("price_tier", "price_tier"), ("building", "building")]
#: fixed values: months that stand for the seasons of the sweep
SWEEP = {"low": 9, "shoulder": 10, "high": 11, "peak": 3}
#: fixed values: labels of neighbourhoods that forward demand knows
HOOD_LABELS = {"zona romantica": "Zona Romantica", "zona romántica": "Zona Romantica", "old town": "Old Town", "amapas": "Amapas", "conchas chinas / amapas": "Amapas", "marina vallarta": "Marina Vallarta", "centro": "Centro"}
#: fixed values: service and tax rates of quotes made from a listing's own rate
SERVICE_RATE, TAX_RATE = 0.10, 0.19


# ---- the first version of comparables

def eligible_v1(df: DataFrame) -> DataFrame:
    """Listings of the two calibrated neighbourhoods that the first version compares (id, hood, bedrooms, price, beach_m, sqft, confidence)."""
    return df.filter(F.col("hood").isin("Zona Romantica", "Amapas") & F.col("bedrooms").between(1, 4) & (F.col("price") > 0) & (F.col("price") <= V1_PRICE_BAR) & F.col("beach_m").isNotNull()
                     & (F.col("sqft").isNull() | (F.col("sqft") >= 200)) & (F.col("confidence") >= V1_CONFIDENCE))


def _read(t: pa.Table, c: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, matches.Candidates]]:
    far = lambda x: matches.floats(c[x], np.inf)
    rating, sqft = matches.floats(t["t_rating"]), matches.floats(t["t_sqft"])
    mine = {"bathrooms": matches.floats(t["t_bathrooms"]), "bedrooms": matches.floats(t["t_bedrooms"]), "no_sqft": t["t_sqft"].is_null().to_numpy(), "no_rating": t["t_rating"].is_null().to_numpy() | (rating <= 0)}
    for k, scale in (("beach_m", np.full(len(t), V1_BEACH_SCALE)), ("sqft", sqft * V1_SQFT_SCALE), ("rating", np.full(len(t), 3.0))):
        mine[k], mine[f"{k}_scale"] = matches.near_to(t[f"t_{k}"], scale)
    theirs = {"bathrooms": matches.floats(c["bathrooms"]), "bedrooms": matches.floats(c["bedrooms"]), "no_sqft": c["sqft"].is_null().to_numpy(), "beach_m": far("beach_m"), "sqft": far("sqft"), "rating": far("rating")}
    return mine, {k: matches.Candidates(v) for k, v in theirs.items()}


def _raw(t: dict[str, np.ndarray], c: dict[str, matches.Candidates], overlap: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Likeness of all pairs, rounded to 0 to 100 later; the weight of size is shared out where either side lacks it."""
    own = lambda k, no_sqft: V1_WEIGHTS[k] + np.where(no_sqft, float(V1_NO_SQFT.get(k, 0)), 0.0) + np.where(t["no_rating"], float(V1_NO_RATING.get(k, 0)), 0.0)
    weight = lambda k: c["no_sqft"].spread(lambda x: own(k, x | t["no_sqft"]))
    near = lambda k, w: c[k].spread(lambda x: matches.nearness(x, t[k], t[f"{k}_scale"], w))
    raw = near("beach_m", 1.0) * weight("beach")
    raw += near("sqft", float(V1_WEIGHTS["sqft"]))
    raw += c["bathrooms"].spread(lambda x: matches.bath_score(x, t["bathrooms"], 1.0)) * weight("bath")
    raw += overlap(own("amenities", False))
    raw += near("rating", np.where(t["no_rating"], 0.0, float(V1_WEIGHTS["rating"])))
    raw -= c["bedrooms"].spread(lambda x: np.where(x != t["bedrooms"], 12.0, 0.0))
    return raw


def comparables_v1(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """Ten best of the target's hood and bedrooms, one bedroom more or less where fewer than three are there (t_id, step, id, price, score, rank).

    Only pairs that can be among the ten best leave the task that scored them.
    """
    flags = {k: (F.col("far") == 0) & (F.abs(F.col("bedrooms") - F.col("t_bedrooms")) <= k - 1) for k in (1, 2)}
    nowhere = pool.select("hood", F.col("hood").alias("near")).limit(0)
    found = comps.pool_best(targets, pool, nowhere, flags, lambda n: F.when(n[1] >= 3, 1).otherwise(2), matches.Scorer(_read, _raw), ["t_id", "step"], ["id", "price"])
    scored = found.select("t_id", "step", "id", "price", comps.to_score(F.col("raw")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= 10)


_V1 = "SELECT *, price_cents / 200.0::DOUBLE AS price FROM listings WHERE hood IN ('Zona Romantica', 'Amapas') AND bedrooms BETWEEN 1 AND 4 AND price_cents > 0 AND price_cents / 200.0::DOUBLE <= 1000 AND (sqft IS NULL OR sqft >= 200) AND confidence >= 0.85"
_NS, _NR = "(t.sqft IS NULL OR c.sqft IS NULL)", "(t.rating IS NULL)"
_SCORE_V1 = f"""greatest(0, least(1, 1 - abs(c.beach_m - t.beach_m) / 400.0::DOUBLE)) * (25 + CASE WHEN {_NS} THEN 12 ELSE 0 END + CASE WHEN {_NR} THEN 8 ELSE 0 END)
  + CASE WHEN {_NS} THEN 0 ELSE greatest(0, least(1, 1 - abs(c.sqft - t.sqft) / (t.sqft * 0.75::DOUBLE))) * 20 END
  + CASE WHEN abs(c.bathrooms - t.bathrooms) = 0 THEN 1.0 WHEN abs(c.bathrooms - t.bathrooms) <= 0.5 THEN 0.67 WHEN abs(c.bathrooms - t.bathrooms) <= 1 THEN 0.33 ELSE 0 END * (15 + CASE WHEN {_NS} THEN 8 ELSE 0 END)
  + len(list_intersect(c.amenities, t.amenities))::DOUBLE / len(list_distinct(list_concat(c.amenities, t.amenities))) * (25 + CASE WHEN {_NR} THEN 7 ELSE 0 END)
  + CASE WHEN {_NR} OR c.rating IS NULL THEN 0 ELSE greatest(0, least(1, 1 - abs(c.rating - t.rating) / 3.0::DOUBLE)) * 15 END - CASE WHEN c.bedrooms <> t.bedrooms THEN 12 ELSE 0 END"""


@query(f"""WITH {LISTINGS}, v AS ({_V1}), p AS (SELECT t.id AS t_id, c.id AS id, abs(c.bedrooms - t.bedrooms) AS gap, c.price AS price, floor((greatest(0, least(100, {_SCORE_V1})) + 1e-9) * 10 + 0.5) / 10 AS score FROM v t JOIN v c ON c.hood = t.hood AND c.id <> t.id),
n AS (SELECT *, count(*) FILTER (WHERE gap = 0) OVER (PARTITION BY t_id) AS n1 FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, id) AS r FROM n WHERE gap <= CASE WHEN n1 >= 3 THEN 0 ELSE 1 END)
SELECT t_id, count(*) AS n_comps, max(score) AS best, CASE WHEN max(n1) >= 3 THEN 1 ELSE 2 END AS step, """ + ", ".join(f"CAST(floor(floor(quantile_cont(price, {p}) * 1000000 + 0.5) / 1000000 + 0.5) AS BIGINT) AS {n}" for p, n in ((0.25, "conservative"), (0.5, "recommended"), (0.75, "stretch"))) + " FROM k WHERE r <= 10 GROUP BY t_id")
def comps_v1(spark: SparkSession, folder: str) -> DataFrame:
    """First version of comparable pricing for every listing it covers."""
    pool = eligible_v1(listings(spark, folder).withColumn("price", F.col("price_cents") / 200.0)).withColumn("tier", F.lit("-"))
    return comparables_v1(pool, pool).groupBy("t_id").agg(
        F.count("*").alias("n_comps"), F.max("score").alias("best"), F.max("step").alias("step"),
        *[half_up(stats.linear_percentile("price", p)).alias(n) for p, n in ((0.25, "conservative"), (0.5, "recommended"), (0.75, "stretch"))])


# ---- drivers, reasons, fees, sweep, positioning

def top_drivers(n: int = 3) -> Column:
    """Labels of the parts (x_ columns) that gave most, positive ones only, ties in the parts' order."""
    parts = F.array(*[F.struct((-half_up(F.col(f"x_{k}") + 1e-9, 1)).alias("s"), F.lit(i).alias("p"), F.lit(label).alias("l")) for i, (k, label) in enumerate(DRIVERS)])
    return F.transform(F.slice(F.array_sort(F.filter(parts, lambda x: x["s"] < 0)), 1, n), lambda x: x["l"])


def plain_number(x: Column) -> Column:
    """A number as text without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def match_reasons() -> Column:
    """Why a comparable (t_ columns for the target) was chosen, as an array of sentences."""
    # fixed values: the sentences and their bounds of size and distance
    c = F.col
    size_gap, beach_gap = F.abs(c("sqft") - c("t_sqft")) / c("t_sqft"), F.abs(c("beach_m") - c("t_beach_m"))
    sizes = F.concat(F.lit(" ("), plain_number(c("sqft")), F.lit(" vs "), plain_number(c("t_sqft")), F.lit(" ft²)"))
    found = [
        F.when(c("hood") == c("t_hood"), F.concat(F.lit("Same neighborhood: "), c("hood"))).otherwise(F.concat(F.lit("Adjacent neighborhood: "), c("hood"), F.lit(" ("), c("t_hood"), F.lit(" pool too thin)"))),
        F.concat(F.lit("Same bedrooms: "), c("bedrooms").cast("string"), F.lit("BR")),
        F.when(c("x_building") > 0, F.concat(F.lit("Same building: "), c("building"))),
        F.when(c("tier") == c("t_tier"), F.concat(F.lit("Same beach tier: "), c("tier"), F.lit(" ("), plain_number(c("beach_m")), F.lit("m)"))),
        F.when(size_gap <= 0.10, F.concat(F.lit("Very similar size"), sizes)).when(size_gap <= 0.25, F.concat(F.lit("Similar size"), sizes)),
        F.when(c("bathrooms") == c("t_bathrooms"), F.concat(F.lit("Same bathrooms: "), plain_number(c("bathrooms")), F.lit("BA"))),
        F.when(beach_gap <= 50, F.concat(F.lit("Very close beach distance ("), plain_number(c("beach_m")), F.lit("m)"))),
        F.when(c("x_price_tier") >= 5, F.concat(F.lit("Same price tier: "), c("price_tier"))),
        F.when(c("bedrooms") != c("t_bedrooms"), F.concat(F.lit("⚠ Expanded pool: "), c("bedrooms").cast("string"), F.lit("BR (target: "), c("t_bedrooms").cast("string"), F.lit("BR)"))),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


_DRIVERS_SQL = "list_sort(list_filter([" + ", ".join(f"{{'s': -floor((x_{k} + 1e-9) * 10 + 0.5) / 10, 'p': {i}, 'l': '{label}'}}" for i, (k, label) in enumerate(DRIVERS)) + "], lambda x: x.s < 0))[1:3]"
_NUM_SQL = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
_SIZES_SQL = f"' (' || {_NUM_SQL.format('c.sqft')} || ' vs ' || {_NUM_SQL.format('t.sqft')} || ' ft²)'"
_REASONS_SQL = f"""[CASE WHEN c.hood = t.hood THEN 'Same neighborhood: ' || c.hood ELSE 'Adjacent neighborhood: ' || c.hood || ' (' || t.hood || ' pool too thin)' END, 'Same bedrooms: ' || c.bedrooms || 'BR',
  CASE WHEN x_building > 0 THEN 'Same building: ' || c.building END, CASE WHEN c.tier = t.tier THEN 'Same beach tier: ' || c.tier || ' (' || {_NUM_SQL.format('c.beach_m')} || 'm)' END,
  CASE WHEN abs(c.sqft - t.sqft) / t.sqft <= 0.10::DOUBLE THEN 'Very similar size' || {_SIZES_SQL} WHEN abs(c.sqft - t.sqft) / t.sqft <= 0.25::DOUBLE THEN 'Similar size' || {_SIZES_SQL} END,
  CASE WHEN c.bathrooms = t.bathrooms THEN 'Same bathrooms: ' || {_NUM_SQL.format('c.bathrooms')} || 'BA' END, CASE WHEN abs(c.beach_m - t.beach_m) <= 50 THEN 'Very close beach distance (' || {_NUM_SQL.format('c.beach_m')} || 'm)' END,
  CASE WHEN x_price_tier >= 5 THEN 'Same price tier: ' || CASE pt WHEN 1 THEN 'lower' WHEN 2 THEN 'middle' ELSE 'upper' END END, CASE WHEN c.bedrooms <> t.bedrooms THEN '⚠ Expanded pool: ' || c.bedrooms || 'BR (target: ' || t.bedrooms || 'BR)' END]"""


def _comparables(spark: SparkSession, folder: str) -> DataFrame:
    return comps.comparables(*comps._targets(spark, folder))


@query(f"""WITH {comps.SCORED_SQL} SELECT t_id, rank, best.id, array_to_string(list_transform({_DRIVERS_SQL}, lambda x: x.l), ',') AS top_drivers, array_to_string(list_filter({_REASONS_SQL}, lambda x: x IS NOT NULL), ' | ') AS match_reasons
FROM best JOIN pool t ON t.id = t_id JOIN pool c ON c.id = best.id""")
def comps_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing's comparables with their three strongest drivers and the reasons of the match."""
    return _comparables(spark, folder).select("t_id", "rank", "id", F.array_join(top_drivers(), ",").alias("top_drivers"), F.array_join(match_reasons(), " | ").alias("match_reasons"))


@query(f"""WITH {comps.SCORED_SQL}, d AS (SELECT t_id, unnest({_DRIVERS_SQL}) AS x FROM best), n AS (SELECT t_id, x.l AS label, x.p AS p, count(*) AS n FROM d GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY n DESC, p) AS r FROM n)
SELECT t_id, string_agg(label, ',' ORDER BY r) AS drivers FROM r WHERE r <= 4 GROUP BY t_id""")
def comps_overall_drivers(spark: SparkSession, folder: str) -> DataFrame:
    """The four labels that most of a listing's comparables share among their drivers."""
    labels = F.array(*[F.lit(label) for _, label in DRIVERS])
    counted = _comparables(spark, folder).select("t_id", F.explode(top_drivers()).alias("label")).groupBy("t_id", "label").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc("n"), F.array_position(labels, F.col("label"))))).filter("r <= 4")
    return ranked.groupBy("t_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), ",").alias("drivers"))


def fees_a_night(spark: SparkSession, folder: str) -> DataFrame:
    """Cents that the newest full quote of a listing adds a night to its rate; negative ones are no fees."""
    c = F.col
    rows = table(spark, folder, "lineitem", ["l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"])
    fee = F.floor(c("l_extendedprice") * (1 + c("l_tax")) * 100 + 0.5) / c("l_quantity") - F.floor(c("l_extendedprice") / c("l_quantity") * 100 + 0.5)
    newest = first_per_key(rows, ["l_partkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")])
    return newest.select(c("l_partkey").alias("id"), fee.alias("fee")).filter("fee >= 0")


_FEES_SQL = """fees AS (SELECT id, fee FROM (SELECT l_partkey AS id, floor(l_extendedprice * (1 + l_tax) * 100 + 0.5) / l_quantity - floor(l_extendedprice / l_quantity * 100 + 0.5) AS fee, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1 AND fee >= 0),
med_fee AS (SELECT t_id, floor(median(fee) * 10000 + 0.5) / 1000000 AS fee, count(*) AS n_fees FROM best JOIN fees ON fees.id = best.id GROUP BY 1)"""


def sweep(base: Column, fee: Column) -> dict[str, Column]:
    """Price of each season on a base without season, and all in where fees are known."""
    out = {}
    for name, month in SWEEP.items():
        price = half_up(base * MONTH_FACTORS[month - 1])
        out |= {name: price, f"{name}_all_in": half_up(price + fee)}
    return out


_JUNE = MONTH_FACTORS[5]


@query(f"""WITH {comps.RECOMMENDED_SQL}, {_FEES_SQL}, x AS (SELECT rec.t_id, recommended, n_fees, fee, recommended / {_JUNE}::DOUBLE AS base FROM rec LEFT JOIN med_fee ON med_fee.t_id = rec.t_id),
y AS (SELECT *, {", ".join(f"CAST(floor(base * {MONTH_FACTORS[m - 1]}::DOUBLE + 0.5) AS BIGINT) AS {n}" for n, m in SWEEP.items())} FROM x)
SELECT t_id, COALESCE(n_fees, 0) AS n_fees, fee, CAST(floor(recommended + fee + 0.5) AS BIGINT) AS all_in, {", ".join(f"{n}, CAST(floor({n} + fee + 0.5) AS BIGINT) AS {n}_all_in" for n in SWEEP)} FROM y""")
def comps_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Median fees of the comparables, the recommendation all in, and a sweep over the seasons from June's."""
    targets, df, near = comps._targets(spark, folder)
    best = comps.comparables(targets, df, near, fees_a_night(spark, folder))
    x = comps.recommend(best, comps.buildings(df, comps.segments(df)), fee=half_up(F.median("fee") * 10_000).cast("double"), n_fees=F.count("fee")).withColumn("fee", F.col("fee") / 1_000_000)
    return x.select("t_id", "n_fees", "fee", half_up(F.col("recommended") + F.col("fee")).alias("all_in"), *[v.alias(k) for k, v in sweep(F.col("recommended") / _JUNE, F.col("fee")).items()])


def positioning(price: Column, median: Column, high: float, low: float = 0.92) -> Column:
    """premium, aligned or underpriced against a median; null without one."""
    share = numbers.ratio(price, median)
    return F.when(share > high, "premium").when(share < low, "underpriced").when(share.isNotNull(), "aligned")


def _position_sql(median: str, high: float) -> str:
    return f"CASE WHEN recommended / {median}::DOUBLE > {high}::DOUBLE THEN 'premium' WHEN recommended / {median}::DOUBLE < 0.92::DOUBLE THEN 'underpriced' WHEN {median} IS NOT NULL THEN 'aligned' END"


@query(f"""WITH {comps.RECOMMENDED_SQL} SELECT t_id, {_position_sql('bs.median', 1.08)} AS in_building, {_position_sql(f'floor(seg.p50 * {_JUNE}::DOUBLE + 0.5)', 1.12)} AS in_segment FROM rec
LEFT JOIN bs ON bs.building = t_building AND bs.hood = t_hood AND bs.bedrooms = t_bedrooms LEFT JOIN seg ON seg.hood = t_hood AND seg.bedrooms = t_bedrooms""")
def comps_positioning(spark: SparkSession, folder: str) -> DataFrame:
    """Where each recommendation stands against its building and against the segment in season."""
    targets, df, near = comps._targets(spark, folder)
    seg = comps.segments(df)
    summaries = comps.buildings(df, seg)
    rec = comps.recommend(comps.comparables(targets, df, near), summaries).select(F.col("t_id").alias("id"), "recommended").join(df.select("id", "hood", "building", "bedrooms").hint("merge"), "id")
    x = rec.join(summaries.select("building", "hood", "bedrooms", "median"), ["building", "hood", "bedrooms"], "left").join(seg.select("hood", "bedrooms", "p50"), ["hood", "bedrooms"], "left")
    return x.select(F.col("id").alias("t_id"), positioning(F.col("recommended"), F.col("median"), 1.08).alias("in_building"), positioning(F.col("recommended"), half_up(F.col("p50") * _JUNE), 1.12).alias("in_segment"))


# ---- availability of a month, rate brackets, quotes from a rate, price sources

@query(f"""WITH {CALENDAR}, d AS (SELECT listing_id, count(*) AS total_days, count(*) FILTER (WHERE available) AS available_days FROM calendar WHERE day >= DATE '1998-06-01' AND day < DATE '1998-07-01' GROUP BY 1)
SELECT listing_id, total_days, available_days, available_days = 0 AS blocked FROM d""")
def month_availability(spark: SparkSession, folder: str) -> DataFrame:
    """Days and open days of each listing in a month; blocked are those known to have none, which are not those without data."""
    days = calendar(spark, folder).filter((F.col("day") >= F.lit("1998-06-01").cast("date")) & (F.col("day") < F.lit("1998-07-01").cast("date")))
    return days.groupBy("listing_id").agg(F.count("*").alias("total_days"), F.count_if(F.col("available")).alias("available_days"), (F.count_if(F.col("available")) == 0).alias("blocked"))


@query(f"""WITH {comps.POOL_SQL}, {CALENDAR}, b AS (SELECT listing_id FROM calendar WHERE day >= DATE '1998-06-01' AND day < DATE '1998-07-01' GROUP BY 1 HAVING count(*) FILTER (WHERE available) = 0)
SELECT hood, count(*) AS n_open, floor(quantile_cont(price, 0.5) * 1000000 + 0.5) / 1000000 AS p50 FROM pool WHERE id NOT IN (SELECT listing_id FROM b) GROUP BY hood""")
def pool_without_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Pool of a month: listings known to be blocked all through it are left out, those without data stay."""
    blocked = month_availability(spark, folder).filter("blocked").select(F.col("listing_id").alias("id"))
    return comps.pool(spark, folder).join(blocked, "id", "left_anti").groupBy("hood").agg(F.count("*").alias("n_open"), stats.linear_percentile("price", 0.5).alias("p50"))


BRACKETS = [(1, "1998-06-10", "1998-06-20", 21_000, 3), (2, "1998-06-01", "1998-06-30", 15_000, 2), (3, "1998-06-25", "1998-07-31", 18_000, 2), (4, "1998-12-15", "1999-01-05", 40_000, 7)]
_BRACKETS_SQL = "br AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, DATE '{a}', DATE '{b}', {c}, {m})" for p, a, b, c, m in BRACKETS) + ") AS t(position, a, b, cents, min_nights))"


def first_bracket(day: Column, brackets: list[tuple]) -> Column:
    """The first bracket (position, start, stop, cents, min_nights) of a rate table that holds the day, null outside all."""
    listed = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("stop"), F.lit(c).cast("long").alias("cents"), F.lit(m).alias("min_nights"))
                       for p, a, b, c, m in sorted(brackets)])
    return F.get(F.filter(listed, lambda x: (day >= x["start"]) & (day <= x["stop"])), F.lit(0))


@query(f"""WITH {CALENDAR}, {_BRACKETS_SQL}, d AS (SELECT listing_id, batch, line, day, (SELECT min(position) FROM br WHERE day BETWEEN a AND b) AS position FROM calendar)
SELECT d.position, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(min_nights) AS min_nights FROM d LEFT JOIN br ON br.position = d.position GROUP BY 1""")
def rate_brackets(spark: SparkSession, folder: str) -> DataFrame:
    """Nights by the first rate bracket that holds them; nights outside all have none."""
    days = calendar(spark, folder).withColumn("bracket", first_bracket(F.col("day"), BRACKETS))
    return days.groupBy(F.col("bracket.position").alias("position")).agg(F.count("*").alias("n"), F.sum("bracket.cents").alias("cents"), F.max("bracket.min_nights").alias("min_nights"))


def quote_from_rate(nightly: Column, nights: Column, cleaning: Column) -> dict[str, Column]:
    """Quote in cents from a nightly rate: service 10 % of the nights, taxes 19 % of nights and cleaning."""
    subtotal = nightly * nights
    service, taxes = half_up(subtotal * SERVICE_RATE), half_up((subtotal + cleaning) * TAX_RATE)
    return {"subtotal": subtotal, "service": service, "taxes": taxes, "total": subtotal + cleaning + service + taxes}


@query(f"""WITH {LISTINGS}, s AS (SELECT id, unnest([2, 3, 7]) AS nights, price_cents, CASE WHEN id % 4 = 0 THEN 0 ELSE 5000 + id % 1000 END AS cleaning FROM listings), q AS (SELECT *, price_cents * nights AS subtotal FROM s)
SELECT id, nights, subtotal, CAST(floor(subtotal * 0.1::DOUBLE + 0.5) AS BIGINT) AS service, CAST(floor((subtotal + cleaning) * 0.19::DOUBLE + 0.5) AS BIGINT) AS taxes,
  subtotal + cleaning + CAST(floor(subtotal * 0.1::DOUBLE + 0.5) AS BIGINT) + CAST(floor((subtotal + cleaning) * 0.19::DOUBLE + 0.5) AS BIGINT) AS total FROM q""")
def quotes_from_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of three lengths of stay from every listing's own rate; some charge no cleaning."""
    stays = listings(spark, folder).select("id", "price_cents", F.explode(F.array(F.lit(2), F.lit(3), F.lit(7))).alias("nights"))
    cleaning = F.when(F.col("id") % 4 == 0, 0).otherwise(5_000 + F.col("id") % 1_000)
    return stays.select("id", "nights", *[v.alias(k) for k, v in quote_from_rate(F.col("price_cents"), F.col("nights"), cleaning).items()])


def daily_source(platform: Column) -> Column:
    """Tag of a platform's daily prices; platforms yet unknown count as real rates."""
    return F.when(platform == "airbnb", "airbnb_daily").otherwise("pvrpv_daily")


@query(f"""WITH {CALENDAR}, p AS (SELECT *, CASE WHEN platform = 'O' THEN 'airbnb' WHEN listing_id % 5 = 0 THEN NULL ELSE 'pvrpv' END AS name FROM calendar), a AS (SELECT name, listing_id, max(day) AS seen FROM p GROUP BY 1, 2),
s AS (SELECT CASE WHEN name = 'airbnb' THEN 'airbnb_daily' ELSE 'pvrpv_daily' END AS source, DATE '2001-12-31' - seen AS age FROM a)
SELECT source, count(*) AS n, count(*) FILTER (WHERE age > 60) AS stale_beyond_60d, count(*) FILTER (WHERE age <= 7) AS full_credit, floor(sum(age)::DOUBLE / count(*) * 10 + 0.5) / 10 AS avg_age FROM s GROUP BY source""")
def source_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Listings by the source of their daily prices: how many, how stale, mean age to one digit."""
    days = calendar(spark, folder).withColumn("name", F.when(F.col("platform") == "O", "airbnb").when(F.col("listing_id") % 5 != 0, "pvrpv"))
    seen = days.groupBy("name", "listing_id").agg(F.max("day").alias("seen")).withColumn("age", F.datediff(F.lit("2001-12-31").cast("date"), "seen"))
    return seen.groupBy(daily_source(F.col("name")).alias("source")).agg(
        F.count("*").alias("n"), F.count_if(F.col("age") > 60).alias("stale_beyond_60d"), F.count_if(F.col("age") <= 7).alias("full_credit"), half_up(numbers.ratio(F.sum("age"), F.count("*")), 1).alias("avg_age"))


# ---- forward demand

#: stand-in events of the first tier (name, first day, last day, neighbourhoods, calibration ratio, run of the calibration)
TIER_1 = [("parade", "1998-06-20", "1998-06-27", ["Zona Romantica", "Amapas"], 0.97, "1998-05-25"), ("regatta", "1998-06-10", "1998-06-14", ["Brand#3"], 1.05, "1998-05-25"), ("fair", "1998-07-20", "1998-07-25", ["Brand#4"], 0.9, "1998-05-10")]
_TIER_1_SQL = "ev AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', DATE '{a}', DATE '{b}', {h}, {r}::DOUBLE, DATE '{d}')" for k, (n, a, b, h, r, d) in enumerate(TIER_1)) + ") AS t(k, name, a, b, hoods, ratio, run_at))"


def suggested_action(bucket: Column, price: Column) -> Column:
    """What to do, as an array of sentences."""
    # fixed values: the sentences
    p = price.cast("string")
    say = lambda *parts: F.array(*parts)
    return (F.when(bucket == "early", say(F.concat(F.lit("Set $"), p, F.lit(" for this night")), F.lit("Re-check in 3 weeks — if comps start moving, you can raise")))
            .when(bucket == "mid", say(F.concat(F.lit("Set $"), p, F.lit(" to stay a step ahead of comps")), F.lit("Re-check in 2 weeks")))
            .when(bucket == "late", say(F.concat(F.lit("Hold around $"), p), F.lit("Re-check in one week"))).otherwise(say(F.concat(F.lit("Set $"), p, F.lit(" to prioritize getting booked")), F.lit("Re-check daily"))))


def forward_demand(stays: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Stays (id, hood, checkin, checkout, median) with nights, the first event they touch and the reason against a recommendation.

    ``events``: position, name, start, stop, hood (a row for each), ratio, run_at; a list of a few dozen.
    Qualifying nights lie in the event and not before ``as_of``.
    """
    nights = dates.nights(F.col("checkin"), F.col("checkout"))
    touched = (F.col("checkin") <= F.col("stop")) & (F.date_sub("checkout", 1) >= F.col("start")) & (F.col("checkout") > F.col("checkin"))
    met = stays.join(events, "hood").filter(touched)
    first = first_per_key(met, ["id"], [F.asc("position")]).select("id", "name", "start", "stop", "ratio", "run_at")
    known = events.select("hood").distinct().withColumn("known", F.lit(True))
    x = stays.join(known, "hood", "left").join(first, "id", "left").withColumn("nights", nights)
    reason = (F.when(F.col("known").isNull(), "hood_not_supported").when(F.col("name").isNull(), "no_tier1_event_in_range").when(F.datediff(as_of, "run_at") > STALE_DAYS, "snapshot_stale")
              .when(F.col("ratio").isNull(), "ratio_missing_for_hood").when(F.col("ratio") >= FLAT_BELOW, "ratio_above_threshold"))
    inside = F.filter("nights", lambda d: (d >= F.col("start")) & (d <= F.col("stop")) & (d >= as_of))
    return x.withColumn("reason", reason).withColumn("qualifying", F.when(F.col("reason").isNull(), inside).otherwise(F.array().cast("array<date>")))


def _stays(spark: SparkSession, folder: str) -> DataFrame:
    checkin = F.date_add(F.lit(AS_OF).cast("date"), (F.col("id") % 60 - 10).cast("int"))
    return listings(spark, folder).select("id", "hood", checkin.alias("checkin"), F.date_add(checkin, (1 + F.col("id") % 9).cast("int")).alias("checkout"), half_up(F.col("price_cents") / 100).alias("median"))


def _events(spark: SparkSession) -> DataFrame:
    rows = [(k, *e) for k, e in enumerate(TIER_1)]
    df = spark.createDataFrame(rows, "position int, name string, start string, stop string, hoods array<string>, ratio double, run_at string")
    return df.withColumns({c: F.to_date(c) for c in ("start", "stop", "run_at")}).withColumn("hood", F.explode("hoods")).drop("hoods")


_STAYS_SQL = f"""{_TIER_1_SQL}, st AS (SELECT id, hood, DATE '{AS_OF}' + CAST(id % 60 - 10 AS INTEGER) AS checkin, DATE '{AS_OF}' + CAST(id % 60 - 10 AS INTEGER) + CAST(1 + id % 9 AS INTEGER) AS checkout, CAST(floor(price_cents / 100.0::DOUBLE + 0.5) AS BIGINT) AS median FROM listings),
fe AS (SELECT st.id, min(k) AS k FROM st JOIN ev ON list_contains(hoods, hood) AND checkin <= b AND checkout - 1 >= a GROUP BY 1),
fd AS (SELECT st.*, ev.name, a, b, CASE WHEN hood NOT IN (SELECT unnest(hoods) FROM ev) THEN 'hood_not_supported' WHEN ev.name IS NULL THEN 'no_tier1_event_in_range' WHEN DATE '{AS_OF}' - run_at > 14 THEN 'snapshot_stale' WHEN ratio >= 1.03::DOUBLE THEN 'ratio_above_threshold' END AS reason
  FROM st LEFT JOIN fe ON fe.id = st.id LEFT JOIN ev ON ev.k = fe.k),
nt AS (SELECT id, median, CAST(unnest(generate_series(checkin, checkout - 1, INTERVAL 1 DAY)) AS DATE) AS night, a, b FROM fd WHERE reason IS NULL),
qn AS (SELECT *, night - DATE '{AS_OF}' AS lead_ FROM nt WHERE night BETWEEN a AND b AND night >= DATE '{AS_OF}')"""


@query(f"""WITH {LISTINGS}, {_STAYS_SQL} SELECT fd.id, reason, name AS event, CAST(checkout - checkin AS BIGINT) AS all_nights, (SELECT count(*) FROM qn WHERE qn.id = fd.id) AS qualifying FROM fd""")
def forward_demand_gates(spark: SparkSession, folder: str) -> DataFrame:
    """A stay for each listing: the event it touches, how many nights qualify, or the first reason against."""
    x = forward_demand(_stays(spark, folder), _events(spark), F.lit(AS_OF).cast("date"))
    return x.select("id", "reason", F.col("name").alias("event"), F.size("nights").cast("long").alias("all_nights"), F.size("qualifying").cast("long").alias("qualifying"))


@query(f"""WITH {LISTINGS}, {_STAYS_SQL}, bu AS (SELECT *, CASE WHEN lead_ >= 60 THEN 'early' WHEN lead_ >= 30 THEN 'mid' WHEN lead_ >= 15 THEN 'late' ELSE 'very_late' END AS bucket FROM qn),
lo AS (SELECT *, greatest(1, median + CASE bucket WHEN 'early' THEN 15 WHEN 'mid' THEN 10 WHEN 'late' THEN 0 ELSE -5 END) AS low, median + CASE bucket WHEN 'early' THEN 20 WHEN 'mid' THEN 15 WHEN 'late' THEN 10 ELSE 0 END AS h FROM bu),
ap AS (SELECT *, greatest(low, h) AS high, CAST(floor((low + greatest(low, h)) / 2.0::DOUBLE + 0.5) AS BIGINT) AS apply FROM lo)
SELECT id, strftime(night, '%Y-%m-%d') AS night, bucket, low, high, apply, CASE bucket WHEN 'early' THEN 'Set $' || apply || ' for this night | Re-check in 3 weeks — if comps start moving, you can raise' WHEN 'mid' THEN 'Set $' || apply || ' to stay a step ahead of comps | Re-check in 2 weeks'
  WHEN 'late' THEN 'Hold around $' || apply || ' | Re-check in one week' ELSE 'Set $' || apply || ' to prioritize getting booked | Re-check daily' END AS action FROM ap""")
def forward_demand_nights(spark: SparkSession, folder: str) -> DataFrame:
    """Band and suggested action of every qualifying night."""
    x = forward_demand(_stays(spark, folder), _events(spark), F.lit(AS_OF).cast("date")).select("id", "median", F.explode("qualifying").alias("night"))
    x = x.withColumn("bucket", lead_bucket(F.datediff("night", F.lit(AS_OF).cast("date"))))
    low, high, middle = band(F.col("bucket"), F.col("median"))
    return x.select("id", "night", "bucket", low.alias("low"), high.alias("high"), middle.alias("apply"), F.array_join(suggested_action(F.col("bucket"), middle), " | ").alias("action"))


RAW_HOODS = [" Zona Romántica ", "OLD TOWN", "amapas", "Conchas Chinas / Amapas", "Centro", "Versalles", "zona romantica"]


@query("""WITH r AS (SELECT lower(trim(list_extract([""" + ", ".join(f"'{x}'" for x in RAW_HOODS) + f"""], CAST(p_partkey % {len(RAW_HOODS)} AS INTEGER) + 1))) AS x FROM part), m(k, v) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in HOOD_LABELS.items()) + ") SELECT v AS hood, count(*) AS n FROM r LEFT JOIN m ON k = x GROUP BY v")
def hood_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Free labels of neighbourhoods, with and without accents, as the names that forward demand knows."""
    names = F.create_map(*[F.lit(x) for kv in HOOD_LABELS.items() for x in kv])
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW_HOODS]), (F.col("p_partkey") % len(RAW_HOODS) + 1).cast("int"))
    return table(spark, folder, "part", ["p_partkey"]).groupBy(F.try_element_at(names, F.lower(F.trim(raw))).alias("hood")).agg(F.count("*").alias("n"))


@query(f"""WITH {LISTINGS}, s AS (SELECT id, DATE '1998-01-01' + CAST(id % 365 AS INTEGER) AS day FROM listings), e AS (SELECT id, day, CASE WHEN day BETWEEN DATE '1998-06-03' AND DATE '1998-06-10' THEN 0.18 WHEN day BETWEEN DATE '1998-06-01' AND DATE '1998-06-12' THEN 0.09 END::DOUBLE AS premium FROM s)
SELECT id, {comps._month_factors_sql()}[CAST(month(day) AS INTEGER)]::DOUBLE AS month_only, floor({comps._month_factors_sql()}[CAST(month(day) AS INTEGER)]::DOUBLE * (1 + COALESCE(premium, 0)) * 1000000 + 0.5) / 1000000 AS date_aware FROM e""")
def seasonal_context(spark: SparkSession, folder: str) -> DataFrame:
    """Multiplier of a month alone, which assumes no event, and of a day, which takes the event and half of it beside."""
    day = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("id") % 365).cast("int"))
    x = listings(spark, folder).select("id", day.alias("day"))
    within = lambda a, b: F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    premium = F.when(within("1998-06-03", "1998-06-10"), 0.18).when(within("1998-06-01", "1998-06-12"), 0.09).otherwise(0.0)
    factor = month_factor(F.month("day"))
    return x.select("id", factor.alias("month_only"), half_up(factor * (1 + premium), 6).alias("date_aware"))
