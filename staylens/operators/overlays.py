"""Event overlays on the nights of stays: interval joins by weeks, one winner a night, zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import dates
from staylens.functions.numbers import clamp, half_up

#: fixed values: monthly demand factors of the market, January to December
MONTH_FACTORS = [1.02, 1.05, 1.05, 1.00, 0.93, 0.82, 0.76, 0.74, 0.68, 0.84, 0.95, 0.95]
#: fixed values: seasons of the months, January to December
MONTH_SEASONS = ["High", "Peak", "Peak", "High", "Shoulder", "Low", "Low", "Low", "Low", "Shoulder", "High", "High"]
#: fixed values: ends of a stay's label
PARTIAL, CLEAN, BASELINE = " (partial-window adjusted)", " — clean window (no event overlap)", " — month baseline"
#: fixed values: priority of an event that names none, bounds of a zone's multiplier and of a night's product
DEFAULT_PRIORITY, ZONE_MIN, ZONE_MAX, NIGHT_CAP = 50, 0.95, 1.40, 2.0
#: days that one join key of the interval join spans
BIN_DAYS = 7


def month_value(month: Column, values: Sequence) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), month)


def active_events(events: DataFrame, as_of: Column, category: str | None = None) -> DataFrame:
    """Active events (category, start, stop, active) that end on or after a day; without a last day one ends when it begins.

    ``category`` None means all of them. An event whose activity is unknown is not active.
    """
    ending = events.filter("active").withColumn("stop", F.coalesce("stop", "start")).filter(F.col("stop") >= as_of)
    return ending if category is None else ending.filter(F.col("category") == category)


def _bin(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BIN_DAYS)


def winning_events(nights: DataFrame, overlays: DataFrame, night: str = "night") -> DataFrame:
    """The event that holds each distinct night: rows (night, key, phase, premium, priority, core_premium, name).

    ``overlays``: key, name, start, end, premium, shoulder_start, shoulder_end, shoulder_premium, priority. A night in the core
    of an event counts as core even where its shoulder covers it too; a shoulder without premium has the core's. Of several
    events the highest priority wins (50 where none is given), then the higher premium, then the smaller key. Nights that no
    event covers, null nights and spans that end before they begin give no rows. Each span is written once for every week it
    touches and meets the distinct nights of that week by key, so neither side is broadcast and a crowded week has seven nights.
    """
    c = F.col
    common = ["key", "name", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"), c("premium").alias("core_premium")]
    core = overlays.select(*common, F.lit("core").alias("phase"), c("start").alias("first"), c("end").alias("last"), "premium")
    shoulder = overlays.select(*common, F.lit("shoulder").alias("phase"), c("shoulder_start").alias("first"), c("shoulder_end").alias("last"), F.coalesce("shoulder_premium", "premium").alias("premium"))
    spans = core.unionByName(shoulder).filter("first <= last").withColumn("week", F.explode(F.sequence(_bin(c("first")), _bin(c("last")))))
    days = nights.select(c(night).alias("night")).filter("night IS NOT NULL").distinct().withColumn("week", _bin(c("night")))
    met = days.join(spans, "week").filter("night BETWEEN first AND last")
    # "core" sorts before "shoulder"
    once = met.groupBy("night", "key").agg(F.min(F.struct("phase", "premium", "priority", "core_premium", "name")).alias("e")).select("night", "key", "e.*")
    best = once.groupBy("night").agg(F.min(F.struct((-c("priority")).alias("p"), (-c("premium")).alias("q"), "key", "phase", "premium", "priority", "core_premium", "name")).alias("e"))
    return best.select("night", "e.key", "e.phase", "e.premium", "e.priority", "e.core_premium", "e.name")


def stay_nights(stays: DataFrame, overlays: DataFrame) -> DataFrame:
    """All columns of ``stays`` and one row a night with its event, or one row without night for a stay of none.

    Adds night, key, phase, premium, priority, core_premium, name. ``stays`` has checkin and checkout and none of these.
    """
    nights = stays.withColumn("night", F.explode_outer(dates.nights(F.col("checkin"), F.col("checkout"))))
    return nights.join(winning_events(nights, overlays), "night", "left")


def stay_seasonality(stays: DataFrame, keys: Sequence[str], overlays: DataFrame) -> DataFrame:
    """Seasonal context of each stay: keys, n_nights, monthly, multiplier, premium, event, label.

    ``multiplier`` is the mean over nights of month factor times event premium, ``premium`` what events add to the months alone
    (null without any), ``event`` the one of highest priority, then of highest core premium, then of smallest key among those
    that hold a night. A stay without nights has its month's factor. ``keys`` name a stay, checkin among them. Factors are
    counted in ten-thousandths, so sums do not depend on the order of nights.
    """
    c = F.col
    month = half_up(month_value(F.month(F.coalesce("night", "checkin")), MONTH_FACTORS) * 100)
    added = half_up(F.coalesce(c("premium"), F.lit(0.0)) * 100)
    lead = F.when(c("key").isNotNull(), F.struct((-c("priority")).alias("p"), (-c("core_premium")).alias("q"), "key", "name"))
    one = stay_nights(stays, overlays).withColumn("m", month * 100).withColumn("f", month * (100 + added))
    s = one.groupBy(*keys).agg(F.count("night").alias("n_nights"), F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("f").alias("f"), F.min(lead).alias("lead"))
    head = F.concat(F.date_format("checkin", "MMMM"), F.lit(" ("), month_value(F.month("checkin"), MONTH_SEASONS), F.lit(" Season)"))
    label = F.when(c("n_nights") == 0, F.concat(head, F.lit(BASELINE))).when(c("lead").isNull(), F.concat(head, F.lit(CLEAN))).otherwise(F.concat(head, F.lit(" — "), c("lead.name"), F.lit(PARTIAL)))
    return s.select(
        *keys, "n_nights", (half_up(c("m") / c("n")) / 10_000).alias("monthly"), (half_up(c("f") / c("n")) / 10_000).alias("multiplier"),
        F.when(c("lead").isNotNull(), F.greatest(F.lit(0.0), half_up(c("f") / c("m") - 1, 4))).alias("premium"), c("lead.key").alias("event"), label.alias("label"))


def zone_overlay(stays: DataFrame, keys: Sequence[str], overlays: DataFrame, zones: DataFrame) -> DataFrame:
    """What zones would add to the event premium of a stay: keys, n_nights, event_avg, zone_avg, final_avg.

    ``zones``: key, zone, strength, one row for each event and zone; ``stays`` has a column zone. A strength is held between
    0.95 and 1.40, a night's product at 2, a night without event or rule counts 1, and so does a stay without nights.
    """
    c = F.col
    rules = zones.select(c("key"), c("zone"), half_up(clamp(c("strength"), ZONE_MIN, ZONE_MAX) * 10_000).alias("zone_units"))
    nights = stay_nights(stays, overlays).join(rules, ["key", "zone"], "left")
    nights = nights.withColumn("applied", half_up((1 + F.coalesce("premium", F.lit(0.0))) * 10_000)).withColumn("zone_units", F.coalesce("zone_units", F.lit(10_000)))
    nights = nights.withColumn("final", F.least(F.lit(int(NIGHT_CAP * 10_000)), half_up(c("applied") * c("zone_units") / 10_000)))
    mean = lambda x: half_up(F.sum(x) / F.count("*")) / 10_000
    return nights.groupBy(*keys).agg(F.count("night").alias("n_nights"), mean("applied").alias("event_avg"), mean("zone_units").alias("zone_avg"), F.least(F.lit(NIGHT_CAP), mean("final")).alias("final_avg"))
