"""Date expressions and the small calendars built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nights(checkin: Column, checkout: Column) -> Column:
    """All nights of a stay, the checkout day excluded; an empty array for an empty stay."""
    empty = F.array().cast("array<date>")
    return F.when(checkout > checkin, F.sequence(checkin, F.date_sub(checkout, 1))).otherwise(empty)


def month_index(year: Column, month: Column) -> Column:
    """Months counted through, so that a difference of 12 is a year whatever is missing between."""
    return year * 12 + month - 1


def dow0(day: Column) -> Column:
    """Day of week with Sunday 0."""
    return F.dayofweek(day) - 1


def week_start_sunday(day: Column) -> Column:
    return F.date_sub(day, F.dayofweek(day) - 1)


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def month_key(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)


def hours_between(start: Column, end: Column) -> Column:
    """Hours from one timestamp to another, with fractions."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros.cast("double") / F.lit(3_600_000_000.0)


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Closed intervals that share a day."""
    return (start_a <= end_b) & (end_a >= start_b)


def easter(year: Column) -> Column:
    """Western Easter Sunday: the Paschal full moon of the Gregorian calendar and the Sunday that follows it."""
    golden, century = year % 19, F.floor(year / 100)
    moon = (century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15) % 30
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.date_add(full, 7 - dow0(full))


def weekday_from(day: Column, dow: int) -> Column:
    """The first given weekday (Sunday 0) on or after a day."""
    return F.date_add(day, (dow - dow0(day) + 7) % 7)


def weekday_until(day: Column, dow: int) -> Column:
    """The last given weekday (Sunday 0) on or before a day."""
    return F.date_sub(day, (dow0(day) - dow + 7) % 7)


def nth_weekday(year: Column, month: Column, dow: int, n: int) -> Column:
    """The n-th given weekday (Sunday 0) of a month."""
    return F.date_add(weekday_from(F.make_date(year, month, F.lit(1)), dow), 7 * (n - 1))


#: fixed values: weeks of rolling weekends, months with a mid-week anchor, days ahead within which events count
WEEKS, ANCHORS, HORIZON_DAYS = 12, 6, 540
FRIDAY, SATURDAY, MONDAY = 5, 6, 1


def season(day: Column) -> Column:
    """Season of a day: November to April high, May and October between, the rest low."""
    return F.when(F.month(day).isin(11, 12, 1, 2, 3, 4), "high").when(F.month(day).isin(5, 10), "shoulder").otherwise("low")


def stay_windows(as_of: Column, weeks: int = WEEKS, anchors: int = ANCHORS) -> Column:
    """Array of stays to quote as of a day (checkin, stay_nights, kind, tag), in the order in which they are listed.

    First the coming weekends from Friday and from Saturday, then the events of this year and the next (check-in from the day on,
    within 540 days), then the second Monday of each of the months that follow the last weekend's.
    """
    def stay(checkin: Column, nights: int, kind: str, tag: Column | None = None) -> Column:
        return F.struct(checkin.alias("checkin"), F.lit(nights).alias("stay_nights"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if tag is None else tag).alias("tag"))

    friday = weekday_from(as_of, FRIDAY)
    weekends = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda w: F.array(
        stay(F.date_add(friday, (7 * w).cast("int")), 2, "weekend"), stay(F.date_add(friday, (7 * w + 1).cast("int")), 2, "weekend"))))
    events = []
    for ahead in (0, 1):
        this = F.year(as_of) + ahead
        that = this + 1
        on = lambda year, month, day: F.make_date(year, F.lit(month), F.lit(day))
        named = lambda tag, year: F.concat(F.lit(tag), year.cast("string"))
        events += [
            stay(on(this, 12, 24), 3, "holiday", named("xmas_", this)), stay(on(this, 12, 30), 3, "holiday", named("nye_", this)),
            stay(nth_weekday(that, F.lit(1), SATURDAY, 3), 7, "event", named("beef_dip_", that)),
            stay(F.date_sub(weekday_until(easter(that), SATURDAY), 7), 7, "event", named("semana_santa_", that)),
            stay(weekday_until(on(that, 5, 31), SATURDAY), 4, "event", named("pride_", that))]
    coming = F.filter(F.array(*events), lambda e: (e["checkin"] >= as_of) & (e["checkin"] <= F.date_add(as_of, HORIZON_DAYS)))
    month = F.trunc(F.date_add(as_of, 7 * weeks), "month")
    middle = F.transform(F.sequence(F.lit(1), F.lit(anchors)), lambda k: stay(F.date_add(weekday_from(F.add_months(month, k.cast("int")), MONDAY), 7), 3, "midweek_anchor"))
    return F.concat(weekends, coming, middle)


def checkpoints(df: DataFrame, as_of: str, weeks: int = WEEKS, anchors: int = ANCHORS) -> DataFrame:
    """Every row of ``df`` with each of its stay windows as of its own day: a window listed twice keeps its first label.

    Adds checkin, checkout, stay_nights, kind, tag, is_weekend, season, days_out. A row without a day gives none. All within the
    row: nothing is shuffled.
    """
    listed, c = "_windows", F.col
    first = lambda x, i: ~F.exists(F.slice(listed, F.lit(1), i), lambda y: (y["checkin"] == x["checkin"]) & (y["stay_nights"] == x["stay_nights"]))
    rows = df.filter(c(as_of).isNotNull()).withColumn(listed, stay_windows(c(as_of), weeks, anchors)).select(*df.columns, F.explode(F.filter(listed, first)).alias("_w")).select(*df.columns, "_w.*")
    return rows.select(
        *df.columns, "checkin", F.date_add("checkin", c("stay_nights")).alias("checkout"), "stay_nights", "kind", "tag", dow0(c("checkin")).isin(FRIDAY, SATURDAY).alias("is_weekend"),
        season(c("checkin")).alias("season"), F.datediff("checkin", as_of).alias("days_out"))
