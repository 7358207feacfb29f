"""Scalar arithmetic, tiers and scores as column expressions.

Numbers are rounded half up towards plus infinity by ``floor``, the same on any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
SQM_TO_SQFT = 10.7639


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity; -2.5 becomes -2."""
    if not digits:
        return F.floor(x + 0.5).cast("long")
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    return ratio(new - old, old) * 100.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two string arrays; two empty arrays are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), both.cast("double")))


def nearness(x: Column, y: Column, scale: Column | float, weight: Column | float) -> Column:
    """Linear similarity: full weight at equality, none from ``scale`` on; null inputs score nothing."""
    scale, weight = (v if isinstance(v, Column) else F.lit(float(v)) for v in (scale, weight))
    gap = F.try_divide(F.abs(x - y).cast("double"), scale)
    # least and greatest skip nulls, so a missing value is told apart before
    return F.when(gap.isNotNull(), clamp(1 - gap, 0.0, 1.0) * weight).otherwise(0.0)


def bath_score(x: Column, y: Column, weight: Column | float) -> Column:
    gap = F.abs(x - y)
    share = F.when(gap == 0, 1.0).when(gap <= 0.5, 0.67).when(gap <= 1, 0.33).otherwise(0.0)
    return share * weight


def tier_score(a: Column, b: Column, weight: Column | float, next_share: float) -> Column:
    """Ordinal tiers: same tier full weight, neighbouring tier a share of it."""
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, next_share).otherwise(0.0) * weight


def beach_tier(metres: Column) -> Column:
    return F.when(metres <= 100, "A").when(metres <= 500, "B").when(metres.isNotNull(), "C")


def price_tier(price: Column, p33: Column, p67: Column) -> Column:
    """Tier within a segment; a missing segment counts as the middle."""
    return F.when(p33.isNull(), "middle").when(price <= p33, "lower").when(price <= p67, "middle").otherwise("upper")


def freshness_weight(age_days: Column) -> Column:
    return F.when(age_days <= 7, 1.0).when(age_days <= 30, 0.5).when(age_days <= 60, 0.25).otherwise(0.0)


def gap_confidence(hours: Column) -> Column:
    return F.when(hours <= 48, "high").when(hours <= 168, "medium").otherwise("low")


def pool_confidence(size: Column) -> Column:
    return F.when(size >= 8, "high").when(size >= 5, "medium").when(size >= 3, "low").otherwise("guidance_only")


def celsius_to_f(c: Column) -> Column:
    return half_up(c * 9 / 5 + 32, 1)


def mm_to_inches(mm: Column) -> Column:
    return half_up(mm / 25.4, 2)


def sqm_to_sqft(sqm: Column) -> Column:
    return half_up(sqm * SQM_TO_SQFT)


def trend_label(delta: Column, threshold: float, up: str = "rising", down: str = "falling", flat: str = "stable") -> Column:
    return F.when(delta > threshold, up).when(delta < -threshold, down).when(delta.isNotNull(), flat)


def alert(value: Column, warn: float, fail: float) -> Column:
    """Freshness tier of an age: ok up to ``warn``, warn up to ``fail``; no value at all fails."""
    return F.when(value.isNull(), "fail").when(value > fail, "fail").when(value > warn, "warn").otherwise("ok")
