"""Stays against overlays, bookings by stay in batch and stream, checkpoints."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from staylens.functions import dates
from staylens.operators import bookings, overlays
from staylens.streaming import feeds

OVERLAY = "key string, name string, start date, end date, premium double, shoulder_start date, shoulder_end date, shoulder_premium double, priority int"
D = date.fromisoformat
EASTER = ("easter", "Easter", D("2026-03-29"), D("2026-04-05"), 0.18, D("2026-04-06"), D("2026-04-12"), 0.08, 90)


def seasonality(spark, stays, events):
    rows = spark.createDataFrame([(i, D(a), D(b)) for i, (a, b) in enumerate(stays)], "stay int, checkin date, checkout date")
    return {r.stay: r for r in overlays.stay_seasonality(rows, ["stay", "checkin"], spark.createDataFrame(events, OVERLAY)).collect()}


def test_stay_windows_of_one_event(spark):
    found = seasonality(spark, [("2026-04-22", "2026-04-28"), ("2026-04-01", "2026-04-06"), ("2026-04-06", "2026-04-13"), ("2026-04-01", "2026-04-15"), ("2026-04-03", "2026-04-03")], [EASTER])
    assert [found[k].multiplier for k in range(5)] == [1.0, 1.18, 1.08, 1.1043, 1.0]
    assert [found[k].premium for k in range(5)] == [None, 0.18, 0.08, 0.1043, None]
    assert [found[k].n_nights for k in range(5)] == [6, 5, 7, 14, 0]
    assert found[0].label == "April (High Season) — clean window (no event overlap)" and found[1].label == "April (High Season) — Easter (partial-window adjusted)"
    assert found[4].label == "April (High Season) — month baseline"


def test_one_winner_a_night(spark):
    events = [
        EASTER, ("fair", "Fair", D("2026-04-04"), D("2026-04-20"), 0.30, None, None, None, 90), ("plain", "Plain", D("2026-04-01"), D("2026-04-30"), 0.50, None, None, None, None),
        ("wide", "Wide", D("2026-04-10"), D("2026-04-10"), 0.10, D("2026-04-08"), D("2026-04-12"), 0.60, 95), ("twin", "Twin", D("2026-04-04"), D("2026-04-20"), 0.30, None, None, None, 90),
        ("bad", "Bad", D("2026-04-20"), D("2026-04-01"), 0.9, None, None, None, 200), ("open", "Open", D("2026-04-25"), D("2026-04-26"), 0.2, D("2026-04-24"), D("2026-04-27"), None, 95)]
    nights = spark.createDataFrame([(D("2026-04-01") + timedelta(days=k),) for k in range(30)] * 3 + [(None,)], "night date")
    won = {r.night.day: (r.key, r.phase, r.premium) for r in overlays.winning_events(nights, spark.createDataFrame(events, OVERLAY)).collect()}
    assert won[1] == ("easter", "core", 0.18) and won[4] == ("fair", "core", 0.30)  # one priority: the higher premium, then the smaller key
    assert won[9] == ("wide", "shoulder", 0.60) and won[10] == ("wide", "core", 0.10)  # a core night is no shoulder night, though that would pay more
    assert won[22] == ("plain", "core", 0.50) and won[24] == ("open", "shoulder", 0.2) and len(won) == 30


def test_zone_bounds(spark):
    stays = spark.createDataFrame([(1, "a", D("2026-04-01"), D("2026-04-03")), (2, "b", D("2026-04-01"), D("2026-04-03")), (3, None, D("2026-04-01"), D("2026-04-03")), (4, "a", D("2026-05-01"), D("2026-05-01"))], "stay int, zone string, checkin date, checkout date")
    rules = spark.createDataFrame([("big", "a", 9.0), ("big", "b", 0.1)], "key string, zone string, strength double")
    events = spark.createDataFrame([("big", "Big", D("2026-04-01"), D("2026-04-01"), 0.6, None, None, None, 90)], OVERLAY)
    got = {r.stay: (r.event_avg, r.zone_avg, r.final_avg) for r in overlays.zone_overlay(stays, ["stay"], events, rules).collect()}
    assert got == {1: (1.3, 1.2, 1.5), 2: (1.3, 0.975, 1.26), 3: (1.3, 1.0, 1.3), 4: (1.0, 1.0, 1.0)}  # 1.6 * 1.4 stays at 2


def test_easter_and_weekdays(spark):
    rows = spark.createDataFrame([(2024,), (2026,), (2027,), (1954,), (1981,)], "y int").select("y", dates.easter(F.col("y")).alias("e"), dates.nth_weekday(F.col("y"), F.lit(11), 4, 4).alias("t")).collect()
    assert [r.e for r in rows] == [D("2024-03-31"), D("2026-04-05"), D("2027-03-28"), D("1954-04-18"), D("1981-04-19")]
    assert rows[1].t == D("2026-11-26")


def plain_checkpoints(today):
    """The same rules, one day after the other."""
    seen, out = set(), []

    def push(checkin, nights, kind, tag=None):
        if (checkin, nights) not in seen:
            seen.add((checkin, nights))
            out.append((checkin, checkin + timedelta(days=nights), nights, kind, tag))

    def step(day, weekday, by):
        while day.weekday() != weekday:
            day += timedelta(days=by)
        return day

    friday = step(today, 4, 1)
    for w in range(12):
        push(friday + timedelta(days=7 * w), 2, "weekend")
        push(friday + timedelta(days=7 * w + 1), 2, "weekend")
    easters = {2024: "2024-03-31", 2025: "2025-04-20", 2026: "2026-04-05", 2027: "2027-03-28", 2028: "2028-04-16"}
    for y in (today.year, today.year + 1):
        for checkin, nights, kind, tag in (
            (date(y, 12, 24), 3, "holiday", f"xmas_{y}"), (date(y, 12, 30), 3, "holiday", f"nye_{y}"), (step(date(y + 1, 1, 1), 5, 1) + timedelta(days=14), 7, "event", f"beef_dip_{y + 1}"),
            (step(D(easters[y + 1]), 5, -1) - timedelta(days=7), 7, "event", f"semana_santa_{y + 1}"), (step(date(y + 1, 5, 31), 5, -1), 4, "event", f"pride_{y + 1}")):
            if today <= checkin <= today + timedelta(days=540):
                push(checkin, nights, kind, tag)
    end = today + timedelta(days=84)
    for k in range(1, 7):
        m = end.month - 1 + k
        push(step(date(end.year + m // 12, m % 12 + 1, 1), 0, 1) + timedelta(days=7), 3, "midweek_anchor")
    return out


def test_checkpoints(spark):
    days = [D("2025-01-01") + timedelta(days=3 * k) for k in range(240)]
    df = spark.createDataFrame([(d, "x") for d in days] + [(None, "none")], "as_of date, kind_of string")
    got = dates.checkpoints(df, "as_of").collect()
    assert sorted((r.as_of, r.checkin, r.checkout, r.stay_nights, r.kind, r.tag or "") for r in got) == sorted((d, *c[:4], c[4] or "") for d in days for c in plain_checkpoints(d))
    assert all(r.is_weekend == (r.checkin.weekday() in (4, 5)) and r.days_out == (r.checkin - r.as_of).days for r in got)


QUOTE = "id long, listing_id long, checkin date, checkout date, collected_at timestamp, status string, nightly long, subtotal long, total long"


def quote_rows(n=400):
    draw, start = random.Random(4), datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        price = draw.choice([None, 0, 90, 120])
        rows.append((i, draw.randrange(5), D("2024-03-01") + timedelta(days=draw.randrange(3)), D("2024-03-05"), start + timedelta(minutes=53 * (i // 2)), draw.choice(["available", "unavailable", "unavailable", "unknown", None]),
                     price, None if price is None else 2 * price, draw.choice([None, 300])))
    return rows


def test_flips_are_one_in_batch_and_stream(spark, tmp_path):
    rows = quote_rows()
    spark.conf.set(*feeds.STORE)
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):  # later files hold later quotes
        spark.createDataFrame(rows[100 * k: 100 * k + 100], QUOTE).coalesce(1).write.mode("append").parquet(land)
        feeds.create(spark, out, feeds.BOOKINGS)
        stream = feeds.booking_flips(feeds.landing(spark, land, QUOTE))
        feeds.append_new(stream, out, ["gone_id", "source_id"], str(tmp_path / "c1")).awaitTermination(240)
    log = spark.createDataFrame(rows, QUOTE).withColumn("collected_at", F.col("collected_at").cast("timestamp_ntz"))
    batch = bookings.infer_bookings(log, F.lit("2024-01-20"), lookback_days=60).withColumns({c: F.col(c).cast("timestamp") for c in ("last_seen_at", "first_gone_at")})
    wanted, got = sorted(map(tuple, batch.collect())), sorted(map(tuple, spark.read.parquet(out).select(*batch.columns).collect()))
    assert len(wanted) > 20 and got == wanted
    # the whole log again, from the start: nothing is added
    feeds.append_new(feeds.booking_flips(feeds.landing(spark, land, QUOTE)), out, ["gone_id", "source_id"], str(tmp_path / "c2")).awaitTermination(240)
    assert spark.read.parquet(out).count() == len(wanted)


def test_stays_of_one_listing_do_not_mix(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    a, b, c = D("2024-03-01"), D("2024-03-02"), D("2024-03-04")
    rows = [(1, 7, a, c, at(0), "available", 100, 300, 330), (2, 7, b, c, at(1), "unavailable", None, None, None), (3, 7, a, c, at(2), "unavailable", None, None, None)]
    log = spark.createDataFrame(rows, QUOTE.replace("timestamp", "timestamp_ntz"))
    flips = bookings.infer_bookings(log, F.lit("2024-01-02"))
    assert [(r.gone_id, r.source_id, r.total, r.confidence) for r in flips.collect()] == [(3, 1, 330, "high")]
    assert bookings.infer_bookings(log, F.lit("2024-02-02")).count() == 0  # beyond the look-back
    assert bookings.new_bookings(flips, flips).count() == 0 and bookings.new_bookings(flips, flips.limit(0)).count() == 1
