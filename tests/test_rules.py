"""Worked examples of the market rules."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from staylens.functions import numbers, text
from staylens.operators import latest, stats, upserts
from staylens.plans import comps, series
from staylens.sources import ical, pages, tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_numbers(spark):
    r = one(spark, a=numbers.half_up(F.lit(-2.5)), b=numbers.half_up(F.lit(217.5)), c=numbers.pct_change(F.lit(576600), F.lit(762800)), d=numbers.ratio(F.lit(1), F.lit(0)),
            e=numbers.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), f=numbers.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert (r.a, r.b, round(r.c, 4), r.d, round(r.e, 4), r.f) == (-2, 218, -24.4101, None, 0.3333, 1.0)


@pytest.mark.parametrize(("days", "weight"), [(7, 1.0), (8, 0.5), (30, 0.5), (31, 0.25), (60, 0.25), (61, 0.0)])
def test_freshness(spark, days, weight):
    assert one(spark, x=numbers.freshness_weight(F.lit(days))).x == weight


@pytest.mark.parametrize(("hours", "label"), [(48.0, "high"), (48.5, "medium"), (168.0, "medium"), (169.0, "low")])
def test_gap_confidence(spark, hours, label):
    assert one(spark, x=numbers.gap_confidence(F.lit(hours))).x == label


def test_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    r = df.agg(stats.linear_percentile("x", 0.25).alias("p25"), stats.linear_percentile("x", 0.5).alias("p50"), stats.upper_median("x").alias("up")).first()
    assert (r.p25, r.p50, r.up) == (1.75, 2.5, 3.0)
    q = spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "x int").agg(stats.nearest_quartile("x", 0.25).alias("a"), stats.nearest_quartile("x", 0.75).alias("b")).first()
    assert (q.a, q.b) == (20, 40)


def test_iqr_trim(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((100, 110, 120, 130, 140, 900))], "k int, id int, x double")
    out = stats.iqr_trim(df, ["k"], "x", "id").collect()
    assert sorted(r.x for r in out) == [100, 110, 120, 130, 140] and {r.n_removed for r in out} == {1}


def test_text(spark):
    r = one(spark, a=text.sqft(F.lit("75 Square Meters")), b=text.sqft(F.lit("224.38 Square Meter/ 2414.33  Square Feet")),
            t=text.og_title(F.lit("Condo in Puerto Vallarta · ★4.96 · 2 bedrooms · 2 beds · 2 private baths")), s=text.bedrooms(F.lit("Studio apartment")), w=text.bedrooms(F.lit("tres recámaras")),
            u=text.canonical_url(F.lit("https://X.com/Rooms/1?utm_source=a&b=2&a=1#top")), m=text.money(F.lit("from $1,234.50 total")), g=text.guarded(F.lit("two"), "int"))
    assert (r.a, r.b, r.s, r.w, r.u, r.m, r.g) == (807, 2414, 0, 3, "https://x.com/rooms/1?a=1&b=2", 1234.5, None)
    assert (r.t.kind, r.t.rating, r.t.bedrooms, r.t.beds, r.t.baths) == ("Condo", 4.96, 2, 2, 2.0)


def test_weights_without_size_and_rating(spark):
    df = spark.createDataFrame([("Zona Romantica", None, None)], "t_hood string, t_sqft double, t_rating double")
    r = df.select(*[comps.weight(p).alias(p) for p in comps.WEIGHTS[""]]).first()
    assert (r.beach, r.bath, r.amenities, r.beach_tier, r.sqft, r.rating) == (27, 19, 29, 12, 0, 0)


def test_recommendation_and_layers(spark):
    df = spark.createDataFrame([(1, 941, None, 90.0, 1.2, "ocean", True, ["pool"], "premium", True, True, 4.95, "2020+")],
                               "t_id int, base long, building_pct double, tier_pct double, seasonal double, view string, rooftop boolean, amenities array<string>, finish string, plunge boolean, terrace boolean, rating double, built string")
    rows = {r.layer: r for r in comps.layers(df).collect()}
    assert rows["beach_tier"].factor == 1.08 and rows["rooftop_pool"].factor == 1.17 and rows["quality"].factor == 1.06
    assert rows["guardrails"].price == 2353  # held at 2.5 times the base


def test_estimate(spark):
    known = spark.createDataFrame([(2026, 3, 576600), (2025, 4, 654100)], "year int, month int, value long")
    r = series.estimate(known, spark.createDataFrame([(2026, 4, 22)], "year int, month int, days_elapsed int")).first()
    assert (r.to_date, r.projected, r.vs_last_year, r.vs_prior, r.confidence) == (444437, 618171, -5.4929, 7.2097, "high")


def test_merges(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, x int, y string")
    new = spark.createDataFrame([(2, None, "c"), (3, 30, "d")], "k int, x int, y string")
    out = {r.k: (r.x, r.y) for r in upserts.merged(old, new, ["k"], {"x": "fill", "y": "overwrite"}).collect()}
    assert out == {1: (10, "a"), 2: (20, "c"), 3: (30, "d")}
    again = upserts.merged(spark.createDataFrame([(k, *v) for k, v in out.items()], "k int, x int, y string"), new, ["k"], {"x": "fill", "y": "overwrite"})
    assert {r.k: (r.x, r.y) for r in again.collect()} == out


def test_replace_table(spark, tmp_path):
    a = upserts.replace_table(spark.range(3).toDF("x"), str(tmp_path / "t"))
    b = upserts.replace_table(spark.range(5).toDF("x"), str(tmp_path / "t"))
    assert a != b and spark.read.parquet(a).count() == 3 and spark.read.parquet(b).count() == 5


def test_streaks(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((1, 0, 0, 2, 0))], "k int, at int, v int")
    out = latest.zero_streaks(df, ["k"], [F.col("at")], "v").orderBy("at").collect()
    assert [r.streak for r in out] == [0, 1, 2, 0, 1]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('slug,weights,note,is_active\nx,"{""a"": 1}","two\nlines, quoted",t\ny,,,f\n')
    rows = tables.csv_table(spark, str(tmp_path / "a.csv"), "slug string, weights string, note string, is_active string").withColumn("flag", tables.csv_flag("is_active")).orderBy("slug").collect()
    assert [(r.weights, r.note, r.flag) for r in rows] == [('{"a": 1}', "two\nlines, quoted", True), (None, None, False)]


def test_newest_snapshot(spark, tmp_path):
    (tmp_path / "2026-01.json").write_text('{"v": 1}')
    (tmp_path / "2026-02.json").write_text('{"v": 2}')
    assert [r.v for r in tables.newest_snapshot(spark, str(tmp_path)).collect()] == [2]


def test_ical(spark):
    body = "BEGIN:VEVENT\r\nUID:1\r\nSUMMARY:No date\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART:20260101T120000Z\r\nDURATION:P2W\r\nEND:VEVENT"
    rows = {r.uid: r for r in ical.events(spark.createDataFrame([(body,)], "text string")).collect()}
    assert rows["1"].error == "missing DTSTART" and rows["2"].end == date(2026, 1, 15)


def test_page_details_and_calendar(spark):
    html = '<script type="application/ld+json">{"name": "Casa", "aggregateRating": {"ratingValue": 4.5}}</script><meta property="og:title" content="Condo in Town · ★4.9 · 2 bedrooms · 3 beds · 2 baths"><p>$120 per night, 900 sq ft</p>'
    r = pages.details(spark.createDataFrame([(1, html)], "id int, html string")).first()
    assert (r.title, r.rating, r.bedrooms, r.bathrooms, r.sqft, r.price) == ("Casa", 4.5, 2, 2.0, 900, 120.0)
    rows = pages.calendar_rows(spark.createDataFrame([(1, '[{"date": "2026-01-01", "price": 0, "available": false}]')], "id int, payload string")).collect()
    assert [(r.date, r.price, r.status) for r in rows] == [(date(2026, 1, 1), None, "booked")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text', None), (2, "two\nlines", 1.5)], "id int, name string, x double")
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in tables.csv_table(spark, str(tmp_path / "out"), "id int, name string, x double").collect()) == sorted(tuple(r) for r in df.collect())
    for name in ("2024-01.json", "2024-02.json"):
        tables.write_snapshot(df.withColumn("run", F.lit(name)), str(tmp_path / "snapshots"), name)
    newest = tables.newest_snapshot(spark, str(tmp_path / "snapshots")).collect()
    assert {r.run for r in newest} == {"2024-02.json"}
    assert [r[0] for r in spark.createDataFrame([("1,234.5",), ("x",), (None,)], "v string").select(tables.csv_number("v")).collect()] == [1234.5, None, None]
