"""Pages by rules, nested JSON, mini-calendars, price panels and rate tables."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from staylens.sources import listing_pages, pages

D = date.fromisoformat


def frame(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "id int, html string")


def state(value):
    return f'<script id="data-deferred-state-0" type="application/json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def test_nodes_at_every_depth(spark):
    nested = {"__typename": "Card", "id": 1, "more": [{"__typename": "Card", "id": 2}, [[{"x": {"__typename": "Card", "id": 3}}]]], "other": {"__typename": "Card?", "id": 4}}
    found = listing_pages.nodes(frame(spark, state({"a": [nested, None, 5, "Card"]}), state("{broken"), "<p>no state</p>", None, state([{"__typename": "Card", "id": 9}]), state('"Card"')), "Card")
    rows = found.select("id", F.try_variant_get("node", "$.id", "int").alias("n")).collect()
    # a card that is found keeps those inside it: both come out
    assert sorted((r.id, r.n) for r in rows) == [(0, 1), (0, 2), (0, 3), (4, 9)]


def test_nodes_deeper_than_asked_are_an_error(spark):
    deep = {"__typename": "Card", "id": 1}
    for _ in range(12):
        deep = {"a": deep}
    assert listing_pages.nodes(frame(spark, state(deep)), "Card", depth=16).count() == 1
    with pytest.raises(Exception, match="nests deeper"):
        listing_pages.nodes(frame(spark, state(deep)), "Card", depth=5).collect()


def test_platform_rules(spark):
    rows = spark.createDataFrame([
        (1, "pvrpv", "https://x.com/a/casa-1/?q=1", "<ul><li><b>Type:</b> Condo</li><li>Bed(s): 2</li><li>Bath(s): 2.5</li><li>type: second</li><li>no label</li></ul><tr><td>$ 100 USD</td></tr><tr>$300.5 USD</tr><tr>$7</tr><tr>$99,999 USD</tr>"),
        (2, "vrbo", "https://v.com/1234567", '<title>Home</title><script type="application/ld+json">{"@type":"Resort","numberOfRooms":3}</script>{"bedrooms": 9, "bathroomCount":1.5}'),
        (3, "vrbo", None, None), (4, "mars", "https://m.com/1", "<li>Type: Condo</li>"), (5, "pvrpv", "", "<li>Bed(s): many</li>")], "id int, platform string, url string, html string")
    got = {r.id: r for r in listing_pages.platform_fields(rows).collect()}
    assert (got[1].kind, got[1].bedrooms, got[1].bathrooms, got[1].price, got[1].external_id) == ("Condo", 2, 2.5, 300.5, "casa-1")
    assert (got[2].title, got[2].bedrooms, got[2].bathrooms, got[2].external_id) == ("Home", 3, 1.5, "1234567")  # JSON-LD before other JSON
    assert all(got[k][f] is None for k in (3, 4, 5) for f in listing_pages.FIELDS)


def test_first_rule_that_finds_something(spark):
    rules = [listing_pages.Rule("p", "title", "tag", "h1"), listing_pages.Rule("p", "title", "meta", "og:title"), listing_pages.Rule("q", "title", "meta", "og:title")]
    rows = spark.createDataFrame([(1, "p", "", '<meta property="og:title" content="b"><h1>a</h1>'), (2, "p", "", '<meta property="og:title" content="b"><h1> </h1>'), (3, "q", "", '<meta property="og:title" content="b"><h1>a</h1>')], "id int, platform string, url string, html string")
    assert {r.id: r.title for r in listing_pages.platform_fields(rows, rules).collect()} == {1: "a", 2: "b", 3: "b"}


def test_discovery_details(spark):
    long = "<p>" + "filler " * 200 + "</p>"
    got = {r.id: r for r in listing_pages.discovery_details(frame(
        spark, '<meta content="Private room in Old Town · ★5 · 1 bedroom · 1.5 shared baths" property="og:title">' + long, '<meta property="og:title" content="x in y">', None,
        '<script type="application/ld+json">[{"@type":"Other","name":"no"},{"@type":"Product","name":"Ln","numberOfBedrooms":"2 rooms","address":{"addressLocality":"Town"},"geo":{"latitude":"20.5"}}]</script>{"lng":-105.5,"lat":1.5}' + long,
        '{"bathrooms":99,"x":"45 baths"}' + long, "<p>two-bath house</p>" + long)).collect()}
    assert (got[0].title[:12], got[0].kind, got[0].place, got[0].bedrooms, got[0].bathrooms) == ("Private room", "room", "Old Town", 1.0, 1.5)
    assert all(got[k][f] is None for k in (1, 2) for f in ("title", "kind", "place", "bedrooms", "bathrooms", "latitude"))
    assert (got[3].title, got[3].place, got[3].bedrooms, got[3].latitude, got[3].longitude) == ("Ln", "Town", 2.0, 20.5, -105.5)
    assert got[4].bathrooms is None and got[5].bathrooms == 2.0


def test_mini_calendar_over_the_year(spark):
    cell = lambda n, kind="", price="": f'<td class="no-padding"><div class="d"><div class="{kind}"><div class="box-cal">{n}</div>{price}</div></div></td>'
    html = ("<table>" + cell(9) + '<th colspan="7">December&nbsp;2025</th>' + cell("&nbsp;") + cell(30, "occ day-off") + cell(31, "", "<small> $ 1,250.50</small>") + cell(32)
            + '<th colspan="7">January 2026</th>' + cell(1, "dep") + cell(2, "occasion") + '<th colspan="7">Brumaire 2026</th>' + cell(3) + '<th colspan="7">february 2026</th>' + cell(29) + cell(28, "arr") + "</table>")
    rows = listing_pages.mini_calendar(frame(spark, html, "", None)).orderBy("position").collect()
    assert [(r.day, r.available, r.price) for r in rows] == [
        (D("2025-12-30"), False, None), (D("2025-12-31"), True, 1250.5), (D("2026-01-01"), False, None), (D("2026-01-02"), True, None), (D("2026-02-28"), False, None)]


def test_price_panels(spark):
    panels = [
        "$120 x 3 nights\n$360\nCleaning fee $80\nTotal\n$440", "$ 100.50 USD × 2 nights\nService fee\nwhat is this\n$20\nTaxes\n$5", "Price\n$900 $450 total for 5 nights", "Total before taxes $300\nTaxes $30", "nothing here", None,
        "$100 x 2 nights\n$50 off\nCleaning fee\n \nNext\n$10\nTax\n$1"]
    rows = spark.createDataFrame(list(enumerate(panels)), "id int, panel string").select("id", pages.price_panel(F.col("panel")).alias("p")).orderBy("id").collect()
    assert [tuple(r.p) for r in rows] == [
        (360.0, 80.0, None, None, 440.0), (201.0, None, 20.0, 5.0, 226.0), (450.0, None, None, None, 450.0), (None, None, None, 30.0, 330.0), (None,) * 5, (None,) * 5, (200.0, 10.0, None, 1.0, 211.0)]


def test_rate_table(spark):
    html = ('<table class="other"><tr><td>a</td></tr></table><TABLE id="x" class="table table-rounded"><tr><th>Dates</th></tr><tr><td>June 1, 2026 to July 5, 2026</td><td><b>$ 1,200</b></td><td>-</td><td>-</td><td>5 nights</td></tr>'
            "<tr><td>short</td></tr><tr><td>soon</td><td>$1</td><td></td><td></td><td></td></tr><tr><td>December 15, 2026  to January 5, 2027</td><td>$99.5</td><td></td><td></td><td>any</td></tr></table><table><tr><td>z</td></tr></table>")
    rows = pages.rate_table(frame(spark, html, "<p>none</p>", None)).collect()
    assert [(r.id, r.start, r.stop, r.nightly, r.min_nights) for r in rows] == [(0, D("2026-06-01"), D("2026-07-05"), 1200.0, 5), (0, D("2026-12-15"), D("2027-01-05"), 99.5, None)]
