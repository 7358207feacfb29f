"""Pages of the platforms: fields by rules, discovery details and mini-calendars, read back from pages that carry a table's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.plans.registry import query
from staylens.sources import listing_pages
from staylens.sources.tables import table


#: what the pages of a platform hold besides the crawled page around it
SNIPPETS = {
    "pvrpv": '<h1>Casa {id}</h1><ul><li>Type: Villa</li><li>Bed(s): {beds}</li><li><b>Bath(s):</b> {beds}.5</li><li>Sleeps(s): {size}</li><li>Square Space: 1,{beds}00 Square Feet</li><li>Year Built: 200{beds}</li>'
             '<li>Area: Amapas</li><li>Type: again</li><li>Ocean view</li></ul><table><tr><td>low</td><td>$ {size}0 USD</td></tr><tr><td>high</td><td>$1,{size}0.50 USD</td></tr><tr><td>pesos $5</td></tr></table>',
    "vrbo": '<meta property="og:title" content="Home {id} | Vrbo"><script type="application/ld+json">not json</script><script type="application/ld+json">[{"@type":"WebSite","name":"no"},{"@type":"VacationRental","numberOfBedrooms":"{beds}",'
            '"occupancy":{"maxOccupancy":{size}},"aggregateRating":{"ratingValue":4.{beds}},"address":{"addressLocality":"Town"}}]</script><script>x={"bathrooms":{beds}.5,"nightlyPrice":{size}99.5,"neighborhood":"Versalles"}</script>',
    "airbnb": '<meta property="og:title" content="Flat {id}"><script>{"personCapacity":{size},"bedrooms":{beds},"roomType":"Entire home/apt","guestSatisfactionOverall":4.{beds}}</script>',
}


def _template(name: str) -> F.Column:
    text = SNIPPETS[name]
    out = F.lit(text)
    for field in ("id", "beds", "size"):
        out = F.replace(out, F.lit("{" + field + "}"), F.col(field).cast("string"))
    return out


@query("""WITH b AS (SELECT page_id, url, p_partkey AS id, CAST(p_size % 4 + 1 AS INTEGER) AS beds, p_size + 10 AS size, CAST(page_id % 4 AS INTEGER) AS k FROM pages JOIN part ON p_partkey = page_id)
SELECT page_id, CASE k WHEN 0 THEN 'pvrpv' WHEN 1 THEN 'vrbo' WHEN 2 THEN 'airbnb' ELSE 'other' END AS platform, CASE WHEN k < 3 THEN nullif(regexp_extract(split_part(url, '?', 1), '([^/]+)/*$', 1), '') END AS external_id,
  CASE k WHEN 0 THEN 'Casa ' || id WHEN 1 THEN 'Home ' || id || ' | Vrbo' WHEN 2 THEN 'Flat ' || id END AS title, CASE k WHEN 0 THEN 'Villa' WHEN 2 THEN 'Entire home/apt' END AS kind, CASE k WHEN 0 THEN 'Amapas' WHEN 1 THEN 'Versalles' END AS area,
  CASE WHEN k < 3 THEN beds END AS bedrooms, CASE WHEN k < 2 THEN beds + 0.5::DOUBLE END AS bathrooms, CAST(CASE WHEN k < 3 THEN size END AS INTEGER) AS guests, CAST(CASE k WHEN 0 THEN 1000 + beds * 100 END AS DOUBLE) AS size, CASE k WHEN 0 THEN 2000 + beds END AS built,
  CAST(CASE k WHEN 0 THEN 1000.5 + size * 10 WHEN 1 THEN size * 100 + 99.5 END AS DOUBLE) AS price, CAST(CASE WHEN k IN (1, 2) THEN 4 + beds / 10 END AS DOUBLE) AS rating FROM b""")
def platform_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of three platforms and of one without rules, read from crawled pages by one table of rules."""
    values = table(spark, folder, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 + 1).cast("int").alias("beds"), (F.col("p_size") + 10).alias("size"))
    k = F.col("page_id") % 4
    met = table(spark, folder, "pages").join(values, F.col("id") == F.col("page_id"))
    platform = F.when(k == 0, "pvrpv").when(k == 1, "vrbo").when(k == 2, "airbnb").otherwise("other")
    snippet = F.when(k == 0, _template("pvrpv")).when(k == 1, _template("vrbo")).otherwise(_template("airbnb"))
    made = met.select("page_id", "url", platform.alias("platform"), F.concat(snippet, F.col("html")).alias("html"))
    return listing_pages.platform_fields(made).drop("url")


@query("""WITH b AS (SELECT page_id, CAST(page_id % 5 AS INTEGER) AS k, p_size AS s, length(html) AS n FROM pages JOIN part ON p_partkey = page_id)
SELECT page_id, CASE WHEN n < 800 THEN NULL WHEN k = 0 THEN 'Entire condo in Old Town & Beach · ★4.9 · ' || s || ' bedrooms · 2 private baths' WHEN k = 1 THEN 'Loft ' || page_id WHEN k = 2 THEN 'Home in Town' END AS title,
  CASE WHEN n < 800 THEN NULL WHEN k = 0 THEN 'condo' WHEN k = 2 THEN 'Home' END AS kind, CASE WHEN n < 800 THEN NULL WHEN k = 0 THEN 'Old Town & Beach' WHEN k = 1 THEN 'Jalisco' WHEN k = 2 THEN 'Town' END AS place,
  CAST(CASE WHEN n >= 800 AND k IN (0, 1) THEN s END AS DOUBLE) AS bedrooms, CAST(CASE WHEN n < 800 THEN NULL WHEN k = 0 THEN 2 WHEN k = 1 THEN 1.5 WHEN k = 2 THEN 2.5 WHEN k = 3 THEN 3 END AS DOUBLE) AS bathrooms,
  CASE WHEN n < 800 THEN NULL WHEN k = 1 THEN 20.5::DOUBLE WHEN k = 2 THEN 20.25::DOUBLE END AS latitude, CASE WHEN n < 800 THEN NULL WHEN k = 1 THEN -105.25::DOUBLE WHEN k = 2 THEN -105.5::DOUBLE END AS longitude FROM b""")
def discovery_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Details of candidates from crawled pages: share titles, JSON-LD, JSON keys, words of the text, and pages too short to count."""
    c, k = F.col, F.col("page_id") % 5
    titled = F.concat(F.lit('<meta content="Entire condo in Old Town &amp; Beach · ★4.9 · '), c("p_size"), F.lit(' bedrooms · 2 private baths" property="og:title">'))
    linked = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"Loft '), c("page_id"), F.lit('","numberOfRooms":"'), c("p_size"), F.lit(' rooms","numberOfBathroomsTotal":1.5,"address":{"addressRegion":"Jalisco"},"geo":{"latitude":"20.5","longitude":-105.25}}</script>'))
    keyed = F.lit('<meta property="og:title" content="Home in Town"><script>{"bathroomLabel":"2.5 shared baths","lat":20.25,"lng":-105.5}</script>')
    made = F.when(k == 0, titled).when(k == 1, linked).when(k == 2, keyed).when(k == 3, F.lit("<p>Tres baños y patio</p>")).otherwise(F.lit("<p>nothing</p>"))
    long = F.rpad(made, 400, " ")
    read = table(spark, folder, "pages", ["page_id", "html"]).join(table(spark, folder, "part", ["p_partkey", "p_size"]), c("p_partkey") == c("page_id"))
    # the crawled text stands in a comment of digits alone, so that only the made part tells anything; lengths are the pages' own
    filler = F.concat(F.lit("<!--"), F.repeat(F.lit("0"), F.greatest(F.lit(0), F.length("html") - 207)), F.lit("-->"))
    return listing_pages.discovery_details(read.select("page_id", F.when(F.length("html") >= 800, F.concat(long, F.lit(" " * 200), filler)).otherwise(made).alias("html")))


@query("""WITH o AS (SELECT DISTINCT o_custkey % 200 AS id, CAST(o_orderdate AS DATE) AS day FROM orders), m AS (SELECT DISTINCT id, CAST(date_trunc('month', day) AS DATE) AS month FROM o),
d AS (SELECT id, month, CAST(unnest(generate_series(month, last_day(month), INTERVAL 1 DAY)) AS DATE) AS day FROM m)
SELECT d.id, d.day, o.day IS NULL AS available, CASE WHEN o.day IS NULL THEN 100.5::DOUBLE + day(d.day) END AS price FROM d LEFT JOIN o ON o.id = d.id AND o.day = d.day""", dates=["day"])
def mini_calendars(spark: SparkSession, folder: str) -> DataFrame:
    """Day rows read back from mini-calendars: one for each group of customers, a month wherever one of them ordered, over years."""
    c = F.col
    days = table(spark, folder, "orders", ["o_custkey", "o_orderdate"]).select((c("o_custkey") % 200).alias("id"), c("o_orderdate").cast("date").alias("day")).distinct()
    months = days.groupBy("id", F.trunc("day", "month").alias("month")).agg(F.collect_set(F.dayofmonth("day")).alias("taken"))
    numbers = F.sequence(F.lit(1), F.dayofmonth(F.last_day("month")))
    cell = lambda n: F.concat(
        F.lit('<td class="no-padding"><div class="day"><div class="'), F.when(F.array_contains("taken", n), F.when(n % 2 == 0, "occ day-off").otherwise("dep")).otherwise(""), F.lit('"><div class="box-cal">'), n.cast("string"),
        F.lit("</div>"), F.when(~F.array_contains("taken", n), F.concat(F.lit("<small>$ "), (n + 100).cast("string"), F.lit(".50</small>"))).otherwise(""), F.lit("</div></div></td>"))
    gap = F.when(F.month("month") % 2 == 0, "&nbsp;").otherwise(" ")
    block = F.concat(F.lit('<table><th colspan="7">'), F.date_format("month", "MMMM"), gap, F.date_format("month", "yyyy"), F.lit('</th><td class="no-padding"><div class="day"><div class=""><div class="box-cal">&nbsp;</div></div></div></td>'),
                     F.array_join(F.transform(numbers, cell), ""), F.lit("</table>"))
    odd = '<th colspan="7">Nomonth 2024</th><td class="no-padding"><div class="day"><div class=""><div class="box-cal">5</div></div></div></td>'
    html = months.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", block.alias("block")))), lambda x: x["block"]), "").alias("html"))
    return listing_pages.mini_calendar(html.select("id", F.concat(F.lit(odd), c("html")).alias("html"))).drop("position")
