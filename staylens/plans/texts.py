"""Text-derived attributes, identity, JSON signals and page sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.functions.numbers import half_up
from staylens.operators.latest import top_per_key
from staylens.plans.registry import query
from staylens.plans.standins import LISTINGS, listings
from staylens.sources import pages as page_source
from staylens.sources.tables import table

TRACKING_SQL = "(" + ", ".join(f"'{x}'" for x in text.TRACKING) + ")"


#: stand-in URLs: the pages' own, repeated names out of order, a name that sorts between another and its sign, a bare host
_URL_SQL = "CASE page_id % 4 WHEN 1 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'k=2&a-b=2&k=1&a=1&utm_source=x' WHEN 2 THEN regexp_extract(url, '^https?://[^/]+') ELSE url END"


@query(f"""WITH r AS (SELECT page_id, {_URL_SQL} AS url FROM pages), b AS (SELECT page_id, string_split(trim(url), '#')[1] AS bare FROM r), s AS (SELECT page_id, string_split(bare, '?')[1] AS p0, list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN {TRACKING_SQL}) AS q FROM b),
o AS (SELECT page_id, CASE WHEN regexp_full_match(p0, '[A-Za-z][A-Za-z0-9+.-]*://[^/]+') THEN p0 || '/' ELSE p0 END AS path, q, list_transform(list_sort(list_transform(range(1, len(q) + 1), lambda i: {{'n': string_split(q[i], '=')[1], 'i': i, 'p': q[i]}})), lambda x: x.p) AS sorted FROM s),
u AS (SELECT page_id, lower(CASE WHEN len(q) > 0 THEN path || '?' || array_to_string(sorted, '&') ELSE path END) AS canonical FROM o)
SELECT page_id, canonical, 'web:url:' || substr(sha1(canonical), 1, 16) AS identity FROM u""")
def url_canonical_identity(spark: SparkSession, folder: str) -> DataFrame:
    own, k = F.col("url"), F.col("page_id") % 4
    more = F.concat(own, F.when(own.contains("?"), "&").otherwise("?"), F.lit("k=2&a-b=2&k=1&a=1&utm_source=x"))
    df = table(spark, folder, "pages", ["page_id", "url"]).withColumn("url", F.when(k == 1, more).when(k == 2, F.regexp_extract(own, "^https?://[^/]+", 0)).otherwise(own))
    return df.select("page_id", text.canonical_url(F.col("url")).alias("canonical"), text.identity_key(F.lit("Web "), F.lit(None).cast("string"), F.col("url")).alias("identity"))


@query("""WITH j AS (SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 11 = 0 THEN 'two' ELSE json_extract_string(props, '$.k') END AS raw FROM events)
SELECT event_id, CASE WHEN regexp_full_match(raw, '-?[0-9]{1,9}') THEN CAST(raw AS INTEGER) END AS k, regexp_full_match(raw, '-?[0-9]{1,9}') AS sound FROM j""")
def guarded_cast_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON numbers behind a pattern guard: malformed values are null, never an error."""
    raw = F.when(F.col("event_id") % 11 == 0, "two").otherwise(F.get_json_object("props", "$.k"))
    number = text.guarded(F.col("raw"), "int")
    return table(spark, folder, "events", ["event_id", "props"]).withColumn("raw", raw).select("event_id", number.alias("k"), number.isNotNull().alias("sound"))


@query(f"""WITH {LISTINGS}, s AS (SELECT id, hood, (sqft IS NOT NULL)::INT + (rating IS NOT NULL)::INT + (price_cents > 100000)::INT + (bedrooms >= 2)::INT + (beach_m <= 500)::INT + (bathrooms >= 2)::INT + (confidence >= 0.85)::INT AS signals FROM listings)
SELECT hood, count(*) AS n, count(*) FILTER (WHERE signals >= 3) AS minimal, count(*) FILTER (WHERE signals >= 5) AS rich, CAST(sum(signals) AS BIGINT) AS signals FROM s GROUP BY hood""")
def comp_signal_flags(spark: SparkSession, folder: str) -> DataFrame:
    """How many listings of a hood have enough signals to serve as comparables."""
    c = F.col
    flags = [c("sqft").isNotNull(), c("rating").isNotNull(), c("price_cents") > 100000, c("bedrooms") >= 2, c("beach_m") <= 500, c("bathrooms") >= 2, c("confidence") >= 0.85]
    signals = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    return listings(spark, folder).withColumn("signals", signals).groupBy("hood").agg(
        F.count("*").alias("n"), F.count_if(c("signals") >= 3).alias("minimal"), F.count_if(c("signals") >= 5).alias("rich"), F.sum("signals").cast("long").alias("signals"))


ALIASES = {"red": "crimson", "blue": "azure", "small": "compact", "hot": "heated", "ring": "band", "bolt": "fastener"}


@query("WITH a(raw, canonical) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items()) + """), w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT p_partkey AS id, list_sort(list_distinct(list(COALESCE(canonical, 'unclassified'))))[1] AS first_key, count(canonical) AS known FROM w LEFT JOIN a ON raw = word GROUP BY 1""")
def alias_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a name through an alias dictionary; what it does not hold is unclassified."""
    dictionary = spark.createDataFrame(list(ALIASES.items()), "raw string, canonical string")
    words = table(spark, folder, "part", ["p_partkey", "p_name"]).select(F.col("p_partkey").alias("id"), F.explode(F.split(text.squeezed(F.col("p_name")), " ")).alias("raw"))
    return words.join(F.broadcast(dictionary), "raw", "left").groupBy("id").agg(
        F.array_sort(F.collect_set(F.coalesce("canonical", F.lit("unclassified"))))[0].alias("first_key"), F.count("canonical").alias("known"))


@query("WITH m AS (SELECT map_from_entries([" + ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items()) + """]) AS m)
SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_name, ' '), lambda w: m[w]), lambda k: k IS NOT NULL))), ',') AS keys FROM part, m""")
def amenity_normalize(spark: SparkSession, folder: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return table(spark, folder, "part", ["p_partkey", "p_name"]).select(F.col("p_partkey").alias("id"), F.array_join(text.canonical_amenities(F.split("p_name", " "), names), ",").alias("keys"))


DESCRIPTION = """CASE p_partkey % 6 WHEN 0 THEN 'Studio near the pier, 1 bath' WHEN 1 THEN p_size || 'BR condo, 2.5 baths, 75 Square Meters' WHEN 2 THEN 'Casa de tres recámaras y dos baños' WHEN 3 THEN 'Two-bedroom loft with three bathrooms 1,250 sq ft'
  WHEN 4 THEN p_size || ' habitaciones · 2 baños · $1,234.50 per night' ELSE 'Guest house with garden' END"""
_NUM = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.NUMBER_WORDS.items()) + " END"
_WORDS = "|".join(text.NUMBER_WORDS)


@query(f"""WITH d AS (SELECT p_partkey AS id, lower({DESCRIPTION}) AS t FROM part), x AS (SELECT id, t, TRY_CAST(regexp_extract(t, '\\b([0-9]+)\\s*-?\\s*(br|bedrooms?|habitaciones?)\\b', 1) AS INTEGER) AS n, regexp_extract(t, '\\b({_WORDS})[\\s-]+(bedroom|recámara)', 1) AS w,
  TRY_CAST(regexp_extract(t, '\\b([0-9]+(\\.5)?)\\s*-?\\s*(baths?|baños?)', 1) AS DOUBLE) AS b, regexp_extract(t, '\\b({_WORDS})[\\s-]+(bathrooms?|baños?)', 1) AS bw FROM d)
SELECT id, CAST(CASE WHEN t LIKE '%studio%' THEN 0 WHEN n <= 20 THEN n ELSE {_NUM.format('w')} END AS INTEGER) AS bedrooms, CAST(COALESCE(b, {_NUM.format('bw')}) AS DOUBLE) AS bathrooms,
  CAST(CASE WHEN t LIKE '%1,250 sq ft%' THEN 1250 WHEN t LIKE '%75 square%' THEN 807 END AS BIGINT) AS sqft, CAST(CASE WHEN t LIKE '%$1,234.50%' THEN 1234.5 END AS DOUBLE) AS price FROM x""")
def text_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Bedrooms, bathrooms, size and price read from free text in two languages."""
    d = table(spark, folder, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("id"), F.expr(DESCRIPTION).alias("t"))
    t = F.col("t")
    return d.select("id", text.bedrooms(t).alias("bedrooms"), text.bathrooms(t).alias("bathrooms"), text.sqft(t).alias("sqft"), text.money(t).alias("price"))


LABELS = ["Entire condo", "Guest house", "Private room in home", "Entire serviced apartment", "Vacation home", "Tiny cabin", "Boat"]
LABEL_SQL = "list_extract([" + ", ".join(f"'{x}'" for x in LABELS) + "], CAST(p_partkey % 7 AS INTEGER) + 1)"
_CASES = " ".join(f"WHEN x LIKE '%{k}%' THEN '{v}'" for k, v in text.PROPERTY_TYPES)


@query(f"""WITH l AS (SELECT {LABEL_SQL} AS label FROM part), x AS (SELECT label, lower(label) AS x FROM l)
SELECT CASE {_CASES} ELSE x END AS kind, regexp_matches(x, '\\b(condo|house|apartment|cabin|home)\\b') AND NOT regexp_matches(x, '\\b(room|vacation home)\\b') AS allowed, count(*) AS n FROM x GROUP BY 1, 2""")
def property_type_rules(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "part", ["p_partkey"]).select(F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_partkey") % 7 + 1).cast("int")).alias("label"))
    return labels.groupBy(text.property_type(F.col("label")).alias("kind"), text.allowed_type(F.col("label"), ["condo", "house", "apartment", "cabin", "home"], ["room", "vacation home"]).alias("allowed")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT p_partkey AS id, 'Condo in Town · ★' || (p_partkey % 5) || '.9' || ' · ' || p_size || ' bedrooms · 2 beds · 2 private baths' AS t FROM part)
SELECT id, 'Condo' AS kind, CAST((id % 5) || '.9' AS DOUBLE) AS rating, CAST(regexp_extract(t, '([0-9]+) bedrooms', 1) AS INTEGER) AS bedrooms, 2 AS beds, CAST(2 AS DOUBLE) AS baths FROM t""")
def og_title_parse(spark: SparkSession, folder: str) -> DataFrame:
    title = F.format_string("Condo in Town · ★%d.9 · %d bedrooms · 2 beds · 2 private baths", F.col("p_partkey") % 5, F.col("p_size"))
    return table(spark, folder, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("id"), text.og_title(title).alias("x")).select("id", "x.*")


@query("""WITH n AS (SELECT DISTINCT p_name AS raw, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), k AS (SELECT DISTINCT p_name AS known, split_part(p_name, ' ', 1) AS c, split_part(p_name, ' ', 2) AS d FROM part),
s AS (SELECT raw, known, CASE WHEN raw = known THEN 1.0 WHEN contains(raw, known) OR contains(known, raw) THEN 0.85 WHEN (a = c) <> (b = d) THEN floor((0.30 + 0.5 / 3) * 10000 + 0.5) / 10000 END AS score FROM n JOIN k ON a = c OR b = d)
SELECT raw, rank, known, CAST(score AS DOUBLE) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY raw ORDER BY score DESC, known) AS INTEGER) AS rank FROM s) WHERE rank <= 3""")
def fuzzy_building(spark: SparkSession, folder: str) -> DataFrame:
    """Three best catalogue names of every raw name, of those that share a word with it."""
    names = table(spark, folder, "part", ["p_name"])
    raw, known = names.select(F.col("p_name").alias("raw")).distinct(), names.select(F.col("p_name").alias("known")).distinct()
    words = lambda c: F.explode(text.name_tokens(F.col(c), [])).alias("word")
    met = raw.select("raw", words("raw")).join(known.select("known", words("known")), "word").select("raw", "known").distinct()
    scored = met.withColumn("score", half_up(text.name_score(F.col("raw"), F.col("known"), []), 4))
    return top_per_key(scored, ["raw"], [F.desc("score"), F.asc("known")], 3).select("raw", "rank", "known", "score")


@query("""SELECT page_id, len(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN length(html) < 500 THEN 'unusable' ELSE 'ok' END AS verdict FROM pages""")
def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "pages", ["page_id", "html"])
    return df.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)">'), F.lit(1))).cast("long").alias("links"),
                     F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), page_source.usability(F.lit(200), F.col("html")).alias("verdict"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"]*)">', 1) AS href, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS name FROM pages),
z AS (SELECT page_id, unnest(range(0, least(len(href), len(name)))) AS position, href, name FROM l)
SELECT page_id, CAST(position AS INTEGER) AS position, href[position + 1] AS href, name[position + 1] AS name FROM z""")
def page_positional_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Streams of matches zipped by position, as long as the shortest."""
    df = table(spark, folder, "pages", ["page_id", "html"])
    return page_source.arrivals(df, "html", {"href": '<li><a href="/([^"]*)">', "name": '<li><a href="[^"]*">([^<]*)</a>'})


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 3 = 0 THEN 4 WHEN o_orderkey % 3 = 1 THEN 9 ELSE 1 END AS INTEGER), '%Y-%m-%d') AS "end", 'u' || o_orderkey AS uid FROM orders""")
def ical_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of synthetic calendars: with an end, with a duration, with neither."""
    from staylens.sources import ical

    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    tail = F.when(k % 3 == 0, F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 4), "yyyyMMdd"))).when(k % 3 == 1, F.lit("DURATION:P1W2D")).otherwise(F.lit("STATUS:CONFIRMED"))
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u"), k.cast("string"), F.lit("\r\nSUMMARY:Res\r\n erved\r\nDTSTART;VALUE=DATE:"), d, F.lit("\r\n"), tail, F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    texts = table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]).select(k.alias("id"), body.alias("text"))
    return ical.events(texts).select("id", "start", "end", "uid")


@query(f"""WITH {LISTINGS} SELECT id, floor((15 + 10 + (CASE WHEN price_cents > 0 THEN 20 ELSE 0 END) + (CASE WHEN rating BETWEEN 0 AND 5 THEN 8 ELSE 0 END) + (CASE WHEN len(amenities) > 0 THEN 5 ELSE 0 END)) / 100.0 * 1000 + 0.5) / 1000 AS score FROM listings""")
def listing_confidence(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    fields = {"bedrooms": c("bedrooms") >= 0, "bathrooms": c("bathrooms") > 0, "price": c("price_cents") > 0, "rating": c("rating").between(0, 5), "amenities": F.size("amenities") > 0}
    return listings(spark, folder).select("id", text.confidence(fields).alias("score"))
