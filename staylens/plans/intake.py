"""Intake: raw listings, buckets of places, amenity keys, building names, merged signals, page parsers, job and dictionary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions import numbers, text
from staylens.functions.numbers import half_up
from staylens.operators import buildings, comp_signals, stats, upserts
from staylens.operators.latest import first_per_key
from staylens.plans.registry import query
from staylens.plans.standins import EVENTS_AS_OF, LISTINGS, QUOTES, listings, quotes
from staylens.sources import listing_pages as listing_pages_source
from staylens.sources import pages as page_source
from staylens.sources.tables import table

#: fixed values: buckets in their order with the words that tell them, and their region
BUCKETS = [
    ("Zona Romántica", "puerto_vallarta", ["zona romántica", "zona romantica", "romantic zone"]), ("Amapas / Conchas Chinas", "puerto_vallarta", ["amapas", "conchas chinas"]),
    ("Centro / Alta Vista", "puerto_vallarta", ["el centro", "centro vallarta", "alta vista", "downtown vallarta"]), ("Hotel Zone / Malecón", "puerto_vallarta", ["hotel zone", "zona hotelera", "malecón", "malecon", "las glorias"]),
    ("5 de Diciembre", "puerto_vallarta", ["5 de diciembre", "cinco de diciembre", "5-de-diciembre"]), ("Old Town", "puerto_vallarta", ["old town"]), ("Versalles", "puerto_vallarta", ["versalles", "versailles"]),
    ("Marina Vallarta", "puerto_vallarta", ["marina vallarta"]), ("Mismaloya", "puerto_vallarta", ["mismaloya", "boca de tomatlán", "boca de tomatlan", "yelapa"]), ("Nuevo Vallarta", "riviera_nayarit", ["nuevo vallarta", "nuevo-vallarta"]),
    ("Bucerías", "riviera_nayarit", ["bucerías", "bucerias"]), ("La Cruz de Huanacaxtle", "riviera_nayarit", ["la cruz de huanacaxtle", "la cruz", "huanacaxtle"]), ("Punta Mita", "riviera_nayarit", ["punta mita", "punta de mita"]),
    ("El Anclote", "riviera_nayarit", ["el anclote", "anclote"]), ("Sayulita", "riviera_nayarit", ["sayulita"]), ("San Pancho", "riviera_nayarit", ["san pancho", "san francisco, nayarit"]),
]
#: fixed values: names that are a canonical neighbourhood, with its bucket where it has one
CANONICAL = {
    "zona romantica": ("Zona Romantica", "Zona Romántica"), "amapas": ("Amapas", "Amapas / Conchas Chinas"), "mismaloya": ("Mismaloya", "Mismaloya"), "old town": ("Old Town", "Old Town"), "centro": ("Centro", "Centro / Alta Vista"),
    "5 de diciembre": ("5 de Diciembre", "5 de Diciembre"), "hotel zone": ("Hotel Zone", "Hotel Zone / Malecón"), "versalles": ("Versalles", "Versalles"), "marina vallarta": ("Marina Vallarta", "Marina Vallarta"), "pitillal": ("Pitillal", None),
    "fluvial vallarta": ("Fluvial Vallarta", None), "nuevo vallarta": ("Nuevo Vallarta", "Nuevo Vallarta"), "bucerias": ("Bucerias", "Bucerías"), "la cruz de huanacaxtle": ("La Cruz de Huanacaxtle", "La Cruz de Huanacaxtle"),
    "punta mita": ("Punta Mita", "Punta Mita"), "el anclote": ("El Anclote", "El Anclote"), "sayulita": ("Sayulita", "Sayulita"), "san pancho": ("San Pancho", "San Pancho")}
#: fixed values: words that tell the region
REGIONS = {"riviera_nayarit": ["riviera nayarit", "nayarit", "bahia de banderas", "bahía de banderas"], "puerto_vallarta": ["puerto vallarta", "vallarta, jalisco", "jalisco", "pv,", "pv "]}
#: fixed values: market box and boxes of neighbourhoods, the first that holds a point counts
MARKET_BOX = (20.5, 20.85, -105.6, -105.18)
BOXES = [
    ("Zona Romantica", 20.598, 20.616, -105.246, -105.230), ("Amapas", 20.586, 20.600, -105.248, -105.230), ("Conchas Chinas", 20.574, 20.590, -105.253, -105.235), ("Centro", 20.616, 20.638, -105.245, -105.222),
    ("Marina Vallarta", 20.665, 20.700, -105.280, -105.240), ("Nuevo Vallarta", 20.700, 20.760, -105.310, -105.270), ("Bucerias", 20.745, 20.775, -105.345, -105.310), ("Punta Mita", 20.762, 20.800, -105.550, -105.480),
    ("Versalles", 20.625, 20.650, -105.255, -105.230), ("Fluvial", 20.640, 20.668, -105.265, -105.240)]
#: fixed values: price above which a night is flagged, and ratings' range
PRICE_FLAG, RATING_MAX = 50_000, 5
#: fixed values: hosts of the platforms, the first that a URL holds counts
HOSTS = [("pvrpv", ["pvrpv.com"]), ("airbnb", ["airbnb.com"]), ("vrbo", ["vrbo.com", "homeaway.com"])]


def pick(names: list, by: Column) -> Column:
    """An entry of a short list by number, for stand-in columns."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))


def pick_sql(names: list, by: str) -> str:
    return "list_extract([" + ", ".join("NULL" if x is None else "'" + str(x).replace("'", "''") + "'" for x in names) + f"], CAST({by} % {len(names)} AS INTEGER) + 1)"


def first_containing(x: Column, named: list[tuple[str, list[str]]]) -> Column:
    """The first name one of whose words the text contains, null without any."""
    holds = lambda words: reduce(lambda a, b: a | b, [x.contains(w) for w in words])
    return reduce(lambda a, kv: a.when(holds(kv[1]), kv[0]), named, F)


def contains_sql(x: str, named: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in named) + " END"


# ---- places

def place_bucket(raw: Column) -> Column:
    """Struct (canonical, bucket, region, confidence) of a free location text: exact name, word of a bucket, region alone, unknown."""
    x = F.trim(F.coalesce(raw, F.lit("")))
    low = F.lower(x)
    names = F.create_map(*[F.lit(v) for k, (name, bucket) in CANONICAL.items() for v in (k, f"{name}|{bucket or ''}")])
    entry = F.try_element_at(names, text.plain(x))
    canonical, bucket = F.split_part(entry, F.lit("|"), F.lit(1)), F.nullif(F.split_part(entry, F.lit("|"), F.lit(2)), F.lit(""))
    inferred = first_containing(low, [(b, words) for b, _, words in BUCKETS])
    region = first_containing(low, list(REGIONS.items()))
    chosen = F.when(entry.isNotNull(), bucket).otherwise(inferred)
    of_bucket = reduce(lambda a, b: a.when(chosen == b[0], b[1]), BUCKETS, F)
    confidence = F.when(entry.isNotNull() & bucket.isNotNull(), "exact").when(entry.isNotNull(), "high").when(inferred.isNotNull() | region.isNotNull(), "inferred").otherwise("unknown")
    return F.struct(canonical.alias("canonical"), chosen.alias("bucket"), F.coalesce(of_bucket, region).alias("region"), confidence.alias("confidence"))


PLACES = ["Zona Romantica", " amapas ", "Pitillal", "Condo near Conchas Chinas beach", "Pitillal, Jalisco", "somewhere in Nayarit", "", "Mars", "Sayulita", "Romantic Zone, PV", None, "Centro", "Punta de Mita, Nayarit", "Fluvial Vallarta", "Hotel Zone", "near Yelapa", "La Cruz", "el anclote"]
_CANON_SQL = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{n}|{b or ''}'" for k, (n, b) in CANONICAL.items()) + " END"


@query(f"""WITH p AS (SELECT p_partkey AS id, trim(COALESCE({pick_sql(PLACES, 'p_partkey')}, '')) AS x FROM part), e AS (SELECT id, x, {_CANON_SQL} AS entry, {contains_sql('lower(x)', [(b, w) for b, _, w in BUCKETS])} AS inferred, {contains_sql('lower(x)', list(REGIONS.items()))} AS hint FROM p),
c AS (SELECT id, entry, inferred, hint, nullif(split_part(entry, '|', 1), '') AS canonical, CASE WHEN entry IS NOT NULL THEN nullif(split_part(entry, '|', 2), '') ELSE inferred END AS bucket FROM e)
SELECT id, canonical, bucket, COALESCE(CASE bucket """ + " ".join(f"WHEN '{b}' THEN '{r}'" for b, r, _ in BUCKETS) + """ END, hint) AS region, CASE WHEN entry IS NOT NULL AND bucket IS NOT NULL THEN 'exact' WHEN entry IS NOT NULL THEN 'high' WHEN inferred IS NOT NULL OR hint IS NOT NULL THEN 'inferred' ELSE 'unknown' END AS confidence FROM c""")
def bucket_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Free location texts as buckets with their confidence."""
    return table(spark, folder, "part", ["p_partkey"]).select(F.col("p_partkey").alias("id"), place_bucket(pick(PLACES, F.col("p_partkey"))).alias("x")).select("id", "x.*")


def in_box(lat: Column, lon: Column, box: tuple) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


@query("""WITH s AS (SELECT s_suppkey AS id, 20.48::DOUBLE + (s_suppkey % 100) * 0.004::DOUBLE AS lat, -105.6::DOUBLE + (s_suppkey % 37) * 0.011::DOUBLE AS lon FROM supplier)
SELECT id, lat BETWEEN 20.5::DOUBLE AND 20.85::DOUBLE AND lon BETWEEN -105.6::DOUBLE AND -105.18::DOUBLE AS in_market, CASE """ + " ".join(f"WHEN lat BETWEEN {a}::DOUBLE AND {b}::DOUBLE AND lon BETWEEN {c}::DOUBLE AND {d}::DOUBLE THEN '{n}'" for n, a, b, c, d in BOXES) + " END AS hood FROM s")
def bounding_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Points in the market's box, and the first neighbourhood box that holds them."""
    k = F.col("s_suppkey")
    points = table(spark, folder, "supplier", ["s_suppkey"]).select(k.alias("id"), (F.lit(20.48) + (k % 100) * F.lit(0.004)).alias("lat"), (F.lit(-105.6) + (k % 37) * F.lit(0.011)).alias("lon"))
    lat, lon = F.col("lat"), F.col("lon")
    return points.select("id", in_box(lat, lon, MARKET_BOX).alias("in_market"), reduce(lambda a, b: a.when(in_box(lat, lon, b[1:]), b[0]), BOXES, F).alias("hood"))


# ---- identities

def bare_id(x: Column) -> Column:
    """External id without the prefix of older code paths."""
    return F.regexp_replace(x, "^ABB-", "")


def url_source(url: Column) -> Column:
    return first_containing(url, HOSTS)


URLS = ["https://www.airbnb.com/rooms/{}", "https://www.vrbo.com/{}", "https://pvrpv.com/x/{}", "https://homeaway.com/{}", "https://other.net/{}"]


@query(f"""WITH u AS (SELECT p_partkey AS id, replace({pick_sql(URLS, 'p_partkey')}, '{{}}', CAST(p_partkey AS VARCHAR)) AS url, CASE WHEN p_partkey % 3 = 0 THEN 'ABB-' ELSE '' END || CAST(p_partkey * 7919 AS VARCHAR) AS ext FROM part)
SELECT id, {contains_sql('url', HOSTS)} AS source, replace(ext, 'ABB-', '') AS external_id, length(replace(ext, 'ABB-', '')) IN (7, 8) AS sound FROM u""")
def source_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Platform of a URL, external id without prefix, and whether its length is one that the platform gives."""
    k = F.col("p_partkey")
    x = table(spark, folder, "part", ["p_partkey"]).select(k.alias("id"), F.replace(pick(URLS, k), F.lit("{}"), k.cast("string")).alias("url"), F.concat(F.when(k % 3 == 0, "ABB-").otherwise(""), (k * 7919).cast("string")).alias("ext"))
    own = bare_id(F.col("ext"))
    return x.select("id", url_source(F.col("url")).alias("source"), own.alias("external_id"), F.length(own).isin(7, 8).alias("sound"))


@query(f"""WITH {LISTINGS}, {QUOTES}, o AS (SELECT listing_id, min(seen_at) AS first_at, max(seen_at) AS last_at, count(*) AS n FROM quotes GROUP BY 1)
SELECT id, 'airbnb:' || id AS identity_key, first_at AS first_seen_at, last_at AS last_seen_at, COALESCE(n, 0) AS seen_count, CASE WHEN last_at IS NULL THEN 'unseen' WHEN last_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY THEN 'active' ELSE 'stale' END AS lifecycle FROM listings LEFT JOIN o ON listing_id = id""", stamps=["first_seen_at", "last_seen_at"])
def identity_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Identity key, sightings and lifecycle of every listing from the log of observations."""
    seen = quotes(spark, folder).groupBy(F.col("listing_id").alias("id")).agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("n"))
    fresh = F.lit(f"{EVENTS_AS_OF} 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    key = text.identity_key(F.lit("Airbnb"), F.col("id").cast("string"), F.lit(None).cast("string"))
    return listings(spark, folder).select("id").join(seen, "id", "left").select(
        "id", key.alias("identity_key"), "first_seen_at", "last_seen_at", F.coalesce("n", F.lit(0)).alias("seen_count"), F.when(F.col("last_seen_at").isNull(), "unseen").when(F.col("last_seen_at") >= fresh, "active").otherwise("stale").alias("lifecycle"))


# ---- raw listings

#: fixed values: warnings of raw listings
NO_PLACE, NO_BEDROOMS, NO_BATHROOMS = 'Neighborhood not recognized: "%s"', "bedrooms missing — defaulted to 0 (studio)", "bathrooms missing or zero"


def clean_rating(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), numbers.clamp(x, 0.0, float(RATING_MAX)))


def clean_price(x: Column) -> Column:
    return F.when(x > 0, x)


def normalised(raw: DataFrame) -> DataFrame:
    """Listing records from raw ones (id, title, url, place, bedrooms, bathrooms, amenities, rating, reviews, price, latitude, longitude, guests) with confidence and warnings."""
    c = F.col
    place = place_bucket(c("place"))
    x = raw.withColumn("hood", F.coalesce(place["canonical"], F.lit("unclassified")))
    clean = x.withColumns({"rooms": F.greatest(F.lit(0), F.coalesce(half_up(c("bedrooms")), F.lit(0))), "baths": F.greatest(F.lit(0.0), F.coalesce("bathrooms", F.lit(0.0))), "rate": clean_price(c("price")), "stars": clean_rating(c("rating"))})
    filled = {"title": F.length("title") > 0, "url": F.length("url") > 0, "hood": c("hood") != "unclassified", "bedrooms": c("rooms") >= 0, "bathrooms": c("baths") > 0, "price": c("rate") > 0, "rating": c("stars").isNotNull(), "reviews": c("reviews") >= 0,
              "latitude": c("latitude").isNotNull(), "longitude": c("longitude").isNotNull(), "guests": c("guests") > 0, "amenities": F.size("amenities") > 0}
    warnings = [
        F.when(c("hood") == "unclassified", F.format_string(NO_PLACE, F.trim(F.coalesce("place", F.lit(""))))), F.when(c("bedrooms").isNull(), NO_BEDROOMS), F.when(c("baths") == 0, NO_BATHROOMS),
        F.when(c("price") <= 0, "price rejected"), F.when(c("price") > PRICE_FLAG, "price flagged"), F.when((c("rating") < 0) | (c("rating") > RATING_MAX), "rating clamped")]
    return clean.select("id", "hood", c("rooms").alias("bedrooms"), c("baths").alias("bathrooms"), c("rate").alias("price"), c("stars").alias("rating"), text.confidence({k: F.coalesce(v, F.lit(False)) for k, v in filled.items()}).alias("confidence"),
                        F.array_join(F.filter(F.array(*warnings), lambda w: w.isNotNull()), " | ").alias("warnings"))


_RAW_SQL = f"""raw AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'https://x/' || p_partkey END AS url, {pick_sql(PLACES, 'p_partkey')} AS place, CASE WHEN p_size % 11 <> 0 THEN p_size % 5 END::DOUBLE AS bedrooms, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 3) * 0.5::DOUBLE END AS bathrooms,
  (p_partkey % 14) * 0.5::DOUBLE - 1 AS rating, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 100 END AS reviews, CASE WHEN p_partkey % 9 = 0 THEN -1 WHEN p_partkey % 23 = 0 THEN 60000 ELSE p_retailprice END::DOUBLE AS price, CASE WHEN p_partkey % 5 <> 0 THEN 20.6::DOUBLE END AS latitude, CASE WHEN p_partkey % 5 <> 0 THEN -105.2::DOUBLE END AS longitude, p_size % 6 AS guests FROM part)"""


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part", ["p_partkey", "p_name", "p_size", "p_retailprice"]).select(
        k.alias("id"), F.col("p_name").alias("title"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("https://x/"), k.cast("string"))).alias("url"), pick(PLACES, k).alias("place"), F.when(s % 11 != 0, (s % 5).cast("double")).alias("bedrooms"),
        F.when(s % 7 != 0, (s % 3) * F.lit(0.5)).alias("bathrooms"), F.split("p_name", " ").alias("amenities"), ((k % 14) * F.lit(0.5) - 1).alias("rating"), F.when(k % 8 != 0, k % 100).alias("reviews"),
        F.when(k % 9 == 0, F.lit(-1.0)).when(k % 23 == 0, F.lit(60_000.0)).otherwise(F.col("p_retailprice")).alias("price"), F.when(k % 5 != 0, F.lit(20.6)).alias("latitude"), F.when(k % 5 != 0, F.lit(-105.2)).alias("longitude"), (s % 6).alias("guests"))


@query(f"""WITH {_RAW_SQL}, n AS (SELECT *, trim(COALESCE(place, '')) AS x FROM raw), c AS (SELECT *, COALESCE(split_part({_CANON_SQL}, '|', 1), 'unclassified') AS hood, greatest(0, COALESCE(CAST(floor(bedrooms + 0.5) AS BIGINT), 0)) AS rooms, greatest(0, COALESCE(bathrooms, 0)) AS baths, CASE WHEN price > 0 THEN price END AS rate, greatest(0, least(5, rating)) AS stars FROM n)
SELECT id, hood, rooms AS bedrooms, baths AS bathrooms, rate AS price, stars AS rating, floor(((CASE WHEN length(title) > 0 THEN 5 ELSE 0 END) + (CASE WHEN length(url) > 0 THEN 5 ELSE 0 END) + (CASE WHEN hood <> 'unclassified' THEN 10 ELSE 0 END) + 15 + (CASE WHEN baths > 0 THEN 10 ELSE 0 END) + (CASE WHEN rate > 0 THEN 20 ELSE 0 END) + 8
  + (CASE WHEN reviews >= 0 THEN 7 ELSE 0 END) + (CASE WHEN latitude IS NOT NULL THEN 5 ELSE 0 END) + (CASE WHEN longitude IS NOT NULL THEN 5 ELSE 0 END) + (CASE WHEN guests > 0 THEN 5 ELSE 0 END) + 5) / 100.0::DOUBLE * 1000 + 0.5) / 1000 AS confidence,
  array_to_string(list_filter([CASE WHEN hood = 'unclassified' THEN 'Neighborhood not recognized: "' || x || '"' END, CASE WHEN bedrooms IS NULL THEN 'bedrooms missing — defaulted to 0 (studio)' END, CASE WHEN baths = 0 THEN 'bathrooms missing or zero' END, CASE WHEN price <= 0 THEN 'price rejected' END, CASE WHEN price > 50000 THEN 'price flagged' END,
  CASE WHEN rating < 0 OR rating > 5 THEN 'rating clamped' END], lambda w: w IS NOT NULL), ' | ') AS warnings FROM c""")
def listing_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Raw listings normalised: place, rooms, prices and ratings in range, confidence over twelve checks, warnings."""
    return normalised(_raw(spark, folder))


@query(f"""WITH {_RAW_SQL} SELECT id, (place IS NOT NULL)::INT + (bedrooms IS NOT NULL)::INT + (bathrooms IS NOT NULL)::INT + (rating IS NOT NULL)::INT + (reviews IS NOT NULL)::INT + (price > 0)::INT + (latitude IS NOT NULL)::INT + (longitude IS NOT NULL)::INT + (length(url) > 0)::INT AS filled FROM raw""")
def field_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many fields of a raw record hold something."""
    c = F.col
    flags = [c(x).isNotNull() for x in ("place", "bedrooms", "bathrooms", "rating", "reviews")] + [c("price") > 0, c("latitude").isNotNull(), c("longitude").isNotNull(), F.length("url") > 0]
    return _raw(spark, folder).select("id", reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags]).alias("filled"))


# ---- amenities and buildings

#: fixed values: amenity keys by category, and names that stand for them
AMENITY_KEYS = {"pool": "water", "shared_pool": "water", "gated_community": "building", "pet_friendly": "rules", "dedicated_workspace": "work", "hot_tub": "water"}
AMENITY_NAMES = {"gated community": "gated_community", "gated": "gated_community", "pets": "pet_friendly", "pet friendly": "pet_friendly", "workspace": "dedicated_workspace", "home office": "dedicated_workspace"}
RAW_KEYS = ["pool", "Shared Pool", "pets", "gated", "fast workspace desk", "hot-tub", "helipad", "Pet  Friendly", "office", None]


def amenity_key(raw: Column) -> Column:
    """Struct (canonical, suggested): the key itself, its underscored form, a name for it, else a name that contains it or that it contains."""
    spaced = F.regexp_replace(F.trim(F.lower(raw)), "[_-]", " ")
    underscored = F.regexp_replace(spaced, r"\s+", "_")
    keys = list(AMENITY_KEYS)
    named = reduce(lambda a, kv: a.when(spaced == kv[0], kv[1]), AMENITY_NAMES.items(), F)
    near = reduce(lambda a, kv: a.when(spaced.contains(kv[0]) | F.lit(kv[0]).contains(spaced), kv[1]), AMENITY_NAMES.items(), F)
    canonical = F.when(raw.isin(*keys), raw).when(underscored.isin(*keys), underscored).otherwise(named)
    return F.struct(canonical.alias("canonical"), F.when(canonical.isNull(), near).alias("suggested"))


_KEYS_SQL = "(" + ", ".join(f"'{k}'" for k in AMENITY_KEYS) + ")"


@query(f"""WITH r AS (SELECT p_partkey AS id, {pick_sql(RAW_KEYS, 'p_partkey')} AS raw FROM part), s AS (SELECT id, raw, regexp_replace(trim(lower(raw)), '[_-]', ' ', 'g') AS sp FROM r),
c AS (SELECT id, sp, CASE WHEN raw IN {_KEYS_SQL} THEN raw WHEN regexp_replace(sp, '\\s+', '_', 'g') IN {_KEYS_SQL} THEN regexp_replace(sp, '\\s+', '_', 'g') ELSE CASE sp {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AMENITY_NAMES.items())} END END AS canonical FROM s)
SELECT id, canonical, CASE WHEN canonical IS NULL THEN CASE {" ".join(f"WHEN contains(sp, '{k}') OR contains('{k}', sp) THEN '{v}'" for k, v in AMENITY_NAMES.items())} END END AS suggested FROM c""")
def amenity_key_check(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part", ["p_partkey"]).select(F.col("p_partkey").alias("id"), amenity_key(pick(RAW_KEYS, F.col("p_partkey"))).alias("x")).select("id", "x.*")


@query(f"""WITH r AS (SELECT p_partkey AS id, {pick_sql(RAW_KEYS, 'p_partkey')} AS raw FROM part), s AS (SELECT id, raw, regexp_replace(trim(lower(raw)), '[_-]', ' ', 'g') AS sp FROM r),
c AS (SELECT id, CASE WHEN raw IN {_KEYS_SQL} THEN raw WHEN regexp_replace(sp, '\\s+', '_', 'g') IN {_KEYS_SQL} THEN regexp_replace(sp, '\\s+', '_', 'g') ELSE CASE sp {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AMENITY_NAMES.items())} END END AS key FROM s),
k AS (SELECT CASE key {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AMENITY_KEYS.items())} END AS category, key, count(DISTINCT id) AS n FROM c WHERE key IS NOT NULL GROUP BY 1, 2)
SELECT category, string_agg(key, ',' ORDER BY key) AS keys, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""")
def amenity_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that listings have by category, with how often."""
    found = table(spark, folder, "part", ["p_partkey"]).select(F.col("p_partkey").alias("id"), amenity_key(pick(RAW_KEYS, F.col("p_partkey")))["canonical"].alias("key"))
    kinds = F.create_map(*[F.lit(v) for pair in AMENITY_KEYS.items() for v in pair])
    counted = found.filter("key IS NOT NULL").groupBy(F.element_at(kinds, F.col("key")).alias("category"), "key").agg(F.count_distinct("id").alias("n"))
    return counted.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"), F.sum("n").alias("n"))


#: fixed values: raw building names that are units of a building
BUILDING_ALIASES = {
    "Estrellita Del Mar 303 Star Light": "Estrellita Del Mar", "Estrellita Del Mar 202": "Estrellita Del Mar", "Estrellita Del Mar 102": "Estrellita Del Mar", "Paramount Bay Villa Serena": "Paramount Bay",
    "Rincon De Almas 207 Rinconcillo": "Rincon De Almas", "Rincon De Almas Casa Sammy": "Rincon De Almas", "Molino De Agua 701 Beach House": "Molino De Agua", "Loma Del Mar C9 Sofias Casa Del Sol": "Loma Del Mar",
    "Loma Del Mar A14": "Loma Del Mar", "Loma Del Mar B21": "Loma Del Mar", "Loma Del Mar D22": "Loma Del Mar", "Playa Bonita Casa De Los Abuelos": "Playa Bonita", "Playa Bonita Apartamento Para Amigos": "Playa Bonita",
    "Playa Bonita Casa Amistosa": "Playa Bonita", "Playa Bonita Casa De Risa": "Playa Bonita", "Selva Romantica Casa Cameron": "Selva Romantica", "Selva Romantica Casa Leone": "Selva Romantica",
    "Selva Romantica Villa Del Cielo": "Selva Romantica", "Selva Romantica Paraiso": "Selva Romantica", "Selva Romantica Amazonas": "Selva Romantica", "Selva Romantica Safari": "Selva Romantica", "Sayan Tropical Suite": "Sayan Tropical",
    "Andrew Christian Sayan Beach": "Sayan Beach", "Sayan Beach Casa Marriott": "Sayan Beach", "Orchid 7e La Maravilla De Orchid": "Orchid", "Avalon Zen Treetop Retreat": "Avalon Zen", "V177 Ph": "V177", "Pacifica 404 Casa Astro": "Pacifica",
    "Rivera Cuale Casa Camartiz": "Rivera Cuale",
}
RAW_BUILDINGS = [*BUILDING_ALIASES, "V177", "Loma Del Mar", "Unknown Tower"]


def canonical_building(raw: Column) -> Column:
    """The building of a raw name; names that are no alias stand for themselves, empty ones for none."""
    names = F.create_map(*[F.lit(x) for kv in BUILDING_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, raw), F.nullif(F.trim(raw), F.lit("")))


@query(f"""WITH {LISTINGS}, r AS (SELECT {pick_sql(RAW_BUILDINGS, 'id')} AS raw, hood, price_cents FROM listings), g AS (SELECT raw, hood, count(*) AS cnt, floor(median(price_cents) + 0.5) AS med FROM r GROUP BY 1, 2), m(k, v) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in BUILDING_ALIASES.items()) + """)
SELECT COALESCE(v, raw) AS building, hood, CAST(sum(cnt) AS BIGINT) AS n, CAST(floor(median(med) + 0.5) AS BIGINT) AS median, CAST(floor(sum(med) / count(*) + 0.5) AS BIGINT) AS mean, sum(cnt) < 3 AS thin FROM g LEFT JOIN m ON k = raw GROUP BY 1, 2""")
def building_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Raw building rows rolled up to their building: counts added, the median of the rows' medians; fewer than three listings are thin."""
    rows = listings(spark, folder).select(pick(RAW_BUILDINGS, F.col("id")).alias("raw"), "hood", "price_cents").groupBy("raw", "hood").agg(F.count("*").alias("cnt"), half_up(F.median("price_cents")).alias("med"))
    return rows.groupBy(canonical_building(F.col("raw")).alias("building"), "hood").agg(
        F.sum("cnt").alias("n"), half_up(F.median("med")).alias("median"), half_up(F.sum("med") / F.count("*")).alias("mean"), (F.sum("cnt") < 3).alias("thin"))


# ---- merged signals of three sources

_SOURCES_SQL = """master AS (SELECT id, CASE WHEN id % 19 = 0 THEN 'vrbo' ELSE 'airbnb' END AS platform, 'A' || id AS external_id, CASE WHEN id % 10 <> 0 THEN 'https://x/' || id END AS url, CASE WHEN id % 6 <> 0 THEN hood END AS bucket, CASE WHEN id % 4 <> 0 THEN 20.6::DOUBLE END AS latitude, CASE WHEN id % 8 <> 0 THEN -105.2::DOUBLE END AS longitude,
  CASE WHEN id % 3 = 0 THEN building END AS title FROM listings),
obs AS (SELECT id, listing_id, seen_at, CASE WHEN amount % 5 <> 0 THEN amount END AS nightly, CASE WHEN id % 4 <> 0 THEN 'USD' END AS currency, CASE WHEN id % 3 = 0 THEN 4.5::DOUBLE END AS rating, CASE WHEN id % 2 = 0 THEN CAST(id % 300 AS INTEGER) END AS reviews, CASE WHEN id % 7 = 0 THEN 'card ' || id END AS title,
  'Old Town' AS bucket, CASE WHEN id % 5 = 0 THEN '{"stayLengthNights": "' || (id % 9) || '"}' WHEN id % 5 = 1 THEN '{"stayLengthNights": "two"}' END AS seed FROM quotes WHERE kind <> 'purchase'),
det AS (SELECT id, listing_id, seen_at AS enriched_at, CASE WHEN kind = 'error' THEN 'failed' ELSE 'ok' END AS status, json_extract_string(props, '$.k') AS k FROM quotes),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY seen_at DESC, id DESC) AS r FROM obs) WHERE r = 1),
d AS (SELECT *, CASE WHEN id % 3 = 0 THEN TRY_CAST(k AS DOUBLE) END AS d_rating, CASE WHEN id % 2 = 0 THEN TRY_CAST(k AS INTEGER) END AS d_reviews, CASE WHEN id % 5 = 0 THEN 20 + id % 10 / 10::DOUBLE END AS d_lat, CASE WHEN id % 5 <> 1 THEN CAST(id % 12 AS INTEGER) END AS guests, CASE WHEN id % 4 = 0 THEN 3 END AS beds,
  CASE WHEN id % 3 <> 1 THEN 'Condo' END AS kind, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS pets, CASE WHEN id % 11 = 0 THEN 'detail ' || id END AS d_title FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY enriched_at DESC, id DESC) AS r FROM det WHERE status = 'ok') WHERE r = 1),
m AS (SELECT l.id, l.external_id, l.url, COALESCE(l.bucket, o.bucket) AS bucket, COALESCE(d.d_lat, l.latitude) AS lat, l.longitude AS lng, nightly, currency, CASE WHEN o.id % 5 = 0 THEN CAST(o.id % 9 AS INTEGER) END AS stay_nights, COALESCE(d.d_rating, o.rating) AS rating, COALESCE(d.d_reviews, o.reviews) AS reviews,
  guests, beds, d.kind, pets, COALESCE(d_title, o.title, l.title) AS title, d.id IS NOT NULL AS has_detail FROM master l LEFT JOIN o ON o.listing_id = l.id LEFT JOIN d ON d.listing_id = l.id WHERE platform = 'airbnb'),
s AS (SELECT *, nightly IS NOT NULL AND currency IS NOT NULL AS has_price, lat IS NOT NULL AND lng IS NOT NULL AS has_geo, rating IS NOT NULL AND reviews IS NOT NULL AS has_rating, bucket IS NOT NULL AND nightly IS NOT NULL AND currency IS NOT NULL AND url IS NOT NULL AS minimal FROM m),
signals AS (SELECT *, minimal AND has_rating::INT + has_geo::INT + (guests IS NOT NULL)::INT + (beds IS NOT NULL)::INT + (kind IS NOT NULL)::INT + (title IS NOT NULL)::INT >= 3 AS rich FROM s)"""


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    c, q = F.col, quotes(spark, folder)
    k, none = c("id"), F.lit(None).cast("string")
    master = listings(spark, folder).select(
        "id", F.when(k % 19 == 0, "vrbo").otherwise("airbnb").alias("platform"), F.concat(F.lit("A"), k).alias("external_id"), F.when(k % 10 != 0, F.concat(F.lit("https://x/"), k)).alias("url"), F.when(k % 6 != 0, c("hood")).alias("bucket"), none.alias("region"),
        F.when(k % 4 != 0, F.lit(20.6)).alias("latitude"), F.when(k % 8 != 0, F.lit(-105.2)).alias("longitude"), F.when(k % 3 == 0, c("building")).alias("title"))
    seed = F.when(k % 5 == 0, F.concat(F.lit('{"stayLengthNights": "'), k % 9, F.lit('"}'))).when(k % 5 == 1, '{"stayLengthNights": "two"}')
    seen = q.filter("kind <> 'purchase'").select(
        "id", "listing_id", F.lit("airbnb").alias("platform"), c("seen_at").alias("observed_at"), c("amount").alias("total"), F.when(c("amount") % 5 != 0, c("amount")).alias("nightly"), F.when(k % 4 != 0, "USD").alias("currency"), F.when(k % 3 == 0, F.lit(4.5)).alias("rating"),
        F.when(k % 2 == 0, (k % 300).cast("int")).alias("reviews"), F.when(k % 7 == 0, F.concat(F.lit("card "), k)).alias("title"), F.lit("near the beach").alias("location"), F.lit("Old Town").alias("bucket"), none.alias("region"), seed.alias("seed"))
    said = F.to_json(F.struct(
        F.when(k % 3 == 0, F.get_json_object("props", "$.k")).otherwise(F.lit("four")).alias("ratingOverall"), F.when(k % 2 == 0, F.get_json_object("props", "$.k")).alias("reviewCount"), F.when(k % 5 == 0, 20 + k % 10 / F.lit(10.0)).alias("latitude"),
        F.when(k % 5 != 1, (k % 12).cast("string")).otherwise("two").alias("maxGuests"), F.when(k % 4 == 0, F.lit(3)).alias("bedCount"), F.when(k % 3 != 1, "Condo").alias("propertyType"),
        F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "false").otherwise("maybe").alias("petsAllowed"), F.when(k % 11 == 0, F.concat(F.lit("detail "), k)).alias("title")))
    told = q.select("id", "listing_id", c("seen_at").alias("enriched_at"), F.when(c("kind") == "error", "failed").otherwise("ok").alias("status"), F.lit("v1").alias("version"), said.alias("fields"))
    return comp_signals.comp_signals(master, seen, told)


@query(f"WITH {LISTINGS}, {QUOTES}, {_SOURCES_SQL} SELECT * FROM signals")
def comp_signal_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Master rows with their latest observation and latest sound detail: detail before observation before master, and what the merge is good for."""
    return _signals(spark, folder).drop("region", "location", "locality", "total", "observed_at", "images", "description", "enriched_at", "version")


@query(f"""WITH {LISTINGS}, {QUOTES}, {_SOURCES_SQL} SELECT signal, n, (SELECT count(*) FROM signals) AS total FROM (SELECT count(*) FILTER (WHERE has_detail) AS has_detail, count(*) FILTER (WHERE has_price) AS has_price, count(*) FILTER (WHERE has_geo) AS has_geo, count(*) FILTER (WHERE has_rating) AS has_rating,
  count(*) FILTER (WHERE minimal) AS minimal, count(*) FILTER (WHERE rich) AS rich FROM signals) UNPIVOT (n FOR signal IN (has_detail, has_price, has_geo, has_rating, minimal, rich))""")
def comp_signal_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many listings have each signal."""
    return comp_signals.signal_coverage(_signals(spark, folder))


# ---- page parsers: pages are made from a table's columns, which are what the parsers must find

@query("""WITH b AS (SELECT p_partkey AS id, CAST(floor(p_retailprice) AS BIGINT) AS rate, p_size % 6 + 1 AS nights, p_size % 3 AS kind FROM part)
SELECT id, CAST(CASE kind WHEN 2 THEN rate ELSE rate * nights END AS DOUBLE) AS accommodation, CAST(CASE kind WHEN 0 THEN 80 END AS DOUBLE) AS cleaning, CAST(CASE kind WHEN 0 THEN 45.5 WHEN 1 THEN 20 END AS DOUBLE) AS service, CAST(CASE kind WHEN 0 THEN 12.25 END AS DOUBLE) AS taxes,
  CAST(CASE kind WHEN 0 THEN rate * nights + 137.75 WHEN 1 THEN rate * nights + 20 ELSE rate END AS DOUBLE) AS total FROM b""")
def price_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes read from the lines of a price panel: full, without total, and collapsed to one line."""
    rate, nights, kind = F.floor("p_retailprice").cast("string"), (F.col("p_size") % 6 + 1), F.col("p_size") % 3
    whole = (F.floor("p_retailprice") * nights).cast("string")
    full = F.concat(F.lit("$"), rate, F.lit(" x "), nights.cast("string"), F.lit(" nights\n$"), whole, F.lit("\nCleaning fee\n$80\nHost service fee\nwhat is this\n$45.50\nTaxes\n$12.25\nTotal\n$"), (F.floor("p_retailprice") * nights + 137.75).cast("decimal(20,2)").cast("string"))
    short = F.concat(F.lit("$"), rate, F.lit(" x "), nights.cast("string"), F.lit(" nights\nShown in USD\nService fee\n$20"))
    line = F.concat(F.lit("$99,999 $"), rate, F.lit(" for "), nights.cast("string"), F.lit(" nights"))
    panels = table(spark, folder, "part", ["p_partkey", "p_size", "p_retailprice"]).select(F.col("p_partkey").alias("id"), F.when(kind == 0, full).when(kind == 1, short).otherwise(line).alias("panel"))
    return panels.select("id", page_source.price_panel(F.col("panel")).alias("x")).select("id", "x.*")


@query("""WITH b AS (SELECT p_partkey AS id, p_size, CAST(floor(p_retailprice) AS BIGINT) AS rate FROM part), r AS (SELECT id, unnest([1, 2]) AS position, rate, p_size FROM b)
SELECT id, CAST(position - 1 AS INTEGER) AS position, CASE position WHEN 1 THEN '1998-06-01' ELSE '1998-12-15' END AS start, CASE position WHEN 1 THEN '1998-11-30' ELSE '1999-01-05' END AS stop, CAST(CASE position WHEN 1 THEN rate ELSE rate + 1000.5 END AS DOUBLE) AS nightly, CAST(CASE position WHEN 1 THEN p_size % 4 + 1 ELSE 7 END AS INTEGER) AS min_nights FROM r""")
def rate_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rate brackets read from a page's table."""
    row = lambda a, rate, least: F.concat(F.lit(f"<tr><td>{a}</td><td>$ "), rate, F.lit("</td><td>-</td><td>-</td><td>"), least, F.lit(" nights</td></tr>"))
    rate = F.floor("p_retailprice")
    html = F.concat(F.lit('<p>x</p><table class="table table-rounded"><tr><th>dates</th></tr>'), row("June 1, 1998 to November 30, 1998", F.format_number(rate, 0), (F.col("p_size") % 4 + 1).cast("string")),
                    row("December 15, 1998 to January 5, 1999", F.concat((rate + 1000).cast("string"), F.lit(".50")), F.lit("7")), F.lit("</table>"))
    pages = table(spark, folder, "part", ["p_partkey", "p_size", "p_retailprice"]).select(F.col("p_partkey").alias("id"), html.alias("html"))
    return page_source.rate_table(pages)


@query("""WITH c AS (SELECT p_partkey AS id, p_name, p_retailprice, unnest(range(1, 1 + p_size % 3)) AS card FROM part)
SELECT id, 'ABB-' || CAST(id * 1000000 + card AS VARCHAR) AS external_id, p_name AS title, floor(p_retailprice * 100 + 0.5) / 100 AS price, CASE WHEN card = 1 THEN 4.5::DOUBLE END AS rating FROM c""")
def search_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Listings read from the cards of a search page, wherever its JSON nests them."""
    k = F.col("p_partkey")
    card = lambda n: F.concat(F.lit('{"__typename":"StaySearchResult","listing":{"id":"'), F.base64(F.concat(F.lit("StayListing:"), (k * 1_000_000 + n).cast("string"))), F.lit('","name":"'), F.col("p_name"), F.lit('"},"price":'),
                              (half_up(F.col("p_retailprice"), 2)).cast("string"), F.lit(',"rating":4.5}' if n == 1 else "}"))
    cards = F.array_join(F.slice(F.array(card(1), card(2)), F.lit(1), (F.col("p_size") % 3).cast("int")), ",")
    html = F.concat(F.lit('<html><script id="data-deferred-state-0" type="application/json">{"a":{"b":[{"c":{"results":['), cards, F.lit(']}}]},"d":{"__typename":"Other"}}</script></html>'))
    pages = table(spark, folder, "part", ["p_partkey", "p_name", "p_size", "p_retailprice"]).select(k.alias("id"), html.alias("html"))
    found = listing_pages_source.nodes(pages, "StaySearchResult")
    of = lambda path, kind="string": F.try_variant_get("node", path, kind)
    return found.select("id", F.concat(F.lit("ABB-"), page_source.node_id(of("$.listing.id"))).alias("external_id"), of("$.listing.name").alias("title"), of("$.price", "double").alias("price"), of("$.rating", "double").alias("rating"))


# ---- job, event and dictionary tables

def transitions(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs (id, status, attempts, error) after results (id, ok, error): complete or failed, attempts counted, errors cut to 1,000 characters; others stay."""
    r = results.select("id", "ok", F.col("error").alias("new_error"))
    done = F.col("ok").isNotNull()
    return jobs.join(r, "id", "left").select(
        "id", F.when(F.col("ok"), "complete").when(done, "failed").otherwise(F.col("status")).alias("status"), (F.col("attempts") + done.cast("int")).alias("attempts"),
        F.when(F.col("ok"), None).when(done, F.substring("new_error", 1, 1_000)).otherwise(F.col("error")).alias("error"))


@query("""WITH j AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'in_progress' ELSE 'pending' END AS status, CAST(o_orderkey % 3 AS INTEGER) AS attempts FROM orders), r AS (SELECT id, id % 2 = 0 AS ok, repeat('e', CAST(500 + id % 1000 AS INTEGER)) AS e FROM j WHERE status = 'in_progress' AND id % 5 <> 0)
SELECT CASE WHEN ok THEN 'complete' WHEN NOT ok THEN 'failed' ELSE status END AS status, count(*) AS n, CAST(sum(attempts + (ok IS NOT NULL)::INT) AS BIGINT) AS attempts, max(CASE WHEN NOT ok THEN least(1000, length(e)) END) AS longest FROM j LEFT JOIN r ON r.id = j.id GROUP BY 1""")
def job_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs after a run: what ended well, what failed, what still waits."""
    k = F.col("o_orderkey")
    jobs = table(spark, folder, "orders", ["o_orderkey", "o_orderstatus"]).select(k.alias("id"), F.when(F.col("o_orderstatus") == "F", "in_progress").otherwise("pending").alias("status"), (k % 3).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"))
    results = jobs.filter("status = 'in_progress' AND id % 5 <> 0").select("id", (F.col("id") % 2 == 0).alias("ok"), F.repeat(F.lit("e"), (500 + F.col("id") % 1000).cast("int")).alias("error"))
    return transitions(jobs, results).groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"), F.max(F.length("error")).cast("long").alias("longest"))


def delisted(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``df`` (id, is_active) with the rows of ``gone`` (id) inactive."""
    marked = df.join(gone.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
    return marked.withColumn("is_active", F.col("is_active") & F.col("gone").isNull()).drop("gone")


@query(f"""WITH {LISTINGS}, g AS (SELECT page_id AS id FROM pages WHERE page_id % 17 = 0) SELECT hood, count(*) FILTER (WHERE id NOT IN (SELECT id FROM g)) AS active, count(*) FILTER (WHERE id IN (SELECT id FROM g)) AS delisted FROM listings GROUP BY hood""")
def delist_gone(spark: SparkSession, folder: str) -> DataFrame:
    """Listings whose page is gone become inactive."""
    gone = table(spark, folder, "pages", ["page_id"]).filter("page_id % 17 = 0").select(F.col("page_id").alias("id"))
    return delisted(listings(spark, folder).select("id", "hood", F.lit(True).alias("is_active")), gone).groupBy("hood").agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("delisted"))


@query("WITH old AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key, 'old' AS category FROM part UNION ALL SELECT 'pool', 'old'), new(key, category) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in AMENITY_KEYS.items()) + ") SELECT COALESCE(n.key, o.key) AS key, COALESCE(n.category, o.category) AS category FROM old o FULL JOIN new n ON n.key = o.key")
def dictionary_seed(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary of the words in use seeded by key: entries of the seed are overwritten or added, others stay."""
    words = table(spark, folder, "part", ["p_name"]).select(F.explode(F.split("p_name", " ")).alias("key")).unionByName(spark.range(1).select(F.lit("pool").alias("key"))).distinct()
    return upserts.merged(words.select("key", F.lit("old").alias("category")), spark.createDataFrame(list(AMENITY_KEYS.items()), "key string, category string"), ["key"], {"category": "overwrite"})


@query("""WITH e AS (SELECT event_id AS id, user_id, event_type AS kind, last_value(CASE WHEN event_type IN ('view', 'click', 'signup') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM events),
a AS (SELECT DISTINCT shown AS id FROM e WHERE kind = 'purchase' AND shown IS NOT NULL)
SELECT user_id, count(*) AS shown, count(a.id) AS applied FROM e LEFT JOIN a ON a.id = e.id WHERE kind IN ('view', 'click', 'signup') GROUP BY 1""")
def tracked_events(spark: SparkSession, folder: str) -> DataFrame:
    """Recommendations shown, and how many an answer marked as applied: an answer names the one shown last before it, and others stay as they are."""
    c = F.col
    log = table(spark, folder, "events", ["event_id", "user_id", "ts", "event_type"])
    was_shown = c("event_type").isin("view", "click", "signup")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    named = log.withColumn("named", F.last(F.when(was_shown, c("event_id")), ignorenulls=True).over(before)).filter("event_type = 'purchase' AND named IS NOT NULL")
    applied = named.select(c("named").alias("event_id"), F.lit(True).alias("applied")).distinct()
    return log.filter(was_shown).join(applied, "event_id", "left").groupBy("user_id").agg(F.count("*").alias("shown"), F.count("applied").alias("applied"))


def row_limit(asked: int | None, least: int = 1, most: int = 50, default: int = 20) -> int:
    """A caller's limit held to what a page may show."""
    return default if asked is None else max(least, min(most, asked))


@query(f"WITH {LISTINGS} SELECT id, price_cents FROM listings ORDER BY price_cents DESC, id LIMIT 50")
def clamped_page(spark: SparkSession, folder: str) -> DataFrame:
    """The dearest listings; a caller that asks for 500 gets a page of 50."""
    return listings(spark, folder).select("id", "price_cents").orderBy(F.desc("price_cents"), "id").limit(row_limit(500))


@query(f"WITH {LISTINGS} SELECT * EXCLUDE (amenities) FROM listings WHERE id = 42")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One listing by its key; the filter reaches the scan."""
    from staylens.plans.standins import listing_rows

    return listing_rows(table(spark, folder, "part").filter("p_partkey = 42")).drop("amenities")


@query(f"""WITH {QUOTES}, n AS (SELECT id, listing_id, seen_at, CASE WHEN amount > 0 AND kind <> 'click' THEN amount END AS amount, CASE WHEN kind <> 'signup' THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) END AS reviews FROM quotes),
old AS (SELECT * FROM n WHERE seen_at < TIMESTAMP '2024-01-25'), new AS (SELECT * FROM n WHERE seen_at >= TIMESTAMP '2024-01-24'), k AS (SELECT DISTINCT listing_id FROM old)
SELECT new.id, new.listing_id, k.listing_id IS NOT NULL AS known, array_to_string(list_filter([CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN reviews IS NULL THEN 'reviews' END], lambda x: x IS NOT NULL), ',') AS missing FROM new LEFT JOIN k ON k.listing_id = new.listing_id WHERE new.id NOT IN (SELECT id FROM old)""")
def append_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of a batch that a log does not hold yet, each with its id, whether its listing is known to the log, and the fields it lacks."""
    c = F.col
    clean = quotes(spark, folder).select("id", "listing_id", "seen_at", F.when((c("amount") > 0) & (c("kind") != "click"), c("amount")).alias("amount"), F.when(c("kind") != "signup", text.guarded(F.get_json_object("props", "$.k"), "int")).alias("reviews"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    held, batch = clean.filter(c("seen_at") < day("2024-01-25")), clean.filter(c("seen_at") >= day("2024-01-24"))
    fresh = upserts.insert_if_absent(held, batch, ["id"])
    known = held.select("listing_id").distinct().withColumn("known", F.lit(True))
    missing = F.filter(F.array(*[F.when(c(x).isNull(), x) for x in ("amount", "reviews")]), lambda x: x.isNotNull())
    return fresh.join(known, "listing_id", "left").select("id", "listing_id", F.coalesce("known", F.lit(False)).alias("known"), F.array_join(missing, ",").alias("missing"))


@query(f"""WITH {LISTINGS} SELECT id, ('Suite in ' || hood || ' · ★' || CAST(rating AS VARCHAR) || ' · ' || bedrooms || ' bedrooms · ' || bedrooms || ' beds · 1.5 baths') AS title, 'Suite' AS kind, rating, bedrooms, CAST(floor(price_cents / 100) AS BIGINT) AS price FROM listings WHERE rating IS NOT NULL""")
def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Listings read back from their pages: title and kind from the share title, rating from JSON-LD, price from the text."""
    c = F.col
    rated = listings(spark, folder).filter("rating IS NOT NULL")
    title = F.concat(F.lit("Suite in "), c("hood"), F.lit(" · ★"), c("rating").cast("string"), F.lit(" · "), c("bedrooms").cast("string"), F.lit(" bedrooms · "), c("bedrooms").cast("string"), F.lit(" beds · 1.5 baths"))
    html = F.concat(F.lit('<html><head><meta property="og:title" content="'), title, F.lit('"><script type="application/ld+json">{"aggregateRating": {"ratingValue": "'), c("rating").cast("string"), F.lit('"}}</script></head><body>from $'),
                    F.floor(c("price_cents") / 100).cast("string"), F.lit(" per night</body></html>"))
    found = page_source.details(rated.select("id", html.alias("html")))
    return found.select("id", "title", text.og_title(c("title"))["kind"].alias("kind"), "rating", "bedrooms", F.floor("price").alias("price"))


# ---- names of buildings against a catalogue

#: stand-in catalogue: (building, neighbourhood, aliases)
CATALOGUE = [(name, ("Zona Romantica", "Amapas")[k % 2], [a for a, b in BUILDING_ALIASES.items() if b == name]) for k, name in enumerate(dict.fromkeys(BUILDING_ALIASES.values()))]


def _plain_slug(name: str) -> str:
    low = name.lower().translate(str.maketrans("áéíóúñü", "aeiounu"))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in low).split())


def _telling(slug: str) -> list[str]:
    return [t for t in slug.split() if t not in buildings.NOISE and not t.isdigit()]


TYPED = ["Orchid", "loma del mar d22", "The Loma del Mar", "Selva Romántica Villa 12", "Casa Leone Selva Romantica", "Playa Bonita 3", "Molino", "rincon", "Avalon Zen Tower North", "V177 penthouse", "Nowhere Heights", "Pacifica 404"]
HINTS = [None, "Zona Romantica", "Amapas"]


def _catalogue_sql() -> str:
    def strings(xs: list[str]) -> str:
        return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"

    rows = []
    for k, (canonical, hood, aliases) in enumerate(CATALOGUE):
        own, others = _plain_slug(canonical), [_plain_slug(a) for a in aliases]
        tokens = [_telling(s) for s in (own, *others)]
        rows.append(f"({k}, '{canonical}', '{hood}', '{own}', {strings(others)}, '{' '.join(tokens[0])}', {strings([' '.join(t) for t in tokens[1:]])}, [{', '.join(strings(t) for t in tokens)}], '{tokens[0][0]}')")
    return "cat(k, canonical, hood, own, others, nn, others_nn, sets, head) AS (VALUES " + ", ".join(rows) + ")"


_NOISE_SQL = "(" + ", ".join(f"'{x}'" for x in buildings.NOISE) + ")"


_MATCH_SQL = f"""{_catalogue_sql()}, r AS (SELECT p_partkey AS id, {pick_sql(TYPED, 'p_partkey')} AS raw, {pick_sql(HINTS, 'p_partkey // 12')} AS hint FROM part), s AS (SELECT id, hint, trim(regexp_replace(strip_accents(lower(raw)), '[^a-z0-9]+', ' ', 'g')) AS slug FROM r),
w AS (SELECT *, list_filter(string_split(slug, ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN {_NOISE_SQL}) AS words FROM s),
x AS (SELECT id, hint, slug, words, array_to_string(words, ' ') AS joined, cat.*, least(length(slug), length(own)) / greatest(length(slug), length(own))::DOUBLE AS share,
  list_max(list_transform(sets, lambda t: CASE WHEN len(list_distinct(list_concat(words, t))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(words, t)) / len(list_distinct(list_concat(words, t)))::DOUBLE END)) AS alike FROM w, cat),
c AS (SELECT *, CASE WHEN slug = own THEN 1.0 WHEN list_contains(others, slug) THEN 0.95 WHEN len(words) > 0 AND joined = nn THEN 0.88 WHEN len(words) > 0 AND list_contains(others_nn, joined) THEN 0.85 WHEN alike >= 0.4::DOUBLE THEN least(0.82::DOUBLE, 0.45::DOUBLE + alike * 0.5::DOUBLE)
  WHEN alike >= 0.22::DOUBLE THEN 0.30::DOUBLE + alike * 0.5::DOUBLE WHEN (contains(slug, own) OR contains(own, slug)) AND length(slug) >= 4 AND length(own) >= 4 AND share >= 0.5 THEN 0.60::DOUBLE + share * 0.1::DOUBLE WHEN words[1] = head AND length(words[1]) >= 4 THEN 0.35 END::DOUBLE - CASE WHEN hint IS NULL OR hint = hood THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END AS sc FROM x),
d AS (SELECT id, canonical, hood, floor(sc * 1000000 + 0.5) / 1000000 AS score, row_number() OVER (PARTITION BY id ORDER BY floor(sc * 1000000 + 0.5) DESC, k) AS r FROM c WHERE sc IS NOT NULL)"""


@query(f"""WITH {_MATCH_SQL}
SELECT w.id, max(CASE WHEN r = 1 AND score >= 0.55::DOUBLE THEN canonical END) AS building, max(CASE WHEN r = 1 AND score >= 0.55::DOUBLE THEN CASE WHEN least(1, score) >= 0.9::DOUBLE THEN 'high' WHEN score >= 0.65::DOUBLE THEN 'medium' ELSE 'low' END END) AS tier, COALESCE(string_agg(canonical, ',' ORDER BY r) FILTER (WHERE r <= 5), '') AS suggestions FROM w LEFT JOIN d ON d.id = w.id GROUP BY w.id""")
def building_match(spark: SparkSession, folder: str) -> DataFrame:
    """Typed names of buildings, some with a neighbourhood, as catalogue entries with their tier, and up to five suggestions."""
    k = F.col("p_partkey")
    typed = table(spark, folder, "part", ["p_partkey"]).select(k.alias("id"), pick(TYPED, k).alias("raw"), pick(HINTS, F.floor(k / 12)).alias("hint"))
    known = spark.createDataFrame([(k, *entry) for k, entry in enumerate(CATALOGUE)], "position int, canonical string, hood string, aliases array<string>")
    found = buildings.resolved(typed, buildings.building_matches(typed, known), ["id"])
    return found.select("id", "building", "tier", F.array_join("suggestions", ",").alias("suggestions"))


# ---- what a request for comparables may use

#: fixed values: warnings of the preparation
ELSEWHERE = 'Building "%s" is in %s, not %s. Neighborhood mismatch — building premium will not be applied.'
PARTLY = 'Partial building match: "%s" → "%s". Confirm this is correct.'
HARDLY = "Low-confidence building match. Treating building as unknown — no premium applied."
UNMATCHED = 'Building name "%s" could not be matched. No building premium will be applied.'
SUGGESTED = "%d amenity key(s) not recognized. Suggestions: %s. Use GET /api/rental/amenities for the full canonical list."
IGNORED = "%d amenity key(s) not recognized and will be ignored by the engine: %s. Use GET /api/rental/amenities for valid keys."
NO_SIZE = "sqft not provided. Size scoring will be skipped and weight redistributed. Providing sqft improves recommendation accuracy."
NO_RATING = "rating_overall not provided. Rating similarity scoring will be skipped."
NO_AMENITIES = "No valid amenity keys provided. Amenity scoring will contribute 0 pts. This significantly reduces comp-set quality. Use GET /api/rental/amenities for valid keys."
THIN = "Amapas %dBR is a thin segment (< 8 listings). Expect a 'low' or 'medium' confidence label from the comps engine."


def prepared(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requests (id, raw: building name or null, hint: neighbourhood, bedrooms, sqft, rating, amenities) as the engine may use them.

    Rows (id, building, tier, suggestions, accepted, rejected, corrections, warnings), lists as arrays in the order of the request. A
    building of another neighbourhood stays named but warns, one of low confidence is not used. Amenities that several keys name count
    once. A null key is rejected as an empty one.
    """
    c = F.col
    found = buildings.resolved(requests.select("id", "raw", "hint"), buildings.building_matches(requests, catalogue), ["id"])
    x = requests.join(found.drop("raw", "hint"), "id")
    keys = F.transform(F.coalesce("amenities", F.array().cast("array<string>")), lambda k: F.struct(F.coalesce(k, F.lit("")).alias("raw"), amenity_key(k).alias("to")))
    x = x.withColumn("_keys", keys)
    x = x.withColumn("accepted", F.array_distinct(F.transform(F.filter("_keys", lambda k: k["to"]["canonical"].isNotNull()), lambda k: k["to"]["canonical"])))
    x = x.withColumn("rejected", F.transform(F.filter("_keys", lambda k: k["to"]["canonical"].isNull()), lambda k: k["raw"]))
    x = x.withColumn("corrections", F.transform(F.filter("_keys", lambda k: k["to"]["canonical"].isNull() & k["to"]["suggested"].isNotNull()), lambda k: F.concat(F.lit('"'), k["raw"], F.lit('" → "'), k["to"]["suggested"], F.lit('"'))))
    n = F.size("rejected")
    of_building = F.when(c("raw").isNotNull() & (c("raw") != ""), F.when(c("building").isNull(), F.format_string(UNMATCHED, "raw")).when(c("building_hood") != c("hint"), F.format_string(ELSEWHERE, "building", "building_hood", "hint"))
                         .when(c("tier") == "medium", F.format_string(PARTLY, "raw", "building")).when(c("tier") == "low", HARDLY))
    warnings = [
        of_building, F.when((n > 0) & (F.size("corrections") > 0), F.format_string(SUGGESTED, n, F.array_join("corrections", ", "))).when(n > 0, F.format_string(IGNORED, n, F.array_join("rejected", ", "))),
        F.when(F.coalesce(c("sqft"), F.lit(0)) == 0, NO_SIZE), F.when(F.coalesce(c("rating"), F.lit(0)) == 0, NO_RATING), F.when(F.size("accepted") == 0, NO_AMENITIES), F.when((c("hint") == "Amapas") & (c("bedrooms") >= 3), F.format_string(THIN, "bedrooms"))]
    used = F.when((c("tier") != "low") | (c("building_hood") != c("hint")), c("building"))
    return x.select("id", used.alias("building"), "tier", "suggestions", "accepted", "rejected", "corrections", F.filter(F.array(*warnings), lambda w: w.isNotNull()).alias("warnings"))


def _text(template: str, *values: str) -> str:
    """A warning as SQL."""
    out = "'" + template.replace("'", "''") + "'"
    for v in values:
        out = out.replace("%s", f"' || {v} || '", 1) if out.find("%s") >= 0 and (out.find("%d") < 0 or out.find("%s") < out.find("%d")) else out.replace("%d", f"' || {v} || '", 1)
    return out


_TO_KEY_SQL = f"CASE WHEN raw IN {_KEYS_SQL} THEN raw WHEN regexp_replace(sp, '\\s+', '_', 'g') IN {_KEYS_SQL} THEN regexp_replace(sp, '\\s+', '_', 'g') ELSE CASE sp " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AMENITY_NAMES.items()) + " END END"
_NEAR_SQL = "CASE " + " ".join(f"WHEN contains(sp, '{k}') OR contains('{k}', sp) THEN '{v}'" for k, v in AMENITY_NAMES.items()) + " END"


@query(f"""WITH {_MATCH_SQL}, q AS (SELECT p_partkey AS id, {pick_sql(TYPED, 'p_partkey')} AS raw, CASE WHEN p_partkey % 3 = 0 THEN 'Zona Romantica' ELSE 'Amapas' END AS hint, CAST(p_size % 4 + 1 AS INTEGER) AS bedrooms, p_size % 7 <> 0 AS sized, p_partkey % 9 <> 0 AS rated FROM part),
cand AS (SELECT q.id, canonical, hood, floor((sc + CASE WHEN x.hint IS NULL OR x.hint = hood THEN 0::DOUBLE ELSE 0.15::DOUBLE END - CASE WHEN q.hint = hood THEN 0::DOUBLE ELSE 0.15::DOUBLE END) * 1000000 + 0.5) / 1000000 AS score, k FROM q JOIN c x ON x.id = q.id WHERE sc IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS r FROM cand),
best AS (SELECT q.*, max(CASE WHEN r = 1 AND score >= 0.55::DOUBLE THEN canonical END) AS building, max(CASE WHEN r = 1 AND score >= 0.55::DOUBLE THEN hood END) AS building_hood, max(CASE WHEN r = 1 AND score >= 0.55::DOUBLE THEN CASE WHEN score >= 0.9::DOUBLE THEN 'high' WHEN score >= 0.65::DOUBLE THEN 'medium' ELSE 'low' END END) AS tier,
  COALESCE(string_agg(canonical, ',' ORDER BY r) FILTER (WHERE r <= 5), '') AS suggestions FROM q LEFT JOIN top ON top.id = q.id GROUP BY ALL),
keyed AS (SELECT p_partkey AS id, unnest([{pick_sql(RAW_KEYS, 'p_partkey')}, {pick_sql(RAW_KEYS, '(p_partkey * 3 + 1)')}, {pick_sql(RAW_KEYS, '(p_partkey * 7 + 4)')}]) AS raw, unnest([1, 2, 3]) AS i FROM part),
spaced AS (SELECT *, regexp_replace(trim(lower(raw)), '[_-]', ' ', 'g') AS sp FROM keyed), told AS (SELECT id, i, COALESCE(raw, '') AS raw, {_TO_KEY_SQL} AS canonical, {_NEAR_SQL} AS near FROM spaced),
firsts AS (SELECT id, canonical, min(i) AS i FROM told WHERE canonical IS NOT NULL GROUP BY 1, 2),
am AS (SELECT told.id, (SELECT COALESCE(string_agg(canonical, ',' ORDER BY i), '') FROM firsts WHERE firsts.id = told.id) AS accepted, COALESCE(string_agg(raw, ',' ORDER BY i) FILTER (WHERE canonical IS NULL), '') AS rejected, COALESCE(string_agg(raw, ', ' ORDER BY i) FILTER (WHERE canonical IS NULL), '') AS rejected_said,
  count(*) FILTER (WHERE canonical IS NULL) AS n, COALESCE(string_agg('"' || raw || '" → "' || near || '"', ', ' ORDER BY i) FILTER (WHERE canonical IS NULL AND near IS NOT NULL), '') AS corrections FROM told GROUP BY told.id)
SELECT best.id, CASE WHEN tier <> 'low' OR building_hood <> hint THEN building END AS building, tier, suggestions, accepted, rejected, corrections, array_to_string(list_filter([
  CASE WHEN building IS NULL THEN {_text(UNMATCHED, 'raw')} WHEN building_hood <> hint THEN {_text(ELSEWHERE, 'building', 'building_hood', 'hint')} WHEN tier = 'medium' THEN {_text(PARTLY, 'raw', 'building')} WHEN tier = 'low' THEN {_text(HARDLY)} END,
  CASE WHEN n > 0 AND corrections <> '' THEN {_text(SUGGESTED, 'n', 'corrections')} WHEN n > 0 THEN {_text(IGNORED, 'n', 'rejected_said')} END, CASE WHEN NOT sized THEN {_text(NO_SIZE)} END, CASE WHEN NOT rated THEN {_text(NO_RATING)} END,
  CASE WHEN accepted = '' THEN {_text(NO_AMENITIES)} END, CASE WHEN hint = 'Amapas' AND bedrooms >= 3 THEN {_text(THIN, 'bedrooms')} END], lambda w: w IS NOT NULL), ' | ') AS warnings FROM best JOIN am ON am.id = best.id""")
def comps_preparation(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing as a request for comparables: its building, amenities and what to warn of."""
    k, s = F.col("p_partkey"), F.col("p_size")
    requests = table(spark, folder, "part", ["p_partkey", "p_size"]).select(
        k.alias("id"), pick(TYPED, k).alias("raw"), F.when(k % 3 == 0, "Zona Romantica").otherwise("Amapas").alias("hint"), (s % 4 + 1).cast("int").alias("bedrooms"), F.when(s % 7 != 0, s * 100).alias("sqft"), F.when(k % 9 != 0, F.lit(4.5)).alias("rating"),
        F.array(pick(RAW_KEYS, k), pick(RAW_KEYS, k * 3 + 1), pick(RAW_KEYS, k * 7 + 4)).alias("amenities"))
    known = spark.createDataFrame([(i, *entry) for i, entry in enumerate(CATALOGUE)], "position int, canonical string, hood string, aliases array<string>")
    done = prepared(requests, known)
    return done.select("id", "building", "tier", *[F.array_join(n, ",").alias(n) for n in ("suggestions", "accepted", "rejected")], F.array_join("corrections", ", ").alias("corrections"), F.array_join("warnings", " | ").alias("warnings"))
