"""Stays: nights against event overlays, bookings by stay window, checkpoints and the quotes on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions import dates, text
from staylens.operators import bookings, overlays
from staylens.plans.offers import stay_quotes
from staylens.plans.registry import query
from staylens.plans.standins import AS_OF, CALENDAR, EVENTS_AS_OF, LISTINGS, calendar, listings, stay_quote_log
from staylens.sources.tables import table

#: fixed values: display names of neighbourhoods whose key is not their slug
HOOD_KEYS = {"Old Town": "zona_romantica", "La Cruz de Huanacaxtle": "la_cruz"}
#: orders above this price stand for market events, each customer for the places around the event
EVENT_PRICE, EVENT_PLACES = 480_000, 8

STAYS_SQL = """stays AS (SELECT DISTINCT l_partkey AS listing_id, CAST(l_shipdate AS DATE) AS checkin, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) % 10 AS checkout FROM lineitem)"""
OVERLAYS_SQL = f"""overlays AS (SELECT o_orderkey AS key, 'event ' || o_orderkey AS name, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS e,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - 4 END AS ss, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) + 5 END AS se,
  CAST(o_orderkey % 31 AS INTEGER) AS pct, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 11 AS INTEGER) END AS spct,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 100 WHEN '2' THEN 90 WHEN '3' THEN 60 END AS priority, o_custkey
  FROM orders WHERE o_totalprice > {EVENT_PRICE})"""
WINNERS_SQL = f"""{STAYS_SQL}, {OVERLAYS_SQL}, nights AS (SELECT *, CAST(unnest(generate_series(checkin, checkout - 1, INTERVAL 1 DAY)) AS DATE) AS night FROM stays WHERE checkout > checkin),
hits AS (SELECT night, key, name, COALESCE(priority, 50) AS priority, pct AS core_pct, CASE WHEN night BETWEEN s AND e THEN 'core' ELSE 'shoulder' END AS phase, CASE WHEN night BETWEEN s AND e THEN pct ELSE COALESCE(spct, pct) END AS pct
  FROM (SELECT DISTINCT night FROM nights) JOIN overlays ON night BETWEEN s AND e OR night BETWEEN ss AND se),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY night ORDER BY priority DESC, pct DESC, key) AS k FROM hits) WHERE k = 1)"""
_FACTOR_SQL = "list_extract([" + ", ".join(str(round(x * 100)) for x in overlays.MONTH_FACTORS) + "], CAST(month({}) AS INTEGER))"
_SEASON_SQL = "list_extract([" + ", ".join(f"'{x}'" for x in overlays.MONTH_SEASONS) + "], CAST(month(checkin) AS INTEGER))"


def stays(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct stay windows of the line items; one in ten has no nights."""
    items = table(spark, folder, "lineitem", ["l_partkey", "l_shipdate", "l_quantity"])
    day = F.col("l_shipdate").cast("date")
    return items.select(F.col("l_partkey").alias("listing_id"), day.alias("checkin"), F.date_add(day, F.col("l_quantity").cast("int") % 10).alias("checkout")).distinct()


def event_overlays(spark: SparkSession, folder: str) -> DataFrame:
    """Large orders as events: some have a shoulder on both sides, some neither a shoulder's premium nor a priority."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    last = F.date_add(day, (key % 9).cast("int"))
    priority = F.substring("o_orderpriority", 1, 1)
    return table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]).filter(F.col("o_totalprice") > EVENT_PRICE).select(
        key.alias("key"), F.concat(F.lit("event "), key).alias("name"), day.alias("start"), last.alias("end"), F.when(key % 3 == 0, F.date_sub(day, 4)).alias("shoulder_start"),
        F.when(key % 3 == 0, F.date_add(last, 5)).alias("shoulder_end"), ((key % 31) / 100).alias("premium"), F.when(key % 2 == 0, (key % 11) / 100).alias("shoulder_premium"),
        F.when(priority == "1", 100).when(priority == "2", 90).when(priority == "3", 60).alias("priority"), F.col("o_custkey").alias("customer"))


def listed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Large orders as entries of an event list: some have no last day, some are not active."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = table(spark, folder, "orders", ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"]).filter(F.col("o_totalprice") > EVENT_PRICE)
    return rows.select(key.alias("key"), F.col("o_orderstatus").alias("category"), day.alias("start"), F.when(key % 4 != 0, F.date_add(day, (key % 9).cast("int"))).alias("stop"), (key % 5 != 0).alias("active"))


def hood_key(hood: str) -> F.Column:
    """Key of a neighbourhood's display name: its own, or its slug; null for no name."""
    known = F.create_map(*(F.lit(x) for pair in HOOD_KEYS.items() for x in pair))
    return F.when(F.col(hood) != "", F.coalesce(F.element_at(known, F.col(hood)), text.slug(F.col(hood), "_")))


def event_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Strength of each event in the neighbourhoods around its customer: the first rule of a neighbourhood counts."""
    around = event_overlays(spark, folder).select("key", F.explode(F.sequence(F.lit(0), F.lit(EVENT_PLACES - 1))).alias("k"), (F.col("customer") + F.col("k")).alias("id"))
    met = around.join(listings(spark, folder).select("id", hood_key("hood").alias("zone")), "id")
    return met.groupBy("key", "zone").agg(F.min_by(F.lit(0.8) + (F.col("id") * 7 % 80) / 100, "k").alias("strength"))


@query(f"""WITH o AS (SELECT o_orderkey AS key, o_orderstatus AS category, CAST(o_orderdate AS DATE) AS start, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) END AS stop, o_orderkey % 5 <> 0 AS active FROM orders WHERE o_totalprice > {EVENT_PRICE})
SELECT key, category, start, COALESCE(stop, start) AS stop FROM o WHERE active AND category = 'F' AND COALESCE(stop, start) >= DATE '{AS_OF}'""", dates=["start", "stop"])
def active_events(spark: SparkSession, folder: str) -> DataFrame:
    """Active events of a category that are not over."""
    return overlays.active_events(listed_events(spark, folder), F.lit(AS_OF).cast("date"), category="F").select("key", "category", "start", "stop")


@query(f"WITH {WINNERS_SQL} SELECT night, key, phase, pct / 100.0::DOUBLE AS premium, priority FROM won", dates=["night"])
def night_event_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The event that holds each night of any stay."""
    nights = stays(spark, folder).select(F.explode(dates.nights(F.col("checkin"), F.col("checkout"))).alias("night"))
    return overlays.winning_events(nights, event_overlays(spark, folder)).select("night", "key", "phase", "premium", "priority")


@query(f"""WITH {WINNERS_SQL}, f AS (SELECT s.listing_id, s.checkin, s.checkout, n.night, {_FACTOR_SQL.format('COALESCE(n.night, s.checkin)')} AS m, COALESCE(pct, 0) AS pct, key, name, priority, core_pct
  FROM stays s LEFT JOIN nights n ON n.listing_id = s.listing_id AND n.checkin = s.checkin AND n.checkout = s.checkout LEFT JOIN won ON won.night = n.night),
g AS (SELECT listing_id, checkin, checkout, count(night) AS n_nights, count(*) AS n, CAST(sum(m * 100) AS BIGINT) AS m, CAST(sum(m * (100 + pct)) AS BIGINT) AS f, count(key) AS touched,
  first(key ORDER BY priority DESC NULLS LAST, core_pct DESC NULLS LAST, key NULLS LAST) AS event, first(name ORDER BY priority DESC NULLS LAST, core_pct DESC NULLS LAST, key NULLS LAST) AS name FROM f GROUP BY 1, 2, 3)
SELECT listing_id, checkin, checkout, n_nights, floor(m::DOUBLE / n + 0.5) / 10000 AS monthly, floor(f::DOUBLE / n + 0.5) / 10000 AS multiplier,
  CASE WHEN touched > 0 THEN greatest(0, floor((f::DOUBLE / m - 1) * 10000 + 0.5) / 10000) END AS premium, event,
  strftime(checkin, '%B') || ' (' || {_SEASON_SQL} || ' Season)' || CASE WHEN n_nights = 0 THEN '{overlays.BASELINE}' WHEN touched = 0 THEN '{overlays.CLEAN}' ELSE ' — ' || name || '{overlays.PARTIAL}' END AS label FROM g""", dates=["checkin", "checkout"])
def stay_window_seasonality(spark: SparkSession, folder: str) -> DataFrame:
    """Seasonal context of every stay window: mean night factor, what events add, the leading event and the label."""
    return overlays.stay_seasonality(stays(spark, folder), ["listing_id", "checkin", "checkout"], event_overlays(spark, folder))


@query(f"""WITH {WINNERS_SQL}, {LISTINGS}, hoods AS (SELECT id, CASE hood {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HOOD_KEYS.items())} ELSE trim(regexp_replace(lower(hood), '[^a-z0-9]+', '_', 'g'), '_') END AS zone FROM listings),
zones AS (SELECT key, zone, least(1.4, greatest(0.95, min_by(0.8 + (id * 7 % 80) / 100, k))) AS strength FROM (SELECT key, o_custkey + k AS place, k FROM overlays, range({EVENT_PLACES}) r(k)) JOIN hoods ON id = place GROUP BY 1, 2),
f AS (SELECT s.listing_id, s.checkin, s.checkout, n.night, 10000 + 100 * COALESCE(pct, 0) AS applied, COALESCE(CAST(floor(strength * 10000 + 0.5) AS BIGINT), 10000) AS zu
  FROM stays s JOIN hoods ON hoods.id = s.listing_id LEFT JOIN nights n ON n.listing_id = s.listing_id AND n.checkin = s.checkin AND n.checkout = s.checkout LEFT JOIN won ON won.night = n.night LEFT JOIN zones ON zones.key = won.key AND zones.zone = hoods.zone)
SELECT listing_id, checkin, checkout, count(night) AS n_nights, floor(sum(applied)::DOUBLE / count(*) + 0.5) / 10000 AS event_avg, floor(sum(zu)::DOUBLE / count(*) + 0.5) / 10000 AS zone_avg,
  least(2, floor(sum(least(20000, floor(applied * zu / 10000.0 + 0.5)))::DOUBLE / count(*) + 0.5) / 10000) AS final_avg FROM f GROUP BY 1, 2, 3""", dates=["checkin", "checkout"])
def zone_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    """Event and zone multipliers of every stay window in its listing's neighbourhood."""
    placed = stays(spark, folder).join(listings(spark, folder).select(F.col("id").alias("listing_id"), hood_key("hood").alias("zone")), "listing_id")
    return overlays.zone_overlay(placed, ["listing_id", "checkin", "checkout"], event_overlays(spark, folder), event_zones(spark, folder))


# ---- bookings by stay window

_LOG_SQL = """log AS (SELECT event_id AS id, user_id AS listing_id, DATE '2024-03-01' + 7 * CAST(event_id % 3 AS INTEGER) AS checkin, DATE '2024-03-03' + 8 * CAST(event_id % 3 AS INTEGER) AS checkout, ts AS collected_at,
  CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'signup' THEN NULL ELSE 'available' END AS status, CASE WHEN event_type <> 'click' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END AS total FROM events),
quoted AS (SELECT *, total - CAST(floor(total / 10.0::DOUBLE + 0.5) AS BIGINT) AS subtotal, CAST(floor((total - CAST(floor(total / 10.0::DOUBLE + 0.5) AS BIGINT))::DOUBLE / (checkout - checkin) + 0.5) AS BIGINT) AS nightly FROM log)"""
_FLIPS_SQL = """SELECT listing_id, checkin, checkout, p.nightly, p.subtotal, p.total, p.collected_at AS last_seen_at, collected_at AS first_gone_at, floor((epoch_us(collected_at) - epoch_us(p.collected_at)) / 3.6e9 * 10000 + 0.5) / 10000 AS gap_hours,
  CASE WHEN (epoch_us(collected_at) - epoch_us(p.collected_at)) / 3.6e9 <= 48 THEN 'high' WHEN (epoch_us(collected_at) - epoch_us(p.collected_at)) / 3.6e9 <= 168 THEN 'medium' ELSE 'low' END AS confidence, p.id AS source_id, id AS gone_id
  FROM (SELECT *, lag({{'id': id, 'collected_at': collected_at, 'status': status, 'nightly': nightly, 'subtotal': subtotal, 'total': total}}) OVER (PARTITION BY listing_id, checkin, checkout ORDER BY collected_at, id) AS p FROM quoted
    WHERE collected_at >= TIMESTAMP '{now}' - INTERVAL 14 DAY {until}) WHERE status = 'unavailable' AND p.status <> 'unavailable' AND p.total IS NOT NULL AND p.nightly > 0"""
#: an earlier run, whose bookings a later one finds in the table
EARLIER = "2024-01-24"


@query(f"WITH {_LOG_SQL} {_FLIPS_SQL.format(now=EVENTS_AS_OF, until='')}", dates=["checkin", "checkout"], stamps=["last_seen_at", "first_gone_at"])
def presumed_bookings_flips(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings presumed from quotes of the last fourteen days, each stay window by itself."""
    return bookings.infer_bookings(stay_quote_log(spark, folder), F.lit(EVENTS_AS_OF))


@query(f"""WITH {_LOG_SQL}, late AS ({_FLIPS_SQL.format(now=EVENTS_AS_OF, until='')}), early AS ({_FLIPS_SQL.format(now=EARLIER, until=f"AND collected_at < TIMESTAMP '{EARLIER}'")})
SELECT count(*) AS candidates, count(*) FILTER (WHERE NOT EXISTS (FROM early WHERE early.listing_id = late.listing_id AND early.checkin = late.checkin AND early.checkout = late.checkout AND early.last_seen_at = late.last_seen_at)) AS inserted FROM late""")
def presumed_bookings_recorded(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a run's bookings are new to a table that an earlier run has filled."""
    log = stay_quote_log(spark, folder)
    held = bookings.infer_bookings(log.filter(F.col("collected_at") < F.lit(EARLIER).cast("timestamp_ntz")), F.lit(EARLIER))
    flips = bookings.infer_bookings(log, F.lit(EVENTS_AS_OF))
    fresh = bookings.new_bookings(flips, held).select(F.lit(1).alias("n"), F.lit(1).alias("fresh"))
    return flips.select(F.lit(1).alias("n"), F.lit(0).alias("fresh")).unionByName(fresh).agg(F.count_if(F.col("fresh") == 0).alias("candidates"), F.count_if(F.col("fresh") == 1).alias("inserted"))


# ---- checkpoints

_WINDOWS_SQL = """y AS (SELECT as_of, y, y + 1 AS z FROM ondays, (SELECT unnest([0, 1]) AS k) JOIN LATERAL (SELECT CAST(year(as_of) AS INTEGER) + k AS y) ON true),
moon AS (SELECT *, (z // 100 - z // 400 - (8 * (z // 100) + 13) // 25 + 19 * (z % 19) + 15) % 30 AS m FROM y),
easter AS (SELECT as_of, y, z, make_date(z, 3, 21) + CAST(m - CASE WHEN m = 29 OR (m = 28 AND z % 19 > 10) THEN 1 ELSE 0 END AS INTEGER) AS full_ FROM moon),
sunday AS (SELECT *, full_ + (7 - CAST(dayofweek(full_) AS INTEGER)) AS easter FROM easter),
raw AS (
  SELECT as_of, 2 * w + h AS pos, as_of + (12 - CAST(dayofweek(as_of) AS INTEGER)) % 7 + 7 * w + h AS checkin, 2 AS stay, 'weekend' AS kind, NULL AS tag FROM ondays, (SELECT unnest(range(12))::INTEGER AS w), (SELECT unnest([0, 1]) AS h)
  UNION ALL SELECT as_of, 100 + 10 * (y - CAST(year(as_of) AS INTEGER)) + e.i, e.checkin, e.stay, e.kind, e.tag FROM sunday, LATERAL (SELECT unnest([
    {'i': 0, 'checkin': make_date(y, 12, 24), 'stay': 3, 'kind': 'holiday', 'tag': 'xmas_' || y}, {'i': 1, 'checkin': make_date(y, 12, 30), 'stay': 3, 'kind': 'holiday', 'tag': 'nye_' || y},
    {'i': 2, 'checkin': make_date(z, 1, 15) + (13 - CAST(dayofweek(make_date(z, 1, 15)) AS INTEGER)) % 7, 'stay': 7, 'kind': 'event', 'tag': 'beef_dip_' || z},
    {'i': 3, 'checkin': easter - 8, 'stay': 7, 'kind': 'event', 'tag': 'semana_santa_' || z},
    {'i': 4, 'checkin': make_date(z, 5, 31) - (CAST(dayofweek(make_date(z, 5, 31)) AS INTEGER) + 1) % 7, 'stay': 4, 'kind': 'event', 'tag': 'pride_' || z}]) AS e) WHERE e.checkin BETWEEN as_of AND as_of + 540
  UNION ALL SELECT as_of, 200 + i, f + 7 + (8 - CAST(dayofweek(f) AS INTEGER)) % 7, 3, 'midweek_anchor', NULL FROM (SELECT as_of, i, CAST(date_trunc('month', as_of + 84) + to_months(i + 1) AS DATE) AS f FROM ondays, (SELECT unnest(range(6))::INTEGER AS i))
), checkpoints AS (SELECT as_of, checkin, checkin + CAST(stay AS INTEGER) AS checkout, CAST(stay AS INTEGER) AS stay_nights, kind, tag, dayofweek(checkin) IN (5, 6) AS is_weekend,
  CASE WHEN month(checkin) IN (11, 12, 1, 2, 3, 4) THEN 'high' WHEN month(checkin) IN (5, 10) THEN 'shoulder' ELSE 'low' END AS season, CAST(checkin - as_of AS INTEGER) AS days_out
  FROM (SELECT *, row_number() OVER (PARTITION BY as_of, checkin, stay ORDER BY pos) AS k FROM raw) WHERE k = 1)"""


@query(f"""WITH ondays AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders), {_WINDOWS_SQL} SELECT * FROM checkpoints""", dates=["as_of", "checkin", "checkout"])
def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Stay windows to quote as of each day on which anything was ordered."""
    days = table(spark, folder, "orders", ["o_orderdate"]).select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    return dates.checkpoints(days, "as_of")


@query("""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), a AS (SELECT y, y % 19 AS g, y // 100 AS c FROM y), h AS (SELECT y, g, c, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM a),
i AS (SELECT y, c, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM h), j AS (SELECT y, i, (y + y // 4 + i + 2 - c + c // 4) % 7 AS j FROM i), l AS (SELECT y, i - j AS l FROM j)
SELECT y AS year, make_date(y, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS easter FROM l""", dates=["easter"])
def easter_sundays(spark: SparkSession, folder: str) -> DataFrame:
    """Easter of every year that has orders."""
    years = table(spark, folder, "orders", ["o_orderdate"]).select(F.year("o_orderdate").alias("year")).distinct()
    return years.select("year", dates.easter(F.col("year")).alias("easter"))


@query(f"""WITH {CALENDAR}, one AS (SELECT listing_id, day, min(price_cents) AS price_cents, bool_and(available) AS available FROM calendar GROUP BY 1, 2),
listed AS (SELECT listing_id, min(day) AS as_of FROM one GROUP BY 1), ondays AS (SELECT DISTINCT as_of FROM listed), {_WINDOWS_SQL},
n AS (SELECT listing_id, checkin, checkout, CAST(unnest(generate_series(checkin, checkout - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM listed JOIN checkpoints USING (as_of)),
q AS (SELECT n.listing_id, checkin, checkout, count(*) AS n_nights, count(price_cents) AS n_priced, count(*) FILTER (WHERE available) AS n_open, CAST(sum(price_cents) AS BIGINT) AS cents FROM n LEFT JOIN one ON one.listing_id = n.listing_id AND one.day = n.day GROUP BY 1, 2, 3)
SELECT listing_id, checkin, checkout, n_nights, n_priced, CASE WHEN n_priced < n_nights THEN 'unknown' WHEN n_open = n_nights THEN 'available' ELSE 'unavailable' END AS status, CAST(floor(cents::DOUBLE / n_priced + 0.5) AS BIGINT) AS nightly,
  CASE WHEN n_priced = n_nights THEN cents END AS subtotal, CAST(CASE WHEN n_priced = n_nights THEN floor(cents * 0.19::DOUBLE + 0.5) END AS BIGINT) AS taxes, CAST(CASE WHEN n_priced = n_nights THEN cents + floor(cents * 0.19::DOUBLE + 0.5) END AS BIGINT) AS total FROM q WHERE n_priced > 0""", dates=["checkin", "checkout"])
def checkpoint_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of every listing at its own checkpoints, counted from its first night in the calendar; stays with no priced night give none."""
    one = calendar(spark, folder).groupBy("listing_id", "day").agg(F.min("price_cents").alias("price_cents"), F.every("available").alias("available"))
    listed = one.groupBy("listing_id").agg(F.min("day").alias("as_of"))
    windows = dates.checkpoints(listed, "as_of").select("listing_id", "checkin", "checkout")
    return stay_quotes(windows, one, ["listing_id", "checkin", "checkout"]).filter("n_priced > 0")
