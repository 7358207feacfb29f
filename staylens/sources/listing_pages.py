"""Listing pages: nodes of embedded JSON, fields by a table of rules for each platform, discovery details, mini-calendars.

Everything happens inside a page's row: no page is shuffled, and no Python runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.operators.stats import upper_of

#: fixed value: the start of the script that holds a page's deferred state
STATE = r'(?s)<script[^>]*data-deferred-state[^>]*>(.*?)</script>'
#: fixed value: JSON-LD blocks of a page
LINKED_DATA = r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'
#: fixed values: types of JSON-LD blocks that describe a place to stay
STAY_TYPES = ["LodgingBusiness", "VacationRental", "Accommodation", "Resort", "Product"]
#: fixed values: classes of a calendar cell that tell a night taken
TAKEN = ["occ", "dep", "arr"]
#: fixed values: bounds of a page's length, of bathrooms and of a night's price
SHORTEST_DETAIL, MOST_BATHS, MOST_PRICE = 1_000, 20, 50_000


# ---- nodes of embedded JSON

def nodes(pages: DataFrame, typename: str, html: str = "html", depth: int = 16) -> DataFrame:
    """Objects of a type in a page's deferred state, however they nest: the columns of ``pages`` but ``html``, and node (variant).

    The tree is walked level by level: each level keeps the objects found and opens all objects and arrays, so a found object may
    hold others. Pages without a state, or with malformed JSON, give no rows. JSON that nests deeper than ``depth`` levels is an
    error and never cut.
    """
    kept = [c for c in pages.columns if c != html]
    object_of = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    children = lambda v: F.coalesce(F.map_values(object_of(v)), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    level = pages.select(*kept, F.try_parse_json(F.regexp_extract(html, STATE, 1)).alias("v"), F.lit(False).alias("found")).filter("v IS NOT NULL")
    for _ in range(depth):
        v = F.col("v")
        mine = F.when(F.try_variant_get(v, "$.__typename", "string") == typename, F.array(F.struct(v.alias("v"), F.lit(True).alias("found"))))
        below = F.transform(children(v), lambda c: F.struct(c.alias("v"), F.lit(False).alias("found")))
        step = F.when(F.col("found"), F.array(F.struct(v.alias("v"), F.lit(True).alias("found")))).otherwise(
            F.concat(F.coalesce(mine, F.array().cast("array<struct<v:variant,found:boolean>>")), below))
        level = level.select(*kept, F.explode(step).alias("x")).select(*kept, "x.v", "x.found")
    deeper = F.size(children(F.col("v"))) > 0
    checked = F.when(~F.col("found") & deeper, F.raise_error(F.lit(f"JSON nests deeper than {depth} levels")).cast("boolean")).otherwise(F.col("found"))
    return level.filter(checked).select(*kept, F.col("v").alias("node"))


# ---- fields by rules

class Rule(NamedTuple):
    """Where a platform's page holds a field: of several rules for one field the first that finds something counts.

    kind: spec (a label of the specification list), ld (a path in JSON-LD), key (a key of any JSON in the page), meta (a meta
    tag), tag (the text of an element), rows (the middle price of the table rows), url (the last part of the path).
    """

    platform: str
    field: str
    kind: str
    place: str


#: fixed values: labels, keys and paths that the platforms' pages use
RULES = [
    *[Rule("pvrpv", f, "spec", p) for f, p in (("kind", "type"), ("bedrooms", "bed(s)"), ("bathrooms", "bath(s)"), ("guests", "sleeps(s)"), ("size", "square space"), ("built", "year built"), ("area", "area"))],
    Rule("pvrpv", "title", "ld", "$.name"), Rule("pvrpv", "title", "tag", "h1"), Rule("pvrpv", "price", "rows", "USD"), Rule("pvrpv", "rating", "ld", "$.aggregateRating.ratingValue"), Rule("pvrpv", "external_id", "url", ""),
    *[Rule("vrbo", f, k, p) for f, k, p in (
        ("title", "ld", "$.name"), ("title", "meta", "og:title"), ("title", "tag", "title"), ("bedrooms", "ld", "$.numberOfBedrooms"), ("bedrooms", "ld", "$.numberOfRooms"), ("bedrooms", "key", "bedrooms"), ("bedrooms", "key", "bedroomCount"),
        ("bathrooms", "ld", "$.numberOfBathroomsTotal"), ("bathrooms", "key", "bathrooms"), ("bathrooms", "key", "bathroomCount"), ("guests", "ld", "$.occupancy.maxOccupancy"), ("guests", "key", "sleeps"), ("guests", "key", "maxSleep"),
        ("price", "key", "nightlyPrice"), ("price", "key", "baseRatePerNight"), ("rating", "ld", "$.aggregateRating.ratingValue"), ("rating", "key", "averageRating"), ("size", "ld", "$.floorSize.value"),
        ("area", "key", "neighborhood"), ("area", "ld", "$.address.addressLocality"), ("kind", "ld", "$.accommodationCategory"), ("kind", "key", "propertyType"), ("external_id", "url", ""))],
    *[Rule("airbnb", f, k, p) for f, k, p in (
        ("title", "meta", "og:title"), ("title", "ld", "$.name"), ("bedrooms", "key", "bedrooms"), ("bedrooms", "ld", "$.numberOfRooms"), ("bathrooms", "key", "bathrooms"), ("guests", "key", "personCapacity"), ("rating", "ld", "$.aggregateRating.ratingValue"),
        ("rating", "key", "guestSatisfactionOverall"), ("area", "ld", "$.address.addressLocality"), ("kind", "key", "roomType"), ("external_id", "url", ""))],
]
#: fields in the order in which they come out, with the type of their first number (or text)
FIELDS = {"external_id": "string", "title": "string", "kind": "string", "area": "string", "bedrooms": "int", "bathrooms": "double", "guests": "int", "size": "double", "built": "int", "price": "double", "rating": "double"}


def spec_items(html: Column) -> Column:
    """Texts of a page's list items."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), text.html_text), lambda x: x != "")


def spec_map(html: Column) -> Column:
    """Map of the specification list: what stands before the first colon, in lower case, to what follows; of equal labels the first."""
    pairs = F.transform(F.filter(spec_items(html), lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def stay_block(html: Column) -> Column:
    """JSON text of the first JSON-LD block, or member of one that is a list, that describes a place to stay; null without any."""
    parsed = F.transform(F.regexp_extract_all(html, F.lit(LINKED_DATA), F.lit(1)), lambda x: F.try_parse_json(x))
    members = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    return F.get(F.filter(members, lambda v: F.try_variant_get(v, "$['@type']", "string").isin(*STAY_TYPES)), F.lit(0)).cast("variant")


def row_price(html: Column, unit: Column) -> Column:
    """The middle one (of an even number the greater) of the prices with a unit in a page's table rows, within bounds."""
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), text.html_text)
    price = lambda x: text.money(F.when(x.contains(unit), x))
    prices = F.array_sort(F.filter(F.transform(rows, price), lambda p: (p > 0) & (p < MOST_PRICE)))
    return upper_of(prices).cast("string")


def platform_fields(pages: DataFrame, rules: Sequence[Rule] = RULES, platform: str = "platform", url: str = "url", html: str = "html") -> DataFrame:
    """The columns of ``pages`` but ``html``, with each field of ``FIELDS`` as the page's platform writes it.

    A platform without rules gives nulls, as does a field that no rule finds or that holds no number where one belongs.
    """
    kept = [x for x in pages.columns if x != html]
    page, path = F.col(html), F.split_part(F.col(url), F.lit("?"), F.lit(1))
    read = pages.withColumn("_specs", spec_map(page)).withColumn("_ld", F.to_json(stay_block(page)))

    def value(rule: Rule) -> Column:
        exact = re.escape(rule.place)
        found = {
            "spec": lambda: F.try_element_at("_specs", F.lit(rule.place)), "ld": lambda: F.get_json_object("_ld", rule.place),
            "key": lambda: F.regexp_extract(page, f'"{exact}"\\s*:\\s*"?([^",\\]}}]+)', 1), "meta": lambda: F.regexp_extract(page, f'(?i)<meta[^>]*(?:property|name)="{exact}"[^>]*content="([^"]*)"', 1),
            "tag": lambda: F.regexp_extract(page, f"(?is)<{exact}[^>]*>([^<]*)<", 1), "rows": lambda: row_price(page, F.lit(rule.place)), "url": lambda: F.regexp_extract(path, "([^/]+)/*$", 1)}
        return F.nullif(F.trim(found[rule.kind]()), F.lit(""))

    def of(field: str) -> Column:
        own = {p: [value(r) for r in rules if (r.platform, r.field) == (p, field)] for p in dict.fromkeys(r.platform for r in rules)}
        return reduce(lambda x, p: x.when(F.col(platform) == p, F.coalesce(*own[p])), [p for p in own if own[p]], F.when(F.lit(False), F.lit(None).cast("string")))

    out = []
    for field, kind in FIELDS.items():
        number = F.nullif(F.regexp_extract(F.regexp_replace(of(field), ",", ""), r"(\d+(?:\.\d+)?)", 1), F.lit(""))
        out.append((of(field) if kind == "string" else number.try_cast("double").cast(kind)).alias(field))
    return read.select(*kept, *out)


# ---- discovery details

def _meta(html: Column, name: str) -> Column:
    """Content of a meta tag, whichever attribute stands first, with its entities read."""
    one, other = (F.regexp_extract(html, p, 1) for p in (
        rf'(?i)<meta[^>]*property=["\']{name}["\'][^>]*content=["\']([^"\']+)', rf'(?i)<meta[^>]*content=["\']([^"\']+)["\'][^>]*property=["\']{name}["\']'))
    raw = F.coalesce(F.nullif(one, F.lit("")), F.nullif(other, F.lit("")))
    entities = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}
    return F.trim(reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), entities.items(), raw))


def loose_number(x: Column) -> Column:
    """The number that a text begins with, null without one."""
    return F.nullif(F.regexp_extract(F.trim(x), r"^([+-]?\d+(?:\.\d*)?)", 1), F.lit("")).try_cast("double")


def _baths(x: Column) -> Column:
    """Bathrooms of a text by number, up to twenty, else by word."""
    count = F.nullif(F.regexp_extract(F.lower(x), rf"\b(\d+(?:\.5)?)\s*-?\s*(?:(?:private|shared)\s+)?{text.BATHS}\b", 1), F.lit("")).try_cast("double")
    named = text.number_word(F.regexp_extract(F.lower(x), r"\b([a-z]+)[\s-]+" + text.BATHS + r"\b", 1)).cast("double")
    return F.coalesce(F.when(count <= MOST_BATHS, count), F.when(count.isNull(), named))


def discovery_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but ``html``, with title, kind, place, bedrooms, bathrooms, latitude, longitude.

    Title, kind, place and rooms come from the share title, then from JSON-LD; bathrooms also from JSON keys, the share description
    and the text; coordinates from JSON-LD, then from any JSON. A page under 1,000 characters, or none, gives nulls.
    """
    page = F.when(F.length(html) >= SHORTEST_DETAIL, F.col(html))
    kept = [x for x in pages.columns if x != html]
    read = pages.withColumn("_page", page).withColumn("_og", _meta(F.col("_page"), "og:title")).withColumn("_ld", F.to_json(stay_block(F.col("_page"))))
    og, p = F.col("_og"), F.col("_page")
    ld = lambda *paths: F.coalesce(*[F.get_json_object("_ld", x) for x in paths])
    head = F.trim(F.regexp_extract(og, "^([^·•|]*)", 1))
    known = head.rlike("(?i).\\s+in\\s+.")
    kind, place = F.trim(F.regexp_extract(head, r"(?i)^(.+?)\s+in\s+", 1)), F.trim(F.regexp_extract(head, r"(?i)^.+?\s+in\s+(.+)$", 1))
    bare = F.trim(F.regexp_replace(kind, r"(?i)^(entire|private|shared)\s+", ""))
    number = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).try_cast("double")
    key = number(r'"(?:bathrooms|bathroomCount|bathroomsTotal|numberOfBathrooms)"\s*:\s*(\d+(?:\.5)?)')
    label = F.nullif(F.regexp_extract(p, r'(?i)"(?:bathroomLabel|subtitleLabel|bathroomString)"\s*:\s*"([^"]*)"', 1), F.lit(""))
    baths = F.coalesce(_baths(og), loose_number(ld("$.numberOfBathroomsTotal")), F.when(key <= MOST_BATHS, key), _baths(label), _baths(_meta(p, "og:description")), _baths(p))
    return read.select(
        *kept, F.coalesce(og, ld("$.name")).alias("title"), F.when(known, F.coalesce(F.nullif(bare, F.lit("")), kind)).alias("kind"),
        F.coalesce(F.when(known, place), ld("$.address.addressLocality", "$.address.addressRegion")).alias("place"),
        F.coalesce(F.nullif(F.regexp_extract(og, r"(?i)(\d+(?:\.\d+)?)\s*bedroom", 1), F.lit("")).try_cast("double"), loose_number(ld("$.numberOfBedrooms", "$.numberOfRooms"))).alias("bedrooms"), baths.alias("bathrooms"),
        F.coalesce(loose_number(ld("$.geo.latitude")), number(r'"lat(?:itude)?"\s*:\s*(-?\d+\.\d+)')).alias("latitude"),
        F.coalesce(loose_number(ld("$.geo.longitude")), number(r'"(?:lng|long|longitude)"\s*:\s*(-?\d+\.\d+)')).alias("longitude"))


# ---- mini-calendars

def mini_calendar(pages: DataFrame, html: str = "html") -> DataFrame:
    """Day rows of a calendar in HTML: the columns of ``pages`` but ``html``, and position, day, available, price.

    A month's heading holds for the day cells up to the next heading; one that names no month drops its cells, and so do cells
    without a number and days that the month does not have. A cell is taken if the inner of its two boxes has a class of ``TAKEN``.
    """
    kept = [x for x in pages.columns if x != html]
    blocks = pages.select(*kept, F.posexplode(F.split(html, r'(?i)(?=<th\s+colspan="7">)')).alias("block", "_block"))
    heading = F.regexp_extract("_block", r'(?i)^<th\s+colspan="7">([a-z]+(?:&nbsp;|\s+)\d{4})</th>', 1)
    months = blocks.withColumn("_month", F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(F.regexp_replace(heading, r"&nbsp;|\s+", " "))), F.lit("d MMMM yyyy")).cast("date")).filter("_month IS NOT NULL")
    cells = months.select(*kept, "block", "_month", F.posexplode(F.regexp_extract_all("_block", F.lit(r'(?is)<td[^>]*class="no-padding"[^>]*>(.*?)</td>'), F.lit(1))).alias("at", "_cell"))
    boxes = F.regexp_extract_all("_cell", F.lit(r'<div class="([^"]*)">'), F.lit(1))
    number = F.nullif(F.regexp_extract("_cell", r'<div class="box-cal">(\d{1,2})</div>', 1), F.lit("")).cast("int")
    dated = cells.withColumn("_n", number).filter((F.col("_n") >= 1) & (F.col("_n") <= F.dayofmonth(F.last_day("_month"))))
    taken = F.arrays_overlap(F.split(F.coalesce(F.get(boxes, F.lit(1)), F.lit("")), r"\W+"), F.array(*map(F.lit, TAKEN)))
    return dated.select(
        *kept, (F.col("block") * 1_000 + F.col("at")).alias("position"), F.date_add("_month", F.col("_n") - 1).alias("day"), (~taken).alias("available"),
        text.money(F.regexp_extract("_cell", r"(?is)<small>(.*?)</small>", 1)).alias("price"))
