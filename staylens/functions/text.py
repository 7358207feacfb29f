"""String, pattern, JSON and identity expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.numbers import half_up, jaccard, sqm_to_sqft

#: fixed values: query parameters that do not tell listings apart
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "source_impression_id", "_set_bev_on_new_domain", "federated_search_id"]
#: fixed values: number words, English and Spanish
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
                "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10}
#: fixed values: words for bedrooms and bathrooms
ROOMS = r"(?:br|bd|bed(?:room)?s?|rec[aá]maras?|habitaciones?|dormitorios?)"
ROOM_WORDS = r"(?:bedroom|bed|rec[aá]mara|habitaci[oó]n|dormitorio)s?"
BATHS = r"(?:bathrooms?|baths?|ba[nñ]os?)"
#: fixed values: property types by what a label contains, the more specific first
PROPERTY_TYPES = [("serviced apartment", "apartment"), ("rental unit", "apartment"), ("condo", "apartment"), ("apartment", "apartment"), ("townhouse", "townhouse"), ("guest suite", "guest_suite"),
                  ("guesthouse", "guest_suite"), ("guest house", "guest_suite"), ("single-family", "house"), ("single family", "house"), ("house", "house"), ("home", "house"), ("villa", "villa"),
                  ("loft", "loft"), ("bungalow", "bungalow"), ("cottage", "cottage"), ("cabin", "cabin"), ("studio", "studio")]
#: fixed values: weights of a listing's filled fields, out of 100
FIELD_WEIGHTS = {"title": 5, "url": 5, "hood": 10, "bedrooms": 15, "bathrooms": 10, "price": 20, "rating": 8, "reviews": 7, "latitude": 5, "longitude": 5, "guests": 5, "amenities": 5}


def squeezed(x: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def plain(x: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(x), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")


def slug(x: Column, mark: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(plain(x), r"[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def name_tokens(x: Column, stop: list[str]) -> Column:
    """Sorted distinct words of a name without stop words and numbers."""
    words = F.split(F.regexp_replace(plain(x), r"[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~w.isin(*stop))))


def canonical_url(url: Column) -> Column:
    """Lower-cased URL without fragment and tracking parameters, the others sorted by name; repeats of a name keep their order, a bare host gets its slash."""
    bare = F.split_part(F.trim(url), F.lit("#"), F.lit(1))
    path, search = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    whole = F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$"), F.concat(path, F.lit("/"))).otherwise(path)
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    kept = F.filter(F.split(search, "&"), lambda p: (p != "") & ~F.lower(name(p)).isin(*TRACKING))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("name"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    return F.lower(F.when(F.size(kept) > 0, F.concat(whole, F.lit("?"), F.array_join(ordered, "&"))).otherwise(whole))


def identity_key(source: Column, external_id: Column, url: Column) -> Column:
    """source:id, or source:url: and 16 hex digits of the canonical URL's SHA-1."""
    name, ext = F.lower(F.trim(source)), F.trim(external_id)
    return F.when(F.length(ext) > 0, F.concat_ws(":", name, ext)).when(url.isNotNull(), F.concat(name, F.lit(":url:"), F.substring(F.sha1(canonical_url(url)), 1, 16)))


def guarded(x: Column, kind: str) -> Column:
    """Cast only what looks like the kind (int, double, boolean); anything else is null."""
    shapes = {"int": r"^-?[0-9]{1,9}$", "double": r"^-?[0-9]+(\.[0-9]+)?$", "boolean": r"^(?i)(true|false)$"}
    return F.when(x.rlike(shapes[kind]), x).try_cast(kind)


def money(x: Column) -> Column:
    """First dollar amount of a text."""
    return F.regexp_replace(F.nullif(F.regexp_extract(x, r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit("")), ",", "").try_cast("double")


def sqft(x: Column) -> Column:
    """Square feet of a text; square metres are converted where feet are not named."""
    number = lambda unit: F.regexp_replace(F.nullif(F.regexp_extract(x, r"(?i)([0-9,]+\.?[0-9]*)\s*" + unit, 1), F.lit("")), ",", "").try_cast("double")
    feet, metres = number(r"(?:Square\s*Feet|sq\.?\s*ft\.?)"), number(r"(?:Square\s*Met(?:er|re)s?|m²|sq\.?\s*m\.?)")
    return F.when(feet > 0, half_up(feet)).when(metres > 0, sqm_to_sqft(metres))


def number_word(word: Column) -> Column:
    return reduce(lambda a, kv: a.when(word == kv[0], kv[1]), NUMBER_WORDS.items(), F)


def bedrooms(text: Column) -> Column:
    """Bedrooms named in a text, English or Spanish; a studio has none."""
    low = F.lower(text)
    counted = F.nullif(F.regexp_extract(low, r"\b([0-9]+)\s*-?\s*" + ROOMS + r"\b", 1), F.lit("")).try_cast("int")
    bare = low.rlike(r"\b[0-9]+\s*" + ROOMS + r"\b")
    words = F.regexp_extract(low, r"\b(" + "|".join(NUMBER_WORDS) + r")[\s-]+" + ROOM_WORDS + r"\b", 1)
    return F.when(low.rlike(r"\b(?:studio|estudio|monoambiente|efficiency)\b") & ~bare, 0).when(counted <= 20, counted).otherwise(number_word(words))


def bathrooms(text: Column) -> Column:
    low = F.lower(text)
    counted = F.nullif(F.regexp_extract(low, r"\b([0-9]+(?:\.5)?)\s*-?\s*" + BATHS, 1), F.lit("")).try_cast("double")
    words = F.regexp_extract(low, r"\b(" + "|".join(NUMBER_WORDS) + r")[\s-]+" + BATHS, 1)
    return F.when(counted <= 20, counted).otherwise(number_word(words).cast("double"))


def property_type(label: Column) -> Column:
    x = squeezed(label)
    return reduce(lambda a, kv: a.when(x.contains(kv[0]), kv[1]), PROPERTY_TYPES, F).otherwise(F.nullif(x, F.lit("")))


def allowed_type(label: Column, allow: list[str], deny: list[str]) -> Column:
    """Whole-word lists; a denied word wins over an allowed one, no label is not allowed."""
    listed = lambda words: label.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b")
    return F.coalesce(listed(allow) & ~listed(deny), F.lit(False))


def og_title(title: Column) -> Column:
    """Type, rating, bedrooms, beds and baths of a share title such as ``Condo in Town · ★4.96 · 2 bedrooms · 2 beds · 2 baths``."""
    part = lambda pattern: F.nullif(F.regexp_extract(title, pattern, 1), F.lit(""))
    return F.struct(
        F.trim(part(r"^(.+?) in ")).alias("kind"), part(r"★\s*([0-9.]+)").try_cast("double").alias("rating"), part(r"([0-9]+) bedrooms?").try_cast("int").alias("bedrooms"),
        part(r"([0-9]+) beds?\b").try_cast("int").alias("beds"), part(r"([0-9.]+) (?:private |shared )?baths?").try_cast("double").alias("baths"))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, common entities decoded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " "), r"<[^>]+>", " ")
    for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(letter))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def canonical_amenities(raw: Column, names: Column) -> Column:
    """Sorted distinct canonical keys of raw labels through a map of names; unknown labels drop out."""
    keys = F.transform(raw, lambda a: F.element_at(names, squeezed(a)))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def name_score(raw: Column, known: Column, stop: list[str]) -> Column:
    """Likeness of a raw building name to a catalogue name: equal, equal slug, contained, shared words."""
    a, b = slug(raw), slug(known)
    x, y = name_tokens(raw, stop), name_tokens(known, stop)
    shared, both = F.size(F.array_intersect(x, y)), (F.size(x) > 0) & (F.size(y) > 0)
    likeness = jaccard(x, y)
    subset = both & ((shared == F.size(x)) | (shared == F.size(y)))
    return (F.when(squeezed(raw) == squeezed(known), 1.0).when(a == b, 0.95).when(both & (x == y), 0.88).when(a.contains(b) | b.contains(a), 0.85)
            .when(subset, F.least(F.lit(0.82), 0.45 + 0.5 * likeness)).when(both & (shared > 0), 0.30 + 0.5 * likeness).otherwise(0.0))


def confidence(fields: dict[str, Column]) -> Column:
    """Share of weighted fields that are filled; ``fields`` gives a boolean for each field at hand."""
    total = reduce(lambda a, b: a + b, [F.when(fields[k], w).otherwise(0) for k, w in FIELD_WEIGHTS.items() if k in fields])
    return half_up(total / F.lit(100.0), 3)
