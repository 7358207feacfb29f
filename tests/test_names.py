"""Building names against brute force over all pairs, merged signals, prepared requests."""

import random
import re
import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from staylens.operators import buildings, comp_signals
from staylens.plans import intake


def slug(x):
    return " ".join(re.findall("[a-z0-9]+", "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))))


def telling(x):
    return [t for t in x.split() if t not in buildings.NOISE and not t.isdigit()]


def plain_score(raw, hint, canonical, hood, aliases):
    """All eight rules for one pair."""
    s, own, others = slug(raw), slug(canonical), [slug(a) for a in aliases]
    words, sets = telling(s), [telling(x) for x in (own, *others)]
    alike = max(1.0 if not set(words) | set(t) else len(set(words) & set(t)) / len(set(words) | set(t)) for t in sets)
    share = min(len(s), len(own)) / max(len(s), len(own), 1)
    if s == own:
        score = 1.0
    elif s in others:
        score = 0.95
    elif words and words == sets[0]:
        score = 0.88
    elif words and words in sets[1:]:
        score = 0.85
    elif alike >= 0.4:
        score = min(0.82, 0.45 + alike * 0.5)
    elif alike >= 0.22:
        score = 0.30 + alike * 0.5
    elif (own in s or s in own) and len(s) >= 4 and len(own) >= 4 and share >= 0.5:
        score = 0.60 + share * 0.1
    elif words and sets[0] and words[0] == sets[0][0] and len(words[0]) >= 4:
        score = 0.35
    else:
        return None
    return score - (0.15 if hint is not None and hint != hood else 0)


def test_no_pair_that_a_rule_would_score_is_missed(spark):
    draw = random.Random(3)
    parts = ["molino", "moli", "torre", "torreón", "azul", "del", "mar", "villa", "12", "pacifica", "pacific", "sol", "the", "unit", "orquídea", "grand", "a1", "zen", "nova", "novavita"]
    name = lambda: draw.choice([" ", "", "-"]).join(draw.choices(parts, k=draw.randrange(1, 5)))
    catalogue = [(k, f"{name()} {chr(97 + k % 26)}" if k % 3 else name(), draw.choice("XY"), [name() for _ in range(draw.randrange(3))] or None) for k in range(60)]
    names = [(name(), draw.choice([None, "X", "Y"])) for _ in range(150)] + [("Villa 12", None), ("the unit", "X"), ("", None), (None, "X"), ("x", None)] * 2
    got = buildings.building_matches(spark.createDataFrame(names, "raw string, hint string"), spark.createDataFrame(catalogue, "position int, canonical string, hood string, aliases array<string>")).collect()
    for raw, hint in {n for n in names if n[0] is not None}:
        scored = sorted((-round(s, 6), k, c) for k, c, h, al in catalogue if (s := plain_score(raw, hint, c, h, al or [])) is not None)[:5]
        mine = sorted((r.rank, r.canonical, round(r.score, 6)) for r in got if (r.raw, r.hint) == (raw, hint))
        assert mine == [(i + 1, c, round(-s, 6)) for i, (s, _, c) in enumerate(scored)], (raw, hint)


def test_signals_of_three_sources(spark):
    at = lambda d: datetime(2026, 1, d)
    master = spark.createDataFrame([(1, "airbnb", "A1", "u", None, None, 20.1, None, "m"), (2, "airbnb", "A2", None, "Centro", None, None, None, None), (3, "vrbo", "V", "u", "Centro", None, 1.0, 1.0, "v"), (4, "airbnb", "A4", "u", "Centro", None, 20.1, -105.0, None)],
                                   "id long, platform string, external_id string, url string, bucket string, region string, latitude double, longitude double, title string")
    seen = spark.createDataFrame([
        (10, 1, "airbnb", at(1), 300, 100, "USD", 4.0, 9, "old", "x", "Old Town", None, '{"stayLengthNights": "3"}'), (11, 1, "airbnb", at(2), 300, 120, "USD", 4.1, 8, "new", "x", "Amapas", None, '{"stayLengthNights": "x"}'), (12, 1, "airbnb", at(2), 300, 130, None, 4.2, 7, None, "x", None, None, None),
        (13, 2, "vrbo", at(3), 1, 1, "USD", 1.0, 1, "no", "x", "No", None, None), (14, None, "airbnb", at(3), 1, 1, "USD", 1.0, 1, "no", "x", "No", None, None), (15, 4, "airbnb", at(3), 90, 90, "USD", None, 3, None, "x", "Amapas", None, None)],
        "id long, listing_id long, platform string, observed_at timestamp_ntz, total long, nightly long, currency string, rating double, reviews int, title string, location string, bucket string, region string, seed string")
    told = spark.createDataFrame([
        (20, 1, at(1), "ok", "v1", '{"ratingOverall": "4.9", "reviewCount": "two", "maxGuests": 4, "longitude": "-105.5", "petsAllowed": "TRUE", "rawLocationHints": {"addressLocality": "PV"}}'), (21, 1, at(5), "failed", "v1", '{"ratingOverall": "1"}'), (22, 4, at(1), "ok", "v1", "broken")],
        "id long, listing_id long, enriched_at timestamp_ntz, status string, version string, fields string")
    got = {r.id: r for r in comp_signals.comp_signals(master, seen, told).collect()}
    assert sorted(got) == [1, 2, 4]
    one = got[1]
    assert (one.nightly, one.currency, one.bucket, one.rating, one.reviews, one.lat, one.lng, one.title, one.guests, one.pets, one.locality, one.stay_nights) == (130, None, None, 4.9, 7, 20.1, -105.5, "m", 4, True, "PV", None)
    assert (one.has_detail, one.has_price, one.has_geo, one.has_rating, one.minimal, one.rich) == (True, False, True, True, False, False)
    assert (got[2].has_detail, got[2].nightly, got[2].minimal) == (False, None, False)
    assert (got[4].bucket, got[4].has_detail, got[4].has_rating, got[4].minimal, got[4].rich) == ("Centro", True, False, True, False)  # position alone of seven
    richer = told.unionByName(told.filter("id = 22").withColumn("id", F.lit(23)).withColumn("fields", F.lit('{"bedCount": "2", "propertyType": "Condo"}')))
    assert {r.id: r.rich for r in comp_signals.comp_signals(master, seen, richer).collect()}[4]
    assert {r.signal: r.n for r in comp_signals.signal_coverage(comp_signals.comp_signals(master, seen, told)).collect()} == {"has_detail": 2, "has_price": 1, "has_geo": 2, "has_rating": 1, "minimal": 1, "rich": 0}


def test_prepared_requests(spark):
    catalogue = spark.createDataFrame([(0, "Molino de Agua", "Zona Romantica", ["Molino"]), (1, "Pacifica Tower Grand", "Amapas", None)], "position int, canonical string, hood string, aliases array<string>")
    rows = [(1, "Molino", "Zona Romantica", 2, 900, 4.5, ["pool", "Shared  Pool", "pool"]), (2, "Molino", "Amapas", 3, 900, 4.5, ["helipad", "pets please"]), (3, "Nowhere", "Amapas", 1, None, None, ["helipad", None]), (4, None, "Amapas", 1, 0, 0.0, None), (5, "Pacifica Sur Uno", "Amapas", 1, 1, 1.0, ["pool"])]
    got = {r.id: r for r in intake.prepared(spark.createDataFrame(rows, "id int, raw string, hint string, bedrooms int, sqft int, rating double, amenities array<string>"), catalogue).collect()}
    assert (got[1].building, got[1].tier, got[1].accepted, got[1].warnings) == ("Molino de Agua", "high", ["pool", "shared_pool"], [])
    assert got[2].building == "Molino de Agua" and got[2].warnings[0].startswith('Building "Molino de Agua" is in Zona Romantica, not Amapas.') and '"pets please" → "pet_friendly"' in got[2].warnings[1] and got[2].warnings[-1].startswith("Amapas 3BR")
    assert got[3].building is None and got[3].rejected == ["helipad", ""] and len(got[3].warnings) == 5 and got[4].warnings[0].startswith("sqft") and got[4].accepted == []
    assert got[5].building is None or got[5].tier != "low"
