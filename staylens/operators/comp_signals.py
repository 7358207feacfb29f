"""What is known of a listing from three sources: its master row, its latest observation and its latest sound detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.operators.latest import first_per_key

#: fixed value: enrichments, of seven, that make a usable listing a rich one
RICH = 3


def comp_signals(master: DataFrame, observations: DataFrame, details: DataFrame, platform: str = "airbnb") -> DataFrame:
    """One row for each master row of a platform, with what the sources say together, which signals it has and what it is good for.

    ``master``: id, platform, external_id, url, bucket, region, latitude, longitude, title. ``observations``: id, listing_id, platform,
    observed_at, total, nightly, currency, rating, reviews, title, location, bucket, region, seed (JSON). ``details``: id, listing_id,
    enriched_at, status, version, fields (JSON); only those with status ok count. The latest is the one of greatest time, then of
    greatest id. Position, rating, reviews and title come from the detail before the observation before the master row, place
    from the master row before the observation, capacity and kind from the detail alone. A malformed number or flag in JSON is null.
    """
    c = F.col
    held = lambda name, kind: text.guarded(F.get_json_object("fields", f"$.{name}"), kind)
    said = lambda path: F.get_json_object("fields", f"$.{path}")
    o = first_per_key(observations.filter((c("platform") == platform) & c("listing_id").isNotNull()), ["listing_id"], [F.desc("observed_at"), F.desc("id")]).select(
        c("listing_id").alias("id"), "observed_at", "total", "nightly", "currency", c("rating").alias("o_rating"), c("reviews").alias("o_reviews"), c("title").alias("o_title"), "location",
        c("bucket").alias("o_bucket"), c("region").alias("o_region"), text.guarded(F.get_json_object("seed", "$.stayLengthNights"), "int").alias("stay_nights"))
    d = first_per_key(details.filter("status = 'ok'"), ["listing_id"], [F.desc("enriched_at"), F.desc("id")]).select(
        c("listing_id").alias("id"), "enriched_at", "version", held("latitude", "double").alias("d_lat"), held("longitude", "double").alias("d_lng"), held("ratingOverall", "double").alias("d_rating"), held("reviewCount", "int").alias("d_reviews"),
        held("imageCount", "int").alias("images"), held("maxGuests", "int").alias("guests"), held("bedCount", "int").alias("beds"), said("propertyType").alias("kind"), held("petsAllowed", "boolean").alias("pets"),
        said("title").alias("d_title"), said("description").alias("description"), said("rawLocationHints.addressLocality").alias("locality"), F.lit(True).alias("_detail"))
    m = master.filter(c("platform") == platform).join(o, "id", "left").join(d, "id", "left").select(
        "id", "external_id", "url", F.coalesce("bucket", "o_bucket").alias("bucket"), F.coalesce("region", "o_region").alias("region"), "location", "locality", F.coalesce("d_lat", "latitude").alias("lat"), F.coalesce("d_lng", "longitude").alias("lng"),
        "total", "nightly", "currency", "stay_nights", "observed_at", F.coalesce("d_rating", "o_rating").alias("rating"), F.coalesce("d_reviews", "o_reviews").alias("reviews"), "images", "guests", "beds", "kind", "pets",
        F.coalesce("d_title", "o_title", "title").alias("title"), "description", "enriched_at", "version", F.coalesce("_detail", F.lit(False)).alias("has_detail"))

    def all_of(*names: str) -> Column:
        known = c(names[0]).isNotNull()
        for n in names[1:]:
            known = known & c(n).isNotNull()
        return known

    minimal = all_of("bucket", "nightly", "currency", "url")
    riches = sum((all_of(*x).cast("int") for x in (("rating", "reviews"), ("lat", "lng"), ("guests",), ("beds",), ("kind",), ("images",), ("title",))), F.lit(0))
    return m.withColumns({"has_price": all_of("nightly", "currency"), "has_geo": all_of("lat", "lng"), "has_rating": all_of("rating", "reviews"), "minimal": minimal, "rich": minimal & (riches >= RICH)})


def signal_coverage(signals: DataFrame) -> DataFrame:
    """How many rows have each signal: rows (signal, n, total)."""
    names = ["has_detail", "has_price", "has_geo", "has_rating", "minimal", "rich"]
    counted = signals.agg(F.count("*").alias("total"), *[F.count_if(n).alias(n) for n in names])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("n")) for n in names])).alias("x"), "total").select("x.*", "total")
