"""Typed names of buildings against a catalogue of any size: candidates by shared keys, then eight rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions import numbers, text
from staylens.functions.numbers import half_up

#: fixed values: words that do not tell buildings apart
NOISE = ["pv", "pvr", "puerto", "vallarta", "unit", "units", "suite", "suites", "penthouse", "ph", "condo", "condominium", "condominios", "villa", "villas", "casa", "casas", "beach", "by", "the", "a", "de", "del", "el", "la", "los", "las", "y", "and", "at", "in"]
#: fixed values: penalty of another neighbourhood, least score of a match, scores from which it is high or medium
CROSS_HOOD, ACCEPTED, HIGH, MEDIUM = 0.15, 0.55, 0.90, 0.65
#: letters of the pieces that names which hold each other share
GRAM = 4


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(text.plain(name), "[^a-z0-9]+", " "))


def telling(slugged: Column) -> Column:
    """Words of a slug that are neither noise nor numbers."""
    return F.filter(F.split(slugged, " "), lambda t: (t != "") & ~t.rlike("^[0-9]+$") & ~t.isin(*NOISE))


def _grams(x: Column) -> Column:
    """All runs of four letters of a text, none of a shorter one."""
    return F.when(F.length(x) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(x) - (GRAM - 1)), lambda i: x.substr(i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def _head(x: Column) -> Column:
    return F.when(F.length(x) >= GRAM, F.array(x.substr(1, GRAM))).otherwise(F.array().cast("array<string>"))


def _keys(*kinds: tuple[str, Column]) -> Column:
    """Distinct keys, each with the letter of its kind before it."""
    def named(kind: str, xs: Column) -> Column:
        return F.transform(xs, lambda x: F.concat(F.lit(kind), x))

    return F.array_distinct(F.concat(*[named(kind, xs) for kind, xs in kinds]))


def building_matches(names: DataFrame, catalogue: DataFrame, most: int = 5) -> DataFrame:
    """Rows (raw, hint, rank, canonical, hood, score) of the ``most`` best entries for each distinct raw name and hint.

    ``names``: raw, hint (a neighbourhood or null). ``catalogue``: position, canonical, hood, aliases. Equal names score before equal
    aliases, then names without noise, then shared words, containment and the first word; an entry of another neighbourhood than the
    hint's loses 0.15. Ties go to the smaller position; null names match nothing.

    A name meets only entries that share a key with it, and each rule has one: the whole slug, a telling word, having no telling words, or,
    for a name that holds another, the first four letters of the shorter among all runs of four of the longer. So no pair that a rule
    would score is missed, and names and entries never meet without a key.
    """
    c = F.col
    raw = names.filter("raw IS NOT NULL").select("raw", "hint").distinct().withColumn("slug", slug(c("raw"))).withColumn("words", telling(c("slug")))
    none = lambda words: F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    entries = catalogue.withColumn("own", slug(c("canonical"))).withColumn("others", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), slug))
    entries = entries.withColumn("forms", F.concat(F.array("own"), c("others"))).withColumn("sets", F.transform("forms", telling)).select("position", "canonical", "hood", "own", "others", "forms", "sets")
    asked = raw.select("raw", "hint", F.explode(_keys(("s", F.array("slug")), ("w", c("words")), ("e", none(c("words"))), ("r", _head(c("slug"))), ("c", _grams(c("slug"))))).alias("key"))
    empty = F.flatten(F.transform("sets", none))
    held = entries.select("position", F.explode(_keys(("s", c("forms")), ("w", F.flatten("sets")), ("e", empty), ("r", _grams(c("own"))), ("c", _head(c("own"))))).alias("key"))
    pairs = asked.join(held, "key").select("raw", "hint", "position").distinct()
    # null hints are a name's own
    met = pairs.join(raw.withColumnsRenamed({"raw": "raw_", "hint": "hint_"}), (c("raw") == c("raw_")) & c("hint").eqNullSafe(c("hint_"))).join(entries, "position")
    words, joined = c("words"), F.array_join("words", " ")
    bare = F.transform("sets", lambda s: F.array_join(s, " "))
    alike = F.array_max(F.transform("sets", lambda s: numbers.jaccard(words, s)))
    share = F.least(F.length("slug"), F.length("own")) / F.greatest(F.length("slug"), F.length("own"))
    inside = (c("slug").contains(c("own")) | c("own").contains(c("slug"))) & (F.length("slug") >= GRAM) & (F.length("own") >= GRAM) & (share >= 0.5)
    first = F.get(words, F.lit(0))
    score = (F.when(c("slug") == c("own"), 1.0).when(F.array_contains("others", c("slug")), 0.95).when((F.size(words) > 0) & (joined == F.get(bare, F.lit(0))), 0.88).when((F.size(words) > 0) & F.array_contains(F.slice(bare, F.lit(2), F.size("others")), joined), 0.85)
             .when(alike >= 0.4, F.least(F.lit(0.82), 0.45 + alike * 0.5)).when(alike >= 0.22, 0.30 + alike * 0.5).when(inside, 0.60 + share * 0.1).when((first == F.get(F.get("sets", F.lit(0)), F.lit(0))) & (F.length(first) >= GRAM), 0.35))
    scored = met.withColumn("score", half_up(score - F.when(c("hint").isNull() | (c("hint") == c("hood")), 0.0).otherwise(CROSS_HOOD), 6)).filter("score IS NOT NULL")
    best = Window.partitionBy("raw", "hint").orderBy(F.desc("score"), "position")
    return scored.withColumn("rank", F.row_number().over(best)).filter(c("rank") <= most).select("raw", "hint", "rank", "canonical", "hood", "score")


def resolved(names: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``names`` (keys, raw, hint) with building, building_hood, score, tier and suggestions (up to five names, best first)."""
    c = F.col
    best = matches.groupBy(c("raw").alias("raw_"), c("hint").alias("hint_")).agg(
        F.min_by(F.struct("canonical", "hood", "score"), "rank").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical"))), lambda x: x["canonical"]).alias("suggestions"))
    told = names.join(best, (c("raw") == c("raw_")) & c("hint").eqNullSafe(c("hint_")), "left")
    score = F.when(c("best.score") >= ACCEPTED, c("best.score"))
    return told.select(
        *keys, "raw", "hint", F.when(score.isNotNull(), c("best.canonical")).alias("building"), F.when(score.isNotNull(), c("best.hood")).alias("building_hood"), score.alias("score"),
        F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").when(score.isNotNull(), "low").alias("tier"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
