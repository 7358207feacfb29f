"""Runs of a collector: batches until a reason to stop, summaries with alerts, and inserts that count themselves as they write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from staylens.functions.numbers import ratio

#: fixed values: a run ends after so many batches without anything new, so many observations or so many seconds
ZERO_LIMIT, MOST_OBSERVED, MOST_SECONDS = 2, 500, 300
#: fixed values: reasons of an alert, in their order
ALERTS = [
    ("fail", "All {} listings failed — Airbnb pricing has gone dark"), ("fail", "0 quotes written despite a non-empty cohort"), ("fail", "Calendar SHA rediscovered {} times in one run — persisted-query rotation is unstable"),
    ("fail", "Quote SHA rediscovered {} times in one run — persisted-query rotation is unstable"), ("warn", "No Airbnb listings matched the cohort filter"), ("warn", "{}/{} listings failed (>=50%)")]


def run_endings(batches: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, zero_limit: int = ZERO_LIMIT, most_observed: int = MOST_OBSERVED, most_seconds: float = MOST_SECONDS) -> DataFrame:
    """Where and why each run ends: keys, batches, observed, new, duplicates, zero_streak, seconds, reason.

    ``batches``: keys, ``order`` (names a batch within its run), ``at`` (timestamp), observed, new. After each batch the reasons are
    asked in this order: ``zero_limit`` batches in a row without anything new (duplicate_only if the run found nothing at all, else
    exhausted), ``most_observed`` observations (manual_cap), ``most_seconds`` since the first batch (timeout). The first batch with a
    reason closes the run; later ones do not count. A run without any reason is ``running``. Two windows over one order of a run.
    """
    c = F.col
    run = Window.partitionBy(*keys).orderBy(*order)
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    x = batches.withColumns({
        "batches": F.row_number().over(run), "total": F.sum("observed").over(upto), "found": F.sum("new").over(upto), "copies": F.sum(F.greatest(F.lit(0), c("observed") - c("new"))).over(upto),
        "seconds": (F.unix_micros(c(at).cast("timestamp")) - F.unix_micros(F.first(at).over(upto).cast("timestamp"))) / 1_000_000})
    # the batch of the last find: what follows it is the streak
    x = x.withColumn("zero_streak", c("batches") - F.coalesce(F.max(F.when(c("new") != 0, c("batches"))).over(upto), F.lit(0)))
    reason = (F.when(c("zero_streak") >= zero_limit, F.when(c("found") == 0, "duplicate_only").otherwise("exhausted"))
              .when(c("total") >= most_observed, "manual_cap").when(c("seconds") >= most_seconds, "timeout"))
    state = F.struct("batches", c("total").alias("observed"), c("found").alias("new"), c("copies").alias("duplicates"), "zero_streak", "seconds", F.coalesce("reason", F.lit("running")).alias("reason"))
    x = x.withColumn("reason", reason)
    ends = x.groupBy(*keys).agg(F.coalesce(F.min_by(state, F.when(c("reason").isNotNull(), c("batches"))), F.max_by(state, "batches")).alias("s"))
    return ends.select(*keys, "s.*")


def alert(attempted: Column, ok: Column, quotes: Column, calendar_finds: Column, quote_finds: Column) -> Column:
    """Struct (level, reason) of a run's counts: failures before warnings, the first that holds; ok without any."""
    failed = attempted - ok
    some = attempted > 0
    cases = [(some & (ok == 0), [attempted]), (some & (quotes == 0), []), (calendar_finds > 1, [calendar_finds]), (quote_finds > 1, [quote_finds]), (attempted == 0, []), ((failed > 0) & (failed * 2 >= attempted), [failed, attempted])]
    level, reason = F, F
    for (holds, values), (name, words) in zip(cases, ALERTS, strict=True):
        level, reason = level.when(holds, name), reason.when(holds, F.format_string(words.replace("%", "%%").replace("{}", "%d"), *[v.cast("long") for v in values]))
    return F.struct(level.otherwise("ok").alias("level"), reason.otherwise("").alias("reason"))


def run_summary(runs: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a run of ``runs`` (keys): attempted, ok, failed, quotes, enrichment_rate, level, reason.

    ``results``: keys, ok, quotes, available, enriched, calendar_finds, quote_finds, one row a listing tried. A run without results
    matched nobody. The rate is null where nothing was available.
    """
    c = F.col
    counted = results.groupBy(*keys).agg(F.count("*").alias("attempted"), F.count_if("ok").alias("n_ok"), *[F.sum(k).alias(k) for k in ("quotes", "available", "enriched", "calendar_finds", "quote_finds")])
    x = runs.join(counted, list(keys), "left").fillna(0, ["attempted", "n_ok", "quotes", "available", "enriched", "calendar_finds", "quote_finds"])
    told = x.withColumn("_a", alert(c("attempted"), c("n_ok"), c("quotes"), c("calendar_finds"), c("quote_finds")))
    return told.select(*keys, "attempted", c("n_ok").alias("ok"), (c("attempted") - c("n_ok")).alias("failed"), "quotes", ratio(c("enriched"), c("available")).alias("enrichment_rate"), "_a.level", "_a.reason")


def insert_counted(batch: DataFrame, held: DataFrame, keys: Sequence[str], path: str) -> dict[str, int]:
    """Append to the table at ``path`` the rows whose key ``held`` and the batch's earlier rows lack; counts come from the writing pass.

    Returns attempted, inserted and skipped. Of rows that share a key one is written; an empty batch writes nothing. A null in a key equals nothing that is held.
    """
    if batch.isEmpty():  # a plan that is known to be empty reports no counts
        return {"attempted": 0, "inserted": 0, "skipped": 0}
    seen, written = Observation(), Observation()
    asked = batch.observe(seen, F.count(F.lit(1)).alias("n"))
    fresh = asked.dropDuplicates(list(keys)).join(held.select(*keys).distinct(), list(keys), "left_anti").observe(written, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").parquet(path)
    attempted, inserted = seen.get["n"], written.get["n"]
    return {"attempted": attempted, "inserted": inserted, "skipped": attempted - inserted}


# ---- buckets of a discovery run

#: fixed values: neighbourhoods, bedroom bands and price bands of the buckets, in their order
HOODS = ["zona_romantica", "amapas", "conchas_chinas", "centro", "cinco_de_diciembre", "versalles", "fluvial", "marina_vallarta", "nuevo_vallarta", "bucerias"]
BEDS = ["1", "2", "3", "4", "5_plus"]
PRICES = ["under_100", "100_200", "200_400", "400_plus"]
#: fixed values: groups that run first, in their order (neighbourhoods, bedrooms, prices)
FIRST_GROUPS = [
    (["zona_romantica"], ["1", "2", "3"], ["100_200", "200_400"]), (["zona_romantica"], ["1"], ["under_100", "400_plus"]), (["versalles"], ["1", "2"], ["under_100", "100_200", "200_400"]),
    (["fluvial"], ["1", "2"], ["under_100", "100_200", "200_400"]), (["marina_vallarta"], ["1", "2"], ["100_200", "200_400", "400_plus"]), (["nuevo_vallarta"], ["1", "2"], ["100_200", "200_400", "400_plus"]),
    (["centro"], ["1", "2"], ["under_100", "100_200", "200_400"]), (["amapas"], ["1", "2"], ["100_200", "200_400"])]
#: fixed values: what makes the first and the second tier (tier, neighbourhoods, bedrooms, prices); all else is the third
TIERS = [
    (1, ["zona_romantica", "centro", "versalles", "fluvial", "marina_vallarta", "nuevo_vallarta", "amapas"], ["1", "2"], ["under_100"]),
    (1, ["zona_romantica", "centro", "versalles", "fluvial", "marina_vallarta", "nuevo_vallarta", "amapas"], ["1", "2", "3"], ["100_200", "200_400", "400_plus"]),
    (2, ["conchas_chinas", "amapas", "marina_vallarta", "centro", "versalles", "fluvial"], ["3", "4"], ["200_400", "400_plus"])]
LAST_TIER = 3


def bedroom_band(bedrooms: Column) -> Column:
    return F.when(bedrooms >= 5, "5_plus").when(bedrooms >= 1, bedrooms.cast("int").cast("string"))


def price_band(dollars: Column) -> Column:
    return F.when(dollars < 100, PRICES[0]).when(dollars < 200, PRICES[1]).when(dollars < 400, PRICES[2]).when(dollars.isNotNull(), PRICES[3])


def execution_order(df: DataFrame, hood: str = "hood", beds: str = "beds", price: str = "price") -> DataFrame:
    """Rows of ``df`` with the tier of their bucket, its execution_rank and its position among all buckets.

    Rules are a relation of buckets: each rule's bands are unfolded, and the least number that a bucket has counts. Groups that run
    first rank by their number, all other buckets by tier, neighbourhood, bedrooms and price. Equal ranks follow in the order of the
    buckets. Rows outside all buckets drop out.
    """
    c, spark = F.col, df.sparkSession
    names = [hood, beds, price]
    unfold = lambda rows, schema: _unfolded(spark.createDataFrame(rows, schema))
    product = spark.createDataFrame([(HOODS, BEDS, PRICES)], "h array<string>, b array<string>, p array<string>")
    buckets = product.select(F.posexplode("h").alias("hi", hood), "b", "p").select("hi", hood, F.posexplode("b").alias("bi", beds), "p").select("hi", hood, "bi", beds, F.posexplode("p").alias("pi", price))
    tiers = unfold(TIERS, "tier int, h array<string>, b array<string>, p array<string>").toDF("tier", *names).groupBy(*names).agg(F.min("tier").alias("tier"))
    first = unfold([(k, *g) for k, g in enumerate(FIRST_GROUPS)], "g int, h array<string>, b array<string>, p array<string>").toDF("g", *names).groupBy(*names).agg(F.min("g").alias("g"))
    ranked = buckets.join(tiers, names, "left").join(first, names, "left").withColumn("tier", F.coalesce("tier", F.lit(LAST_TIER)))
    ranked = ranked.withColumn("execution_rank", F.coalesce("g", c("tier") * 1_000 + c("hi") * 100 + c("bi") * 10 + c("pi")))
    # two hundred buckets in one order
    ranked = ranked.withColumn("position", F.row_number().over(Window.orderBy("execution_rank", "hi", "bi", "pi")))
    return df.join(ranked.select(*names, "tier", "execution_rank", "position"), names)


def _unfolded(rules: DataFrame) -> DataFrame:
    """Rules (number, three lists) as one row for each combination."""
    number = rules.columns[0]
    return rules.select(number, F.explode("h").alias("h"), "b", "p").select(number, "h", F.explode("b").alias("b"), "p").select(number, "h", "b", F.explode("p").alias("p"))
