"""Runs of a collector: where they end, how they went, and the order of their buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators import runs
from staylens.plans.intake import pick, pick_sql
from staylens.plans.registry import query
from staylens.sources.tables import table

_BATCHES_SQL = """b AS (SELECT user_id, CAST(date_trunc('month', ts) AS DATE) + 6 * ((CAST(day(ts) AS INTEGER) - 1) // 6) AS run, ts, event_id, CAST(floor(value / 4) AS BIGINT) AS observed, CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value / 8) AS BIGINT) ELSE 0 END AS new FROM events),
u AS (SELECT *, row_number() OVER w AS k, sum(observed) OVER w AS total, sum(new) OVER w AS found, sum(greatest(0, observed - new)) OVER w AS copies, (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6 AS seconds FROM b WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, k - COALESCE(max(CASE WHEN new <> 0 THEN k END) OVER (PARTITION BY user_id, run ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS zeros FROM u),
r AS (SELECT *, CASE WHEN zeros >= 3 AND found = 0 THEN 'duplicate_only' WHEN zeros >= 3 THEN 'exhausted' WHEN total >= 150 THEN 'manual_cap' WHEN seconds >= 250000 THEN 'timeout' END AS reason FROM z),
e AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN k END) OVER (PARTITION BY user_id, run) AS stop, max(k) OVER (PARTITION BY user_id, run) AS last_ FROM r)"""


@query(f"""WITH {_BATCHES_SQL} SELECT user_id, run, CAST(k AS INTEGER) AS batches, CAST(total AS BIGINT) AS observed, CAST(found AS BIGINT) AS new, CAST(copies AS BIGINT) AS duplicates, CAST(zeros AS INTEGER) AS zero_streak, seconds, COALESCE(reason, 'running') AS reason
FROM e WHERE k = COALESCE(stop, last_)""", dates=["run"])
def run_endings(spark: SparkSession, folder: str) -> DataFrame:
    """Why each user's runs of six days end: streaks of nothing new before the cap before the time."""
    c = F.col
    log = table(spark, folder, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    run = F.date_add(F.trunc("ts", "month"), (6 * F.floor((F.dayofmonth("ts") - 1) / 6)).cast("int"))
    new = F.when(c("event_type").isin("view", "click"), F.floor(c("value") / 8)).otherwise(F.lit(0).cast("long"))
    batches = log.select("user_id", run.alias("run"), "ts", "event_id", F.floor(c("value") / 4).alias("observed"), new.alias("new"))
    return runs.run_endings(batches, ["user_id", "run"], ["ts", "event_id"], "ts", zero_limit=3, most_observed=150, most_seconds=250_000)


@query("""WITH r AS (SELECT CAST(ts AS DATE) AS run, user_id, bool_or(event_type IN ('view', 'purchase')) AS ok, count(*) FILTER (WHERE event_type = 'click') AS quotes, count(*) FILTER (WHERE event_type = 'purchase') AS available,
  count(*) FILTER (WHERE event_type = 'purchase' AND value > 100) AS enriched, count(*) FILTER (WHERE event_type = 'signup' AND value > 480) AS c, count(*) FILTER (WHERE event_type = 'signup' AND value > 440 AND value <= 480) AS q FROM events GROUP BY 1, 2),
d AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) + 3 FROM events), INTERVAL 1 DAY)) AS DATE) AS run),
s AS (SELECT d.run, count(user_id) AS attempted, count(*) FILTER (WHERE ok) AS ok, CAST(COALESCE(sum(quotes), 0) AS BIGINT) AS quotes, sum(available) AS available, sum(enriched) AS enriched, CAST(COALESCE(sum(c), 0) AS BIGINT) AS c, CAST(COALESCE(sum(q), 0) AS BIGINT) AS q FROM d LEFT JOIN r ON r.run = d.run GROUP BY 1)
SELECT run, attempted, ok, attempted - ok AS failed, quotes, enriched::DOUBLE / nullif(available, 0) AS enrichment_rate,
  CASE WHEN attempted > 0 AND (ok = 0 OR quotes = 0) OR c > 1 OR q > 1 THEN 'fail' WHEN attempted = 0 OR (attempted - ok > 0 AND (attempted - ok) * 2 >= attempted) THEN 'warn' ELSE 'ok' END AS level,
  CASE WHEN attempted > 0 AND ok = 0 THEN 'All ' || attempted || ' listings failed — Airbnb pricing has gone dark' WHEN attempted > 0 AND quotes = 0 THEN '0 quotes written despite a non-empty cohort'
    WHEN c > 1 THEN 'Calendar SHA rediscovered ' || c || ' times in one run — persisted-query rotation is unstable' WHEN q > 1 THEN 'Quote SHA rediscovered ' || q || ' times in one run — persisted-query rotation is unstable'
    WHEN attempted = 0 THEN 'No Airbnb listings matched the cohort filter' WHEN attempted - ok > 0 AND (attempted - ok) * 2 >= attempted THEN (attempted - ok) || '/' || attempted || ' listings failed (>=50%)' ELSE '' END AS reason FROM s""", dates=["run"])
def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """How each day's run went, days without any result included."""
    c = F.col
    log = table(spark, folder, "events", ["user_id", "ts", "event_type", "value"]).withColumn("run", c("ts").cast("date"))
    kind, value = c("event_type"), c("value")
    results = log.groupBy("run", "user_id").agg(
        F.bool_or(kind.isin("view", "purchase")).alias("ok"), F.count_if(kind == "click").alias("quotes"), F.count_if(kind == "purchase").alias("available"), F.count_if((kind == "purchase") & (value > 100)).alias("enriched"),
        F.count_if((kind == "signup") & (value > 480)).alias("calendar_finds"), F.count_if((kind == "signup") & (value > 440) & (value <= 480)).alias("quote_finds"))
    days = log.agg(F.min("run").alias("a"), F.max("run").alias("b")).select(F.explode(F.sequence("a", F.date_add("b", 3))).alias("run"))
    return runs.run_summary(days, results, ["run"])


_PRODUCT_SQL = "b AS (SELECT h.i AS hi, h.x AS hood, b.i AS bi, b.x AS beds, p.i AS pi, p.x AS price FROM " + ", ".join(
    f"(VALUES {', '.join(f'({i}, {x!r})' for i, x in enumerate(xs))}) AS {n}(i, x)" for n, xs in (("h", runs.HOODS), ("b", runs.BEDS), ("p", runs.PRICES))) + ")"


def _in(name: str, xs: list[str]) -> str:
    return f"{name} IN ({', '.join(map(repr, xs))})"


_TIER_SQL = "CASE " + " ".join(f"WHEN {_in('hood', h)} AND {_in('beds', b)} AND {_in('price', p)} THEN {t}" for t, h, b, p in runs.TIERS) + " ELSE 3 END"
_GROUP_SQL = "CASE " + " ".join(f"WHEN {_in('hood', h)} AND {_in('beds', b)} AND {_in('price', p)} THEN {k}" for k, (h, b, p) in enumerate(runs.FIRST_GROUPS)) + " END"


@query(f"""WITH {_PRODUCT_SQL}, t AS (SELECT *, {_TIER_SQL} AS tier, {_GROUP_SQL} AS g FROM b), r AS (SELECT *, COALESCE(g, tier * 1000 + hi * 100 + bi * 10 + pi) AS execution_rank FROM t),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY execution_rank, hi, bi, pi) AS INTEGER) AS position FROM r),
l AS (SELECT {pick_sql(runs.HOODS, 'p_partkey')} AS hood, CASE WHEN p_size % 7 >= 5 THEN '5_plus' WHEN p_size % 7 >= 1 THEN CAST(p_size % 7 AS VARCHAR) END AS beds, CASE WHEN p_retailprice % 600 < 100 THEN 'under_100' WHEN p_retailprice % 600 < 200 THEN '100_200' WHEN p_retailprice % 600 < 400 THEN '200_400' ELSE '400_plus' END AS price FROM part)
SELECT hood, beds, price, count(*) AS n, tier, execution_rank, position FROM l JOIN o USING (hood, beds, price) GROUP BY ALL""")
def execution_order(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets that hold listings, with tier, rank and place in the order of a discovery run."""
    k = F.col("p_partkey")
    beds, dollars = F.col("p_size") % 7, F.col("p_retailprice") % 600
    held = table(spark, folder, "part", ["p_partkey", "p_size", "p_retailprice"]).select(pick(runs.HOODS, k).alias("hood"), runs.bedroom_band(beds).alias("beds"), runs.price_band(dollars).alias("price"))
    return runs.execution_order(held.groupBy("hood", "beds", "price").agg(F.count("*").alias("n")))
