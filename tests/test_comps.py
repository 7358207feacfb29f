"""Comparables of a crowded market: rows as the SQL has them, and no step of a plan that holds the pairs."""

import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from staylens import plans
from staylens.operators import matches
from staylens.plans import comps
from tests.test_queries import cells

LISTINGS = 3_000


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """One neighbourhood and number of bedrooms; three of eight listings may be compared."""
    folder = str(tmp_path_factory.mktemp("crowd"))
    con = duckdb.connect()
    con.execute(f"""CREATE TABLE part AS SELECT k AS p_partkey, list_extract(['old', 'hot', 'blue'], CAST(k % 3 AS INTEGER) + 1) || ' ' || list_extract(['ring', 'nut', 'bolt', 'old'], CAST(k // 7 % 4 AS INTEGER) + 1) AS p_name,
        'Brand#1' AS p_brand, 'T' || (k // 5 % 6) AS p_type, CAST(k // 3 % 12 * 4 + 1 AS INTEGER) AS p_size, 700 + k * 7 % 900 + 0.25 AS p_retailprice FROM range({LISTINGS}) t(k)""")
    con.execute("CREATE TABLE lineitem AS SELECT * REPLACE (l_orderkey * 7 % 3000 AS l_partkey) FROM '/root/testdata/sf0.001/lineitem.parquet'")
    for name in ("part", "lineitem"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, con


def most_rows(spark):
    """The largest number of rows that a step of the last query gave out."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1)
    metrics, values = last.metrics(), store.executionMetrics(last.executionId())
    asked = [metrics.apply(k) for k in range(metrics.size()) if metrics.apply(k).name() == "number of output rows"]
    return max(int(values.apply(m.accumulatorId()).replace(",", "")) for m in asked if values.contains(m.accumulatorId()))


@pytest.mark.parametrize("name", ["comps_scores", "jaccard_pairs", "comps_selected", "comps_overall_drivers", "comps_recommendation", "comps_layers", "comps_positioning", "comps_sweep", "comps_v1"])
def test_pairs_stay_in_tasks(spark, crowd, name):
    folder, con = crowd
    df = plans.QUERIES[name](spark, folder)
    rows = sorted(cells(r) for r in df.collect())
    assert most_rows(spark) <= 20 * LISTINGS  # over 400,000 pairs are scored
    wanted = con.execute(plans.SQL[name])
    order = [[d[0] for d in wanted.description].index(c) for c in df.columns]
    assert rows == sorted(cells([r[i] for i in order]) for r in wanted.fetchall())


def test_blocks_and_pieces_score_as_the_columns_do(spark):
    draw = random.Random(5)
    words = [["a"], ["a", "b"], ["b", "a", "a"], [], None, ["c", None], ["d", "b", "c"]]
    some = lambda *x: draw.choice([None, *x])
    rows = [(k, draw.choice(["Amapas", "North", "South"]), some("T", "U"), draw.randrange(1, 4), some(1.0, 1.5, 2.0), float(draw.randrange(700)), some(300.0, 410.0, 0.0), some(3.1, 4.9, 4.2), draw.choice(words), 100.0 + k % 9)
            for k in range(400)]
    df = spark.createDataFrame(rows, "id long, hood string, building string, bedrooms int, bathrooms double, beach_m double, sqft double, rating double, amenities array<string>, price double")
    df = df.withColumns({"tier": F.when(F.col("beach_m") <= 100, "A").when(F.col("beach_m") <= 500, "B"), "price_tier": F.lit("lower")}).fillna({"tier": "C"})
    near = spark.createDataFrame([("Amapas", "North")], "hood string, near string")
    targets, flags = comps.weighted(df), comps.cascade_flags()
    score = comps.to_score(F.col("raw"))
    ten = lambda x: sorted(tuple(r) for r in x.withColumn("r", F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc(score), "id"))).filter("r <= 10").select("t_id", "id", "r", "step", "mixed", "raw").collect())
    wanted = ten(comps.likeness(comps.pool_pairs(targets, df, near, flags, comps.cascade_step)))
    scorer = matches.Scorer(comps._read, comps._raw, comps._price_tiers, "w_price_tier")
    for block, piece in ((8_192, 65_536), (7, 30)):
        found = comps.pool_best(targets, df, near, flags, comps.cascade_step, scorer, ["t_id", "step", "mixed"], ["id", "price"], block, piece)
        assert repr(ten(found)) == repr(wanted) and len(wanted) > 3_000
