"""Runs, alerts, counted inserts, orders of buckets and reloads."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from staylens.operators import runs
from staylens.sources import tables


def plain_ending(batches, zero_limit=2, most=500, seconds=300):
    n = total = found = copies = zeros = 0
    for at, observed, new in batches:
        n, total, found, copies = n + 1, total + observed, found + new, copies + max(0, observed - new)
        zeros = 0 if new else zeros + 1
        passed = (at - batches[0][0]).total_seconds()
        reason = ("exhausted" if found else "duplicate_only") if zeros >= zero_limit else "manual_cap" if total >= most else "timeout" if passed >= seconds else "running"
        if reason != "running":
            break
    return n, total, found, copies, zeros, passed, reason


def test_endings_and_their_precedence(spark):
    start = datetime(2026, 1, 1)
    at = lambda *s: [start + timedelta(seconds=x) for x in s]
    cases = {
        "both": list(zip(at(0, 1, 2, 3), (10, 600, 600, 5), (3, 0, 0, 9), strict=True)), "cap": list(zip(at(0, 1, 2), (10, 600, 5), (3, 0, 0), strict=True)), "nothing": list(zip(at(0, 400), (5, 5), (0, 0), strict=True)),
        "late": list(zip(at(0, 299, 300, 301), (1, 1, 1, 1), (1, 0, 1, 0), strict=True)), "goes_on": list(zip(at(0, 1, 2), (1, 1, 1), (1, 0, 1), strict=True)), "late_and_streak": list(zip(at(0, 1, 900), (1, 1, 1), (1, 0, 0), strict=True))}
    rows = [(k, i, *b) for k, v in cases.items() for i, b in enumerate(v)]
    got = {r.run: tuple(r)[1:] for r in runs.run_endings(spark.createDataFrame(rows, "run string, i int, at timestamp, observed long, new long"), ["run"], ["i"], "at").collect()}
    assert got == {k: plain_ending(v) for k, v in cases.items()}
    assert [got[k][-1] for k in ("both", "cap", "nothing", "late", "goes_on", "late_and_streak")] == ["manual_cap", "manual_cap", "duplicate_only", "timeout", "running", "exhausted"]


def test_alerts(spark):
    c = F.col
    rows = [(10, 0, 0, 5, 5), (10, 9, 0, 5, 5), (10, 9, 5, 2, 5), (10, 9, 5, 1, 2), (0, 0, 0, 0, 0), (10, 5, 5, 1, 1), (10, 6, 5, 1, 1)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a long, o long, q long, c long, f long").select("i", runs.alert(c("a"), c("o"), c("q"), c("c"), c("f")).alias("x")).orderBy("i").collect()
    assert [r.x.level for r in got] == ["fail", "fail", "fail", "fail", "warn", "warn", "ok"]
    assert got[2].x.reason.startswith("Calendar SHA rediscovered 2 times") and got[5].x.reason == "5/10 listings failed (>=50%)" and got[6].x.reason == ""


def test_inserts_count_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, day string, x int"
    held = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema)
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (3, "c", 4), (None, "a", 5)], schema).repartition(3)
    assert runs.insert_counted(batch, held, ["k", "day"], path) == {"attempted": 5, "inserted": 3, "skipped": 2}
    written = spark.read.parquet(path)
    assert sorted((r.k or 0, r.day) for r in written.collect()) == [(0, "a"), (1, "b"), (3, "c")]
    assert runs.insert_counted(batch.filter("k IS NOT NULL"), written.unionByName(held), ["k", "day"], path) == {"attempted": 4, "inserted": 0, "skipped": 4}
    assert runs.insert_counted(batch.limit(0), held, ["k", "day"], path) == {"attempted": 0, "inserted": 0, "skipped": 0}


def test_order_of_buckets(spark):
    product = [(h, b, p) for h in runs.HOODS for b in runs.BEDS for p in runs.PRICES]
    got = sorted(runs.execution_order(spark.createDataFrame([*product, ("mars", "1", "100_200")], "hood string, beds string, price string")).collect(), key=lambda r: r.position)
    assert len(got) == 200 and [r.position for r in got] == list(range(1, 201))
    tiers = {t: sum(r.tier == t for r in got) for t in (1, 2, 3)}
    # 7 x 9 + 7 x 2 of the first tier; of 6 x 2 x 2 of the second those that the first has not
    assert tiers[1] == 77 and tiers[2] == 14 and tiers[3] == 109
    assert [(r.hood, r.beds, r.price) for r in got[:6]] == [("zona_romantica", b, p) for b in "123" for p in ("100_200", "200_400")] and got[6].execution_rank == 1
    assert next(r.execution_rank for r in got if r.execution_rank > 7) == 1010 and max(r.execution_rank for r in got) == 3943


def test_numbered_reload(spark, tmp_path):
    df = spark.range(1_000, numPartitions=7).selectExpr("id * 3 AS x", "'y' AS _place").filter("x % 7 <> 0")
    first = spark.read.parquet(tables.reload_numbered(df, str(tmp_path / "t")))
    n = df.count()
    assert sorted(r.id for r in first.select("id").collect()) == list(range(1, n + 1)) and first.columns == ["id", "x", "_place"]
    again = spark.read.parquet(tables.reload_numbered(df.filter("x < 300"), str(tmp_path / "t")))
    assert again.agg(F.min("id"), F.max("id")).first()[:] == (1, again.count()) and first.count() == n
    assert spark.read.parquet(tables.reload_numbered(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_reloads_see_the_new_versions(spark, tmp_path):
    folder = str(tmp_path / "tables")
    steps = lambda n: [("a", lambda t: spark.range(n).toDF("x")), ("b", lambda t: t["a"].filter("x % 2 = 0")), ("registry", tables.registry)]
    old = tables.reload_all(spark, steps(4), folder)
    new = tables.reload_all(spark, steps(9), folder)
    counts = lambda paths: {r.name: r.n_rows for r in spark.read.parquet(paths["registry"]).collect()}
    assert list(new) == ["a", "b", "registry"] and counts(old) == {"a": 4, "b": 2} and counts(new) == {"a": 9, "b": 5}
