"""Audit of how quality filters interact: what each filter removes at every place of every order.

Each document becomes one mask of the filters that it fails. Masks are counted into cells, the cells are unpivoted
against the steps of all orders, and a running bit-or over the steps before tells whether an earlier filter has
removed a cell already. Everything after the masks works on counts, whatever the corpus holds.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the filters' letters; the place in this string is the bit in a mask
FILTERS = "ABCDE"
#: fixed values: thresholds of the filters
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = (
        n < LEAST_WORDS,
        F.lit(100) * distinct < F.lit(LEAST_DISTINCT_PERCENT) * n,
        F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITAL_PERCENT).cast("long") * F.length(text),
        text.rlike(SYMBOLS),
    )
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask.bitwiseOR(F.when(failed, 1 << bit).otherwise(0))
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents: rows (part, mask int, good boolean, toxic boolean, n long).

    ``part`` is the document's lang, a null one being the empty string. Bit E is set where a smaller doc_id has the same
    text; texts are compared by SHA-256. Rows that repeat one doc_id and text are no copies of each other. A row without
    doc_id is no copy of any and has no label. A document is good (toxic) if some label row of its id says so.
    Texts meet by hash with one row a text and cell from each task, so a text that a third of all rows share is counted
    before it is shuffled. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), own_mask(text).alias("own"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("text_key"),
    ).groupBy("doc_id", "part", "own", "text_key").agg(F.count("*").alias("n"))
    told = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    told = told.filter("labelled_id IS NOT NULL").groupBy("labelled_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # rows without an id are dealt by their text; no label meets them
    dealt = rows.withColumn("place", F.coalesce("doc_id", F.xxhash64("text_key")))
    met = dealt.join(told, (F.col("place") == F.col("labelled_id")) & F.col("doc_id").isNotNull(), "left")
    named = F.col("doc_id").isNotNull()
    texts = met.groupBy("text_key", "part", "own", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("text_key"))
    originals = texts.withColumn("originals", F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    split = originals.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), F.col("originals").alias("n")),
        F.struct(F.col("own").bitwiseOR(copy).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))).alias("cell"))
    return split.select("part", "cell.mask", "good", "toxic", "cell.n").filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def order_metrics(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every filter does at every step of every order of ``filters`` (at most 6), from cells as ``mask_cells`` gives them.

    Rows (part, filter_order, step int, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley long), zeros
    included: one for each part, order and step. ``shapley`` is what the step's filter removes, summed over all orders.
    Every cell is written once for each step of each order, which is a fixed factor; no documents are.
    """
    if len(filters) > 6:
        raise ValueError("all orders of more than six filters are too many to write out")
    orders = ["".join(p) for p in permutations(filters)]
    long = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).select(
        "*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).filter("filter <> ''")
    bit = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i))), F.col("filter"))
    long = long.withColumn("step", (F.col("at") + 1).cast("int")).withColumn("hit", F.col("mask").bitwiseAND(bit))
    run = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step")
    long = long.withColumn("earlier", F.coalesce(F.bit_or("hit").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit, gone = F.col("hit") != 0, F.col("earlier") != 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")

    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~hit & ~gone).alias("kept"), total(hit & ~gone).alias("removed"), total(hit & gone).alias("redundant"),
        total(hit & (F.col("mask") == F.col("hit"))).alias("unique_fails"),
        total(hit & ~gone & F.col("good")).alias("good_lost"), total(hit & ~gone & F.col("toxic")).alias("toxic_lost"))
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``order_metrics`` of the five filters over all documents; see ``mask_cells`` for nulls, repeats and empty tables.

    A label table without rows gives zeros for good_lost and toxic_lost. Other columns are not looked at.
    """
    return order_metrics(mask_cells(docs, labels))
