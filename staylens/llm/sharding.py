"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt over logical partitions by a keyed hash. How many rows of a partition go to each shard is
drawn from the multivariate hypergeometric law, so that the row sums are the partition sizes and the
column sums the shard sizes. Each partition is permuted and cut by its matrix row, the pieces are
exchanged, and each shard is permuted again. Both permutations order by a keyed hash, so a task that runs
again after a lost executor deals the same rows to the same places.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PARTITIONS = 65_536


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One exact draw; numpy's sampler stops at populations of 10^9, beyond it walks outward from the mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    low, high = max(0, drawn - bad), min(good, drawn)
    lg = math.lgamma

    def log_choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    mode = min(high, max(low, (good + 1) * (drawn + 1) // (good + bad + 2)))
    peak = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u, left, right, p_left, p_right = rng.random() - peak, mode, mode, peak, peak
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (drawn - right) / ((right + 1) * (bad - drawn + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - drawn + left) / ((good - left + 1) * (drawn - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts [partition, shard] with the given row sums and column sums at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(rows)
    capacity = [total // shards + (s < total % shards) for s in rng.permutation(shards)]
    matrix = np.zeros((len(rows), shards), np.int64)
    for p, size in enumerate(rows):
        population = sum(capacity)
        for s in range(shards):
            if size == 0:
                break
            population -= capacity[s]
            matrix[p, s] = taken = _hypergeometric(rng, capacity[s], population, size)
            size -= taken
            capacity[s] -= taken
    return matrix


def _unit(*keys: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.xxhash64(*keys).cast("double") / F.lit(2.0**64) + F.lit(0.5)


def uniform_shards(df: DataFrame, keys: list[str], shards: int = 24, seed: int = 20_240_601, rows_per_partition: int = 20_000) -> DataFrame:
    """``df`` with columns shard (int) and slot (long): a uniform shuffle, shard sizes at most one apart.

    ``keys`` identify a row (a unique id; further columns break ties between repeated ids). Rows equal in
    all keys are dealt in any order. Any column may be null. slot counts from 0 without gaps in its
    shard. The driver holds a matrix of at most 65,536 x ``shards`` counts, whatever the input. An empty
    table gives no rows. Columns named shard or slot in the input are replaced; names that start with
    ``_op2_`` are reserved.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    total = df.count()
    parts = min(MAX_PARTITIONS, max(64, -(-total // rows_per_partition)))
    cells = max(8, parts // shards)
    cols = [F.col(k) for k in keys]
    part = F.floor(_unit(F.lit(seed), *cols) * parts).cast("int")
    sizes = dict(df.groupBy(F.least(part, F.lit(parts - 1)).alias("p")).count().collect())
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], shards, seed)
    cuts = spark.createDataFrame([(p, row) for p, row in enumerate(np.cumsum(matrix, axis=1).tolist())], "_op2_p int, _op2_cuts array<long>")

    def dealt(frame: DataFrame) -> DataFrame:
        order = Window.partitionBy("_op2_p").orderBy(F.xxhash64(F.lit(seed + 1), *cols), *cols)
        placed = frame.withColumn("_op2_p", F.least(part, F.lit(parts - 1))).withColumn("_op2_rank", F.row_number().over(order))
        return (
            placed.join(F.broadcast(cuts), "_op2_p")
            .withColumn("shard", F.size(F.filter("_op2_cuts", lambda c: c < F.col("_op2_rank"))))
            .withColumn("_op2_cell", F.least(F.floor(_unit(F.lit(seed + 2), *cols) * cells), F.lit(cells - 1)).cast("int"))
            .drop("_op2_p", "_op2_rank", "_op2_cuts")
        )

    counted = dealt(df.select(*keys)).groupBy("shard", "_op2_cell").count().collect()
    starts, at = [], dict.fromkeys(range(shards), 0)
    for shard, cell, n in sorted(counted):
        starts.append((shard, cell, at[shard]))
        at[shard] += n
    offsets = spark.createDataFrame(starts, "shard int, _op2_cell int, _op2_start long")
    inside = Window.partitionBy("shard", "_op2_cell").orderBy(F.xxhash64(F.lit(seed + 3), *cols), *cols)
    return (
        dealt(df).withColumn("_op2_in", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "_op2_cell"])
        .withColumn("slot", F.col("_op2_start") + F.col("_op2_in") - 1)
        .drop("_op2_cell", "_op2_start", "_op2_in")
    )
