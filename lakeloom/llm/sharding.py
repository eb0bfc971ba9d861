"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt by a hash of all their columns over P partitions. How many rows of each partition go to each shard is
drawn from the exact (multivariate hypergeometric) law that a uniform permutation of all rows would give, so
shard sizes are met exactly. Each partition permutes its rows and cuts them by its line of the matrix; after
the exchange each shard permutes again, in blocks, which gives a slot.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

ROWS_PER_BLOCK = 200_000
#: Most partitions, that is lines of the matrix, and most blocks of all shards; beyond, they hold more rows each.
MAX_PARTS = 1 << 14
#: Where a partition holds so many times its share, equal rows are common, and rows are dealt by number instead.
MOST_SKEW = 4


def draw_hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """Number of good items among draws without replacement, by inversion.

    Probabilities relative to the mode's follow from their ratios; beyond twelve standard deviations they vanish.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))
    low, high = max(low, mode - int(12 * spread) - 30), min(high, mode + int(12 * spread) + 30)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + min(int(np.searchsorted(mass, u * mass[-1], side="right")), high - low)


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """rows[p]: rows of partition p. Entry [p][s]: how many of them go to shard s; shards differ by one row at most."""
    rng = random.Random(seed)
    total = sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        line, left, rest = [], n, sum(room)
        for s in range(shards):
            take = draw_hypergeometric(rng.random(), room[s], rest - room[s], left)
            rest -= room[s]
            left -= take
            line.append(take)
        room = [a - b for a, b in zip(room, line)]
        matrix.append(line)
    return matrix


def row_hash(df: DataFrame, seed: int, salt: int) -> Column:
    """A hash of all columns that can be hashed (maps cannot)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()], F.lit(seed), F.lit(salt))


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 42, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """df with `shard` (0 to shards - 1) and `slot` (gapless from 0 within its shard).

    Law: row counts of shards differ by one at most, and every assignment with such counts is equally likely.
    Nulls in any column are values like others; repeated rows each get a slot of their own, and where they are so many
    that a partition would hold several times its share, rows are written with numbers and dealt by these. An empty
    table stays empty; texts may be of any length. Columns of df named shard or slot are replaced. The matrix has
    ceil(rows / rows_per_block) lines, 32 to MAX_PARTS, and is all that the driver holds; it is broadcast, as is the
    table of block offsets, of at most MAX_PARTS and shards lines.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    columns = df.columns
    total = df.count()
    parts, blocks = min(MAX_PARTS, max(32, -(-total // rows_per_block))), max(8, min(MAX_PARTS // shards, -(-total // (shards * rows_per_block))))

    def dealt_rows(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        dealt = rows.withColumn("__part", F.pmod(row_hash(rows, seed, 1), F.lit(parts)).cast("int"))
        return dealt, {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # at most MAX_PARTS

    dealt, counts = dealt_rows(df)
    if counts and max(counts.values()) > MOST_SKEW * total / parts + 1000:
        df = staged(df.withColumn("__number", F.monotonically_increasing_id()), "numbered")
        dealt, counts = dealt_rows(df)
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = lambda line: ",".join(f"{sum(line[: s + 1])}L" for s in range(shards))
    cuts = spark.sql("SELECT * FROM VALUES " + ",".join(f"({p}, array({ends(line)}))" for p, line in enumerate(matrix)) + " AS t(__part, __ends)")
    local = Window.partitionBy("__part").orderBy(row_hash(df, seed, 2))
    sent = (
        dealt.withColumn("__rank", F.row_number().over(local).cast("long"))
        .join(F.broadcast(cuts), "__part")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__rank"))))
        .withColumn("__block", F.pmod(F.xxhash64(row_hash(df, seed, 3), "__rank", "__part"), F.lit(blocks)).cast("int"))
        .drop("__part", "__rank", "__ends")
    )
    sent = staged(sent, "sharded")
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "__block").agg(F.count("*").alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    again = Window.partitionBy("shard", "__block").orderBy(row_hash(df, seed, 4))
    return (
        sent.withColumn("__rank", F.row_number().over(again))
        .join(F.broadcast(offsets), ["shard", "__block"])
        .withColumn("slot", F.col("__offset") + F.col("__rank") - 1)
        .select(*[f"`{c}`" for c in columns], "shard", "slot")
    )
