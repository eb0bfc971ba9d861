"""Mixing sources to target weights: raking (iterative proportional fitting) and calibrated sampling.

Tokens are summed in cells of source, language and topic. Raking scales the cells in turn until each of the
three marginals meets its target; a cell's ratio of raked to own tokens gives the probability with which its
documents are kept. Only the table of cells takes part in the iterations; while it is small, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_WORDS, broadcast_within, discard, staged, unit_interval

DIMENSIONS = ("__source", "__lang", "__topic")
#: Without targets, a value's target is in proportion to this power of its own tokens (1: as they are; 0: all equal).
TEMPER = 0.85
#: Rounds go on until no marginal is off by more than this share of all tokens; CHECK rounds are one plan.
TOLERANCE = 1e-7
MOST_ROUNDS, CHECK = 400, 8
MAX_BROADCAST_CELLS = 200_000
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORDS)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A stand-in topic for corpora that have none: the form of the text."""
    return F.when(F.contains(text, F.lit("|")), "table").when(tokens < 100, "short").when(tokens < 1000, "medium").otherwise("long")


def value_name(column: Column) -> Column:
    """A text for each value; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def with_targets(cells: DataFrame, targets: DataFrame | None, temper: float = TEMPER) -> DataFrame:
    """cells (DIMENSIONS, tokens) with the target tokens __source_t, __lang_t and __topic_t of their values.

    targets: rows (dimension: source, lang or topic; value; share). Shares of a dimension are scaled so that those of
    its values that occur sum to 1; a value of such a dimension without a share gets none. A dimension without
    targets has tempered ones.
    """
    whole = F.sum("tokens").over(Window.partitionBy())
    for d in DIMENSIONS:
        own = Window.partitionBy(d)
        cells = cells.withColumn(f"{d}_t", F.pow(F.sum("tokens").over(own), F.lit(temper)))
        if targets is not None:
            given = targets.where(F.col("dimension") == d[2:]).groupBy(value_name(F.col("value")).alias(d)).agg(F.sum("share").alias("__share"))
            if given.limit(1).count():
                cells = cells.join(broadcast_within(given, MAX_BROADCAST_CELLS), d, "left").withColumn(f"{d}_t", F.coalesce(F.col("__share").cast("double"), F.lit(0.0))).drop("__share")
    if targets is not None:
        cells = local(cells)
    for d in DIMENSIONS:
        cells = cells.withColumn("__once", F.col(f"{d}_t") / F.count("*").over(Window.partitionBy(d)))  # each value counts once
        once = F.sum("__once").over(Window.partitionBy())
        cells = cells.withColumn(f"{d}_t", F.when(once > 0, F.col(f"{d}_t") / once * whole).otherwise(0.0)).drop("__once")
    return cells


def local(cells: DataFrame) -> DataFrame:
    """The cells in one partition while they are few enough to broadcast: windows over them need no exchange."""
    return cells.coalesce(1) if cells.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS else cells


def marginals(cells: DataFrame) -> DataFrame:
    """Of raked cells, for each dimension and value: tokens, target and w, the raked tokens."""
    parts = [cells.groupBy(F.lit(d[2:]).alias("dimension"), F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.max(f"{d}_t").alias("target"), F.sum("w").alias("w")) for d in DIMENSIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def raked(cells: DataFrame, targets: DataFrame | None = None, temper: float = TEMPER, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """cells: DIMENSIONS and tokens. Adds the targets and w, the raked tokens.

    Rounds end when no marginal is off by more than tolerance of all tokens, or no longer comes closer (targets that
    contradict each other, or empty cells), or after most_rounds; `marginals` tells what is met.
    """
    rows = cells.count()
    cells = with_targets(local(cells), targets, temper).withColumn("w", F.col("tokens").cast("double"))
    last, done = None, 0
    while True:
        for _ in range(CHECK):
            for d in DIMENSIONS:
                whole = F.sum("w").over(Window.partitionBy(d))
                cells = cells.withColumn("w", F.when(whole > 0, F.col("w") * F.col(f"{d}_t") / whole).otherwise(0.0))
        done += CHECK
        written = staged(cells, "raking", rows)
        off = written
        for d in DIMENSIONS:
            off = off.withColumn(f"{d}_off", F.abs(F.sum("w").over(Window.partitionBy(d)) - F.col(f"{d}_t")))
        worst = off.agg(F.max(F.greatest(*[f"{d}_off" for d in DIMENSIONS])) / F.sum("tokens")).first()[0] or 0.0
        if last is not None:
            discard(before)
        if worst <= tolerance or done >= most_rounds or (last is not None and worst > 0.99 * last):
            return written
        cells, last, before = local(written), worst, written


def mix(docs: DataFrame, topic: Column | None = None, key: str = "doc_id", seed: str = SEED, targets: DataFrame | None = None) -> DataFrame:
    """docs (text, lang, source, key) with n_tokens, topic, weight, keep_prob and kept; clashing columns are replaced.

    targets: wanted shares of tokens, see with_targets. weight is the cell's raked share over its own share of tokens;
    keep_prob is weight over the largest weight, and a row is kept if a number in [0, 1) made from its key and text
    lies below it. Nulls are values of their own; texts without tokens count as one token, so that every cell has a
    weight; texts of any length count whole; equal rows share their fate; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_tokens", "topic", "weight", "keep_prob", "kept")]
    counted = docs.select(*own, n_tokens(F.col("text")).alias("n_tokens"))
    counted = counted.withColumn("topic", topic if topic is not None else form_topic(F.coalesce("text", F.lit("")), F.col("n_tokens")))
    counted = counted.withColumns({d: value_name(F.col(d[2:])) for d in DIMENSIONS})
    cells = staged(counted.groupBy(*DIMENSIONS).agg(F.sum(F.greatest("n_tokens", F.lit(1))).alias("tokens")), "cells", counted.count())
    weights = raked(cells, targets).withColumn("ratio", F.col("w") / F.col("tokens"))
    top, total = weights.agg(F.max("ratio"), F.sum("w") / F.sum("tokens")).first()
    weights = weights.select(*DIMENSIONS, (F.col("ratio") / F.lit(float(total or 1.0))).alias("weight"), (F.col("ratio") / F.lit(float(top or 1.0))).alias("keep_prob"))
    joined = counted.join(broadcast_within(weights, MAX_BROADCAST_CELLS), list(DIMENSIONS), "left")
    draw = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    return joined.select(*own, "n_tokens", "topic", "weight", "keep_prob", (unit_interval(draw, seed) < F.col("keep_prob")).alias("kept"))
