"""Key and index access on DataFrames: point, prefix and range reads, cursors, revisions and log reads.

Filters are plain predicates, so Parquet scans receive them; nothing here collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def point_lookup(df: DataFrame, key: dict[str, object]) -> DataFrame:
    """Rows whose whole key equals the given values. A None among them matches nothing."""
    return df.where(_all([F.col(c) == F.lit(v) for c, v in key.items()]))


def prefix_seek(df: DataFrame, columns: Sequence[str], values: Sequence[object]) -> DataFrame:
    """Rows equal on the leading columns; surplus values are ignored, and no values read the whole index."""
    return df.where(_all([F.col(c) == F.lit(v) for c, v in zip(columns, values)]))


def range_scan(df: DataFrame, column: str, low=None, high=None, low_open: bool = False, high_open: bool = False, ascending: bool = True) -> DataFrame:
    """Rows within bounds (None: no bound), in key order."""
    c, tests = F.col(column), []
    if low is not None:
        tests.append(c > F.lit(low) if low_open else c >= F.lit(low))
    if high is not None:
        tests.append(c < F.lit(high) if high_open else c <= F.lit(high))
    return df.where(_all(tests)).orderBy(c.asc() if ascending else c.desc())


def index_entries(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The index as a relation: its columns and the primary key. It is read through predicates and joins, so it is in no order."""
    return df.select(*columns, *[k for k in key if k not in columns])


def index_lookup(base: DataFrame, entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Base rows that some index entry points to. Entries without a base row give nothing."""
    return base.join(entries.select(*key).distinct(), list(key), "left_semi")


def edge(df: DataFrame, column: str, last: bool = False) -> DataFrame:
    """The row of the least key, or of the greatest."""
    return df.orderBy(F.col(column).desc() if last else F.col(column)).limit(1)


def neighbours(df: DataFrame, column: str, at) -> DataFrame:
    """One row (prior, found, next): keys around `at`, null where there is none."""
    c = F.col(column)
    return df.agg(F.max(F.when(c < F.lit(at), c)).alias("prior"), F.max(F.when(c == F.lit(at), c)).alias("found"), F.min(F.when(c > F.lit(at), c)).alias("next"))


def count_from(df: DataFrame, column: str, at, ascending: bool = True) -> DataFrame:
    """Number of rows from a key onwards, itself included, in either direction."""
    return df.where(F.col(column) >= F.lit(at) if ascending else F.col(column) <= F.lit(at)).agg(F.count("*").alias("n"))


def pinned_get(blocks: DataFrame, ids: DataFrame, key: str, revision: str | None = None, at: int | None = None, unreached: DataFrame | None = None) -> DataFrame:
    """One row for each distinct id asked for: the block's columns and status present, absent or unavailable.

    With a revision column, blocks hold states of many revisions, and the newest up to `at` is read. An id that is not
    found is unavailable rather than absent where it is in `unreached`, the ids whose holders could not all be asked.
    """
    if revision:
        blocks = as_of(blocks, [key], revision, at)
    asked = ids.select(key).distinct()
    found = asked.join(blocks.withColumn("__there", F.lit(True)), key, "left")
    missing = F.lit("absent")
    if unreached is not None:
        found = found.join(unreached.select(key).distinct().withColumn("__unreached", F.lit(True)), key, "left")
        missing = F.when(F.col("__unreached"), "unavailable").otherwise("absent")
    return found.withColumn("status", F.when(F.col("__there"), "present").otherwise(missing)).drop("__there", "__unreached")


def as_of(changes: DataFrame, key: Sequence[str], revision: str, at, deleted: str | None = None) -> DataFrame:
    """State at a revision: of each key the change of the greatest revision up to `at`, unless it is a deletion."""
    latest = changes.where(F.col(revision) <= F.lit(at)).groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in changes.columns if c not in key]), F.col(revision)).alias("__row"))
    out = latest.select(*key, "__row.*")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def read_since(log: DataFrame, revision: str, after: int, ascending: bool = True) -> DataFrame:
    """Log entries of revisions beyond `after`."""
    log = log.where(F.col(revision) > after)
    return log.orderBy(F.col(revision) if ascending else F.col(revision).desc())


def pending_context(log: DataFrame, by: Sequence[str], revision: str) -> DataFrame:
    """(by, action, revision) of the actions that a reader from the tail has to know: those after the newest checkpoint,
    and the ones which that checkpoint carries.

    log: by, revision, action (null for entries that are none) and pendings, an array of (action, rev) on checkpoints.
    """
    newest = log.where("pendings IS NOT NULL").groupBy(*by).agg(F.max(revision).alias("__at"), F.max_by("pendings", revision).alias("__carried"))
    carried = newest.select(*by, F.explode("__carried").alias("p")).select(*by, F.col("p.action").alias("action"), F.col("p.rev").alias(revision))
    after = log.where("action IS NOT NULL").join(newest.select(*by, "__at"), list(by), "left").where(F.col("__at").isNull() | (F.col(revision) > F.col("__at")))
    return after.select(*by, "action", revision).unionByName(carried)


def revisions_between(log: DataFrame, revision: str, first: int, last: int) -> DataFrame:
    """Both ends included; descending where first is beyond last."""
    low, high = sorted((first, last))
    return log.where(F.col(revision).between(low, high)).orderBy(F.col(revision) if first <= last else F.col(revision).desc())


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the last row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
