"""Majorities over claims of voters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needed(responders: Column, capacity: int, theta: float = 0.75) -> Column:
    """max(floor, floor(theta * responders)), floor = max(1, min(2, capacity))."""
    return F.greatest(F.lit(max(1, min(2, capacity))), F.floor(F.lit(theta) * responders))


def quorum_revision(claims: DataFrame, item: str, voter: str, revision: str, action: str, capacity: int = 16, theta: float = 0.75) -> DataFrame:
    """For each item the highest (revision, action) that a quorum of its distinct responders supports."""
    support = claims.groupBy(item, revision, action).agg(F.countDistinct(voter).alias("support"))
    responders = claims.groupBy(item).agg(F.countDistinct(voter).alias("responders"))
    met = support.join(responders, item).where(F.col("support") >= needed(F.col("responders"), capacity, theta))
    return met.groupBy(item).agg(F.max(F.struct(revision, action, "support", "responders")).alias("__top")).select(item, "__top.*")


def quorum_content(claims: DataFrame, item: str, voter: str, content: str, capacity: int = 16, theta: float = 0.75) -> DataFrame:
    """For each item its content hash, if exactly one has a quorum."""
    support = claims.groupBy(item, content).agg(F.countDistinct(voter).alias("support"))
    responders = claims.groupBy(item).agg(F.countDistinct(voter).alias("responders"))
    met = support.join(responders, item).where(F.col("support") >= needed(F.col("responders"), capacity, theta))
    return met.groupBy(item).agg(F.count("*").alias("__n"), F.min(content).alias(content), F.min("support").alias("support")).where("__n = 1").drop("__n")


def super_majority(votes: Column, total: Column, threshold: float = 0.75) -> Column:
    return votes >= F.ceil(F.lit(threshold) * total)
