"""Counters, nearest-rank histograms, distributions and sliding peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tag_text(tags: Column) -> Column:
    """A map of tags as sorted k=v text, as maps cannot be grouped."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def counters(samples: DataFrame, name: str, tags: Column, value: str) -> DataFrame:
    return samples.groupBy(name, tags.alias("tags")).agg(F.sum(value).alias("total"))


def histogram_stats(df: DataFrame, by: list[str], value: str, percentiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """count, min, max, mean and nearest-rank percentiles of each group. Without rows of a group there is no row."""
    rank = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in percentiles]
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), *rank)


def cdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Empirical distribution over distinct values: value and the share of rows up to it.

    Rows are counted by value first, so the window runs over distinct values only.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    share = F.sum("n").over(group.orderBy(value)) / F.sum("n").over(group)
    return counts.select(*by, value, share.alias("share"))


def sliding_peak(df: DataFrame, by: list[str], millis: str, window_ms: int) -> DataFrame:
    """The most events in any window; events window_ms apart or more are not in one window."""
    w = Window.partitionBy(*by).orderBy(millis).rangeBetween(-(window_ms - 1), 0)
    return df.withColumn("__n", F.count("*").over(w)).groupBy(*by).agg(F.max("__n").alias("peak"))


def tumbling_peak(df: DataFrame, by: list[str], millis: str, width_ms: int = 1000) -> DataFrame:
    slots = df.groupBy(*by, F.floor(F.col(millis) / width_ms).alias("slot")).agg(F.count("*").alias("n"))
    return slots.groupBy(*by).agg(F.max("n").alias("peak"), F.count("*").alias("slots"))


def trailing_rate(df: DataFrame, by: list[str], millis: str, window_ms: int = 60_000) -> DataFrame:
    """For each event the number of events in the window that ends with it; its lower bound belongs to it."""
    w = Window.partitionBy(*by).orderBy(millis).rangeBetween(-window_ms, 0)
    return df.withColumn("rate", F.count("*").over(w))


def growth_promotes(df: DataFrame, by: list[str], millis: str, count: str, window_ms: int = 10_000, lookahead_ms: int = 30_000, cap: int = 64, ties: list[str] = ()) -> DataFrame:
    """Two-point slope over the trailing window; promotes where count + slope * lookahead reaches cap.

    Of rows that share the window's first instant the first by `ties` counts, or the least count where none are given.
    """
    at = Window.partitionBy(*by).orderBy(millis)
    w, peers = at.rangeBetween(-window_ms, 0), at.rangeBetween(0, 0)
    t0, c0 = F.first(millis).over(w), F.first("__first").over(w)
    span = F.col(millis) - t0
    slope = F.when(span > 0, (F.col(count) - c0) / span)
    df = df.withColumn("__first", F.min(F.struct(*ties, F.col(count).alias("__n"))).over(peers)["__n"])
    return df.withColumn("slope", slope).drop("__first").withColumn("promotes", F.coalesce((F.col("slope") > 0) & (F.col(count) + F.col("slope") * lookahead_ms >= cap), F.lit(False)))


def churn(contacts: DataFrame, peer: str, order: str, ms: str, departure: Column, failure: Column, now_ms: int, window_ms: int = 10_000, failures: int = 3, alarm: int = 5) -> DataFrame:
    """For each peer whether it departed within the window, or is unreachable: `failures` last contacts failed and no departure.

    partitioned tells on every row whether `alarm` peers or more are one or the other.
    """
    broke = F.sum(F.when(~failure, 1).otherwise(0)).over(Window.partitionBy(peer).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    marked = contacts.withColumn("__left", departure & (F.col(ms) > now_ms - window_ms)).withColumn("__breaks", broke)
    peers = marked.groupBy(peer).agg(F.bool_or("__left").alias("departed"), (F.count_if(F.col("__breaks") == 0) >= failures).alias("__failed"))
    peers = peers.select(peer, "departed", (F.col("__failed") & ~F.col("departed")).alias("unreachable"))
    whole = peers.agg((F.count_if(F.col("departed") | F.col("unreachable")) >= alarm).alias("partitioned"))
    return peers.join(F.broadcast(whole), F.lit(True))  # one row
