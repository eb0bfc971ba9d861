"""Streams without hand-kept state: notification building, replay guard, rates, expiry, watches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def change_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Change events as they land in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def notifications(changes: DataFrame, payload: str, cap: int) -> DataFrame:
    """delta travels along only where it has 1 to cap bytes; digest is always there."""
    size = F.octet_length(payload)
    return changes.withColumn("digest", F.sha2(F.col(payload), 256)).withColumn("delta", F.when((size > 0) & (size <= cap), F.col(payload)))


def admitted(ts: Column, now: Column, max_age_s: int = 60, max_skew_s: int = 5) -> Column:
    """Not older than max_age_s and not more than max_skew_s ahead."""
    return (ts >= now - F.expr(f"INTERVAL {max_age_s} SECONDS")) & (ts <= now + F.expr(f"INTERVAL {max_skew_s} SECONDS"))


def replay_guard(events: DataFrame, ts: str, ident: str, max_age: str = "60 seconds", received: str | None = None) -> DataFrame:
    """One event of each id within max_age of event time; with a column of arrival times, only events admitted by it."""
    if received:
        events = events.where(admitted(F.col(ts), F.col(received)))
    return events.withWatermark(ts, max_age).dropDuplicatesWithinWatermark([ident])


def arrival_rates(events: DataFrame, ts: str, topic: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    """Arrivals of each topic in hopping windows."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, length, slide), topic).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), topic, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "60 seconds") -> DataFrame:
    """Sessions of each key, ended by a gap without events; a stream gives those that the watermark has closed."""
    counts = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def followed(first: DataFrame, then: DataFrame, key: str, ts: str, then_ts: str, within: str, late: str = "60 seconds") -> DataFrame:
    """Pairs of an event and one of the other stream with the same key, at most `within` later.

    Both watermarks and the range bound the state: an event is dropped once no partner can come.
    """
    a, b = first.withWatermark(ts, late).alias("a"), then.withWatermark(then_ts, late).alias("b")
    near = (F.col(f"b.{then_ts}") >= F.col(f"a.{ts}")) & (F.col(f"b.{then_ts}") <= F.col(f"a.{ts}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near).select("a.*", *[F.col(f"b.{c}") for c in then.columns if c != key])


def live(registrations: DataFrame, key: list[str], ping: str, ttl: str, now: Column) -> DataFrame:
    """Latest registration of each key that is not stale: stale means now - ping > ttl."""
    last = registrations.groupBy(*key).agg(F.max_by(F.struct(*[c for c in registrations.columns if c not in key]), ping).alias("r")).select(*key, "r.*")
    return last.where(~(now - F.col(ping) > F.col(ttl)))


def clamped_ttl(ttl: Column, low: int = 10_000, high: int = 900_000) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), ttl))


def adaptive_window(rate: Column, seconds: int = 60, least: int = 256, most: int = 8192) -> Column:
    """clamp(max(least, ceil(seconds * rate)), most)."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(seconds * rate).cast("int")))


def checkpoint_span(rate: Column, seconds: int = 60, least: int = 256, most: int = 8192, ratio: int = 16) -> Column:
    """The span of a parent's checkpoint, a multiple of the window."""
    return adaptive_window(rate, seconds, least, most) * ratio


def queue_depth(subscribers: Column, baseline: int, least: int = 32, most: int | None = None) -> Column:
    """ceil(least * subscribers / baseline), never below `least`, and at most `most`."""
    depth = F.greatest(F.lit(least), F.ceil(least * subscribers / baseline).cast("int"))
    return F.least(F.lit(most), depth) if most else depth


def registered(registrations: DataFrame, ttl: str = "ttl") -> DataFrame:
    """The terms that a registration gets: its ttl clamped, and a ping due every third of it."""
    return registrations.withColumn(ttl, clamped_ttl(F.col(ttl))).withColumn("ping_every", F.floor(F.col(ttl) / 3).cast("long"))


def willingness(profile: Column, load: Column) -> Column:
    """Per-tier bits: willing by profile and by load."""
    return profile.bitwiseAND(load)


def watch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Call back once for each micro-batch that has rows: at least once for every change, never none."""

    def each(df: DataFrame, epoch: int) -> None:
        if df.limit(1).count():
            callback(df, epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
