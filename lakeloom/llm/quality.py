"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A document is described by whole numbers (counts, and ratios in thousandths). The sketch of a group is a
histogram over fixed buckets: exact below 256, and above that 128 buckets for each power of two (relative error
under 1 %). Sketches merge by adding counts, in any order, so results do not depend on how rows were dealt. A group's
thresholds are quantiles of its sketch, carried on by tail distances of the same sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_within, staged, words_of

#: metric -> (percentile of the upper fence, that of the lower one or None, reach). A fence lies beyond its percentile by
#: `reach` times the distance from there to the group's median; nothing else is added.
METRICS = {"symbols": (90, None, 1), "repeats": (99, None, 1), "dup_lines": (99, None, 1), "word_length": (90, 10, 4)}
LEVELS = (10, 50, 90, 99)
#: Smaller groups have too few documents beyond the 99th percentile.
MIN_GROUP = 200
MAX_BROADCAST_GROUPS = 100_000


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Repeated three-word windows are found by sorting 64-bit values made of a window's hash and its position;
    neighbours in that order are compared word by word. The work stays within the row: no shuffle.
    """
    words, packed, n = F.col("__words"), F.col("__packed"), F.col("n_words")
    bits = F.length(F.bin(n))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [c for c in df.columns if c != text]
    df = df.select(
        *kept,
        words_of(F.col(text)).alias("__words"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    df = df.select(
        *kept, "n_symbols", "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    gram = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    df = df.withColumn(
        "__packed",
        F.sort_array(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda _, i: F.call_function("shiftleft", F.call_function("shiftright", gram(i), bits), bits).bitwiseOR(i.cast("long")))),
    )
    where = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    def same(x: Column, k: Column) -> Column:
        y = F.get(packed, k)
        alike = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
        return alike & F.forall(F.array(*map(F.lit, range(3))), lambda d: F.get(words, where(x) + d) == F.get(words, where(y) + d))

    df = df.withColumn("__starts", F.sort_array(F.transform(F.filter(packed, lambda x, k: same(x, k - 1) | same(x, k + 1)), where)))
    starts = F.col("__starts")
    return df.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.aggregate(F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metric_values() -> dict[str, Column]:
    ratio = lambda a, b: F.call_function("div", 1000 * F.col(a), F.greatest(F.col(b), F.lit(1)))
    return {"symbols": ratio("n_symbols", "word_chars"), "repeats": ratio("n_repeat_words", "n_words"), "dup_lines": ratio("n_dup_lines", "n_lines"), "word_length": ratio("word_chars", "n_words")}


def bucket_of(x: Column) -> Column:
    """The lowest value of x's bucket."""
    drop = F.greatest(F.length(F.bin(x)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(counts: DataFrame) -> DataFrame:
    """Of documents that pass the base rules: rows (lang, source, metric, bucket, n)."""
    values = F.array(*(F.struct(F.lit(m).alias("metric"), bucket_of(v).alias("bucket")) for m, v in metric_values().items()))
    exploded = counts.where(~base_failed()).select("__lang", "__source", F.inline(values))
    return exploded.groupBy("__lang", "__source", "metric", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches within `by`; rows (by, metric, total, and q10 to q99 of LEVELS)."""
    keys = [*by, "metric"]
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    merged = merged.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda p: F.min(F.when(100 * F.col("cum") >= p * F.col("total"), F.col("bucket"))).alias(f"q{p}")
    return merged.groupBy(*keys).agg(F.max("total").alias("total"), *map(at, LEVELS))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each language and source, with low_ and high_ fences of each metric.

    A group of fewer than min_group documents takes its language's sketch; a language of fewer, that of all.
    """
    groups = sketch.select("__lang", "__source", "metric").distinct()
    own, lang, everything = (quantiles(sketch, by) for by in (["__lang", "__source"], ["__lang"], []))
    named = ("total", *(f"q{p}" for p in LEVELS))
    name = lambda df, tag: df.select(*[c for c in df.columns if c.startswith("__") or c == "metric"], *[F.col(c).alias(f"{tag}_{c}") for c in named])
    joined = groups.join(name(own, "a"), ["__lang", "__source", "metric"]).join(name(lang, "b"), ["__lang", "metric"]).join(F.broadcast(name(everything, "c")), "metric")
    pick = lambda q: F.when(F.col("a_total") >= min_group, F.col(f"a_{q}")).when(F.col("b_total") >= min_group, F.col(f"b_{q}")).otherwise(F.col(f"c_{q}"))
    joined = joined.withColumns({q: pick(q) for q in named[1:]})
    out = []
    for m, (high, low, reach) in METRICS.items():
        fence = lambda p: F.max(F.when(F.col("metric") == m, F.col(f"q{p}") + reach * (F.col(f"q{p}") - F.col("q50"))))  # noqa: E731, B023
        out.append(fence(high).alias(f"high_{m}"))
        if low is not None:
            out.append(fence(low).alias(f"low_{m}"))
    return joined.groupBy("__lang", "__source").agg(*out)


def quality_verdicts(docs: DataFrame, carry: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """For each row of docs (text, lang, source): carry, the counts, base_failed and kept.

    A row is kept if it passes the base rules and the bucket of every metric lies within its group's fences. Null texts count
    as empty and fail; null languages and sources are groups of their own; equal rows get equal verdicts; texts of any
    length are counted whole; other columns may have any names; an empty table gives no rows.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    own = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], F.col("text").alias("text"), key("lang").alias("__lang"), key("source").alias("__source"))
    counts = staged(text_counts(own), "quality-counts")
    sketch = staged(sketches(counts), "quality-sketches", len(METRICS) * counts.count())
    fences = staged(thresholds(sketch, min_group), "quality-fences", sketch.count())
    joined = counts.join(broadcast_within(fences, MAX_BROADCAST_GROUPS), ["__lang", "__source"], "left")
    inside = F.lit(True)
    for m, v in metric_values().items():
        inside &= F.coalesce(bucket_of(v) <= F.col(f"high_{m}"), F.lit(True))
        if METRICS[m][1] is not None:
            inside &= F.coalesce(bucket_of(v) >= F.col(f"low_{m}"), F.lit(True))
    return joined.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"),
    )
