"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ten words, and a window is a set of five-word shingles (a shorter one is
a single shingle). All of them have to occur, so the necessary prefix of a window in rarity order is one token:
its rarest shingle. Documents' shingles that occur in the benchmark at all are kept with their positions; those
equal to a prefix token, at a position where the whole window fits, become candidates; a candidate stands if
every shingle of the window is found at its place. Overlapping shingles at consecutive places spell the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROWS_PER_FILE, ascii_lower, broadcast_within, staged, words_of

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST_ROWS = 1_000_000
#: Bits of the filter for each benchmark shingle, and the most there are (1 MB; it travels in every row).
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 23


def shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(words, at + j) for j in range(k)))


def shingles(words: Column, sizes: list[int]) -> Column:
    """Array of (pos, h) for each word run of the given sizes."""

    def runs(k: int) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.struct(i.alias("pos"), shingle(words, i, k).alias("h")))

    return F.concat(*map(runs, sizes)) if sizes else F.array().cast("array<struct<pos:int,h:bigint>>")


def bit_filter(hashes: DataFrame) -> tuple[Column, int]:
    """One array of 64-bit words in which the bit of every h is set, as a scalar, and its number of bits.

    Equal hashes have equal bits, so a shingle whose bit is not set is not among them; above MAX_FILTER_BITS the array
    does not grow, and only lets more through.
    """
    bits = 1 << 16
    wanted = FILTER_BITS * hashes.count()
    while bits < min(wanted, MAX_FILTER_BITS):
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    word = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
    whole = hashes.sparkSession.range(bits >> 6).select(F.col("id").alias("at")).join(word, "at", "left")
    held = F.sort_array(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    return staged(whole.agg(F.transform(held, lambda x: x["word"]).alias("words")), "bench-filter").scalar(), bits


def hit_summary(docs: DataFrame, items: DataFrame, carry: list[str], window: int = 10, k: int = 5) -> DataFrame:
    """For each row of docs (text): carry, n_words, n_hit, n_items, items_sha256 and contaminated.

    items has item_id and text. Null texts have no words; items without words have no windows; equal rows get
    equal results; items of equal text all count, and those of null id hit words but are not listed. Without items
    nothing is hit; an empty table gives no rows; texts of any length are read whole. Only carry and text of docs are
    used, so other columns may have any names.
    """
    item_words = items.select("item_id", words_of(ascii_lower(F.col("text")), WORDS).alias("words")).where(F.size("words") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0))), lambda i: F.slice("words", i + 1, window))
    item_windows = item_words.select("item_id", F.explode(cut).alias("words")).distinct()
    some = item_windows.count()
    windows = staged(item_windows.select("words").distinct().coalesce(max(1, some // ROWS_PER_FILE)).withColumn("wid", F.monotonically_increasing_id()), "bench-windows")
    holders = staged(item_windows.join(windows, "words").select("wid", "item_id"), "bench-items", some)
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(k))).distinct().collect())
    parts = None
    for size in sizes:
        own = windows.where(F.least(F.size("words"), F.lit(k)) == size).select("wid", F.size("words").alias("len"), F.inline(shingles(F.col("words"), [size])))
        parts = own if parts is None else parts.unionByName(own)
    parts = staged(parts if parts is not None else windows.select("wid", F.lit(0).alias("len"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")), "bench-shingles", some)

    hashes = staged(parts.select("h").distinct(), "bench-hashes", some * window)
    filtered, bits = bit_filter(hashes)
    own_bit = lambda h: F.call_function("getbit", F.get("__bits", F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    named = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    worded = docs.select(*named, F.xxhash64(*carry, "text").alias("key"), words_of(ascii_lower(F.col("text")), WORDS).alias("words"), filtered.alias("__bits"))
    # a line of its own for each row of docs, at position -1, and one for each shingle that the filter lets through
    first = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("h")))
    found = F.concat(first, F.filter(shingles(F.col("words"), sizes), lambda x: own_bit(x["h"])))
    carried = [f"__c{i}" for i in range(len(carry))]
    rows = worded.select(*carried, "key", F.size("words").alias("n"), F.inline(found))
    kept = rows.join(broadcast_within(hashes.withColumn("found", F.lit(True)), MAX_BROADCAST_ROWS), "h", "left").where("found OR pos = -1")
    kept = staged(kept, "bench-matches")
    matches = kept.where("found").select("key", "n", "pos", "h").distinct()
    documents = kept.where("pos = -1").select(*carried, "key", "n")

    rarity = matches.groupBy("h").agg(F.count("*").alias("freq"))
    ordered = parts.join(rarity, "h", "left").groupBy("wid", "len").agg(
        F.min(F.struct("freq", "h", "pos")).alias("rarest"), F.count("*").alias("tokens"), F.count("freq").alias("present")
    )
    prefixes = ordered.where("tokens = present").select(F.col("rarest.h").alias("h"), F.col("rarest.pos").alias("offset"), "wid", "len", "tokens")
    prefixes = staged(prefixes, "bench-prefixes", some)
    candidates = (
        matches.join(broadcast_within(prefixes, MAX_BROADCAST_ROWS), "h")
        .where((F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("len") <= F.col("n")))
        .select("key", (F.col("pos") - F.col("offset")).alias("start"), "wid", "len", "tokens")
    )
    places = candidates.join(broadcast_within(parts.select("wid", F.col("pos").alias("at"), "h"), MAX_BROADCAST_ROWS), "wid").withColumn("pos", F.col("start") + F.col("at"))
    proven = places.join(matches.select("key", "pos", "h"), ["key", "pos", "h"], "left_semi").groupBy("key", "start", "wid", "len", "tokens").count().where("count = tokens")
    proven = staged(proven.select("key", "start", "wid", "len"), "bench-hits", kept.count())

    reached = F.max(F.col("start") + F.col("len")).over(Window.partitionBy("key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1))
    spans = proven.select("key", "start", "len").distinct().withColumn("fresh", F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0)))))
    hits = spans.groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    found = proven.select("key", "wid").distinct().join(broadcast_within(holders, MAX_BROADCAST_ROWS), "wid").groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return documents.join(hits, "key", "left").join(found, "key", "left").select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
