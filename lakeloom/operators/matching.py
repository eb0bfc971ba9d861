"""Matchmaking over registrations: capability filters, first-come queries, shard choice, decisions, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matches_capabilities(capabilities: Column, budget: Column, must: list[str] = (), must_not: list[str] = (), min_budget: float | None = None) -> Column:
    """must is part of the capabilities, must_not shares none with them, and the budget suffices. Null capabilities are none."""
    have = F.coalesce(capabilities, F.array().cast("array<string>"))
    out = F.lit(True)
    if must:
        out &= F.size(F.array_except(F.array(*map(F.lit, must)), have)) == 0
    if must_not:
        out &= ~F.arrays_overlap(have, F.array(*map(F.lit, must_not)))
    if min_budget is not None:
        out &= F.coalesce(budget >= min_budget, F.lit(False))
    return out


def query_providers(live: DataFrame, attached: str, limit: int, ties: list[str] = ()) -> DataFrame:
    """The first `limit` rows by attachment, with rank, and whether more were cut off.

    Limit and count are separate aggregates: no window runs over all rows.
    """
    total = live.agg(F.count("*").alias("__total"))
    top = live.orderBy(attached, *ties).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(attached, *ties)))  # of at most `limit` rows
    return ranked.join(F.broadcast(total), F.lit(True)).withColumn("truncated", F.col("__total") > limit).drop("__total")


def log_bucket(n: Column) -> Column:
    """The greatest power of two that is no more than n; 0 where n < 1."""
    return F.when(n >= 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n)) - 1)).otherwise(F.lit(0).cast("long"))


def utilisation_bucket(u: Column) -> Column:
    """clamp(7 + floor(log2 u), 0, 7); not positive or not a number: 0."""
    return F.when(F.isnan(u) | (u <= 0) | u.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(7), 7 + F.floor(F.log2(u))))).cast("int")


def slot_counts(df: DataFrame, slot: Column, slots: int, keep_empty: bool = False) -> DataFrame:
    """Rows in each prefix slot, with their power-of-two bucket; empty slots only on demand."""
    counts = df.groupBy(slot.cast("int").alias("slot")).agg(F.count("*").alias("n"))
    if keep_empty:
        counts = df.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(counts, "slot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.withColumn("bucket", log_bucket(F.col("n")))


def select_shards(counts: DataFrame, want: int, overprovision: float = 1.0, most: int = 4) -> DataFrame:
    """The most populated slots, until their buckets cover want * overprovision, and at most `most` of them."""
    need = F.greatest(F.lit(1), F.ceil(F.lit(want * overprovision)))
    top = counts.where("bucket > 0").orderBy(F.desc("bucket"), "slot").limit(most)
    w = Window.orderBy(F.desc("bucket"), "slot")
    before = F.coalesce(F.sum("bucket").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top.withColumn("before", before).where(F.col("before") < need)


def expected_matches(arrivals: Column, accept_ratio: Column, patience_ms: Column) -> Column:
    return arrivals * accept_ratio * (patience_ms / 60_000)


def contention(arrivals: Column, queries: Column, mean_want: Column, cap: float) -> Column:
    return F.least(1 + queries * mean_want / F.greatest(arrivals, F.lit(1.0)), F.lit(cap))


def hang_out(matches: Column, want: Column, expected: Column, factor: Column) -> Column:
    """done, hangOut or escalate."""
    return F.when(matches >= want, "done").when(matches + expected >= want * factor, "hangOut").otherwise("escalate")


def accept_ratio(matched: Column, returned: Column, initial: float = 1.0) -> Column:
    return F.when(returned > 0, matched / returned).otherwise(F.lit(initial))


def assemble_quorum(slices: list[DataFrame], key: str, order: list[str], valid: Column, tag: str, target: int) -> DataFrame:
    """Union of slices in order, first row of each key, those that are valid and carry the tag, up to target, with met_target."""
    rows = None
    for i, s in enumerate(slices):
        s = s.withColumn("__slice", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    w = Window.partitionBy(key).orderBy("__slice", *order)
    found = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").where(valid & F.array_contains("capabilities", tag)).drop("__n")
    taken = found.orderBy("__slice", *order).limit(target)
    count = taken.agg(F.count("*").alias("taken"))
    return taken.drop("__slice").join(F.broadcast(count), F.lit(True)).withColumn("met_target", F.col("taken") >= target)


def assign_slots(participants: DataFrame, members: DataFrame, participant: str, member: str, epoch: str, backups: int = 2) -> DataFrame:
    """Primary and up to two backups: members in order, from place SHA-256(participant, epoch) mod k onwards."""
    ring = members.agg(F.array_sort(F.collect_set(member)).alias("ring"))  # one cohort's members: a bounded ring
    digest = F.sha2(F.concat(F.col(participant).cast("string"), F.lit(epoch)), 256)
    k = F.size("ring")
    residue = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda acc, i: (acc * 4294967296 + F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")) % k)
    out = participants.join(F.broadcast(ring), F.lit(True)).withColumn("__slot", residue.cast("int"))
    names = [("primary", 0), *((f"backup{i}", i) for i in range(1, backups + 1))]
    return out.select(*participants.columns, *[F.when(F.lit(i) < k, F.get("ring", (F.col("__slot") + i) % k)).alias(n) for n, i in names])


def nearest_by_xor(members: DataFrame, ident: str, target: str, k: int) -> DataFrame:
    """Members by XOR distance of hex identifiers of equal length to a target, at most k.

    With three members or fewer all are given; beyond, min(k, max(1, floor(n / 2))).
    """
    n = members.count()
    effective = n if n <= 3 else min(k, max(1, n // 2))
    words = range(0, len(target), 8)
    distance = [F.conv(F.substring(ident, i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(int(target[i : i + 8], 16))).alias(f"d{i // 8}") for i in words]
    return members.withColumn("__d", F.struct(*distance)).orderBy("__d", ident).limit(effective).drop("__d")


def start_depth(n: Column, confidence: Column, fanout: int = 16, cap: int = 60, least_confidence: float = 0.3) -> Column:
    """clamp(floor(log_F n) - 1, 0, cap) over whole numbers; low confidence halves the cap."""
    powers = [fanout**i for i in range(1, 16) if fanout**i < 2**62]
    depth = F.greatest(F.lit(0), F.least(F.lit(cap), F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p <= n)) - 1))
    return F.when(confidence < least_confidence, F.least(depth, F.lit(cap // 2))).otherwise(depth)


def tree_depth(n: Column, cap: int, fanout: int) -> Column:
    """max(0, ceil(log_F(n / cap))); 0 where n <= cap."""
    sizes = [cap * fanout**i for i in range(0, 16) if cap * fanout**i < 2**62]
    return F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: s < n))


def backoff_ms(attempt: Column, base: float = 100.0, factor: float = 2.0, cap: float = 5000.0, seed: int | None = None) -> Column:
    """min(base * factor^attempt, cap), less up to a half of it at random where a seed is given."""
    full = F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(cap))
    return full if seed is None else full * (1 - 0.5 * F.rand(seed))


def fan_out(selected: DataFrame, providers: DataFrame, slot: str, key: str, attached: str, matches: Column, want: int) -> DataFrame:
    """Providers of the selected shards, once each, those that match, the first `want` by attachment."""
    found = providers.join(F.broadcast(selected.select(slot)), slot, "left_semi").where(matches)  # shards: a few by construction
    once = found.groupBy(key).agg(F.min(attached).alias(attached))
    return once.orderBy(attached, key).limit(want)


def tier_walk(seekers: DataFrame, states: DataFrame, key: str, start: int, most: int = 60) -> DataFrame:
    """Where each seeker's walk ends: tier and hops.

    states: key, tier and promoted, one row for each tier that holds state. From tier `start` seekers go inward to the
    first tier with state, or to the root, tier 0; where that tier has been promoted they go one outward, at most to `most`.
    """
    met = states.where(F.col("tier").between(1, start)).groupBy(key).agg(F.max(F.struct("tier", "promoted")).alias("at"))
    tier = F.coalesce(F.col("at.tier"), F.lit(0))
    out = F.when(F.coalesce(F.col("at.promoted"), F.lit(False)), 1).otherwise(0)
    walked = seekers.join(met, key, "left").select(*seekers.columns, tier.alias("__met"), out.alias("__out"))
    return walked.select(*seekers.columns, F.least(F.col("__met") + F.col("__out"), F.lit(most)).alias("tier"), (F.lit(start) - F.col("__met") + F.col("__out")).alias("hops"))
