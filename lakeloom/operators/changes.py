"""Change logs: contiguity, folds over revisions, hash chains, resume classes and the invalidation cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.functions.codec import base64url


def with_gaps(log: DataFrame, by: list[str], revision: str) -> DataFrame:
    """status first, duplicate, delivered or gap against the revision before, and the range to backfill."""
    prior = F.lag(revision).over(Window.partitionBy(*by).orderBy(revision))
    out = log.withColumn("prior", prior)
    step = F.col(revision) - F.col("prior")
    status = F.when(F.col("prior").isNull(), "first").when(step <= 0, "duplicate").when(step == 1, "delivered").otherwise("gap")
    return out.withColumn("status", status).withColumn("missing_from", F.when(step > 1, F.col("prior") + 1)).withColumn("missing_to", F.when(step > 1, F.col(revision) - 1))


def contiguous(intervals: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Whether each interval begins right after the one before."""
    prior = F.lag(high).over(Window.partitionBy(*by).orderBy(low))
    return intervals.withColumn("abuts", F.coalesce(F.col(low) == prior + 1, F.lit(True)))


def digest_fold(log: DataFrame, by: list[str], revision: str, digest: Column) -> DataFrame:
    """acc = SHA-256(acc || digest) over the revisions of a group, in order. A group is one checkpoint's span, so it is bounded."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(revision).alias("r"), digest.alias("d"))))
    fold = F.aggregate(steps, F.unhex(F.lit("")), lambda acc, x: F.unhex(F.sha2(F.concat(acc, x["d"]), 256)))
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.min(revision).alias("from_rev"), F.max(revision).alias("to_rev"), F.lower(F.hex(fold)).alias("digest"))


def coalesced_delta(log: DataFrame, by: list[str], revision: str, delta: str, cap: int) -> DataFrame:
    """Deltas joined in revision order, dropped (null) where they exceed cap bytes or one is missing or cap is 0."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(revision).alias("r"), F.col(delta).alias("d"))))
    joined = F.array_join(F.transform(steps, lambda s: s["d"]), "")
    grouped = log.groupBy(*by).agg(joined.alias("delta"), F.sum(F.octet_length(delta)).alias("bytes"), F.count_if(F.col(delta).isNull()).alias("__none"))
    return grouped.withColumn("delta", F.when((F.col("bytes") <= cap) & (F.lit(cap) > 0) & (F.col("__none") == 0), F.col("delta"))).drop("__none")


def rolling_checkpoint(log: DataFrame, by: list[str], revision: str, digest: Column, delta: str, window: int = 256, span: int = 4096, cap: int = 65_536) -> DataFrame:
    """Of each collection the `span` revisions below its newest `window`: their ends, folded digest and coalesced delta."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(revision).desc()))
    retired = log.withColumn("__n", place).where((F.col("__n") > window) & (F.col("__n") <= window + span)).drop("__n")
    return digest_fold(retired, by, revision, digest).join(coalesced_delta(retired, by, revision, delta, cap), by)


def spliced(items: Column, at: Column, removed: Column, added: Column) -> Column:
    """items without `removed` entries from place `at` (0: the first), and with `added` there."""
    head = F.slice(items, F.lit(1), F.least(at, F.size(items)))
    tail = F.slice(items, F.least(at + removed, F.size(items)) + 1, F.size(items))
    return F.concat(head, added, tail)


def transformed(blocks: DataFrame, operations: DataFrame, order: str) -> DataFrame:
    """blocks (block, attribute, items) after operations (block, kind, attribute, at, removed, added, `order`).

    Inserts give a block its items, then its updates splice them in order, and a delete wins over both. Splices of a
    block that is not there, or of an attribute that it lacks, do nothing. One attribute's updates, those of one
    transform, are folded within a row.
    """
    gone = operations.where("kind = 'delete'").select("block").distinct()
    fresh = operations.where("kind = 'insert'").groupBy("block", "attribute").agg(F.max_by("added", order).alias("items"))
    kept = blocks.join(fresh.select("block").distinct(), "block", "left_anti").unionByName(fresh).join(gone, "block", "left_anti")
    steps = operations.where("kind = 'update'").groupBy("block", "attribute").agg(F.array_sort(F.collect_list(F.struct(order, "at", "removed", "added"))).alias("__steps"))
    fold = F.aggregate("__steps", F.col("items"), lambda acc, s: spliced(acc, s["at"], s["removed"], s["added"]))
    return kept.join(steps, ["block", "attribute"], "left").select("block", "attribute", F.when(F.col("__steps").isNull(), F.col("items")).otherwise(fold).alias("items"))


def blocks_at(bases: DataFrame, operations: DataFrame, revision: str, at: int) -> DataFrame:
    """(block, attribute, items) at a revision: each block's newest base up to it, and the operations after that base.

    bases are blocks with the revision that they were materialised at. A block begins anew with its last insert, and is
    gone after a last delete; within one revision a delete comes last.
    """
    upto = bases.where(F.col(revision) <= at)
    newest = upto.groupBy("block").agg(F.max(revision).alias("__base"))
    steps = operations.where(F.col(revision) <= at).join(newest, "block", "left").where(F.col("__base").isNull() | (F.col(revision) > F.col("__base")))
    begun = steps.where("kind != 'update'").groupBy("block").agg(F.max(F.struct(F.col(revision).alias("rev"), (F.col("kind") == "delete").alias("gone"))).alias("__begun"))
    rest = steps.join(begun, "block", "left").where(F.col("__begun").isNull() | (F.col(revision) > F.col("__begun.rev")) | ((F.col(revision) == F.col("__begun.rev")) & (~F.col("__begun.gone") | (F.col("kind") == "delete"))))
    start = upto.join(newest, "block").where(F.col(revision) == F.col("__base"))
    return transformed(start.select("block", "attribute", "items"), rest.drop("__base", "__begun"), revision)


def merged_operations(first: DataFrame, second: DataFrame, order: str) -> DataFrame:
    """One transform that does first, then second. What the first did to blocks that the second inserts or deletes is dropped."""
    told = second.where("kind IN ('insert', 'delete')").select("block").distinct()
    step = lambda df, i: df.withColumn(order, F.struct(F.lit(i).alias("part"), F.col(order).alias("at")))
    return step(first.join(told, "block", "left_anti"), 0).unionByName(step(second, 1))


def first_seen(log: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    at = log.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("at"))
    return at.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def hash_chain(log: DataFrame, by: list[str], order: str, body: Column) -> DataFrame:
    """body_hash of each entry and prior_hash, that of the entry before (base64url of SHA-256)."""
    own = base64url(F.unhex(F.sha2(body, 256)))
    out = log.withColumn("body_hash", own)
    return out.withColumn("prior_hash", F.lag("body_hash").over(Window.partitionBy(*by).orderBy(order)))


def chain_breaks(chain: DataFrame, by: list[str], order: str) -> DataFrame:
    """Entries whose stored prior_hash is not the hash of the entry before."""
    expected = F.lag("body_hash").over(Window.partitionBy(*by).orderBy(order))
    return chain.withColumn("__expected", expected).where(~F.col("prior_hash").eqNullSafe(F.col("__expected"))).drop("__expected")


def resume_class(from_rev: Column, known_tail: Column, tail: Column, ring_low: Column, checkpoint_low: Column, checkpoint_high: Column) -> Column:
    """tail_rotated, backfill, checkpoint_window or out_of_window. A checkpoint helps only if it abuts the ring."""
    covered = (checkpoint_high == ring_low - 1) & from_rev.between(checkpoint_low, checkpoint_high)
    return F.when(~known_tail.eqNullSafe(tail), "tail_rotated").when(F.coalesce(from_rev >= ring_low, F.lit(False)), "backfill").when(F.coalesce(covered, F.lit(False)), "checkpoint_window").otherwise("out_of_window")


def retained(log: DataFrame, by: list[str], revision: str, window: int = 256) -> DataFrame:
    """The highest `window` revisions of each collection."""
    w = Window.partitionBy(*by).orderBy(F.col(revision).desc())
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= window).drop("__n")


def commit_blocks(log: DataFrame, by: list[str], revision: str, size: int = 64, warm_up: int = 56) -> DataFrame:
    """Tumbling windows by count: block number, place in it, and the marks warm_up and full."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(revision)) - 1
    out = log.withColumn("block", F.floor(place / size).cast("long")).withColumn("place", place % size + 1)
    return out.withColumn("warm_up", F.col("place") == warm_up).withColumn("full", F.col("place") == size)


def cascade(reads: DataFrame, writes: DataFrame, roots: DataFrame, max_depth: int | None = None, stage=lambda df: df, max_transactions: int | None = None) -> DataFrame:
    """Actions that depend, over reads of written blocks, on invalidated actions: (action, depth, escalation).

    reads: action, block, rev; writes: action, block, rev; roots: action. An action is reached when it read a
    (block, rev) that a reached action wrote. Each round joins the last round's writes with all reads, which are kept by
    block and revision meanwhile, until no action is new. Where a limit is given and leaves reachable actions out, escalation says so on every row:
    max-depth, or max-transactions (reached ones besides the roots, by depth and action); else it is null. With a
    column collection in reads (the reader's) and writes, a read of a revision of the own collection that is not
    before the reader's own is an error. `stage` may write a round's result out, to cut lineage.
    """
    forward = "collection" in reads.columns and "collection" in writes.columns
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt and sorted once, by what the rounds join them on: a round shuffles its front alone
    reads = reads.repartition(parts, "block", "rev").sortWithinPartitions("block", "rev").persist()
    writes = writes.repartition(parts, "action").sortWithinPartitions("action").persist()
    try:
        found = stage(roots.select("action").distinct().withColumn("depth", F.lit(0)))
        front, reached, depth, escalation = found, 0, 0, None
        while escalation is None:
            depth += 1
            touched = front.select("action").join(writes, "action").drop("action").distinct()
            if forward:
                own = writes.select("action", "collection", F.col("rev").alias("own")).distinct()
                back = reads.join(touched.select("block", "rev", "collection"), ["block", "rev", "collection"]).join(own, ["action", "collection"]).where("own <= rev").first()
                if back:
                    raise ValueError(f"back edge: action {back['action']} at revision {back['own']} read {back['block']}@{back['rev']} of its collection")
            front = reads.join(touched, ["block", "rev"], "left_semi").select("action").distinct().join(found.select("action"), "action", "left_anti")
            front = stage(front.withColumn("depth", F.lit(depth)))
            new = front.count()
            if not new:
                break
            if max_depth is not None and depth > max_depth:
                escalation = "max-depth"
                break
            if max_transactions is not None and reached + new > max_transactions:
                escalation = "max-transactions"
                front = front.orderBy("action").limit(max_transactions - reached)
            reached += new
            found = stage(found.unionByName(front))
        return found.withColumn("escalation", F.lit(escalation).cast("string"))
    finally:
        reads.unpersist()
        writes.unpersist()


def verdicts(candidates: DataFrame) -> DataFrame:
    """One verdict for each action from its matched reads (action, observed, restored, legacy).

    legacy reads cannot be judged; differing or missing content invalidates; otherwise the action is retained.
    """
    differs = F.col("observed").isNull() | F.col("restored").isNull() | (F.col("observed") != F.col("restored"))
    grouped = candidates.groupBy("action").agg(F.bool_or("legacy").alias("legacy"), F.bool_or(differs).alias("differs"))
    return grouped.select("action", F.when(F.col("legacy"), "unevaluable").when(F.col("differs"), "invalidate").otherwise("retain").alias("verdict"))


def replayed(operations: DataFrame, key: list[str], order: str, kind: str, value: str) -> DataFrame:
    """State of each entity after its insert, update and delete operations in order; a deletion clears it."""
    last = operations.groupBy(*key).agg(F.max_by(F.struct(F.col(kind).alias("k"), F.col(value).alias("v")), F.col(order)).alias("last"))
    return last.where("last.k != 'delete'").select(*key, F.col("last.v").alias(value))


def rotations(log: DataFrame, by: list[str], revision: str, tail: str) -> DataFrame:
    """Entries at which the tail differs from that of the entry before: the new tail becomes effective there."""
    prior = F.lag(tail).over(Window.partitionBy(*by).orderBy(revision))
    return log.withColumn("prior_tail", prior).where(F.col("prior_tail").isNotNull() & (F.col("prior_tail") != F.col(tail)))


def handoffs(log: DataFrame, by: list[str], revision: str, tail: str, ms: str, now: Column, drain_ms: int = 60_000) -> DataFrame:
    """For each rotation: the last revision under the old tail, until when that one drains, and whether it still does at `now`."""
    turned = rotations(log, by, revision, tail)
    ends = turned.withColumn("last_rev", F.col(revision) - 1).withColumn("drains_until", F.col(ms) + drain_ms)
    return ends.withColumn("draining", now < F.col("drains_until"))


def registration_plan(subscribers: DataFrame, ident: str, at: Column, jitter_ms: int = 30_000) -> DataFrame:
    """When each subscriber registers again after a rotation: at, plus a jitter that its identifier fixes."""
    jitter = F.conv(F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 8), 16, 10).cast("long") % jitter_ms
    return subscribers.withColumn("register_at", at + jitter)


def backfill(log: DataFrame, requests: DataFrame, by: list[str], revision: str, low: str = "from_rev", high: str = "to_rev") -> DataFrame:
    """Log entries of each requested range, with underflow where the log begins after the range's start."""
    first = log.groupBy(*by).agg(F.min(revision).alias("ring_low"))
    asked = requests.join(first, by, "left").withColumn("underflow", F.coalesce(F.col(low) < F.col("ring_low"), F.lit(True)))
    entries = asked.select(*by, low, high, "underflow").join(log, by, "left")
    return entries.where(F.col(revision).isNull() | F.col(revision).between(F.col(low), F.col(high)))


def chain_push(chain: DataFrame, entries: DataFrame, order: str) -> DataFrame:
    """Entries at the tail, numbered on from the last place."""
    last = chain.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("__last"))
    new = entries.withColumn("__n", F.row_number().over(Window.orderBy(order)))  # one batch of entries
    return chain.unionByName(new.join(F.broadcast(last), F.lit(True)).withColumn("place", F.col("__last") + F.col("__n")).select(*chain.columns))


def chain_take(chain: DataFrame, n: int, head: bool = False) -> tuple[DataFrame, DataFrame]:
    """(taken, left): pop n from the tail, or dequeue n from the head."""
    taken = chain.orderBy("place" if head else F.desc("place")).limit(n)
    return taken, chain.join(taken.select("place"), "place", "left_anti")


def chain_update(chain: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries replaced at their places; changed has the chain's columns, and places that the chain lacks are left out."""
    rest = [c for c in chain.columns if c != "place"]
    new = changed.select("place", F.struct(*rest).alias("__new"))
    own = F.struct(*rest)
    return chain.join(new, "place", "left").select("place", F.coalesce("__new", own).alias("e")).select("place", "e.*").select(*chain.columns)
