"""N-gram Jaccard self-join by parity sketches, and the components of its links.

Sets of size a and b with Jaccard similarity J >= p/q differ in at most (a + b)(q - p)/(q + p) tokens. XOR-ing
tokens into bits gives sketches whose Hamming distance never exceeds that difference. Sizes are cut into bands; in a
band the token space is cut into more segments than sets may differ in tokens, so two linked sets agree in some
segment (pigeonhole), and in one that holds two tokens at least if a set has more such segments than it may
differ in tokens. Each set announces its first t + 1 such segments (t: its largest difference), by the XOR of
their tokens; sets that meet are compared by size, by a 1024-bit parity sketch and then exactly.

Sets that meet are first compared with the least of them alone (a star, not all pairs). Only where a meeting
then still spans several components are further pairs tried, in blocks, and only across components. A bucket
that many sets share is found by counting in a part of them, and dealt over several tasks: each has a star of
its own, and the stars' centres are compared with the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, discard, staged
from .textvec import Words, mix64, runs_of, slices

SKETCH_WORDS = 16
BAND = 1.6
BLOCK_ROWS = 512
MAX_BROADCAST_IDS = 500_000
#: A bucket with HOT_COUNT rows or more in one of HOT_SAMPLE parts of the sets is dealt over SALTS tasks.
HOT_SAMPLE, HOT_COUNT, SALTS = 64, 500, 64
MAX_BROADCAST_HOT = 100_000
FEATURES = "key long, n long, hi long, lo long, sketch array<long>, keys array<long>"


def band_edges(most: int) -> np.ndarray:
    """Least sizes of the bands, up to one beyond `most`."""
    edges = [1]
    while edges[-1] <= most * 2:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges, np.int64)


def largest_difference(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return (n + n * den // num) * (den - num) // (den + num)


def distinct_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after the other, and their number."""
    tokens, count = runs_of(words, k)
    ends = np.cumsum(count)
    for a, z in zip(ends - count, ends):
        tokens[a:z].sort()
    text = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    return tokens[new], np.bincount(text[new], minlength=len(count))


def announced(tokens: np.ndarray, text: np.ndarray, n: np.ndarray, band: np.ndarray, edges: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and the text of each. tokens and text: those of the texts with n > 0; band: of each text."""
    top = largest_difference(edges[1:] - 1, num, den)
    segments = np.where(top == 0, 1, np.ceil((top + 1) * 1.3).astype(np.int64) + 1)[band]
    base = np.cumsum(segments) - segments
    own = ((mix64(tokens, 21) >> np.uint64(32)) * segments[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    cell = base[text] + own
    total = int(segments.sum())
    load = np.bincount(cell, minlength=total)
    content = np.zeros(total, np.uint64)
    np.bitwise_xor.at(content, cell, mix64(tokens, 22))
    owner = np.repeat(np.arange(len(n)), segments)
    t = largest_difference(n, num, den)
    count = lambda mask: np.bincount(owner[mask], minlength=len(n))
    heavy, filled = load >= 2, load >= 1
    many, some = count(heavy) > t, count(filled) > t
    rank = np.cumsum(heavy)
    rank -= np.concatenate(([0], rank))[base][owner]
    send = np.where(many[owner], heavy & (rank <= t[owner] + 1), np.where(some[owner], filled, True))
    at = np.flatnonzero(send)
    who = owner[at]
    place = (band[who].astype(np.uint64) << np.uint64(40)) | (at - base[who]).astype(np.uint64)
    return mix64(content[at] ^ mix64(place, 23), 24), who


def features(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, ends in slices(batch, "text"):
            tokens, n = distinct_sets(Words(data, ends), k)
            size = len(n)
            text = np.repeat(np.arange(size), n)
            hi, lo = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
            np.add.at(hi, text, mix64(tokens, 11))
            np.bitwise_xor.at(lo, text, mix64(tokens, 12))
            sketch = np.zeros(size * SKETCH_WORDS, np.uint64)
            bit = mix64(tokens, 13)
            np.bitwise_xor.at(sketch, text * SKETCH_WORDS + ((bit >> np.uint64(6)) % np.uint64(SKETCH_WORDS)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            edges = band_edges(int(n.max(initial=1)))
            home = np.searchsorted(edges, n, side="right") - 1
            keys, owners = [], []
            visits = (n > 0) & (n * den // num >= edges[np.maximum(home, 0) + 1])
            for chosen, shift in ((n > 0, 0), (visits, 1)):
                ids = np.flatnonzero(chosen)
                if len(ids):
                    new = np.cumsum(chosen) - 1
                    mine = chosen[text]
                    got, who = announced(tokens[mine], new[text[mine]], n[ids], home[ids] + shift, edges, num, den)
                    keys.append(got)
                    owners.append(ids[who])
            owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            order = np.argsort(owner, kind="stable")
            flat = (np.concatenate(keys) if keys else np.zeros(0, np.uint64))[order].view(np.int64)
            starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=size)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(n, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * SKETCH_WORDS, pa.int32()), pa.array(sketch.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(flat)),
                ],
                names=["key", "n", "hi", "lo", "sketch", "keys"],
            )


def token_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of rows (node, hi, text) those whose set is the node's, told by the sum of its tokens' hashes."""
    for batch in batches:
        for rows, data, ends in slices(batch, "text"):
            tokens, n = distinct_sets(Words(data, ends), k)
            hi = np.zeros(len(n), np.uint64)
            np.add.at(hi, np.repeat(np.arange(len(n)), n), mix64(tokens, 11))
            starts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            out = pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(starts), pa.array(tokens.view(np.int64)))], names=["key", "tokens"])
            yield out.filter(pa.array(rows.column(1).to_numpy().view(np.uint64) == hi))


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, salt, key): those of runs with several keys, with the least key and their place.

    A run is a bucket, or a salted part of one; rows of salted parts (salt > 0) are all given.
    """
    last = None  # bucket, salt, key, least key of the run, place
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, salt, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        if last:
            bucket, salt, key = (np.concatenate(([a], b)) for a, b in zip(last, (bucket, salt, key)))
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1]) | (key[1:] != key[:-1])
        bucket, salt, key = bucket[new], salt[new], key[new]
        head = np.ones(len(bucket), bool)
        head[1:] = (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])
        run = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        least, place = key[first][run], np.arange(len(bucket)) - first[run]
        size = np.bincount(run)
        several = (size[run] > 1) | (salt > 0)
        if last:
            mine = run == 0
            least[mine], place[mine] = last[3], place[mine] + last[4]
            if last[4] > 0 or last[1] > 0:
                several[mine] = True
                several[0] = False  # told before
        last = (bucket[-1], salt[-1], key[-1], least[-1], place[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (bucket, salt, key, least, place.astype(np.int64))], names=["bucket", "salt", "key", "least", "place"])


def crossing(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, i, j): pairs of a block that are in different components and may be linked."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        block, key, comp, n, i, j = (rows.column(c).to_numpy() for c in ("block", "key", "comp", "n", "i", "j"))
        bits = np.stack([rows.column(f"s{w}").to_numpy() for w in range(SKETCH_WORDS)], axis=1).view(np.uint64)
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        xs, ys = [], []
        for a in left:
            b = right[key[right] > key[a]] if i[0] == j[0] else right
            b = b[comp[b] != comp[a]]
            both = n[a] + n[b]
            room = both - 2 * (-(-num * both // (num + den)))
            far = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1)
            b = b[(far <= room) & (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b]))]
            xs.append(np.full(len(b), key[a]))
            ys.append(key[b])
        x, y = np.concatenate(xs), np.concatenate(ys)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    held: list[pa.Table] = []
    name = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ids = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
        cuts = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(ids)])) if len(ids) else []
        for a, z in zip(cuts[:-1], cuts[1:]):
            if name is not None and tuple(ids[a]) != name:
                yield pairs(pa.concat_tables(held))
                held = []
            name = tuple(ids[a])
            held.append(table.slice(a, z - a))
    if held:
        yield pairs(pa.concat_tables(held))


def components(links: DataFrame) -> DataFrame:
    """links (x, y) -> (key, comp): the least key that each linked key reaches. Labels flow along links and jump."""
    rows = 2 * links.count()
    ways = staged(links.select("x", "y").union(links.select("y", "x")).distinct(), "ways", rows)
    labels = staged(ways.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).withColumnRenamed("x", "key"), "labels", rows)
    before = labels
    while True:
        near = ways.join(labels, ways.y == labels.key).groupBy("x").agg(F.min("comp").alias("near"))
        moved = labels.join(near, labels.key == near.x).select("key", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        ahead = labels.select(F.col("key").alias("via"), F.col("comp").alias("ahead"))
        moved = staged(moved.join(ahead, "via").select("key", "old", F.least("via", "ahead").alias("comp")), "labels", rows)
        discard(before)
        labels, before = moved.select("key", "comp"), moved
        if moved.where("comp != old").limit(1).count() == 0:
            discard(ways)
            return labels


def jaccard_components(docs: DataFrame, key: str = "doc_id", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """For each row of docs (key, text): key, n_shingles and component_id.

    Words are ASCII-lower-cased runs without white space; a set holds the distinct k-word shingles (a shorter
    text is one shingle; no words, no set). Sets link at Jaccard similarity num/den or more; component_id is the
    least key that is reachable. Every distinct set is a node of its own, whatever keys its rows have: rows of equal
    sets are linked, rows that share a key but not a set are not; null keys take no part and get null. Sets are
    compared by 64-bit shingle hashes. Texts of any length count whole; other columns, whatever their names, take
    no part; an empty table gives no rows.
    """
    read = docs.select(F.col(key).cast("long").alias("key"), F.col("text"))
    table = staged(read.mapInArrow(lambda it: features(it, k, num, den), FEATURES), "parity-features")
    rows_read = table.count()
    narrow = staged(table.select("key", "n", "hi", "lo"), "parity-rows", rows_read)
    sets = narrow.where("n > 0 AND key IS NOT NULL").groupBy("hi", "lo", "n").agg(F.min("key").alias("rep"))
    sets = staged(sets, "parity-sets", rows_read)
    # a node has its least key as name, so that stars stand around early documents; further sets of one key have hashes
    firsts = sets.groupBy("rep").agg(F.min(F.struct("hi", "lo", "n")).alias("set")).select(F.col("rep").alias("first"), "set.*")
    named = sets.join(firsts, ["hi", "lo", "n"], "left").withColumn("node", F.coalesce("first", F.xxhash64("rep", "hi", "lo", "n"))).drop("first")
    sets = staged(named, "parity-nodes", rows_read)
    own = sets.select(F.col("rep").alias("key"), "hi", "lo", "n", "node")
    chosen = table.where("n > 0").join(own, ["key", "hi", "lo", "n"])
    reps = chosen.select(F.col("node").alias("key"), "n", "sketch", "keys")
    # by a join column, so that only the sample is joined
    some = chosen.where(F.pmod(F.xxhash64("hi", F.lit(3)), F.lit(HOT_SAMPLE)) == 0).select(F.explode("keys").alias("bucket"))
    hot = staged(some.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_COUNT), "parity-hot")
    salt = F.when(F.col("n").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("key", F.lit(4)), F.lit(SALTS))).cast("int")
    dealt = reps.select(F.explode("keys").alias("bucket"), "key").join(broadcast_within(hot, MAX_BROADCAST_HOT), "bucket", "left").select("bucket", salt.alias("salt"), "key")
    dealt = dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "key")
    met = staged(dealt.mapInArrow(meetings, "bucket long, salt int, key long, least long, place long"), "parity-meetings")
    rows = met.count()
    centres = met.where("salt > 0 AND place = 0").select("bucket", F.col("key").alias("y"))
    centres = centres.join(centres.groupBy("bucket").agg(F.min("y").alias("x")), "bucket").where("x != y").select("x", "y")
    ids = staged(met.select("key").distinct(), "parity-ids", rows)
    sketches = staged(reps.select("key", "n", "sketch").join(broadcast_within(ids, MAX_BROADCAST_IDS), "key", "left_semi").dropDuplicates(["key"]), "parity-sketches", 4 * ids.count())
    discard(table, hot, ids)

    pairs = met.where("key != least").select(F.col("least").alias("x"), F.col("key").alias("y")).unionByName(centres).distinct()
    end = lambda c: sketches.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = F.col("nx") + F.col("ny")
    far = F.aggregate(F.zip_with("sx", "sy", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    least = F.ceil(num * both / (num + den))
    likely = pairs.join(end("x"), "x").join(end("y"), "y").where((den * F.least("nx", "ny") >= num * F.greatest("nx", "ny")) & (far <= both - 2 * least)).select("x", "y")
    likely = staged(likely, "parity-candidates", rows)
    links = verified(likely, read, own, k, num, den)
    comps = components(links)

    found = met.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    block = F.col("salt").cast("long") * (1 << 32) + (F.col("place") / BLOCK_ROWS).cast("long")
    found = staged(found.select("bucket", "key", "comp", block.alias("block")), "parity-found", rows)
    discard(met, likely)
    spread = found.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.count("*").alias("members"), F.collect_set("block").alias("blocks")).where("a != z AND members > 2")
    dealt = found.join(spread, "bucket").select("bucket", "key", "comp", "block", F.explode("blocks").alias("other"))
    words = [F.get("sketch", F.lit(w)).alias(f"s{w}") for w in range(SKETCH_WORDS)]
    dealt = dealt.join(sketches, "key").select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "comp", "n", *words)
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    across = staged(dealt.mapInArrow(lambda it: crossing(it, num, den), "x long, y long").distinct(), "parity-crossing", rows)
    more = verified(across, read, own, k, num, den)
    if more.limit(1).count():
        comps = components(links.unionByName(more))
    discard(found, sketches, across)

    linked = sets.select(F.col("node").alias("key"), "hi", "lo", "n", "rep").join(comps, "key")
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = linked.join(least, "comp").select("hi", "lo", "n", "component_id")
    labels = sets.join(labels, ["hi", "lo", "n"], "left").select("hi", "lo", "n", F.coalesce("component_id", "rep").alias("component_id"))
    worded = narrow.where("n > 0").join(labels, ["hi", "lo", "n"], "left").select("key", "n", "component_id")
    named = worded.unionByName(narrow.where("n = 0").select("key", "n", F.lit(None).cast("long").alias("component_id")))
    return named.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))


def verified(pairs: DataFrame, read: DataFrame, own: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (x, y) of nodes whose sets have Jaccard similarity num/den or more.

    read: rows (key, text); own: of each node the least key of its rows, by which its text is found again.
    """
    rows = pairs.count()
    ids = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    ids = staged(ids.join(own.select("node", "key", "hi"), "node"), "parity-ids", 2 * rows)
    texts = read.join(broadcast_within(ids, MAX_BROADCAST_IDS), "key").select("node", "hi", "text")
    sets = staged(texts.mapInArrow(lambda it: token_sets(it, k), "key long, tokens array<long>"), "parity-tokens")
    if sets.count() > ids.count():  # repeated rows
        sets = sets.dropDuplicates(["key"])
    end = lambda c: sets.select(F.col("key").alias(c), F.col("tokens").alias(f"t{c}"))
    shared = F.size(F.array_intersect("tx", "ty"))
    close = den * shared >= num * (F.size("tx") + F.size("ty") - shared)
    return staged(pairs.join(end("x"), "x").join(end("y"), "y").where(close).select("x", "y").distinct(), "parity-links")
