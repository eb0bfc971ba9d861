from __future__ import annotations

import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom import registry
from lakeloom.operators import changes, matching, metrics
from lakeloom.sources.scratch import saved
from lakeloom.streaming import flows, stateful, steps


def test_contiguity_dedupe_and_queue():
    run = lambda step, rows: (lambda s, out: [out.extend(m) or s.update(n) for r in rows for n, m in [step(s, r)]] and out)({}, [])
    out = run(steps.contiguity(), [{"rev": r} for r in (3, 4, 4, 7, 5)])
    assert [o["outcome"] for o in out] == ["adopted", "delivered", "duplicate", "gap", "delivered"] and (out[3]["from_rev"], out[3]["to_rev"]) == (5, 7)
    out = run(steps.dedupe(window=2), [{"rev": r, "mark": m} for r, m in ((1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (1, "a"), (1, "a"))])
    assert [(o["rev"], o["mark"]) for o in out] == [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (1, "a"), (1, "a")]
    out = run(steps.bounded_queue(depth=2), [{"item": i, "drain": 0} for i in range(4)] + [{"item": None, "drain": 5}])
    assert [(o["item"], o["outcome"]) for o in out] == [(0, "dropped"), (1, "dropped"), (2, "delivered"), (3, "delivered")]
    out = run(steps.rate_limit(rate=2, window_ms=100), [{"ms": t} for t in (0, 1, 2, 3, 99, 100, 101, 300)])
    assert [o["accepted"] for o in out] == [True, True, False, False, False, True, True, True] and [o["retry_ms"] for o in out[2:5]] == [1000, 2000, 4000]
    out = run(steps.hysteresis(), [{"ms": 0, "n": 64}, {"ms": 1000, "n": 3}, {"ms": 290_000, "n": 3}, {"ms": 302_000, "n": 3}])
    assert [(o["ms"], o["event"]) for o in out] == [(0, "promote"), (302_000, "demote")]
    out = run(steps.resident(cap=1), [{"topic": "a", "n": 1}, {"topic": "b", "n": 1}, {"topic": "a", "n": 0}, {"topic": "b", "n": 1}])
    assert [o["outcome"] for o in out] == ["admitted", "refused", "resident", "admitted"] and out[3]["evicted"] == "a"
    out = run(steps.replay_ring(window=1), [{"rev": 2, "payload": "x", "ms": 1}, {"rev": 2, "payload": "y", "ms": 2}, {"rev": 1, "payload": "z", "ms": 3}])
    assert out == [{"rev": 1, "payload": "z"}]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, t) for u in range(5) for t in range(0, 400, 7 + u)]
    spark.createDataFrame(rows, "u long, ms long").repartition(3).write.parquet(str(tmp_path / "in"))
    schema, step = "u long, ms long, accepted boolean, retry_ms long", steps.rate_limit(rate=3, window_ms=60)
    batch = stateful.in_batch(spark.read.parquet(str(tmp_path / "in")), ["u"], ["ms"], step, schema)
    source = flows.change_source(spark, str(tmp_path / "in"), "u long, ms long")
    name = f"m{uuid.uuid4().hex}"
    q = stateful.in_stream(source, ["u"], ["ms"], step, schema).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert sorted(spark.table(name).collect()) == sorted(batch.collect())


def test_watch_never_misses(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    q = flows.watch(flows.change_source(spark, str(tmp_path / "in"), "id long"), lambda df, epoch: seen.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(seen) == 5


def test_metrics_and_resume(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)], "g string, v double")
    r = metrics.histogram_stats(df, ["g"], "v").first()
    assert (r["count"], r["p50"], r["p95"], r["mean"]) == (4, 2.0, 4.0, 2.5)
    peak = metrics.sliding_peak(spark.createDataFrame([("a", t) for t in (0, 99, 100)], "g string, ms long"), ["g"], "ms", 100).first()
    assert peak["peak"] == 2
    cls = lambda frm, tail="t", low=10: spark.range(1).select(changes.resume_class(F.lit(frm), F.lit(tail), F.lit("t"), F.lit(low).cast("int"), F.lit(3), F.lit(9))).first()[0]
    assert [cls(10), cls(9), cls(2), cls(10, "u"), cls(5, low=12), cls(5, low=None)] == ["backfill", "checkpoint_window", "out_of_window", "tail_rotated", "out_of_window", "out_of_window"]


@pytest.mark.parametrize("depth,expected", [(1, {1: 0, 2: 1}), (5, {1: 0, 2: 1, 3: 2})])
def test_cascade(spark, depth, expected):
    reads = spark.createDataFrame([(2, "b1", 1), (3, "b2", 2), (4, "b9", 1), (1, "b3", 3)], "action long, block string, rev long")
    writes = spark.createDataFrame([(1, "b1", 1), (2, "b2", 2), (3, "b3", 3)], "action long, block string, rev long")
    got = changes.cascade(reads, writes, spark.createDataFrame([(1,)], "action long"), depth)
    assert {r["action"]: r["depth"] for r in got.collect()} == expected


def test_cascade_goes_on_to_the_end_or_says_where_it_stopped(spark):
    n = 36
    writes = spark.createDataFrame([(i, "b", i) for i in range(n)], "action long, block string, rev long").cache()
    reads = writes.where(F.col("action") > 0).withColumn("rev", F.col("rev") - 1).cache()
    roots = spark.createDataFrame([(0,)], "action long")
    run = lambda **limits: sorted(tuple(r) for r in changes.cascade(reads, writes, roots, stage=lambda df: saved(df, "cascade"), **limits).collect())
    assert run() == run(max_depth=n - 1, max_transactions=n - 1) == [(i, i, None) for i in range(n)]
    assert run(max_depth=3) == [(i, i, "max-depth") for i in range(4)]
    assert run(max_transactions=3) == [(i, i, "max-transactions") for i in range(4)]
    named = [df.withColumn("collection", F.lit("c")) for df in (reads, writes)]
    assert changes.cascade(*named, roots, 2).count() == 3
    loop = named[0].unionByName(spark.createDataFrame([(1, "b", 2, "c")], "action long, block string, rev long, collection string"))
    with pytest.raises(ValueError, match="back edge: action 1 at revision 1 read b@2"):
        changes.cascade(loop, named[1], roots, stage=lambda df: saved(df, "cascade"))


def test_cascade_takes_its_reads_once(spark):
    """However many rounds: reads are dealt once, and are let go in the end."""
    n, seen = 6, spark.sparkContext.accumulator(0)
    writes = spark.createDataFrame([(i, "b", i) for i in range(n)], "action long, block string, rev long")

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    reads = writes.withColumn("rev", F.col("rev") - 1).mapInArrow(counted, writes.schema)
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    got = changes.cascade(reads, writes, spark.createDataFrame([(0,)], "action long"), stage=lambda df: saved(df, "cascade"))
    assert seen.value == n and len(spark.sparkContext._jsc.getPersistentRDDs()) == held
    assert sorted((r["action"], r["depth"]) for r in got.collect()) == [(i, i) for i in range(n)]


def test_depths_beyond_the_last_size_class(spark, tmp_path):
    """The query keeps to the classes of its SQL, the operators go on."""
    spark.createDataFrame([(2**k - 1 + d,) for k in range(2, 30) for d in (-1, 0, 1)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.QUERIES["start_and_tree_depth"](spark, str(tmp_path)).collect()
    duck = duckdb.sql(registry.ORACLES["start_and_tree_depth"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'"))
    assert sorted(tuple(r) for r in got) == sorted(duck.fetchall()) and len(got) == 84
    n = F.lit(2**24 + 1).cast("long")
    assert tuple(spark.range(1).select(matching.start_depth(n, F.lit(1.0)), matching.tree_depth(n, 64, 16)).first()) == (5, 5)


def test_growth_takes_one_count_of_an_instant(spark):
    """Whatever the order of the rows: the first by id of those that share the window's first instant, else the least count."""
    rows = [("g", 0, 1, 90), ("g", 0, 2, 10), ("g", 0, 3, 50), ("g", 1000, 4, 60)]
    run = lambda rows, **more: {r["id"]: (r["slope"], r["promotes"]) for r in metrics.growth_promotes(spark.createDataFrame(rows, "g string, ms long, id long, n long").coalesce(1), ["g"], "ms", "n", **more).collect()}
    for each in (rows, rows[::-1], rows[1:] + rows[:1]):
        assert run(each, ties=["id"]) == {1: (None, False), 2: (None, False), 3: (None, False), 4: (-0.03, False)}
        assert run(each)[4] == (0.05, True)


def test_resident_topics_takes_every_event_on_its_node(spark):
    sf = "/root/testdata/sf0.01"
    out = registry.QUERIES["resident_topics"](spark, sf)
    assert out.count() == registry.table(spark, sf, "events").count()
    assert out.groupBy("topic").agg(F.countDistinct("node").alias("n")).where("n > 1").count() == 0 and out.select("node").distinct().count() > 16


SF10 = "/root/testdata/sf0.01"


def in_order(spark, frame, key, order):
    rows = sorted((r.asDict() for r in frame.collect()), key=lambda r: [r[c] for c in order])
    groups = {}
    for r in rows:
        groups.setdefault(r[key], []).append(r)
    return groups


def test_hysteresis_query_equals_brute_force(spark):
    log = registry.table(spark, SF10, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("user_id") % 80).alias("n"))
    expected = []
    for kind, rows in in_order(spark, log, "event_type", ["ms", "n"]).items():
        up, since, low, seen = False, None, None, []
        for r in rows:
            seen.append((r["ms"], r["n"]))
            recent = [x for x in seen if x[0] >= r["ms"] - 10_000]
            low = None if r["n"] > 16 else (r["ms"] if low is None else low)
            span = recent[-1][0] - recent[0][0]
            trend = (recent[-1][1] - recent[0][1]) / span if span else 0.0
            if not up and (r["n"] >= 64 or (trend > 0 and r["n"] + trend * 30_000 >= 64)):
                up, since = True, r["ms"]
                expected.append((kind, r["ms"], "promote"))
            elif up and r["ms"] - since >= 60_000 and low is not None and r["ms"] - low >= 600_000:
                up, low = False, None
                expected.append((kind, r["ms"], "demote"))
    got = [(r["event_type"], r["ms"], r["event"]) for r in registry.QUERIES["promotion_hysteresis"](spark, SF10).collect()]
    assert sorted(got) == sorted(expected) and expected


def test_resident_query_equals_brute_force(spark):
    from lakeloom.functions import digest

    log = registry.table(spark, SF10, "events").select(F.col("user_id").cast("string").alias("topic"), "event_type", "event_id").withColumn("node", digest.hash_mod(F.encode("topic", "utf-8"), 8).cast("int"))
    expected = []
    for node, rows in in_order(spark, log, "node", ["event_id"]).items():
        held = []  # topics in order of touch, with participants
        for r in rows:
            n = 0 if r["event_type"] == "error" else 1
            old = next((x for x in held if x[0] == r["topic"]), None)
            if old:
                held.remove(old)
                expected.append((node, r["topic"], "resident", None))
            elif len(held) >= 100:
                gone = next((x for x in held if x[1] == 0), None)
                expected.append((node, r["topic"], "admitted" if gone else "refused", gone and gone[0]))
                if not gone:
                    continue
                held.remove(gone)
            else:
                expected.append((node, r["topic"], "admitted", None))
            held.append((r["topic"], n))
    got = [tuple(r[c] for c in ("node", "topic", "outcome", "evicted")) for r in registry.QUERIES["resident_topics"](spark, SF10).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_null_keys_keep_their_state_and_long_values_stay_exact(spark):
    rows = [(None, 1), (None, 2), (None, 3), (2**53 + 1, 2**53 + 1), (2**53 + 1, 2**53 + 2)]
    out = stateful.in_batch(spark.createDataFrame(rows, "k long, rev long"), ["k"], ["rev"], steps.contiguity(), "k long, rev long, outcome string, from_rev long, to_rev long").collect()
    assert sorted((r["rev"], r["k"], r["outcome"]) for r in out) == [(1, None, "adopted"), (2, None, "delivered"), (3, None, "delivered"), (2**53 + 1, 2**53 + 1, "adopted"), (2**53 + 2, 2**53 + 1, "delivered")]


def test_capped_keys_are_forgotten_and_swept():
    step = steps.capped(steps.rate_limit(rate=1, window_ms=10**9), "peer", cap=2, idle_ms=1000)
    state, seen = {}, []
    for peer, ms in (("a", 0), ("a", 1), ("b", 2), ("c", 3), ("a", 4), ("c", 5), ("c", 2000), ("c", 2001)):
        state, made = step(state, {"peer": peer, "ms": ms})
        seen += [(m["peer"], m["accepted"]) for m in made]
    # a is pushed out by c, so it starts anew; after a second without a touch c does as well
    assert seen == [("a", True), ("a", False), ("b", True), ("c", True), ("a", True), ("c", False), ("c", True), ("c", False)]
    assert list(state["held"]) == ["c"]


def test_transform_algebra(spark):
    blocks = spark.createDataFrame([("b", "x", ["1", "2", "3"]), ("c", "x", ["7"])], "block string, attribute string, items array<string>")
    ops = lambda rows: spark.createDataFrame(rows, "block string, kind string, attribute string, at int, removed int, added array<string>, ord long")
    show = lambda df: {(r["block"], r["attribute"]): r["items"] for r in df.collect()}
    first = ops([("b", "update", "x", 1, 1, ["p", "q"], 0), ("b", "update", "x", 99, 5, ["end"], 1), ("n", "insert", "y", None, None, ["new"], 2), ("n", "update", "y", 0, 0, ["0"], 3), ("gone", "update", "x", 0, 0, ["?"], 4)])
    assert show(changes.transformed(blocks, first, "ord")) == {("b", "x"): ["1", "p", "q", "3", "end"], ("c", "x"): ["7"], ("n", "y"): ["0", "new"]}
    second = ops([("b", "update", "x", 0, 1, [], 0), ("n", "delete", None, None, None, None, 1), ("c", "insert", "x", None, None, ["8"], 2)])
    one = changes.transformed(changes.transformed(blocks, first, "ord"), second, "ord")
    both = changes.transformed(blocks, changes.merged_operations(first, second, "ord"), "ord")
    assert show(one) == show(both) == {("b", "x"): ["p", "q", "3", "end"], ("c", "x"): ["8"]}


def test_tier_walk_and_churn(spark):
    states = spark.createDataFrame([(1, 3, False), (1, 2, False), (2, 1, True), (3, 9, False)], "k long, tier int, promoted boolean")
    got = {r["k"]: (r["tier"], r["hops"]) for r in matching.tier_walk(spark.range(1, 5).withColumnRenamed("id", "k"), states, "k", 3).collect()}
    assert got == {1: (3, 0), 2: (2, 3), 3: (0, 3), 4: (0, 3)}
    rows = [(p, r, 1000 * r, kind) for p, kinds in (("a", "offf"), ("b", "foff"), ("c", "ffff"), ("d", "fffd")) for r, kind in enumerate(kinds)]
    log = spark.createDataFrame(rows, "peer string, rev long, ms long, kind string")
    found = metrics.churn(log, "peer", "rev", "ms", F.col("kind") == "d", F.col("kind") == "f", 3500, alarm=3).collect()
    assert {r["peer"]: (r["departed"], r["unreachable"], r["partitioned"]) for r in found} == {"a": (False, True, True), "b": (False, False, True), "c": (False, True, True), "d": (True, False, True)}
