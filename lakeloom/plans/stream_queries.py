"""Registered queries: stateful change-stream operators, as batches over the log, and streams over its files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.functions import digest
from lakeloom.plans.scan_queries import revisions
from lakeloom.registry import query, table
from lakeloom.sources.scratch import shared_dir
from lakeloom.streaming import flows, stateful, steps

MS = "(epoch_us(ts) // 1000)"
REVS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev FROM events"


def timed(spark, sf):
    return revisions(spark, sf).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


LATE = f"rev <= (SELECT max(rev) FROM ({REVS}) x WHERE x.user_id = r.user_id) - 8"


def repeated(spark, sf):
    """Every event twice in a row, and once more after all of the log."""
    log = timed(spark, sf).select("user_id", "rev", F.md5("props").alias("mark"), F.explode(F.array(*map(F.lit, range(3)))).alias("copy"))
    return log.withColumn("late", F.col("copy") == 2)


@query(f"SELECT user_id, rev, md5(props) AS mark FROM ({REVS}) UNION ALL SELECT user_id, rev, md5(props) FROM ({REVS}) r WHERE {LATE}")
def notification_dedupe(spark, sf):
    """The second copies are dropped, and the late ones of the last eight revisions; older ones are forgotten and pass again."""
    return stateful.in_batch(repeated(spark, sf), ["user_id"], ["late", "rev", "copy"], steps.dedupe(window=8), "user_id long, rev long, mark string")


@query(f"""WITH l AS (SELECT user_id, rev FROM ({REVS}) WHERE event_type <> 'error' OR rev < 4), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rev) AS n, min(rev) OVER (PARTITION BY user_id) AS f FROM l),
w AS (SELECT *, rev - f + 1 = n AS run FROM m)
SELECT user_id, rev, CASE WHEN n = 1 THEN 'adopted' WHEN run THEN 'delivered' ELSE 'gap' END AS outcome,
 CASE WHEN NOT run THEN (SELECT max(rev) + 1 FROM w x WHERE x.user_id = w.user_id AND x.run) END AS from_rev, CASE WHEN NOT run THEN rev END AS to_rev FROM w""")
def subscriber_contiguity(spark, sf):
    log = timed(spark, sf).where("event_type != 'error' OR rev < 4").select("user_id", "rev")
    return stateful.in_batch(log, ["user_id"], ["rev"], steps.contiguity(), "user_id long, rev long, outcome string, from_rev long, to_rev long")


def rate_sql(rate: int, window: int) -> str:
    """Greedy acceptance: the state is the list of the last `rate` accepted times, and the rejections since."""
    live = f"list_filter(r.acc, lambda t: t > e.ms - {window})"
    strikes = f"CASE WHEN len({live}) > 0 THEN r.strikes ELSE 0 END"
    ok = f"len({live}) < {rate}"
    return f"""WITH RECURSIVE e AS (SELECT user_id, {MS} AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev FROM events),
r(user_id, rev, ms, acc, ok, strikes, wait) AS (SELECT user_id, rev, ms, [ms], true, 0, CAST(0 AS BIGINT) FROM e WHERE rev = 1 UNION ALL
 SELECT e.user_id, e.rev, e.ms, CASE WHEN {ok} THEN list_append({live}, e.ms) ELSE {live} END, {ok}, CASE WHEN {ok} THEN 0 ELSE {strikes} + 1 END,
  CASE WHEN {ok} THEN 0 ELSE CAST(least(1000 * pow(2.0, {strikes}), 60000) AS BIGINT) END FROM r JOIN e ON e.user_id = r.user_id AND e.rev = r.rev + 1)
SELECT user_id, ms, ok AS accepted, wait AS retry_ms FROM r"""


@query(rate_sql(4, 300_000_000))
def rate_limiter(spark, sf):
    return stateful.in_batch(timed(spark, sf).select("user_id", "ms", "rev"), ["user_id"], ["rev"], steps.rate_limit(rate=4, window_ms=300_000_000), "user_id long, ms long, accepted boolean, retry_ms long")


@query()
def promotion_hysteresis(spark, sf):
    log = timed(spark, sf).select("event_type", "ms", (F.col("user_id") % 80).alias("n"))
    return stateful.in_batch(log, ["event_type"], ["ms", "n"], steps.hysteresis(low_ms=600_000, sticky_ms=60_000), "event_type string, ms long, event string")


QUEUE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, rev, event_id AS item, CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS drain FROM ({REVS})),
q(user_id, rev, queue, gone, outcome) AS (SELECT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), '' FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT e.user_id, e.rev, CASE WHEN drain > 0 THEN q.queue[3:] WHEN len(q.queue) = 8 THEN list_append(q.queue[2:], e.item) ELSE list_append(q.queue, e.item) END,
  CASE WHEN drain > 0 THEN q.queue[:2] WHEN len(q.queue) = 8 THEN q.queue[:1] ELSE CAST([] AS BIGINT[]) END, CASE WHEN drain > 0 THEN 'delivered' ELSE 'dropped' END FROM q JOIN e ON e.user_id = q.user_id AND e.rev = q.rev + 1)
SELECT user_id, unnest(gone) AS item, outcome FROM q"""


@query(QUEUE_SQL)
def bounded_queue(spark, sf):
    log = timed(spark, sf).select("user_id", "rev", F.col("event_id").alias("item"), F.when(F.col("event_type") == "purchase", 2).otherwise(0).alias("drain"))
    return stateful.in_batch(log, ["user_id"], ["rev"], steps.bounded_queue(depth=8), "user_id long, item long, outcome string")


@query(f"SELECT user_id, rev, event_type AS payload FROM ({REVS}) r WHERE rev <= (SELECT max(rev) FROM ({REVS}) x WHERE x.user_id = r.user_id) - 32")
def ring_retirement(spark, sf):
    log = timed(spark, sf).select("user_id", "rev", "ms", F.col("event_type").alias("payload"))
    return stateful.in_batch(log, ["user_id"], ["rev"], steps.replay_ring(window=32), "user_id long, rev long, payload string")


@query(f"SELECT user_id, rev, md5(props) AS mark, true AS advances FROM ({REVS}) UNION ALL SELECT user_id, rev, md5(props), false FROM ({REVS}) r WHERE {LATE}")
def forwarder_pipeline(spark, sf):
    """Late copies that pass again do not advance."""
    return stateful.in_batch(repeated(spark, sf), ["user_id"], ["late", "rev", "copy"], steps.forwarder(window=8), "user_id long, rev long, mark string, advances boolean")


@query(f"""SELECT user_id, rev, CASE WHEN rev % 10 = 0 AND rev = o THEN 'rebaselined' WHEN rev % 10 = 0 THEN 'ignored' WHEN rev < 10 AND rev = f THEN 'adopted' ELSE 'delivered' END AS outcome
FROM (SELECT user_id, rev, unnest(CASE WHEN rev % 10 = 0 THEN [rev, -1] ELSE [rev] END) AS o, min(rev) OVER (PARTITION BY user_id) AS f FROM ({REVS}) WHERE rev % 10 NOT IN (8, 9))""")
def subscriber_rebaseline(spark, sf):
    """Two revisions of ten are missing; every tenth is a new baseline, told twice: the second one is not ahead."""
    log = timed(spark, sf).where("rev % 10 NOT IN (8, 9)").select("user_id", "rev", (F.col("rev") % 10 == 0).alias("base"))
    twice = log.withColumn("copy", F.explode(F.when(F.col("base"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    found = stateful.in_batch(twice, ["user_id"], ["rev", "copy"], steps.contiguity(rebase="base"), "user_id long, rev long, outcome string, from_rev long, to_rev long")
    return found.select("user_id", "rev", "outcome")


@query()
def resident_topics(spark, sf):
    """Topics live on the node that their hash names, each with its own cap."""
    topic = F.col("user_id").cast("string")
    log = table(spark, sf, "events").select(digest.hash_mod(F.encode(topic, "utf-8"), 8).cast("int").alias("node"), topic.alias("topic"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("n"), "event_id")
    return stateful.in_batch(log, ["node"], ["event_id"], steps.resident(cap=100), "node int, topic string, outcome string, evicted string")


@query("SELECT event_id, sha256(props) AS digest, CASE WHEN strlen(props) <= 8 THEN props END AS delta FROM events")
def notification_origin(spark, sf):
    return flows.notifications(table(spark, sf, "events"), "props", 8).select("event_id", "digest", "delta")


def _drained(spark, df, name: str):
    """Run a stream to its end into a Parquet folder and give what it wrote."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def _events(spark, sf):
    one = table(spark, sf, "events")
    return spark.readStream.schema(one.schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf}/").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id FROM events")
def stream_replay_guard(spark, sf):
    twice = _events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return _drained(spark, flows.replay_guard(twice, "ts", "event_id").select("event_id", "user_id"), "guard")


@query(rate_sql(4, 300_000_000))
def stream_rate_limiter(spark, sf):
    """The same step as the batch form, with state between micro-batches."""
    e = _events(spark, sf).withColumn("ms", F.unix_millis("ts")).select("user_id", "ms")
    limited = stateful.in_stream(e, ["user_id"], ["ms"], steps.rate_limit(rate=4, window_ms=300_000_000), "user_id long, ms long, accepted boolean, retry_ms long")
    return _drained(spark, limited, "limit")


@query("""SELECT start, start + INTERVAL 1 DAY AS end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) FOR k IN range(0, 4)]) AS start FROM events)
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_arrival_rates(spark, sf):
    """Windows that the watermark has closed by the end."""
    return _drained(spark, flows.arrival_rates(_events(spark, sf), "ts", "event_type", "1 day", "6 hours", "1 hour"), "rates")


@query("SELECT event_id, user_id FROM events WHERE event_id % 90 BETWEEN 7 AND 72")
def stream_replay_admission(spark, sf):
    """Events that arrive from 12 seconds before their own time to 77 after it: those too old or too far ahead are dropped."""
    late = _events(spark, sf).withColumn("received", F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 90 - 12) * 1_000_000))
    twice = late.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return _drained(spark, flows.replay_guard(twice, "ts", "event_id", received="received").select("event_id", "user_id"), "admission")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 1 DAY, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 1 DAY AS end, user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed by the end."""
    return _drained(spark, flows.sessions(_events(spark, sf), "ts", "user_id", "1 day", "1 hour"), "sessions")


@query("""SELECT a.event_id, a.user_id, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY""")
def stream_followed(spark, sf):
    """Views and the purchases of the same user within a day, from two streams."""
    views = _events(spark, sf).where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = _events(spark, sf).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("ts").alias("bought_ts"))
    return _drained(spark, flows.followed(views, bought, "user_id", "ts", "bought_ts", "1 day", "1 hour").select("event_id", "user_id", "bought"), "followed")
