"""Registered queries: scans, predicates, joins, set operations, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.operators import scans
from lakeloom.registry import query, table

DAY = "TIMESTAMP '1998-09-02'"
ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query(f"SELECT {ORDERS} FROM orders")
def full_scan(spark, sf):
    return table(spark, sf, "orders").select(*ORDERS.split(", "))


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey = 77")
def pk_point_lookup(spark, sf):
    return scans.point_lookup(table(spark, sf, "orders"), {"o_orderkey": 77}).select(*ORDERS.split(", "))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1")
def composite_point_lookup(spark, sf):
    return scans.point_lookup(table(spark, sf, "conversations"), {"turn": 1, "conv_id": 3}).select("conv_id", "turn", "role")


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey = NULL")
def null_key_lookup(spark, sf):
    return scans.point_lookup(table(spark, sf, "orders"), {"o_orderkey": None}).select(*ORDERS.split(", "))


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey BETWEEN 100 AND 250")
def pk_range_scan(spark, sf):
    return scans.range_scan(table(spark, sf, "orders"), "o_orderkey", 100, 250).select(*ORDERS.split(", "))


@query("SELECT o_orderkey FROM orders WHERE o_custkey > 10 AND o_custkey < 20")
def index_range_scan(spark, sf):
    return scans.range_scan(table(spark, sf, "orders"), "o_custkey", 10, 20, low_open=True, high_open=True, ascending=False).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_suppkey = 7")
def index_prefix_seek(spark, sf):
    items = table(spark, sf, "lineitem")
    return scans.prefix_seek(items, ["l_returnflag", "l_linestatus", "l_suppkey"], ["R", "F", 7, "surplus"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT count(*) AS n FROM lineitem")
def index_whole(spark, sf):
    return scans.prefix_seek(table(spark, sf, "lineitem"), ["l_suppkey"], []).agg(F.count("*").alias("n"))


@query(f"SELECT {ORDERS} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def index_nested_lookup(spark, sf):
    orders = table(spark, sf, "orders")
    entries = scans.index_entries(orders, ["o_custkey"], ["o_orderkey"])
    wanted = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return scans.index_lookup(orders, entries.join(wanted, "o_custkey", "left_semi"), ["o_orderkey"]).select(*ORDERS.split(", "))


@query("""SELECT (SELECT min(o_orderkey) FROM orders) AS first_key, (SELECT max(o_orderkey) FROM orders) AS last_key,
  (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 500) AS prior, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey = 500) AS found,
  (SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 500) AS next""")
def cursor_moves(spark, sf):
    orders = table(spark, sf, "orders")
    ends = orders.agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
    return ends.join(scans.neighbours(orders, "o_orderkey", 500), F.lit(True))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def last_row(spark, sf):
    return scans.edge(table(spark, sf, "orders"), "o_orderkey", last=True).select("o_orderkey", "o_totalprice")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey >= 500) AS up, (SELECT count(*) FROM orders WHERE o_orderkey <= 500) AS down")
def count_from_position(spark, sf):
    orders = table(spark, sf, "orders")
    up, down = (scans.count_from(orders, "o_orderkey", 500, a).withColumnRenamed("n", n) for a, n in ((True, "up"), (False, "down")))
    return up.join(down, F.lit(True))


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def diary_select(spark, sf):
    return table(spark, sf, "conversations").orderBy(F.desc("conv_id"), F.desc("turn")).select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query("SELECT user_id, rev, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev FROM events) WHERE rev > 40")
def log_read_since(spark, sf):
    return scans.read_since(revisions(spark, sf), "rev", 40).select("user_id", "rev", "event_id")


@query("SELECT user_id, rev, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev FROM events) WHERE rev BETWEEN 5 AND 9")
def revision_list(spark, sf):
    return scans.revisions_between(revisions(spark, sf), "rev", 9, 5).select("user_id", "rev", "event_id")


@query("""SELECT user_id, max(rev) AS rev, arg_max(event_id, rev) AS event_id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev FROM events) WHERE event_type = 'error' AND rev > 3 GROUP BY user_id""")
def last_invalidation(spark, sf):
    log = scans.read_since(revisions(spark, sf), "rev", 3, ascending=False).where("event_type = 'error'")
    return log.groupBy("user_id").agg(F.max("rev").alias("rev"), F.max_by("event_id", "rev").alias("event_id"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey <= 8000)
SELECT o_custkey, o_orderkey AS rev, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM c) WHERE n = 1 AND o_orderstatus <> 'F'""")
def block_as_of(spark, sf):
    changes = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("rev"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("deleted"))
    return scans.as_of(changes, ["o_custkey"], "rev", 8000, "deleted")


@query("""SELECT ids.id AS c_custkey, c_name, CASE WHEN c_custkey IS NULL THEN 'absent' ELSE 'present' END AS status
FROM (SELECT DISTINCT o_custkey * 2 AS id FROM orders) ids LEFT JOIN customer ON c_custkey = ids.id""")
def pinned_batch_get(spark, sf):
    ids = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"))
    return scans.pinned_get(table(spark, sf, "customer").select("c_custkey", "c_name"), ids, "c_custkey")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(id, v) WHERE id >= 2")
def values_and_parameters(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(id, v) WHERE id >= :low", args={"low": 2})


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'O' AND o_orderpriority LIKE '1%'")
def filter_project_like(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 400000 AND o_orderstatus = 'O' AND o_orderpriority LIKE '1%'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))


@query("SELECT d.doc_id, quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality = 0")
def is_null_predicate(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.where("quality IS NULL OR quality = 0").select("doc_id", F.col("quality").isNull().alias("unlabelled"))


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT coalesce(l_quantity <= 49 AND l_discount >= 0, true)")
def check_violations(spark, sf):
    from lakeloom.operators.dml import check_failures
    from lakeloom.sources.tables import TableDef

    lines = TableDef("lines", [("l_orderkey", "INTEGER", False), ("l_linenumber", "INTEGER", False)], ["l_orderkey"], checks=["new.l_quantity <= 49", "new.l_discount >= 0"])
    return check_failures(table(spark, sf, "lineitem"), lines, "INSERT").select("l_orderkey", "l_linenumber", "l_quantity").distinct()


@query("SELECT event_id FROM events WHERE epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-15') > 900000")
def ttl_stale(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").where(ms - F.unix_millis(F.lit("2024-01-15").cast("timestamp")) > 900_000).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 3600 SECONDS AND ts <= TIMESTAMP '2024-01-15' + INTERVAL 5 SECONDS")
def timestamp_admission(spark, sf):
    from lakeloom.streaming.flows import admitted

    return table(spark, sf, "events").where(admitted(F.col("ts"), F.lit("2024-01-15").cast("timestamp"), max_age_s=3600)).select("event_id")


@query("SELECT DISTINCT c.c_custkey, c.c_name FROM customer c JOIN (SELECT s_name, s_nationkey FROM supplier) s ON c.c_nationkey = s.s_nationkey")
def unique_probe(spark, sf):
    from lakeloom.operators.dml import collisions

    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return collisions(table(spark, sf, "customer"), rows, ["c_nationkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def insert_if_absent(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey, coalesce((SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), 0) + 1 AS next_line FROM orders")
def correlated_max(spark, sf):
    for name in ("orders", "lineitem"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql("SELECT o_orderkey, coalesce((SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), 0) + 1 AS next_line FROM orders")


@query("SELECT r_regionkey, (SELECT count(*) FROM nation) <= 25 AS small FROM region")
def scalar_subquery(spark, sf):
    for name in ("region", "nation"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql("SELECT r_regionkey, (SELECT count(*) FROM nation) <= 25 AS small FROM region")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_suppkey = o_custkey GROUP BY ALL")
def two_key_match(spark, sf):
    a, b = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return a.join(b, (a.l_orderkey == b.o_orderkey) & (a.l_suppkey == b.o_custkey)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT id, min(src) AS src FROM (SELECT o_custkey AS id, 'a' AS src FROM orders UNION ALL SELECT c_custkey, 'b' FROM customer) GROUP BY id")
def union_first_wins(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("a").alias("src"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("b").alias("src"))
    return a.unionByName(b).groupBy("id").agg(F.min("src").alias("src"))


@query("""SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def outer_join_counts(spark, sf):
    n, r, c = (table(spark, sf, t) for t in ("nation", "region", "customer"))
    return n.join(r, n.n_regionkey == r.r_regionkey).join(c, c.c_nationkey == n.n_nationkey, "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"))


@query("""SELECT o_orderkey, event_id FROM (SELECT o_orderkey, o_orderdate, o_custkey % 150 AS u FROM orders) o
ASOF LEFT JOIN (SELECT event_id, user_id, ts - INTERVAL 9000 DAYS + INTERVAL 7000 DAYS AS at FROM events) e ON o.u = e.user_id AND o.o_orderdate >= e.at""")
def as_of_join(spark, sf):
    """As-of by one sort: both sides in a union, the last right row so far carried along."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("u"), F.col("o_orderdate").cast("timestamp").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("event_id"))
    e = table(spark, sf, "events").select(F.lit(None).cast("long").alias("o_orderkey"), F.col("user_id").alias("u"), (F.col("ts").cast("timestamp") - F.expr("INTERVAL 2000 DAYS")).alias("at"), F.lit(0).alias("side"), "event_id")
    w = Window.partitionBy("u").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = o.unionByName(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(w))
    return both.where("side = 1").select("o_orderkey", "event_id")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def order_limit(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_retailprice")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedupe_last_wins(spark, sf):
    return scans.last_per_key(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedupe_first_wins(spark, sf):
    return scans.first_per_key(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "ts")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def set_operations(spark, sf):
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey")).subtract(n.where("n_regionkey = 2").select("n_nationkey"))


@query("""SELECT n_nationkey, list_aggregate(list_sort(list(DISTINCT p)), 'string_agg', ',') AS missing FROM (
  SELECT n_nationkey, unnest(['ECONOMY','SMALL','MEDIUM','PROMO','STANDARD','LARGE']) AS p FROM nation) x
  WHERE NOT EXISTS (SELECT 1 FROM supplier JOIN part ON p_partkey % 100 = s_suppkey WHERE s_nationkey = n_nationkey AND p_type = p AND p_size < 4) GROUP BY n_nationkey""")
def tag_difference(spark, sf):
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    have = s.join(p, (F.col("p_partkey") % 100 == F.col("s_suppkey")) & (F.col("p_size") < 4)).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_set("p_type").alias("have"))
    need = F.array(*map(F.lit, ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")))
    joined = table(spark, sf, "nation").join(have, "n_nationkey", "left")
    missing = F.array_sort(F.array_except(need, F.coalesce("have", F.array().cast("array<string>"))))
    return joined.select("n_nationkey", F.array_join(missing, ",").alias("missing")).where("missing != ''")


@query("""SELECT c_nationkey, c_mktsegment, grouping(c_nationkey) AS g1, grouping(c_mktsegment) AS g2, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment) HAVING count(*) > 2""")
def rollup_having(spark, sf):
    grouped = table(spark, sf, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.grouping("c_nationkey").cast("long").alias("g1"), F.grouping("c_mktsegment").cast("long").alias("g2"), F.count("*").alias("n"))
    return grouped.where("n > 2")


@query("""WITH RECURSIVE t(k, depth) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT k * 2, depth + 1 FROM t WHERE k * 2 <= 1000)
SELECT k, depth, count(o_orderkey) AS orders FROM t LEFT JOIN orders ON o_custkey = k GROUP BY ALL""")
def recursive_closure(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("WITH RECURSIVE t(k, depth) AS (SELECT 1L, 0L UNION ALL SELECT k * 2, depth + 1 FROM t WHERE k * 2 <= 1000) SELECT k, depth, count(o_orderkey) AS orders FROM t LEFT JOIN orders ON o_custkey = k GROUP BY k, depth")


def revisions(spark, sf):
    """The event log with a revision per user."""
    return table(spark, sf, "events").withColumn("rev", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


@query("""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev FROM events), c AS (SELECT user_id, max(rev) AS newest FROM l WHERE rev % 8 = 0 GROUP BY user_id)
SELECT user_id, event_id AS action, rev FROM l LEFT JOIN c USING (user_id) WHERE rev % 8 <> 0 AND event_type <> 'error' AND (newest IS NULL OR rev > newest)
UNION ALL SELECT user_id, event_id, rev FROM l JOIN c USING (user_id) WHERE rev IN (newest - 1, newest - 2)""")
def log_pending_context(spark, sf):
    """Every eighth entry is a checkpoint that carries the two before it; errors are no actions."""
    log = revisions(spark, sf).select("user_id", "rev", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("rev")
    carried = F.array(*[F.struct(F.lag("event_id", i).over(w).alias("action"), (F.col("rev") - i).alias("rev")) for i in (1, 2)])
    point = F.col("rev") % 8 == 0
    log = log.withColumn("pendings", F.when(point, carried)).withColumn("action", F.when(~point & (F.col("event_type") != "error"), F.col("event_id")))
    return scans.pending_context(log, ["user_id"], "rev")


@query("""SELECT c_custkey AS o_custkey, rev, o_totalprice, CASE WHEN rev IS NOT NULL THEN 'present' WHEN c_nationkey < 9 THEN 'unavailable' ELSE 'absent' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS rev, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderkey <= 700 GROUP BY o_custkey) ON c_custkey = o_custkey""")
def pinned_at_revision(spark, sf):
    """Orders are the revisions of a customer; customers of some nations could not be asked."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    blocks = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("rev"), "o_totalprice")
    return scans.pinned_get(blocks, customers, "o_custkey", "rev", 700, customers.where("c_nationkey < 9"))
