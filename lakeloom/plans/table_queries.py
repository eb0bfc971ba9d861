"""Registered queries: keyed tables, writes with conflict actions, versions, transactions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.operators import dml
from lakeloom.operators.txn import Transaction
from lakeloom.registry import query, table
from lakeloom.sources import formats
from lakeloom.sources.scratch import shared_dir
from lakeloom.sources.tables import Store, TableDef, Unique

LINES = TableDef("lines", [("l_orderkey", "INTEGER", False), ("l_linenumber", "INTEGER", False), ("l_quantity", "REAL", True)], ["l_orderkey", "l_linenumber"])
ORDINAL = "l_partkey * 1000000 + l_suppkey * 10000 + CAST(l_quantity * 100 AS BIGINT)"
BASE = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, min(l_quantity) AS l_quantity FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL"
DELTA = f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, row_number() OVER (ORDER BY {ORDINAL}, l_extendedprice, l_orderkey, l_linenumber) AS ord FROM lineitem WHERE l_orderkey % 2 = 0"


def lines(spark, sf):
    items = table(spark, sf, "lineitem")
    base = items.where("l_orderkey % 3 = 0").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.min("l_quantity").alias("l_quantity"))
    order = F.struct(F.expr(ORDINAL), "l_extendedprice", "l_orderkey", "l_linenumber")
    delta = items.where("l_orderkey % 2 = 0").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity", order.alias("ord"))
    return base, delta


@query(f"WITH b AS ({BASE}), d AS ({DELTA}) SELECT * FROM b UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ord) AS n FROM d) x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = x.l_orderkey AND b.l_linenumber = x.l_linenumber)")
def insert_or_ignore(spark, sf):
    base, delta = lines(spark, sf)
    return dml.insert(base, delta, LINES, "ord", "IGNORE")


@query(f"WITH b AS ({BASE}), d AS ({DELTA}), l AS (SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ord DESC) AS n FROM d) WHERE n = 1) SELECT * FROM l UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber)")
def insert_or_replace(spark, sf):
    base, delta = lines(spark, sf)
    return dml.insert(base, delta, LINES, "ord", "REPLACE")


@query("SELECT 'ABORT' AS action, 'UNIQUE constraint failed: lines.l_orderkey, lines.l_linenumber' AS message")
def insert_or_abort(spark, sf):
    base, delta = lines(spark, sf)
    try:
        dml.insert(base, delta, LINES, "ord")
        message = None
    except dml.ConstraintError as e:
        message = str(e)
    return spark.createDataFrame([("ABORT", message)], "action string, message string")


@query(f"WITH b AS ({BASE}), d AS ({DELTA}), l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM d GROUP BY ALL) SELECT coalesce(b.l_orderkey, l.l_orderkey) AS l_orderkey, coalesce(b.l_linenumber, l.l_linenumber) AS l_linenumber, CASE WHEN b.l_orderkey IS NULL THEN q WHEN l.l_orderkey IS NULL THEN l_quantity ELSE l_quantity + q END AS l_quantity FROM b FULL JOIN l ON b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber")
def upsert_do_update(spark, sf):
    base, delta = lines(spark, sf)
    return dml.upsert(base, delta, ["l_orderkey", "l_linenumber"], {"l_quantity": lambda old, new: old + new}, "ord")


@query(f"WITH b AS ({BASE}), d AS ({DELTA}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ord DESC) AS n FROM d) WHERE n = 1) SELECT l_orderkey, l_linenumber, l_quantity FROM l WHERE l_quantity > 25 UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber)")
def tree_batch_merge(spark, sf):
    base, delta = lines(spark, sf)
    return dml.merge_batch(base, delta.withColumn("gone", F.col("l_quantity") <= 25), ["l_orderkey", "l_linenumber"], "ord", "gone")


@query(f"WITH b AS ({BASE}) SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM b WHERE l_quantity < 40")
def update_delete_where(spark, sf):
    base, _ = lines(spark, sf)
    kept = dml.delete_where(base, F.col("l_quantity") >= 40)
    return dml.update_where(kept, F.col("l_quantity") < 10, {"l_quantity": F.col("l_quantity") + 1}, LINES)


CUSTOMERS = TableDef("customers", [("id", "INTEGER", False), ("tag", "TEXT", True)], ["id"], unique=[Unique(["tag"])])


@query("""WITH RECURSIVE d AS (SELECT event_id AS id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE 't' || (user_id % 60) END AS tag FROM events)
SELECT id, tag FROM (SELECT id, tag, row_number() OVER (PARTITION BY tag ORDER BY id DESC) AS n FROM d) WHERE n = 1 OR tag IS NULL""")
def unique_replace_chain(spark, sf):
    """INSERT OR REPLACE with a second UNIQUE set: of each tag the last row stays, null tags all stay."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("t"), (F.col("user_id") % 60).cast("string"))).alias("tag"), F.col("event_id").alias("ord"))
    base = spark.createDataFrame([], CUSTOMERS.schema())
    return dml.insert(base, rows, CUSTOMERS, "ord", "REPLACE")


@query("""SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 100000 ELSE c_custkey END AS id, c_name AS tag FROM customer""")
def update_moves_key(spark, sf):
    """The greatest key moves first: beyond 100,000 customers a key moves to where another has just left."""
    c = table(spark, sf, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("tag"))
    moves = base.where("id % 5 = 0").select(F.col("id").alias("old_id"), (F.col("id") + 100000).alias("id"), "tag", (-F.col("id")).alias("ord"))
    return dml.update(base, moves, CUSTOMERS, "ord")


def _store(spark):
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


NATIONS = TableDef("nations", [("id", "INTEGER", False), ("name", "TEXT", False), ("region", "INTEGER", True)], ["id"], checks=["new.id >= 0"], defaults={"name": "concat('N', context_tenant)"}, indexes={"by_region": ["region"]})


@query("""SELECT 'v1' AS at, n_nationkey AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation UNION ALL
SELECT 'v2', n_nationkey, n_name, CAST(n_regionkey AS BIGINT) FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'v2', 100, 'N7', 9""")
def committed_versions(spark, sf):
    """Two transactions, and both versions read at their heads."""
    store = _store(spark)
    store.create(NATIONS)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    first = Transaction(store)
    first.insert("nations", n.withColumn("ord", F.col("id")), "ord")
    one = first.commit()
    second = Transaction(store)
    second.delete("nations", n.where("region = 1").select("id"))
    second.savepoint("s")
    second.delete("nations", n.select("id"))
    second.rollback_to("s")
    second.insert("nations", spark.range(100, 101).select("id", F.lit(9).cast("long").alias("region"), F.col("id").alias("ord")), "ord", context={"tenant": "7"})
    two = second.commit()
    return store.read("nations", one).withColumn("at", F.lit("v1")).unionByName(store.read("nations", two).withColumn("at", F.lit("v2")))


@query("SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def diary_append(spark, sf):
    """A table that grows by appends alone: three parts, each written once."""
    store = _store(spark)
    store.create(NATIONS)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    for i in range(3):
        head = store.append("nations", n.where(F.col("id") % 3 == i))
    return store.read("nations", head)


@query("SELECT 'delete' AS op, n_nationkey AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'update', n_nationkey FROM nation WHERE n_regionkey = 2")
def version_changes(spark, sf):
    store = _store(spark)
    store.create(NATIONS)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    one = store.commit(store.head(), {"nations": n})
    two = store.commit(one, {"nations": n.where("region != 1").withColumn("name", F.when(F.col("region") == 2, F.lit("moved")).otherwise(F.col("name")))})
    return store.changes("nations", ["id"], one, two).select("op", "id")


@query("SELECT * FROM (VALUES ('index', 'by_region', 'nations'), ('table', 'nations', 'nations')) t(type, name, tbl_name)")
def schema_catalog(spark, sf):
    store = _store(spark)
    store.apply_schema([NATIONS])
    assert store.apply_schema([NATIONS]) == []
    return store.schema_view().select("type", "name", "tbl_name")


@query("SELECT r_regionkey, r_name FROM region")
def json_rows(spark, sf):
    r = table(spark, sf, "region")
    return formats.decode_rows(formats.encode_rows(r, ["r_regionkey"]), r.schema)


@query("SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS rev, CASE WHEN bool_or(l_orderkey % 2 = 0) THEN 'own' ELSE 'archive' END AS src FROM lineitem GROUP BY ALL")
def archive_restore(spark, sf):
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("rev")).distinct()
    return formats.restore_archive(keys.where("id % 2 = 0").withColumn("src", F.lit("own")), keys.withColumn("src", F.lit("archive")), ["id"], "rev")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://blog.')")
def key_prefix_list(spark, sf):
    return formats.keys_with_prefix(table(spark, sf, "pages"), "url", "https://blog.").select("page_id")
