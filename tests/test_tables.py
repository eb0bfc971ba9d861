from __future__ import annotations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom import registry
from lakeloom.operators import changes, dml, scans, txn
from lakeloom.operators.txn import Transaction
from lakeloom.sources import formats
from lakeloom.sources.tables import SchemaConflict, StaleHead, Store, TableDef, Unique

T = TableDef("t", [("id", "INTEGER", True), ("a", "TEXT", True), ("b", "INTEGER", True)], ["id"], unique=[Unique(["a"]), Unique(["b"], "IGNORE")])
ROW = "id long, a string, b long"


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, ROW + extra)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("id", "a", "b")) for r in df.collect()), key=repr)


def model(base, delta, sets, actions):
    """One row after the other: the list of rows, or the failed columns."""
    kept = list(base)
    for row in delta:
        evicted, fate = [], None
        for i, (col, null_equal) in enumerate(sets):
            if row[col] is None and not null_equal:
                continue
            hit = next((r for r in kept if r not in evicted and r[col] == row[col]), None)
            if hit is None:
                continue
            if actions[i] == "REPLACE":
                evicted.append(hit)
            else:
                fate = actions[i]
                break
        if fate == "IGNORE":
            continue
        if fate:
            return None
        kept = [r for r in kept if r not in evicted] + [row]
    return sorted(kept, key=repr)


small = st.tuples(st.integers(0, 5) | st.none(), st.sampled_from("xyz") | st.none(), st.integers(0, 3) | st.none())


@settings(max_examples=8, deadline=None)
@given(st.lists(small, max_size=6), st.sampled_from([None, "REPLACE", "IGNORE"]), st.sampled_from(["REPLACE", "IGNORE", "ABORT"]))
def test_insert_follows_the_sequential_model(spark, delta, statement, declared):
    table = TableDef("t", T.columns, ["id"], declared, [Unique(["a"], declared), Unique(["b"], "IGNORE")])
    actions = [dml.resolve_action(statement, d) for d in (declared, declared, "IGNORE")]
    base = [(0, "x", 0), (9, None, None)]
    expected = model(base, delta, [(0, True), (1, False), (2, False)], actions)
    new = frame(spark, [(*r, i) for i, r in enumerate(delta)], ", ord long")
    if expected is None:
        with pytest.raises(Exception, match="UNIQUE constraint failed"):
            dml.insert(frame(spark, base), new, table, "ord", statement).collect()
    else:
        assert rows_of(dml.insert(frame(spark, base), new, table, "ord", statement)) == expected


def test_key_only_conflicts(spark):
    plain = TableDef("t", T.columns, ["id"])
    base = frame(spark, [(1, "x", 1), (None, "n", 0)])
    new = frame(spark, [(1, "y", 2, 0), (2, "z", 3, 1), (2, "w", 4, 2), (None, "m", 5, 3)], ", ord long")
    assert rows_of(dml.insert(base, new, plain, "ord", "IGNORE")) == sorted([(1, "x", 1), (None, "n", 0), (2, "z", 3)], key=repr)
    assert rows_of(dml.insert(base, new, plain, "ord", "REPLACE")) == sorted([(1, "y", 2), (2, "w", 4), (None, "m", 5)], key=repr)
    for rows in (new, new.where("id = 2")):
        with pytest.raises(dml.ConstraintError, match="t.id"):
            dml.insert(base, rows, plain, "ord")


def test_key_moves(spark):
    table = TableDef("t", T.columns, ["id"])
    base = frame(spark, [(1, "x", 1), (2, "y", 2)])
    shift = frame(spark, [(2, "x", 1, 1, 0), (3, "y", 2, 2, 1)], ", old_id long, ord long")
    with pytest.raises(Exception, match="UNIQUE"):
        dml.update(base, shift, table, "ord").collect()
    back = shift.withColumn("ord", -F.col("ord"))
    assert rows_of(dml.update(base, back, table, "ord")) == [(2, "x", 1), (3, "y", 2)]
    assert rows_of(dml.update(base, shift.where("old_id = 1"), table, "ord", "REPLACE")) == [(2, "x", 1)]
    assert rows_of(dml.update(base, shift.where("old_id = 1"), table, "ord", "IGNORE")) == [(1, "x", 1), (2, "y", 2)]


def test_moved_rows_keep_their_values(spark):
    """A value that a row had before it moved is not held against it; one that it takes is."""
    table = TableDef("t", T.columns, ["id"], unique=[Unique(["a"])])
    base = frame(spark, [(1, "x", 1), (2, "x", 2), (3, "y", 3)])
    moves = frame(spark, [(11, "x", 1, 1, 0), (12, "x", 2, 2, 1)], ", old_id long, ord long")
    assert rows_of(dml.update(base, moves, table, "ord")) == [(11, "x", 1), (12, "x", 2), (3, "y", 3)]
    with pytest.raises(Exception, match="t.a"):
        dml.update(base, moves.withColumn("a", F.lit("y")), table, "ord").collect()


def test_update_moves_key_onto_moved_keys(spark, tmp_path):
    """More than 100,000 keys: keys move onto keys that move themselves, and names repeat."""
    spark.range(0, 200_100, 50).selectExpr("id AS c_custkey", "concat('Customer#', id % 30000) AS c_name").unionByName(spark.range(1, 20).selectExpr("id AS c_custkey", "'odd' AS c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.QUERIES["update_moves_key"](spark, str(tmp_path)).collect()
    duck = duckdb.sql(registry.ORACLES["update_moves_key"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'"))
    assert sorted((r["id"], r["tag"]) for r in got) == sorted(duck.fetchall())


def test_long_chains_of_shared_values(spark):
    table = TableDef("t", T.columns, ["id"])
    base = frame(spark, [(i, f"r{i}", i) for i in range(300)])
    up = base.select((F.col("id") + 1).alias("id"), "a", "b", F.col("id").alias("old_id"), (-F.col("id")).alias("ord"))
    assert rows_of(dml.update(base, up, table, "ord")) == sorted([(i + 1, f"r{i}", i) for i in range(300)], key=repr)
    with pytest.raises(Exception, match="UNIQUE"):
        dml.update(base, up.withColumn("ord", F.col("id")), table, "ord").collect()
    for actions in (["REPLACE"] * 3, ["REPLACE", "REPLACE", "IGNORE"], ["IGNORE"] * 3):
        pairs = TableDef("t", T.columns, ["id"], actions[0], [Unique(["a"], actions[1]), Unique(["b"], actions[2])])
        delta = [(i, f"a{i // 2}", (i + 1) // 2) for i in (j * 77 % 240 for j in range(240))]
        new = frame(spark, [(*r, i) for i, r in enumerate(delta)], ", ord long")
        assert rows_of(dml.insert(frame(spark, [(900, "a5", 70)]), new, pairs, "ord")) == model([(900, "a5", 70)], delta, [(0, True), (1, False), (2, False)], actions)


def test_replace_alone_needs_no_components(spark, monkeypatch):
    """Where every set says REPLACE: rows that are replaced later still evict, nulls share no UNIQUE value, equal keys do."""
    monkeypatch.setattr(dml, "components", None)
    table = TableDef("t", T.columns, ["id"], unique=[Unique(["a"]), Unique(["b"])])
    base = [(1, "x", 1), (2, "y", 2), (None, None, None), (7, None, 7)]
    delta = [(3, "x", 3), (3, "z", 4), (None, "q", None), (None, None, 8), (4, None, None), (5, "z", 9), (6, "z", None), (8, "w", 9)]
    new = frame(spark, [(*r, i) for i, r in enumerate(delta)], ", ord long")
    run = lambda b, n: rows_of(dml.insert(frame(spark, b), n, table, "ord", "REPLACE"))
    assert run(base, new) == model(base, delta, [(0, True), (1, False), (2, False)], ["REPLACE"] * 3)
    assert run(base, new.limit(0)) == sorted(base, key=repr)
    assert run([], new.where("id = 3").unionByName(new.where("id = 3"))) == [(3, "z", 4)]
    one = TableDef("one", T.columns, [], unique=[Unique(["a"])])
    assert rows_of(dml.insert(frame(spark, base[:1]), new.limit(0), one, "ord", "REPLACE")) == base[:1]
    assert rows_of(dml.insert(frame(spark, base[:1]), new, one, "ord", "REPLACE")) == [delta[-1]]


def test_values_stay_exact_and_apart(spark):
    big = 2**53
    table = TableDef("t", T.columns, ["id"], "REPLACE", [Unique(["a", "b"], "REPLACE")])
    new = frame(spark, [(big, "x", 1, -9), (big + 1, "y", None, -8), (None, "y", None, -7)], ", ord long")
    assert rows_of(dml.insert(frame(spark, [(5, "x", 1)]), new, table, "ord")) == sorted([(big, "x", 1), (big + 1, "y", None), (None, "y", None)], key=repr)


def test_upsert_and_delete(spark):
    base = frame(spark, [(1, "x", 1), (2, "y", 2)])
    new = frame(spark, [(2, "q", 5, 0), (3, "z", 3, 1)], ", ord long")
    assert rows_of(dml.upsert(base, new, ["id"], None, "ord")) == [(1, "x", 1), (2, "y", 2), (3, "z", 3)]
    assert rows_of(dml.upsert(base, new, ["id"], {"b": lambda old, ex: old + ex}, "ord")) == [(1, "x", 1), (2, "y", 7), (3, "z", 3)]
    assert rows_of(dml.delete(base, spark.createDataFrame([(1,)], "id long"), T)) == [(2, "y", 2)]


def test_upsert_folds_repeated_keys_in_order(spark, monkeypatch):
    monkeypatch.setattr(dml, "FOLD_ROWS", 2)
    base = frame(spark, [(1, "x", 10), (None, "n", 1), (9, "keep", 9)])
    delta = [(1, "a", 5), (1, "b", 7), (2, "c", 1), (2, "d", 2), (2, "e", 3), (2, "f", 4), (2, "g", 5), (None, "m", 6)]
    new = frame(spark, [(*r, i) for i, r in enumerate(delta)], ", ord long")
    rules = {"b": lambda old, ex: old * 2 + ex, "a": lambda old, ex: F.concat(old, ex)}
    state = {r[0]: r for r in rows_of(base)}
    for i, a, b in delta:
        state[i] = (i, state[i][1] + a, state[i][2] * 2 + b) if i in state else (i, a, b)
    assert rows_of(dml.upsert(base, new, ["id"], rules, "ord")) == sorted(state.values(), key=repr)
    assert rows_of(dml.upsert(base, new, ["id"], None, "ord")) == sorted([(1, "x", 10), (None, "n", 1), (9, "keep", 9), (2, "c", 1)], key=repr)
    assert rows_of(dml.upsert(base, new.limit(0), ["id"], rules, "ord")) == rows_of(base)


def test_update_and_delete_by_predicate(spark):
    base = frame(spark, [(1, "x", 1), (2, "y", None), (3, "z", 3)])
    assert rows_of(dml.delete_where(base, F.col("b") > 2)) == sorted([(1, "x", 1), (2, "y", None)], key=repr)
    table = TableDef("t", T.columns, ["id"], unique=[Unique(["a"])])
    assert rows_of(dml.update_where(base, F.col("b") >= 1, {"b": F.col("b") + 5}, table)) == sorted([(1, "x", 6), (2, "y", None), (3, "z", 8)], key=repr)
    assert rows_of(dml.update_where(base, F.col("id") > 2, {"id": F.col("id") + 1}, table)) == sorted([(1, "x", 1), (2, "y", None), (4, "z", 3)], key=repr)
    with pytest.raises(Exception, match="UNIQUE"):
        dml.update_where(base, F.col("id") > 1, {"a": F.lit("same")}, table).collect()


def test_a_hot_unique_value_takes_one_pass(spark):
    """Twenty thousand rows of one UNIQUE value, each replacing the one before."""
    table = TableDef("t", T.columns, ["id"], "REPLACE", [Unique(["a"], "REPLACE")])
    new = spark.range(20_000).select("id", F.lit("same").alias("a"), F.col("id").alias("b"), F.col("id").alias("ord"))
    assert rows_of(dml.insert(frame(spark, [(-1, "same", 0)]), new, table, "ord")) == [(19_999, "same", 19_999)]


def test_singleton_table(spark):
    one = TableDef("one", T.columns, [])
    empty = frame(spark, [])
    first = dml.insert(empty, frame(spark, [(1, "x", 1, 0)], ", ord long"), one, "ord")
    assert first.count() == 1
    with pytest.raises(dml.ConstraintError):
        dml.insert(first, frame(spark, [(2, "y", 1, 0)], ", ord long"), one, "ord")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.create(TableDef("t", T.columns, ["id"], checks=["new.b > 0", "new.b = coalesce((SELECT max(b) FROM committed_t), 0) + 1 OR new.a IS NOT NULL"]))
    return s


def put(spark, store, rows, action=None):
    t = Transaction(store)
    t.insert("t", frame(spark, [(*r, i) for i, r in enumerate(rows)], ", ord long"), "ord", action)
    return t


def test_versions_checks_and_savepoints(spark, store):
    one = put(spark, store, [(1, "x", 1)]).commit()
    with pytest.raises(dml.ConstraintError, match="CHECK"):
        put(spark, store, [(2, "y", -1)])
    with pytest.raises(dml.ConstraintError, match="CHECK"):
        put(spark, store, [(2, None, 9)])
    t = put(spark, store, [(2, None, 2)])
    t.savepoint("s")
    t.delete("t", spark.createDataFrame([(1,)], "id long"))
    assert t.read("t").count() == 1 and t.committed("t").count() == 1
    t.rollback_to("s")
    assert txn.stamp_id(t) == t.stamp and len(t.stamp) == 43
    two = t.commit()
    assert txn.stamp_id(t) is None and txn.stamp_id(None) is None
    assert rows_of(store.read("t", one)) == [(1, "x", 1)]
    assert rows_of(store.read("t", two)) == [(1, "x", 1), (2, None, 2)]
    assert [r["op"] for r in store.changes("t", ["id"], one, two).collect()] == ["insert"]
    assert store.head(one.rev).versions == one.versions


def test_stale_commits_fail_and_retries_win(spark, store):
    a, b = put(spark, store, [(1, "x", 1)]), put(spark, store, [(1, "y", 1)])
    a.commit()
    with pytest.raises(StaleHead):
        b.commit()
    done = txn.retrying(store, lambda t: t.insert("t", frame(spark, [(5, "q", 3, 0)], ", ord long"), "ord"))
    assert rows_of(store.read("t", done)) == [(1, "x", 1), (5, "q", 3)]
    with pytest.raises(StaleHead):
        store.commit(store.head(done.rev - 1), {"t": frame(spark, [])})


def test_appends_write_new_rows_alone(spark, store):
    for i in range(3):
        head = store.append("t", frame(spark, [(i, "x", i)]))
    assert rows_of(store.read("t", head)) == [(0, "x", 0), (1, "x", 1), (2, "x", 2)]
    assert head.versions["t"].count(",") == 2 and rows_of(store.read("t", store.head(head.rev - 1))) == [(0, "x", 0), (1, "x", 1)]


def test_rebase_runs_pending_writes_on_the_newer_head(spark, store):
    mine = put(spark, store, [(1, "x", 1), (2, "y", 2)])
    put(spark, store, [(1, "other", 5)]).commit()
    with pytest.raises(StaleHead):
        mine.commit()
    mine.rebase(lambda name, rows, old, new: rows.join(new, "id", "left_anti"))
    assert rows_of(store.read("t", mine.commit())) == [(1, "other", 5), (2, "y", 2)]


def test_checks_of_one_operation(spark, tmp_path):
    s = Store(spark, str(tmp_path / "ops"))
    s.create(TableDef("t", T.columns, ["id"], checks=["ON INSERT new.b = 1", "ON UPDATE new.b = 2", "new.a IS NOT NULL"]))
    t = put(spark, s, [(1, "x", 1)])
    change = lambda b: frame(spark, [(1, "x", b, 1, 0)], ", old_id long, ord long")
    t.update("t", change(2), "ord")
    for bad in (lambda: t.update("t", change(1), "ord"), lambda: put(spark, s, [(3, "x", 2)]), lambda: put(spark, s, [(3, None, 1)])):
        with pytest.raises(dml.ConstraintError, match="CHECK"):
            bad()
    found = dml.check_failures(frame(spark, [(1, "x", 1), (2, "y", 2), (3, None, None)]), s.definition("t"), "INSERT")
    assert [r["id"] for r in found.orderBy("id").collect()] == [2, 3]


def test_unique_indexes_refuse_rows_that_clash(spark, store):
    store.append("t", frame(spark, [(1, "x", 1), (2, "x", 2), (3, None, 3), (4, None, 4)]))
    with pytest.raises(SchemaConflict, match="share a value"):
        store.create_index("t", "by_a", ["a"], unique=True)
    store.create_index("t", "by_b", ["b"], unique=True)
    store.create_index("t", "by_a", ["a"], unique=True, partial="id > 1")


def test_catalog(spark, store):
    assert store.apply_schema([store.definition("t")]) == []
    store.create_index("t", "by_a", ["A"], unique=True)
    d = store.definition("t")
    assert d.indexes == {"by_a": ["a"]} and d.unique[0].columns == ["a"]
    with pytest.raises(SchemaConflict):
        store.create(TableDef("t", [("z", "TEXT", True)], ["z"]), exists_ok=True)
    before = store.schema_hash()
    store.create(TableDef("u", [("x", "WHATEVER", True)], ["x"]))
    assert store.schema_hash() != before and store.definition("u").schema()["x"].dataType.simpleString() == "binary"
    store.drop("u")
    assert store.schema_hash() == before and len(before) == 22


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, None, b"\x00\xff")], "id long, s string, x binary")
    assert formats.decode_rows(formats.encode_rows(df, ["id"]), df.schema).collect() == df.collect()
    with pytest.raises(NotImplementedError):
        formats.encode_rows(df, ["id"], "msgpack")
    m = spark.createDataFrame([('a"b,c', 1.0)], "name string, value double")
    formats.export_metrics(m, str(tmp_path / "csv"), "csv")
    formats.export_metrics(m, str(tmp_path / "json"), "json")
    assert '"a""b,c",1.0' in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def test_validation(spark, store):
    rows = frame(spark, [(1, "x", 1), (2, None, 2)])
    t = put(spark, store, [(1, "x", 1)])
    claim = {"stamp": t.stamp, "at_ms": 1000, "schema_hash": store.schema_hash(), "reads": {}, "operations_hash": txn.operations_hash(rows)}
    assert txn.validate(store, claim, lambda: rows.orderBy("id"), 2000) == []
    t.commit()
    bad = claim | {"stamp": "x", "schema_hash": "", "reads": {"t": "old"}}
    assert txn.validate(store, bad, lambda: rows.limit(1), 99_000) == ["stamp", "expired", "schema", "stale read", "operations"]


def test_pinned_reads_tell_absent_from_unavailable(spark):
    blocks = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 9, "c"), (2, 9, "d")], "id long, rev long, v string")
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id long")
    silent = spark.createDataFrame([(1,), (3,)], "id long")
    found = {r["id"]: (r["v"], r["status"]) for r in scans.pinned_get(blocks, ids, "id", "rev", 5, silent).collect()}
    assert found == {1: ("b", "present"), 2: (None, "absent"), 3: (None, "unavailable"), None: (None, "absent")}
    assert scans.pinned_get(blocks.limit(0), ids.limit(0), "id", "rev", 5, silent).count() == 0


def test_pending_context_begins_at_the_newest_checkpoint(spark):
    log = [(1, 1, "a", None), (1, 2, None, [("a", 1)]), (1, 3, "b", None), (1, 4, None, []), (1, 5, None, None), (1, 6, "c", None), (2, 1, "x", None)]
    log = spark.createDataFrame(log, "k long, rev long, action string, pendings array<struct<action: string, rev: long>>")
    context = lambda df: {tuple(r) for r in scans.pending_context(df, ["k"], "rev").collect()}
    assert context(log) == {(1, "c", 6), (2, "x", 1)}
    assert context(log.where("rev < 4")) == {(1, "a", 1), (1, "b", 3), (2, "x", 1)}
    assert context(log.limit(0)) == set()


def test_blocks_at_replays_after_the_newest_base(spark):
    bases = spark.createDataFrame([(1, "l", ["o"], 2), (1, "l", ["p", "q"], 4), (2, "l", ["z"], 9)], "block long, attribute string, items array<string>, rev long")
    steps = [(1, "update", 3, ["lost"]), (1, "update", 5, ["r"]), (1, "delete", 7, None), (1, "insert", 8, ["new"]), (1, "update", 8, ["s"]), (3, "update", 1, ["none"]), (4, "insert", 1, ["g"]), (4, "delete", 1, None)]
    operations = spark.createDataFrame([(b, k, "l", 0, 1, a, r) for b, k, r, a in steps], "block long, kind string, attribute string, at int, removed int, added array<string>, rev long")
    state = lambda at: {r["block"]: r["items"] for r in changes.blocks_at(bases, operations, "rev", at).collect()}
    assert state(3) == {1: ["lost"]}
    assert state(6) == {1: ["r", "q"]}
    assert state(7) == {}
    assert state(9) == {1: ["s"], 2: ["z"]}


def test_checks_of_transactions_in_several_threads_see_their_own_rows(spark):
    from concurrent.futures import ThreadPoolExecutor

    table = TableDef("c", [("id", "INTEGER", True)], ["id"], checks=["id > (SELECT min(id) - 1 FROM committed_c)"])

    def fails(low):
        rows = spark.createDataFrame([(5,)], "id long")
        try:
            dml.enforce_checks(rows, table, {"committed_c": spark.createDataFrame([(low,)], "id long")})
        except dml.ConstraintError:
            return True
        return False

    with ThreadPoolExecutor(6) as pool:
        assert list(pool.map(fails, [1, 9] * 6)) == [False, True] * 6
