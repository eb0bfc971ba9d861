"""Writes to keyed tables: conflict actions, UNIQUE and CHECK constraints, upserts and merges.

With a primary key alone a batch is resolved by joins: the first or last row of a key by ordinal wins. With
further UNIQUE sets each row's fate depends on those before it; rows that share a value of some key, directly or
through others, form a component, and each component is resolved in order on its own.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.operators.scans import first_per_key, last_per_key
from lakeloom.sources.tables import TableDef

STOP = ("ABORT", "FAIL", "ROLLBACK")


class ConstraintError(ValueError):
    pass


def resolve_action(statement: str | None, declared: str | None) -> str:
    """The statement's OR clause, else what the constraint declares, else ABORT."""
    return (statement or declared or "ABORT").upper()


def _null_safe(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= a[c].eqNullSafe(b[c])
    return out


def checks_for(table: TableDef, operation: str) -> list[str]:
    """The CHECKs of a table for INSERT or UPDATE: `ON INSERT <sql>` and `ON UPDATE <sql>` hold for their operation alone."""
    out = []
    for check in table.checks:
        head = check.split(None, 2)
        if len(head) == 3 and head[0].upper() == "ON" and head[1].upper() in ("INSERT", "UPDATE"):
            if head[1].upper() == operation:
                out.append(head[2])
        else:
            out.append(check)
    return out


def check_failures(rows: DataFrame, table: TableDef, operation: str) -> DataFrame:
    """Rows for which some CHECK over the row alone is false. An unknown CHECK passes."""
    failed = F.lit(False)
    for check in checks_for(table, operation):
        failed |= ~F.coalesce(F.expr(check), F.lit(True))
    return rows.alias("new").where(failed)


_VIEWS = threading.Lock()  # view names are the session's: transactions of several threads name and resolve them one at a time


def enforce_checks(rows: DataFrame, table: TableDef, views: dict[str, DataFrame] | None = None, operation: str = "INSERT") -> None:
    """Raise where a NOT NULL column is null or a CHECK is false. An unknown CHECK passes.

    A CHECK is SQL over the row; it may read the frames in `views`, such as committed_T, by scalar subqueries.
    """
    for n, _, nullable in table.columns:
        if not nullable and n not in table.primary_key and rows.where(F.col(n).isNull()).limit(1).count():
            raise ConstraintError(f"NOT NULL constraint failed: {table.name}.{n}")
    with _VIEWS:
        for name, frame in (views or {}).items():
            frame.createOrReplaceTempView(name)
        rows.createOrReplaceTempView("new_rows")
        failing = [(c, rows.sparkSession.sql(f"SELECT 1 FROM new_rows new WHERE NOT coalesce(({c}), true) LIMIT 1")) for c in checks_for(table, operation)]
    for check, found in failing:
        if found.count():
            raise ConstraintError(f"CHECK constraint failed: {check}")


def with_defaults(rows: DataFrame, table: TableDef, context: dict[str, object] | None = None) -> DataFrame:
    """Missing columns get their DEFAULT (SQL that may name context variables), or null."""
    for name, value in (context or {}).items():
        rows = rows.withColumn(f"context_{name}", F.lit(value))
    for f in table.schema():
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.expr(table.defaults[f.name]) if f.name in table.defaults else F.lit(None))
        rows = rows.withColumn(f.name, F.col(f.name).cast(f.dataType))
    return rows


def insert(base: DataFrame, rows: DataFrame, table: TableDef, ordinal: str, action: str | None = None) -> DataFrame:
    """base after INSERT of rows in the order of `ordinal`, with the statement's action or the declared ones.

    ABORT, FAIL and ROLLBACK raise at the first conflict; IGNORE leaves the new row out; REPLACE removes the rows in its
    way. Null keys equal each other in the primary key, and nothing in other UNIQUE sets.
    """
    sets = [u for u in table.unique if not u.partial or table.strict]
    if sets and {resolve_action(action, a) for a in (table.on_conflict, *[u.on_conflict for u in sets])} == {"REPLACE"}:
        return _replaced(base, rows, [table.primary_key, *[u.columns for u in sets]], ordinal)
    if sets:
        return _resolved(base, rows.withColumn("__op", F.lit("insert")), table, ordinal, action)
    pk, how = table.primary_key, resolve_action(action, table.on_conflict)
    columns = base.columns
    if how in STOP:
        twice = rows.groupBy(*pk).count().where("count > 1").limit(1).count() if pk else max(0, rows.limit(2).count() - 1)
        there = base.join(rows.select(*pk), _null_safe(base, rows, pk), "left_semi").limit(1).count()
        if twice or there:
            raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{table.name}.{c}' for c in pk)}")
        return base.unionByName(rows.select(*columns))
    if how == "IGNORE":
        fresh = first_per_key(rows, pk, [F.col(ordinal)])
        fresh = fresh.join(base, _null_safe(fresh, base, pk), "left_anti")
        return base.unionByName(fresh.select(*columns))
    fresh = last_per_key(rows, pk, [F.col(ordinal)])
    return base.join(fresh, _null_safe(base, fresh, pk), "left_anti").unionByName(fresh.select(*columns))


def _replaced(base: DataFrame, rows: DataFrame, sets: list[list[str]], ordinal: str) -> DataFrame:
    """INSERT where all sets, the primary key first, say REPLACE: no row is turned away, so the last row of each value stays.

    A new row stays where it is the last of its key and of each UNIQUE value, a base row where no new row has one of its
    values. Last rows are found by aggregates and joined by their place in the order, so a value that many rows share
    is no large group.
    """
    pk, columns = sets[0], base.columns
    rows = rows.select(F.col(ordinal).alias("__ord"), *[F.col(c).cast(base.schema[c].dataType).alias(c) for c in columns])
    place = F.struct("__ord", *columns)  # rows of one ordinal: in the order of their columns
    stay = rows.groupBy(*pk).agg(F.max(place).alias("__at")).where("__at IS NOT NULL").select("__at.*")
    left = base.join(rows, _null_safe(base, rows, pk), "left_anti")
    for unique in sets[1:]:
        free = F.greatest(*[F.col(c).isNull() for c in unique], F.lit(False))
        last = rows.where(~free).groupBy(*unique).agg(F.max(place).alias("__at")).select("__at")
        held = stay.where(~free).withColumn("__at", place).join(last, "__at", "left_semi").drop("__at")
        stay = stay.where(free).unionByName(held)
        left = left.join(rows.select(*unique).distinct(), unique, "left_anti")
    return left.unionByName(stay.select(*columns))


def update(base: DataFrame, changes: DataFrame, table: TableDef, ordinal: str, action: str | None = None) -> DataFrame:
    """base after updates; changes hold old_<key> for each key column, and the whole new row.

    Rows move one after the other in the order of `ordinal`, and each meets what those before it left. A value that a
    row had before is not held against it, whoever shares it.
    """
    return _resolved(base, changes.withColumn("__op", F.lit("update")), table, ordinal, action)


def delete(base: DataFrame, keys: DataFrame, table: TableDef) -> DataFrame:
    return base.join(keys, _null_safe(base, keys, table.primary_key), "left_anti")


def delete_where(base: DataFrame, predicate: Column) -> DataFrame:
    """base without the rows for which the predicate is true; where it is unknown they stay."""
    return base.where(~F.coalesce(predicate, F.lit(False)))


def update_where(base: DataFrame, predicate: Column, values: dict[str, Column], table: TableDef, action: str | None = None) -> DataFrame:
    """base with the values set where the predicate is true; rows whose key moves go through the constraints."""
    hit = F.coalesce(predicate, F.lit(False))
    sets = {c for u in table.unique for c in u.columns} | set(table.primary_key)
    if not sets.intersection(values):
        return base.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
    rows = base.where(hit).select("*", *[F.col(k).alias(f"old_{k}") for k in table.primary_key]).withColumns(values)
    ordinal = F.row_number().over(Window.orderBy(*[f"old_{k}" for k in table.primary_key]))  # one order for all: that of the keys
    return update(base, rows.withColumn("__at", ordinal), table, "__at", action)


#: Rows of one key that a round of upsert folds at a time.
FOLD_ROWS = 10_000


def upsert(base: DataFrame, rows: DataFrame, key: list[str], set_columns: dict[str, Callable[[Column, Column], Column]] | None, ordinal: str) -> DataFrame:
    """ON CONFLICT (key): DO NOTHING where set_columns is None, else each column becomes f(old, excluded).

    Rows of one key follow one another in the order of `ordinal`: the first is inserted where the key is free, each
    further one meets what those before it left. They are folded within a row, FOLD_ROWS of a key in a round.
    """
    columns = base.columns
    if set_columns is None:
        fresh = first_per_key(rows, key, [F.col(ordinal)])
        return base.unionByName(fresh.join(base, _null_safe(fresh, base, key), "left_anti").select(*columns))
    pack = lambda prefix="": F.struct(*[F.col(f"{prefix}{c}").cast(base.schema[c].dataType).alias(c) for c in columns])
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(ordinal)) - 1).withColumn("__round", F.floor(F.col("__n") / FOLD_ROWS))
    most = numbered.agg(F.max("__round")).first()[0]
    step = lambda old, new: F.struct(*[(set_columns[c](old[c], new[c]).cast(base.schema[c].dataType) if c in set_columns else old[c]).alias(c) for c in columns])
    for i in range(0 if most is None else most + 1):
        part = numbered.where(F.col("__round") == i).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), pack().alias("row")))).alias("__rows"))
        old = base.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(key)], pack().alias("__old"))
        same = F.lit(True)
        for j, k in enumerate(key):
            same &= part[k].eqNullSafe(old[f"__k{j}"])
        both = part.join(old, same, "full")
        first = F.coalesce(F.col("__old"), F.get("__rows", F.lit(0))["row"])
        later = F.when(F.col("__old").isNull(), F.slice("__rows", 2, F.greatest(F.size("__rows") - 1, F.lit(0)))).otherwise(F.col("__rows"))
        done = F.when(F.col("__rows").isNull(), F.col("__old")).otherwise(F.aggregate(later, first, lambda acc, x: step(acc, x["row"])))
        base = both.select(done.alias("r")).select("r.*")
    return base


def merge_batch(base: DataFrame, batch: DataFrame, key: list[str], ordinal: str, deleted: str) -> DataFrame:
    """A batch of upserts and deletes, the last of each key in order."""
    last = last_per_key(batch, key, [F.col(ordinal)])
    kept = base.join(last, _null_safe(base, last, key), "left_anti")
    return kept.unionByName(last.where(~F.col(deleted)).select(*base.columns))


def collisions(base: DataFrame, rows: DataFrame, columns: list[str], excluded: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Base rows that share the (null-free) UNIQUE value of some row, without those of the excluded keys."""
    wanted = rows.select(*columns).dropna().distinct()
    found = base.join(wanted, columns, "left_semi")
    return found.join(excluded, key, "left_anti") if excluded is not None else found


def _resolved(base: DataFrame, delta: DataFrame, table: TableDef, ordinal: str, action: str | None) -> DataFrame:
    pk, columns = table.primary_key, base.columns
    sets = [(pk, True, resolve_action(action, table.on_conflict))]
    sets += [(u.columns, False, resolve_action(action, u.on_conflict)) for u in table.unique if not u.partial or table.strict]
    old = [f"old_{c}" for c in pk if f"old_{c}" in delta.columns]
    kinds = {f.name: f.dataType for f in base.schema}

    def part(name: str, column: str) -> Column:
        c = F.col(name).cast(kinds[column])
        c = (c + F.lit(0.0) if kinds[column].typeName() in ("double", "float") else c).cast("string")  # -0.0 is 0.0
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit("="), c), F.lit("-"))

    def text(names: list[str], cs: list[str], i: int, null: bool) -> Column:
        """One text for each value of set i, the lengths in front of its parts; null where the value takes no part."""
        whole = F.concat(F.lit(f"{i}:"), *[part(n, c) for n, c in zip(names, cs)]).cast("binary")
        for n in [] if null else names:
            whole = F.when(F.col(n).isNotNull(), whole)
        return whole

    def values(df: DataFrame, with_old: bool) -> DataFrame:
        out = df.withColumn("__held", F.array(*[text(cs, cs, i, null) for i, (cs, null, _) in enumerate(sets)]))
        out = out.withColumn("__was", text(old, pk, 0, True) if with_old and old else F.lit(None).cast("binary"))
        return out.withColumn("__values", F.array_compact(F.array_append("__held", F.col("__was"))))

    new = values(delta.withColumn("__node", F.concat(F.lit("d"), F.col(ordinal).cast("string"))), True)
    own = values(base.withColumn("__node", F.concat(F.lit("b"), F.xxhash64(*columns).cast("string"), F.lower(F.hex(text(pk, pk, 0, True))))), False)
    touched = new.select(F.explode("__values").alias("v")).distinct()
    near = own.join(own.select("__node", F.explode("__values").alias("v")).join(touched, "v", "left_semi").select("__node").distinct(), "__node", "left_semi")
    # rows that an eviction may free or block lie one step from the batch: base rows do not conflict with each other
    labels = new.select("__node", F.explode("__values").alias("v")).unionByName(near.select("__node", F.explode("__values").alias("v")))
    labels = components(labels)
    shape = lambda df, op, late, at: df.join(labels, "__node").select("comp", op.alias("__op"), F.lit(late).alias("__late"), at.cast("long").alias("__ord"), "__held", "__was", *[F.col(c).cast(kinds[c]).alias(c) for c in columns])
    events = shape(near, F.lit("base"), 0, F.lit(0)).unionByName(shape(new, F.col("__op"), 1, F.col(ordinal)))
    name = table.name

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by component and order stream through; of one component the rows kept so far are held."""
        comp, kind = None, None
        kept: dict[int, dict] = {}
        holder: dict[bytes, int] = {}

        def leave(at: int) -> None:
            for v in kept.pop(at)["__held"]:
                if holder.get(v) == at:
                    del holder[v]

        def enter(at: int, row: dict) -> None:
            kept[at] = row
            for v in row["__held"]:
                if v is not None:
                    holder[v] = at

        def settled() -> Iterator[pa.RecordBatch]:
            rows = list(kept.values())
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows[a : a + 10_000]], kind)

        n = 0
        for batch in batches:
            kind = pa.schema([batch.schema.field(c) for c in columns])
            for row in batch.to_pylist():
                n += 1
                if row["comp"] != comp:
                    yield from settled()
                    comp, kept, holder = row["comp"], {}, {}
                if row["__op"] == "base":
                    enter(n, row)
                    continue
                gone: list[int] = []
                had: list[bytes | None] = []
                if row["__op"] == "update":
                    at = holder.get(row["__was"])
                    if at is None:
                        continue  # no such row
                    gone.append(at)
                    had = kept[at]["__held"]
                blocked = None
                for v, (cs, _, how) in zip(row["__held"], sets):
                    at = holder.get(v) if v is not None else None
                    if at is None or at in gone or v in had:
                        continue
                    if how == "REPLACE":
                        gone.append(at)
                    else:
                        blocked = how
                        break
                if blocked == "IGNORE":
                    continue
                if blocked:
                    raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{name}.{c}' for c in cs)}")
                for at in gone:
                    leave(at)
                enter(n, row)
        yield from settled()

    settled = events.repartition("comp").sortWithinPartitions("comp", "__late", "__ord").mapInArrow(in_order, base.schema)
    return base.join(near.select(*columns), _null_safe(base, near, pk), "left_anti").unionByName(settled)


def components(values: DataFrame) -> DataFrame:
    """(__node, v) -> (__node, comp): nodes that share values, directly or through others.

    Until no label changes, labels flow along values and jump: a node takes the label that its least neighbour's
    label has itself, so long chains take few rounds. Each round is checkpointed.
    """
    values = _saved(values.select("__node", "v").distinct())
    labels = values.select("__node").distinct().withColumn("comp", F.col("__node"))
    while True:
        by_value = values.join(labels, "__node").groupBy("v").agg(F.min("comp").alias("low"))
        near = values.join(by_value, "v").groupBy("__node").agg(F.min("low").alias("via"))  # its own label is among them
        moved = labels.withColumnRenamed("comp", "old").join(near, "__node")
        ahead = labels.select(F.col("__node").alias("via"), "comp")
        moved = _saved(moved.join(ahead, "via").select("__node", "old", "comp"))
        labels = moved.select("__node", "comp")
        if not moved.where("old != comp").limit(1).count():
            return labels


def _saved(df: DataFrame) -> DataFrame:
    from lakeloom.sources.scratch import saved

    return saved(df, "components")
