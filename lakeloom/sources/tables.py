"""Keyed tables as versioned Parquet snapshots, with a catalog and a commit log.

A commit writes each changed table to a new folder and then one small row set, the next head, that names the
version of every table. Readers pin a head and read all tables at it, so a commit of several tables shows whole
or not at all. The folder of a head number can be created once: a second writer of the same number fails and
has to begin again on the newer head.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, LongType, NullType, StringType, StructField, StructType, TimestampNTZType

# Declared column types. Any other name is BLOB.
TYPES: dict[str, DataType] = {
    "NULL": NullType(), "INTEGER": LongType(), "REAL": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType(), "NUMERIC": DecimalType(38, 18),
    "BOOLEAN": BooleanType(), "DATE": DateType(), "DATETIME": TimestampNTZType(), "JSON": StringType(),
}


class StaleHead(RuntimeError):
    """Another commit came first."""


class SchemaConflict(ValueError):
    pass


@dataclass
class Unique:
    columns: list[str]
    on_conflict: str | None = None
    partial: str | None = None  # a predicate: stored, and not enforced unless strict


@dataclass
class TableDef:
    """Columns are (name, type, nullable); an empty primary key makes a table of at most one row."""

    name: str
    columns: list[tuple[str, str, bool]]
    primary_key: list[str]
    on_conflict: str | None = None
    unique: list[Unique] = field(default_factory=list)
    indexes: dict[str, list[str]] = field(default_factory=dict)
    checks: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)
    strict: bool = False

    def schema(self) -> StructType:
        return StructType([StructField(n, TYPES.get(t.upper(), BinaryType()), True) for n, t, _ in self.columns])

    def column(self, name: str) -> str:
        """A column's declared name, whatever the case."""
        return next(n for n, _, _ in self.columns if n.lower() == name.lower())

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    @staticmethod
    def of(text: str) -> TableDef:
        d = json.loads(text)
        return TableDef(**d | {"columns": [tuple(c) for c in d["columns"]], "unique": [Unique(**u) for u in d["unique"]]})

    def merged(self, other: TableDef) -> TableDef:
        """Declared again: indexes and unique sets are added by name; other differences are an error."""
        same = lambda d: (d.columns, d.primary_key)
        if same(self) != same(other):
            raise SchemaConflict(f"{self.name} exists with other columns")
        mine = {tuple(u.columns): u for u in self.unique} | {tuple(u.columns): u for u in other.unique}
        return TableDef.of(TableDef(**{**self.__dict__, "unique": list(mine.values()), "indexes": self.indexes | other.indexes}).text())


def has_clashes(rows: DataFrame, columns: list[str], partial: str | None) -> bool:
    """Whether rows share a value of the columns; nulls equal nothing."""
    rows = rows.where(partial) if partial else rows
    return bool(rows.select(*columns).dropna().groupBy(*columns).count().where("count > 1").limit(1).count())


CATALOG = "_catalog"
CATALOG_SCHEMA = StructType([StructField("name", StringType()), StructField("definition", StringType())])
HEAD_SCHEMA = StructType([StructField("name", StringType()), StructField("version", StringType()), StructField("rev", LongType())])


@dataclass(frozen=True)
class Head:
    rev: int
    versions: dict[str, str]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # heads

    def head(self, rev: int | None = None) -> Head:
        """The latest head, or that of a revision. Revision 0 is the empty store."""
        try:
            heads = self.spark.read.schema(HEAD_SCHEMA).parquet(f"{self.root}/_heads/*")
            rows = heads.where("name IS NOT NULL") if rev is None else heads.where(F.col("rev") == rev)
            rows = rows.where(F.col("rev") == rows.agg(F.max("rev")).first()[0]).collect()  # one row for each table
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if not rows:
            if rev:
                raise KeyError(f"no revision {rev}")
            return Head(0, {})
        return Head(rows[0]["rev"], {r["name"]: r["version"] for r in rows})

    def commit(self, base: Head, changed: dict[str, DataFrame], dropped: tuple[str, ...] = (), appended: dict[str, DataFrame] | None = None) -> Head:
        """Write changed tables, then the head base.rev + 1. StaleHead where that head exists.

        Rows in `appended` join what the table holds: only they are written. The head is claimed by a file that the
        file system creates for one writer alone.
        """
        versions = {n: v for n, v in base.versions.items() if n not in dropped}
        for name, df in changed.items():
            version = uuid.uuid4().hex
            df.write.parquet(f"{self.root}/{name}/v={version}")
            versions[name] = version
        for name, df in (appended or {}).items():
            version = uuid.uuid4().hex
            df.write.parquet(f"{self.root}/{name}/v={version}")
            versions[name] = f"{versions[name]},{version}" if name in versions else version
        rev = base.rev + 1
        claim = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/h={rev}")
        files = claim.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.createNewFile(claim):
            raise StaleHead(f"revision {rev} exists; begin again")
        rows = self.spark.createDataFrame([(n, v, rev) for n, v in sorted(versions.items())] or [("", "", rev)], HEAD_SCHEMA)
        try:
            rows.coalesce(1).write.mode("error").parquet(f"{self.root}/_heads/h={rev}")
        except Exception:
            files.delete(claim, False)
            raise
        return Head(rev, versions)

    def append(self, name: str, rows: DataFrame) -> Head:
        """Entries at the end of a table, whose own rows are not written again; a newer head is appended to as it is."""
        while True:
            try:
                return self.commit(self.head(), {}, appended={name: rows})
            except StaleHead:
                continue

    # reads

    def read(self, name: str, head: Head | None = None) -> DataFrame:
        """The committed table at a head; pass the same head to all reads of a query."""
        head = head or self.head()
        schema = CATALOG_SCHEMA if name == CATALOG else self.definition(name, head).schema()
        if name not in head.versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/v={v}" for v in head.versions[name].split(",")])

    def changes(self, name: str, key: list[str], older: Head, newer: Head) -> DataFrame:
        """Rows that differ between two heads: op insert, update or delete, with the newer values."""
        a, b = self.read(name, older), self.read(name, newer)
        rest = [c for c in a.columns if c not in key]
        pack = lambda df, tag: df.select(*key, F.struct(*(rest or key)).alias(tag))
        both = pack(a, "__old").join(pack(b, "__new"), key, "full")
        op = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").otherwise("update")
        return both.where(~F.col("__old").eqNullSafe(F.col("__new"))).select(op.alias("op"), *key, *[F.col(f"__new.{c}").alias(c) for c in rest])

    # catalog

    def definitions(self, head: Head | None = None) -> dict[str, TableDef]:
        head = head or self.head()
        rows = self.read(CATALOG, head).collect() if CATALOG in head.versions else []
        return {r["name"]: TableDef.of(r["definition"]) for r in rows}

    def definition(self, name: str, head: Head | None = None) -> TableDef:
        found = self.definitions(head)
        if name not in found:
            raise KeyError(f"no table {name}")
        return found[name]

    def _catalog(self, definitions: dict[str, TableDef]) -> DataFrame:
        return self.spark.createDataFrame([(n, d.text()) for n, d in sorted(definitions.items())], CATALOG_SCHEMA).coalesce(1)

    def create(self, table: TableDef, exists_ok: bool = False) -> Head:
        head = self.head()
        known = self.definitions(head)
        if table.name in known:
            if not exists_ok:
                raise SchemaConflict(f"table {table.name} exists")
            table = known[table.name].merged(table)
        return self.commit(head, {CATALOG: self._catalog(known | {table.name: table})})

    def create_index(self, table: str, name: str, columns: list[str], unique: bool = False, partial: str | None = None, on_conflict: str | None = None) -> Head:
        head = self.head()
        known = self.definitions(head)
        d = known[table]
        d.indexes[name] = [d.column(c) for c in columns]
        if unique and has_clashes(self.read(table, head), d.indexes[name], partial):
            raise SchemaConflict(f"UNIQUE index {name}: rows of {table} share a value already")
        if unique:
            d.unique.append(Unique(d.indexes[name], on_conflict, partial))
        return self.commit(head, {CATALOG: self._catalog(known)})

    def drop(self, name: str) -> Head:
        head = self.head()
        known = self.definitions(head)
        del known[name]
        return self.commit(head, {CATALOG: self._catalog(known)}, (name,))

    def apply_schema(self, tables: list[TableDef]) -> list[str]:
        """Create what is missing and merge what is there; gives the names that changed. A second call changes nothing."""
        known, done = self.definitions(), []
        for t in tables:
            if t.name not in known or known[t.name].merged(t).text() != known[t.name].text():
                self.create(t, exists_ok=True)
                done.append(t.name)
        return done

    def schema_view(self, head: Head | None = None) -> DataFrame:
        """(type, name, tbl_name, sql) of tables and indexes."""
        rows = []
        for n, d in self.definitions(head).items():
            sql = ", ".join(f"{c} {t}{' NULL' if null else ''}" for c, t, null in d.columns)
            rows.append(("table", n, n, f"CREATE TABLE {n} ({sql}, PRIMARY KEY ({', '.join(d.primary_key)}))"))
            rows += [("index", i, n, f"CREATE INDEX {i} ON {n} ({', '.join(c)})") for i, c in d.indexes.items()]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string")

    def schema_hash(self, head: Head | None = None) -> str:
        """Base64url of the first 16 bytes of SHA-256 over type, name and sql in order."""
        import base64

        rows = self.schema_view(head).orderBy("type", "name").collect()
        text = json.dumps([[r["type"], r["name"], r["sql"]] for r in rows], separators=(",", ":"))
        return base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()[:16]).decode().rstrip("=")
