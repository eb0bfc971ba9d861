"""Helpers that the corpus operators share: tables, staging in the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A temporary one is set only in local mode where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


ROWS_PER_FILE = 50_000


def staged(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: it cuts lineage and survives lost executors.

    rows, for tables of narrow rows: how many there are at most; they are written in files of 50,000 or so
    instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made from them has been staged itself."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        at.getFileSystem(conf).delete(at, True)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint where it has at most max_rows rows; beyond that a shuffle join is left to AQE.

    df has to be cheap to count: a staged table or an aggregate of one.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(text: Column) -> Column:
    """Only A-Z become lower case. Pure ASCII texts take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, pattern: str = SPACE_WORDS) -> Column:
    """All words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def unit_interval(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
