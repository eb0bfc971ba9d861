"""Row formats and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from lakeloom.operators.scans import last_per_key


def encode_rows(df: DataFrame, key: list[str], row_format: str = "json") -> DataFrame:
    """key and the row as a JSON object by column name; binary columns are base64 (as to_json writes them)."""
    if row_format != "json":
        raise NotImplementedError(f"row format {row_format} is not implemented")
    return df.select(*key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def decode_rows(encoded: DataFrame, schema: StructType, row_format: str = "json") -> DataFrame:
    if row_format != "json":
        raise NotImplementedError(f"row format {row_format} is not implemented")
    assert not any(isinstance(f.dataType, BinaryType) and f.name == "row" for f in schema)
    return encoded.select(F.from_json("row", schema).alias("r")).select("r.*")


def export_metrics(df: DataFrame, path: str, kind: str) -> None:
    """json, or csv with quotes by RFC 4180."""
    if kind == "json":
        df.write.json(path)
    elif kind == "csv":
        df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        raise ValueError(kind)


def restore_archive(store: DataFrame, archive: DataFrame, key: list[str], revision: str) -> DataFrame:
    """store and archive merged: one row for each key and revision, the store's where both have it."""
    both = store.withColumn("__own", F.lit(1)).unionByName(archive.withColumn("__own", F.lit(0)))
    return last_per_key(both, [*key, revision], [F.col("__own")]).drop("__own")


def keys_with_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))
