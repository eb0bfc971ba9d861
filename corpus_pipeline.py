"""From raw documents to shards: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Null ids and repeated rows pass
as they are until the second stage, which keeps one row of each group of near duplicates. An empty table stays empty;
extra columns are passed on. Rows that go are few, so stages join documents with those rather than with the kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import broadcast_within, staged, table
from lakeloom.llm.decontam import hit_summary
from lakeloom.llm.mixing import mix
from lakeloom.llm.parity_join import jaccard_components
from lakeloom.llm.quality import quality_verdicts
from lakeloom.llm.sharding import shard_rows

MAX_BROADCAST_KEYS = 1_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.xxhash64("doc_id", "text"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose key is not in keys (a staged table of one column, __row), those that go."""
    return _keyed(docs).join(broadcast_within(keys, MAX_BROADCAST_KEYS), "__row", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the fences of their own language and source.

    Whole rows go through the rules, so each has a verdict of its own and no join of documents is needed.
    """
    own = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__document"))
    return quality_verdicts(own, ["__document"]).where("kept").select("__document.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id (nulls last), of each group linked at Jaccard 0.8 over five-word shingles.

    Rows are told apart by doc_id and text; of rows that agree in both, one is kept. Documents without words are no
    near duplicates of others.
    """
    rows = docs.count()
    keyed = _keyed(docs)
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        keyed = docs.withColumn("__row", F.col("doc_id").cast("long"))  # ids tell rows apart, and stars stand around early ones
    found = staged(jaccard_components(keyed.select("__row", "text"), key="__row", k=5, num=80, den=100), "near-duplicates", rows)
    shared = found.groupBy("component_id").agg(F.count("*").alias("n"), F.countDistinct("__row").alias("texts")).where("n > 1")
    groups = staged(found.join(shared.where("texts > 1").select("component_id"), "component_id").select("__row", "component_id").distinct(), "groups", rows)
    named = groups.join(keyed.select("__row", "doc_id").distinct(), "__row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("best"))
    gone = groups.join(best, "component_id").where("__row != best.__row").select("__row").distinct()
    kept = keyed.join(broadcast_within(staged(gone, "gone", rows), MAX_BROADCAST_KEYS), "__row", "left_anti").select(*docs.columns)
    if shared.where("n > texts").limit(1).count():  # rows that agree in doc_id and text
        kept = _keyed(kept).dropDuplicates(["__row"]).select(*docs.columns)
    return kept


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    hits = hit_summary(_keyed(docs).select("__row", "text"), table(spark, sf_dir, "benchmark"), ["__row"])
    return _without(docs, staged(hits.where("contaminated").select("__row").distinct(), "hit", docs.count()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares of source, language and topic follow the raked weights."""
    own = [F.col(c).alias(f"__d{i}") for i, c in enumerate(docs.columns)]  # extra columns may have the names that mix gives
    mixed = mix(docs.select("doc_id", "text", "lang", "source", *own)).where("kept")
    return mixed.select(*[F.col(f"__d{i}").alias(c) for i, c in enumerate(docs.columns)])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard (0 to 7) and slot."""
    return shard_rows(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The last stage draws from a random law that SQL does not express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
