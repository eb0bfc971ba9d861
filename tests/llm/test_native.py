"""Quality rules, decontamination, mixing and sharding against brute force and on awkward tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import decontam, mixing, quality, sharding
from lakeloom.llm.common import table
from lakeloom.llm.queries import QUERIES

from .helpers import SF, awkward, base_counts, empty, hits


def test_quality_counts_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op3_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, rep = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_on_awkward_rows(spark):
    rows = quality.quality_verdicts(awkward(spark), ["doc_id", "score"]).collect()
    assert len(rows) == 15 and all(r["score"] == "clash" for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    texts = {r["doc_id"]: r["text"] for r in awkward(spark).collect()}
    for i, r in by.items():
        if i is not None:
            assert base_counts(texts[i]) == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert by[1]["kept"] == by[2]["kept"]
    assert quality.quality_verdicts(empty(spark), ["doc_id"]).collect() == []


def test_thresholds_adapt_to_groups(spark):
    """Where symbols are common they are tolerated; where they are rare the same text goes."""
    text = lambda i, k: " ".join(f"w{i}x{j}" + ("#" if j % k == 0 else "") for j in range(80))
    rows = [(i, text(i, 2), "en", "code") for i in range(60)] + [(100 + i, text(i, 1000), "en", "prose") for i in range(60)] + [(999, text(999, 2), "en", "prose")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"], min_group=50).collect()}
    assert all(got[i] for i in range(60)) and all(got[100 + i] for i in range(60)) and not got[999]


def test_quantiles_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"={la}", "=s", "symbols", rng.randrange(200), 1 + rng.randrange(3)) for la in "ab" for _ in range(150)]
    got = quality.quantiles(spark.createDataFrame(rows, "__lang string, __source string, metric string, bucket long, n long"), ["__lang"]).collect()
    assert len(got) == 2
    for r in got:
        values = sorted(b for la, _, _, b, n in rows if la == r["__lang"] for _ in range(n))
        for p in quality.LEVELS:
            assert r[f"q{p}"] == values[-(-p * len(values) // 100) - 1]


def test_fences_part_junk_from_clean_documents(spark):
    """By the labels, which no threshold sees; documents that fail the base rules are left out."""
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    rows = QUERIES["op3_quality_rules"](spark, sf).where("NOT base_failed").join(labels, "doc_id").collect()
    junk, clean = [r["kept"] for r in rows if not r["quality"]], [r["kept"] for r in rows if r["quality"]]
    assert sum(junk) / len(junk) < 0.1 and sum(clean) / len(clean) > 0.98


def test_sketch_buckets(spark):
    rng = random.Random(1)
    values = [rng.randrange(10 ** rng.randrange(1, 9)) for _ in range(300)]
    for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket_of(F.col("v")).alias("b")).collect():
        assert r["b"] <= r["v"] and r["v"] - r["b"] <= r["v"] / 128


def check_hits(rows, texts, items, key="doc_id"):
    for r in rows:
        n, hit, found = hits(texts[r[key]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), r
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontamination_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    rows = QUERIES["op2_decontamination"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    check_hits(rows, texts, items)


def test_decontamination_of_short_items_and_awkward_rows(spark):
    items = {1: "one two", 2: "ONE", 3: "", 4: None, 5: " ".join(f"word{i} and thing{i % 7}" for i in range(5, 10)), 6: "one two three four five six", 7: "and", 8: "one two"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in awkward(spark).where("doc_id IS NOT NULL").collect()}
    rows = decontam.hit_summary(awkward(spark), bench, ["doc_id"]).collect()
    assert len(rows) == 15 and Counter(r["doc_id"] for r in rows)[2] == 2
    check_hits([r for r in rows if r["doc_id"] is not None], texts, items)
    none = decontam.hit_summary(awkward(spark), bench.limit(0), ["doc_id"]).collect()
    assert len(none) == 15 and not any(r["contaminated"] for r in none)
    assert decontam.hit_summary(empty(spark), bench, ["doc_id"]).collect() == []


def test_mixing_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "a b c " * rng.randrange(1, 60), rng.choice(["en"] * 8 + ["de", "fr"]), rng.choice(["s0"] * 6 + ["s1", "s2"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs).cache()
    assert mixed.count() == 3000
    share = lambda df, by, w: {r[0]: r[1] for r in df.groupBy(by).agg(F.sum(w)).collect()}
    for by in ("lang", "source", "topic"):
        own = share(mixed, by, "n_tokens")
        scale = sum(own.values()) / sum(v**mixing.TEMPER for v in own.values())
        raked = share(mixed, by, F.col("n_tokens") * F.col("weight"))
        total = sum(raked.values())
        for k, v in own.items():
            assert raked[k] / total == pytest.approx(v**mixing.TEMPER * scale / sum(own.values()), rel=0.03)
        expected, got = share(mixed, by, F.col("n_tokens") * F.col("keep_prob")), share(mixed.where("kept"), by, "n_tokens")
        for k in own:
            assert got.get(k, 0) == pytest.approx(expected[k], rel=0.25)
    assert mixed.agg(F.max("keep_prob")).first()[0] == pytest.approx(1.0)
    assert mixing.mix(docs).where("kept").count() == mixed.where("kept").count()


def plain_raking(cells, targets, rounds=500):
    """cells: (source, lang, topic) -> tokens; targets: one dict of tokens for each of the three."""
    w = {c: float(t) for c, t in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            whole = Counter()
            for c, x in w.items():
                whole[c[d]] += x
            w = {c: x * targets[d].get(c[d], 0) / whole[c[d]] if whole[c[d]] else 0.0 for c, x in w.items()}
    return w


def test_raking_to_given_targets_equals_brute_force(spark):
    rng = random.Random(6)
    cells = {(s, la, t): rng.randrange(1, 2000) for s in ("=a", "=b", "null") for la in ("=en", "=de", "=fr") for t in ("=x", "=y") if rng.random() < 0.9}
    total = sum(cells.values())
    frame = spark.createDataFrame([(*c, n) for c, n in cells.items()], "__source string, __lang string, __topic string, tokens long")
    wanted = spark.createDataFrame([("source", "a", 3.0), ("source", "b", 1.0), ("source", None, 1.0), ("source", "absent", 9.0), ("lang", "en", 0.5), ("lang", "de", 0.5)], "dimension string, value string, share double")
    got = mixing.raked(frame, wanted).cache()
    own = Counter()
    for c, n in cells.items():
        own[c[2]] += n
    scale = total / sum(v**mixing.TEMPER for v in own.values())
    targets = [{"=a": total * 0.6, "=b": total * 0.2, "null": total * 0.2}, {"=en": total / 2, "=de": total / 2}, {k: v**mixing.TEMPER * scale for k, v in own.items()}]
    expected = plain_raking(cells, targets)
    for r in got.collect():
        assert r["w"] == pytest.approx(expected[r["__source"], r["__lang"], r["__topic"]], rel=1e-4, abs=1e-3)
    for r in mixing.marginals(got).collect():
        assert r["w"] == pytest.approx(r["target"], rel=1e-4, abs=1e-3)


def test_targets_that_no_weights_meet_are_told(spark):
    """Source a is German alone, so one of the two targets has to give way; the rounds still end."""
    frame = spark.createDataFrame([("=a", "=de", "=x", 10), ("=b", "=de", "=x", 10), ("=b", "=en", "=x", 10)], "__source string, __lang string, __topic string, tokens long")
    wanted = spark.createDataFrame([("source", "a", 0.9), ("source", "b", 0.1), ("lang", "en", 0.9), ("lang", "de", 0.1)], "dimension string, value string, share double")
    told = mixing.marginals(mixing.raked(frame, wanted)).where("abs(w - target) > 1").count()
    assert told > 0
    assert mixing.mix(empty(spark), targets=wanted).collect() == []


def test_mixing_draws_rows_of_null_or_shared_ids_apart(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"words of text {i}", "en", f"s{i % 3}") for i in range(600)], "doc_id long, text string, lang string, source string")
    wanted = spark.createDataFrame([("source", "s0", 0.5), ("source", "s1", 0.25), ("source", "s2", 0.25)], "dimension string, value string, share double")
    rows = mixing.mix(docs, targets=wanted).collect()
    kept = Counter((r["doc_id"], r["source"]) for r in rows if r["kept"])
    assert all(kept[i, "s0"] == 100 and 25 < kept[i, s] < 75 for i in (None, 7) for s in ("s1", "s2"))


def test_mixing_on_awkward_rows(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == 15 and all(r["weight"] > 0 and isinstance(r["kept"], bool) and r["shard"] == "clash" for r in rows)
    assert mixing.mix(empty(spark)).collect() == []


def test_hypergeometric_law():
    rng = random.Random(5)
    n = 20_000
    drawn = Counter(sharding.draw_hypergeometric(rng.random(), 5, 7, 6) for _ in range(n))
    from math import comb

    for k in range(6):
        p = comb(5, k) * comb(7, 6 - k) / comb(12, 6)
        assert drawn[k] / n == pytest.approx(p, abs=4 * (p * (1 - p) / n) ** 0.5 + 1e-9)
    assert sharding.draw_hypergeometric(0.999999999, 10**9, 10**9, 10**6) > 500_000
    m = sharding.communication_matrix([10, 0, 7, 3], 8, 1)
    assert [sum(line) for line in m] == [10, 0, 7, 3] and sorted(map(sum, zip(*m))) == [2, 2, 2, 2, 3, 3, 3, 3]


def test_sharding(spark):
    rows = QUERIES["op8_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    import zlib

    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode())) and r["grown_shard"] is None for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_sharding_on_awkward_rows(spark):
    rows = sharding.shard_rows(awkward(spark)).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 15 and max(counts.values()) - min(counts.values()) <= 1
    assert sharding.shard_rows(empty(spark)).collect() == []


def test_sharding_of_equal_rows_and_of_maps(spark, monkeypatch):
    """A third of the rows is one row; a map cannot be hashed; small bounds on partitions and blocks."""
    monkeypatch.setattr(sharding, "MAX_PARTS", 64)
    docs = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.create_map(F.lit("a"), F.lit(1)).alias("m.x"), F.lit("z").alias("shard"))
    rows = sharding.shard_rows(docs, rows_per_block=100).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 9000 and set(counts.values()) == {1125} and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(1125))
    nulls = Counter(r["shard"] for r in rows if r["doc_id"] is None)
    assert all(n == pytest.approx(375, abs=90) for n in nulls.values())


def test_sharding_by_brute_force_of_the_law(spark):
    """Over many seeds every way to share four rows between two shards is about as frequent."""
    ways = Counter()
    docs = spark.createDataFrame([(i,) for i in range(4)], "doc_id long").cache()
    for seed in range(48):
        got = sharding.shard_rows(docs, shards=2, seed=seed).collect()
        ways[tuple(sorted(r["doc_id"] for r in got if r["shard"] == 0))] += 1
    assert len(ways) == 6 and max(ways.values()) <= 20


def test_sharding_is_uniform(spark):
    """Pairs of neighbouring ids share a shard about as often as chance has it."""
    rows = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(spark.range(8000).withColumnRenamed("id", "doc_id")).collect()}
    together = sum(rows[i] == rows[i + 1] for i in range(7999)) / 7999
    assert together == pytest.approx(1 / 8, abs=0.02)
