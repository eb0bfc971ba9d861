"""The parity-sketch join and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import parity_join
from lakeloom.llm.common import table
from lakeloom.llm.queries import QUERIES
from lakeloom.llm.textvec import Words, runs_of, slices

from .helpers import SF, ascii_lower, awkward, components, empty, hits, shingle_set, space_words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \n\t,", max_size=30)), max_size=8), st.integers(1, 5))
def test_words_and_shingles(texts, k):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = []
    for _, data, ends in slices(batch, "text", 20):
        words = Words(data, ends)
        runs, number = runs_of(words, k)
        assert [words.text(i) for i in range(len(words.hash))] == [w for t in texts[len(got) : len(got) + len(ends)] for w in space_words(t)]
        got += [list(x) for x in np.split(runs, np.cumsum(number)[:-1])] if len(number) else []
    plain = [[w[j : j + k] for j in range(max(1, len(w) - k + 1))] if (w := space_words(ascii_lower(t))) else [] for t in texts]
    assert [len(x) for x in got] == [len(x) for x in plain]
    meaning = {}
    for a, b in zip(got, plain):
        for h, s in zip(a, b):
            assert meaning.setdefault(int(h), tuple(s)) == tuple(s)
    assert len(meaning) == len({tuple(s) for x in plain for s in x})


def near(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def test_announcements_meet():
    """Any two linked sets share a bucket key, at all sizes."""
    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (80, 100)):
        for n in [*range(1, 60), 100, 333, 1000, 3000]:
            base = rng.integers(0, 2**64, n, dtype=np.uint64)
            most = int(parity_join.largest_difference(np.array([n]), num, den)[0])
            for drop in {0, most // 2, most}:
                add = most - drop
                other = np.concatenate((base[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)))
                if not len(other):
                    continue
                shared = n - drop
                if den * shared < num * (n + add):
                    continue
                keys = []
                for s in (base, other):
                    s = np.unique(s)
                    size = np.array([len(s)])
                    edges = parity_join.band_edges(len(s))
                    home = int(np.searchsorted(edges, len(s), side="right")) - 1
                    bands = {home} | ({home + 1} if len(s) * den // num >= edges[home + 1] else set())
                    keys.append(set(np.concatenate([parity_join.announced(s, np.zeros(len(s), np.int64), size, np.array([b]), edges, num, den)[0] for b in bands]).tolist()))
                assert keys[0] & keys[1], (num, n, drop, add)


def test_join_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    expected = components(texts)
    for r in QUERIES["op10_jaccard_join"](spark, SF).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(shingle_set(texts[r["doc_id"]], 4)), expected[r["doc_id"]])


def test_join_of_dense_groups(spark):
    """Groups whose members are near the threshold, so that no member stands for all, and one passage in many texts."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts, i = {}, 0
    for size in (60, 40):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(size):
            texts[i := i + 1] = " ".join(near(rng, base, 0.02))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(150):
        texts[i := i + 1] = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 90])))
    expected = components(texts)
    rows = parity_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK_ROWS", 4)
    test_join_of_dense_groups(spark)


def test_salted_buckets_lose_nothing(spark, monkeypatch):
    for name, value in (("HOT_SAMPLE", 1), ("HOT_COUNT", 3), ("SALTS", 3), ("BLOCK_ROWS", 8)):
        monkeypatch.setattr(parity_join, name, value)
    test_join_of_dense_groups(spark)


def test_join_on_awkward_rows(spark):
    rows = parity_join.jaccard_components(awkward(spark)).collect()
    assert len(rows) == 15
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    texts = {r["doc_id"]: r["text"] for r in awkward(spark).where("doc_id IS NOT NULL").collect()}
    expected = components(texts)
    assert {i: r["component_id"] for i, r in by.items()} == expected
    assert expected[2] == 1 and expected[11] == 10 and by[3]["n_shingles"] == 0 and by[10]["n_shingles"] == 1
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert parity_join.jaccard_components(empty(spark)).collect() == []


def test_rows_that_share_an_id_but_not_a_text(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, one), (1, two), (1, two), (3, two + " end"), (3, three), (4, three + " end"), (9, one + " end"), (None, one)]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 57, 1), (1, 57, 1), (1, 57, 1), (3, 57, 3), (3, 58, 1), (4, 58, 3), (9, 58, 1)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    got = {r["key"]: r["comp"] for r in parity_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    assert list(stage) == ["quality_rules", "jaccard_join", "decontamination", "mixing", "sharding"]
    kept = {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, SF).where("kept").collect()}
    one = corpus_pipeline.staged(stage["quality_rules"](spark, docs, SF), "t")
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    groups = components(texts, 5, 80, 100)
    two = corpus_pipeline.staged(stage["jaccard_join"](spark, one, SF), "t")
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(i for i, c in groups.items() if i == c)
    three = corpus_pipeline.staged(stage["decontamination"](spark, two, SF), "t")
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(r["doc_id"] for r in two.collect() if not hits(r["text"], items)[1])
    four = corpus_pipeline.staged(stage["mixing"](spark, three, SF), "t")
    assert four.columns == docs.columns and 0 < four.count() <= three.count()
    five = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in five) == sorted(r["doc_id"] for r in four.collect())
    counts = Counter(r["shard"] for r in five)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_near_duplicates_of_rows_that_share_an_id(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(7, one), (7, two), (7, two), (5, two + " end"), (8, three), (None, three), (None, one + " x y z v w u t s r q p o n m l k")]
    out = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[6]], key=repr)


def test_pipeline_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for name, f in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(f(spark, docs, SF), "t")
        assert set(docs.columns) <= set(out.columns)
        if name == "jaccard_join":
            ids = [r["doc_id"] for r in out.collect()]
            assert Counter(ids)[None] == 2 and 2 not in ids and 11 not in ids and {1, 3, 4, 5, 10} <= set(ids)
        if name == "decontamination":
            assert out.count() == 15
        if name != "sharding":
            assert {r["kept"] for r in out.collect()} <= {"clash"}
        assert f(spark, empty(spark), SF).count() == 0


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100)])
def test_difference_bound(num, den):
    rng = random.Random(9)
    for _ in range(2000):
        a, b = rng.randrange(1, 400), rng.randrange(1, 400)
        shared = rng.randrange(0, min(a, b) + 1)
        if den * shared >= num * (a + b - shared):
            t = parity_join.largest_difference(np.array([a, b]), num, den)
            assert a + b - 2 * shared <= t.min()
