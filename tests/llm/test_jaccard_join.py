"""Long lists: cut in the first round, dealt as cells in the second; counts that are summed in parts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import brute, prose

from spanwright.llm import jaccard_join


def families(seed):
    """Families of near copies around a common passage, so that lists are long and hold several components."""
    rng = random.Random(seed)
    passage, texts = prose(seed, 50), {}
    for f in range(4):
        base = f"{passage} {prose(100 * seed + f, 25 + 10 * f)}".split()
        for i in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts[1000 * f + i] = " ".join(copy)
    return texts


@pytest.mark.parametrize("percent", [85, 50])
def test_cut_lists_equal_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 15)
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 6)
    texts = families(percent)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, percent=percent).collect()}
    assert got == brute(texts, 4, percent)


def test_hot_rows_meet_the_hub_in_every_part():
    elements = np.array([5, 9], np.uint64)
    hot = jaccard_join.Hot(elements, np.array([3, 4]), np.array([100, 200]))
    keys = {5: set(), 9: set()}
    for group in range(90, 110):
        rows = np.zeros(3, jaccard_join._POSTING)
        rows["key"] = rows["element"] = [5, 7, 9]
        rows["group"] = group
        out = hot.rows(rows)
        assert len(out) == (5 if group == 100 else 3) and out["key"][out["element"] == 7].tolist() == [7]
        for e in keys:
            keys[e] |= set(out["key"][(out["element"] == e)].tolist())
        if group == 100:
            hub = set(out["key"][out["element"] == 5].tolist())
    assert len(keys[5]) == 3 and len(keys[9]) == 4 and keys[5] == hub


def test_counts_are_summed_over_what_is_handed_on(monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUFFERED", 80)
    rng = np.random.default_rng(1)
    held, out = [], jaccard_join._Counts(np.dtype(np.uint64), 3)
    batches = []
    for _ in range(30):
        rows = rng.integers(0, 40, 7).astype(np.uint64) ** 3
        held.append(rows)
        if out.add(rows):
            batches += list(out.flush())
    batches += list(out.flush())
    elements, n = np.unique(np.concatenate(held), return_counts=True)
    got = {}
    for bucket in range(3):
        own = [b.filter(pa.array([x == bucket for x in b.column("bucket").to_pylist()])) for b in batches]
        got |= dict(zip(*(x.tolist() for x in jaccard_join._summed(own)), strict=True))
    assert got == dict(zip(elements.tolist(), n.tolist(), strict=True))
    assert [len(x) for x in jaccard_join._summed([])] == [0, 0]


def test_overlap_of_very_long_texts(spark):
    from pyspark.sql import functions as F

    from spanwright.llm import jaccard_join

    frame = spark.createDataFrame([(13_000_000, 13_000_000), (2_000_000_000, 2_100_000_000), (4, 5)], "a int, b int")
    got = [r[0] for r in frame.select(jaccard_join.overlap_needed(F.col("a"), F.col("b"), 85)).collect()]
    assert got == [-(-85 * (a + b) // 185) for a, b in [(13_000_000, 13_000_000), (2_000_000_000, 2_100_000_000), (4, 5)]]


def test_nothing_that_was_not_counted_is_broadcast(spark):
    """Spark takes the salted copies of a table, and numbers that compress well, for small enough to broadcast."""
    from spanwright.llm import common

    big = spark.range(40).selectExpr("id % 20 AS k", "id AS v")
    small = common.materialize(spark.range(20).selectExpr("id AS k", "id * 2 AS w"), "small")
    for joined in (common.attach(big, small, ["k"], max_rows=10), big.join(common.bounded(small, 10), "k")):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["v"], r["w"]) for r in joined.collect()) == [(v, v % 20 * 2) for v in range(40)]
    assert "BroadcastHashJoin" in big.join(common.bounded(small, 20), "k")._jdf.queryExecution().executedPlan().toString()


def test_many_rows_take_joins_without_broadcasts(spark, monkeypatch):
    from spanwright.llm import common

    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(common.bounded, "__defaults__", (3,))
    monkeypatch.setattr(common.attach, "__defaults__", ("left", 3))
    texts = families(7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    out = jaccard_join.jaccard_components(df)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute(texts, 4, 85)
