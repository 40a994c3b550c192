"""Nearest neighbours: recall on clustered and unclustered vectors, exact scores, odd tables, groups of lists."""

import numpy as np
import pytest

from spanwright.llm import ivf_pq


def table(spark, x, kind="float"):
    return spark.createDataFrame([(i, v.tolist(), "x", "y", 1) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, list string, code string, id int")


def exact(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return d, np.lexsort((np.arange(len(x)), d))[:k]


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall(spark, monkeypatch, clusters):
    monkeypatch.setattr(ivf_pq, "GROUP", 500)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 24))
    x = x if not clusters else rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 4000)] + 0.2 * x
    x = x.astype(np.float32).astype(np.float64)
    got = ivf_pq.nearest(table(spark, x)).collect()
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & set(exact(x, q)[1].tolist())) for q in range(0, 4000, 100))
    assert hits >= 0.93 * 400


def test_scores_are_those_of_the_original_doubles(spark):
    x = np.random.default_rng(2).normal(size=(300, 6)) * 1e-3 + 1 / 3
    for r in ivf_pq.nearest(table(spark, x, "double")).collect():
        assert r["score"] == pytest.approx(exact(x, r["query_id"])[0][r["vec_id"]], rel=1e-12)


def test_an_id_with_several_vectors_has_the_smallest(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [9.0, 9.0]), (2, [3.0, 3.0])]
    got = ivf_pq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, pytest.approx(8**0.5))]


def test_groups_hold_bounded_lists():
    sizes = np.array([5, 0, 250, 40, 40, 40, 100, 1])
    got = ivf_pq.grouped(sizes, 100)
    assert [w for w, _, _ in got] == [0, 2, 3, 4, 5, 6, 7]
    held = {}
    for w, begin, cuts in got:
        for g in range(begin, begin + cuts):
            held[g] = held.get(g, 0) + sizes[w] / cuts
    assert max(held.values()) <= 100 and sorted(held) == list(range(len(held)))


def dense_group(rng):
    """A third of the rows lie within a thousandth of one place, finer than codewords of the others tell apart."""
    x = rng.normal(size=(3000, 16))
    x[::3] = 2 + 1e-3 * x[::3]
    return x


def several_scales(rng):
    return rng.normal(size=(3000, 16)) * 10.0 ** rng.integers(-4, 3, (3000, 1))


def common_offset(rng):
    return rng.normal(size=(3000, 16)) + 1e7


def huge_values(rng):
    return rng.normal(size=(3000, 16)) * 1e25


def queries_elsewhere(rng):
    """Queries lie far out, around clusters of all other rows."""
    x = rng.normal(size=(200, 16))[rng.integers(0, 200, 4000)] + 0.05 * rng.normal(size=(4000, 16))
    x[::100] = 6 * rng.normal(size=(40, 16))
    return x


@pytest.mark.parametrize("rows", [dense_group, several_scales, common_offset, huge_values, queries_elsewhere])
def test_recall_on_odd_rows(spark, rows):
    x = rows(np.random.default_rng(5))
    got = ivf_pq.nearest(table(spark, x, "double")).collect()
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & set(exact(x, q)[1].tolist())) for q in range(0, len(x), 100))
    assert hits >= 0.93 * 10 * len(range(0, len(x), 100))


def test_reranking_reaches_all_within_the_room_for_errors():
    rng = np.random.default_rng(6)
    y, x = rng.normal(size=(500, 4)), rng.normal(size=4)
    coded = y + 0.3 * rng.normal(size=y.shape)
    error = np.sqrt(((coded - y) ** 2).sum(1)) + 1e-12
    # The codes lie apart from their vectors in any direction, so the square of the error is no part of the distance.
    true = np.sqrt(((y - x) ** 2).sum(1))
    best, score = ivf_pq.rerank(((coded - x) ** 2).sum(1), error, x, y, 10, 10, 1.0)
    assert sorted(best.tolist()) == sorted(np.argsort(true)[:10].tolist()) and score == pytest.approx(true[best])
