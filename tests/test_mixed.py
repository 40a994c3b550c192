"""Mixed models against dense likelihoods, refits and numerical integrals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import mixed, stats

def model():
    return F.col("y"), {"x": F.col("x")}


def dense(design, y, v, reml=False):
    """Profile (restricted) log-likelihood with relative covariance v."""
    n, p = design.shape
    w = np.linalg.solve(v, design)
    beta = np.linalg.solve(design.T @ w, w.T @ y)
    r, left = y - design @ beta, n - p if reml else n
    s = r @ np.linalg.solve(v, r) / left
    log_det = np.linalg.slogdet(v)[1] + (np.linalg.slogdet(design.T @ w)[1] if reml else 0)
    return -0.5 * (left * (math.log(2 * math.pi * s) + 1) + log_det), beta, s


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    effect = rng.normal(0, 1.5, 18)
    return [(g, g % 3 if i % 2 else (g + i) % 3, float(x), float(1 - x + effect[g] + rng.normal())) for g in range(18) for i, x in enumerate(rng.normal(0, 1, 1 + g % 5))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([*rows, (3, 0, None, 1.0), (4, 1, 1.0, None)], "g int, k int, x double, y double")


def arrays(rows):
    g, k, x, y = (np.array(c) for c in zip(*rows, strict=True))
    return g, k, np.stack([np.ones(len(x)), x], 1), y


def test_both_criteria_of_an_intercept(frame, rows):
    g, _, design, y = arrays(rows)
    same = (g[:, None] == g[None, :]).astype(float)
    fit = mixed.intercept_fit(frame, *model(), "g")
    for own, reml in ((fit.reml, True), (fit.ml, False)):
        ratio = (own.group_sigma / own.sigma) ** 2
        ll, beta, s = dense(design, y, np.eye(len(y)) + ratio * same, reml)
        assert own.log_likelihood == pytest.approx(ll, abs=1e-6) and own.coefficients == pytest.approx(beta, abs=1e-8) and own.sigma**2 == pytest.approx(s, rel=1e-8)
        near = [dense(design, y, np.eye(len(y)) + ratio * z * same, reml)[0] for z in (0.9, 0.99, 1.01, 1.1)]
        assert ll >= max(near)
    assert fit.reml.group_sigma > fit.ml.group_sigma
    plain = stats.mixed_fit(frame, *model(), "g")
    assert fit.ml.log_likelihood == pytest.approx(plain.log_likelihood, abs=1e-7)


@pytest.mark.parametrize("ratio", [None, 0.0, 0.7])
def test_held_out_scores_like_refits(spark, frame, rows, ratio):
    g, k, design, y = arrays(rows)
    same = (g[:, None] == g[None, :]).astype(float)
    for r in mixed.held_out(frame, "k", *model(), "g", ratio=ratio):
        train = k != r["fold"]
        own = spark.createDataFrame([x for x in rows if x[1] != r["fold"]], "g int, k int, x double, y double")
        if ratio is None:
            fit = mixed.intercept_fit(own, *model(), "g").ml
            t = (fit.group_sigma / fit.sigma) ** 2
            assert r["sigma"] == pytest.approx(fit.sigma, rel=1e-5)
        else:
            t = ratio
        v = np.eye(len(y)) + t * same
        _, beta, s = dense(design[train], y[train], v[np.ix_(train, train)])
        full = lambda m, b=beta, s=s, v=v: -0.5 * (m.sum() * math.log(2 * math.pi * s) + np.linalg.slogdet(v[np.ix_(m, m)])[1] + (z := y[m] - design[m] @ b) @ np.linalg.solve(v[np.ix_(m, m)], z) / s)
        assert r["log_likelihood"] == pytest.approx(full(train | True) - full(train), abs=1e-5)
        assert r["mse"] == pytest.approx(np.mean((y[~train] - design[~train] @ beta) ** 2), rel=1e-5) and r["n"] == (~train).sum()


@pytest.mark.parametrize("reml", [False, True])
def test_crossed_groups_like_a_dense_likelihood(spark, reml):
    rng = np.random.default_rng(7)
    item, worker = rng.normal(0, 0.8, 6), rng.normal(0, 1.4, 25)
    rows = [(i, w, float(x), float(2 + 0.5 * x + item[i] + worker[w] + rng.normal())) for w in range(25) for i in range(6) if (i + w) % 4 for x in rng.normal(0, 1, 1 + w % 3)]
    frame = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0)], "item int, worker int, x double, y double")
    i, w, design, y = arrays(rows)
    a, b = (i[:, None] == i[None, :]).astype(float), (w[:, None] == w[None, :]).astype(float)
    fit = mixed.crossed_fit(frame, *model(), ("item", "worker"), reml)
    turned = mixed.crossed_fit(frame, *model(), ("worker", "item"), reml)
    assert turned.group_sigma == pytest.approx(fit.group_sigma[::-1]) and turned.log_likelihood == pytest.approx(fit.log_likelihood, abs=1e-9)
    s, t = ((x / fit.sigma) ** 2 for x in fit.group_sigma)
    ll, beta, variance = dense(design, y, np.eye(len(y)) + s * a + t * b, reml)
    assert fit.log_likelihood == pytest.approx(ll, abs=1e-6) and fit.coefficients == pytest.approx(beta, abs=1e-7) and fit.sigma**2 == pytest.approx(variance, rel=1e-7)
    near = [dense(design, y, np.eye(len(y)) + s * u * a + t * v * b, reml)[0] for u in (0.95, 1, 1.05) for v in (0.95, 1, 1.05)]
    assert max(near) <= ll + 1e-9


def test_crossed_groups_are_bounded_on_one_side_only(spark, monkeypatch):
    frame = spark.createDataFrame([(i % 5, i % 7, float(i), float(i * i % 11)) for i in range(70)], "a int, b int, x double, y double")
    monkeypatch.setattr(mixed, "CROSSED_LEVELS", 4)
    with pytest.raises(ValueError, match="5 levels"):
        mixed.crossed_fit(frame, *model(), ("a", "b"))


def test_gamma_intercepts_like_numerical_integrals(spark):
    rng = np.random.default_rng(3)
    effect = rng.normal(0, 0.6, 20)
    rows = [(g, float(x), float(rng.gamma(4.0, math.exp(1 + 0.4 * x + effect[g]) / 4))) for g in range(20) for x in rng.normal(3, 2, 2 + g % 6)]
    frame = spark.createDataFrame([*rows, (1, 1.0, 0.0), (1, None, 2.0)], "g int, x double, y double")
    fit = mixed.gamma_intercept_fit(frame, "y", ["x"], "g")

    def brute(b0, b1, shape, tau):
        u = np.linspace(-8 * tau, 8 * tau, 4001)
        out = 0.0
        for g in range(20):
            x, y = np.array([r[1:] for r in rows if r[0] == g]).T
            eta = b0 + b1 * x[:, None] + u[None, :]
            ll = (shape * math.log(shape) - math.lgamma(shape) + (shape - 1) * np.log(y)[:, None] - shape * eta - shape * y[:, None] * np.exp(-eta)).sum(0) - u * u / (2 * tau**2)
            out += ll.max() + math.log(np.exp(ll - ll.max()).sum() * (u[1] - u[0]) / (math.sqrt(2 * math.pi) * tau))
        return out

    best = (*map(float, fit.coefficients), fit.sigma**-2, fit.group_sigma)
    assert fit.log_likelihood == pytest.approx(brute(*best), abs=1e-6)
    for k in range(4):  # no neighbour is better
        for z in (0.995, 1.005):
            assert brute(*[v * (z if i == k else 1) for i, v in enumerate(best)]) <= fit.log_likelihood + 1e-4
    assert best == pytest.approx((1.0, 0.4, 4.0, 0.6), rel=0.5)
