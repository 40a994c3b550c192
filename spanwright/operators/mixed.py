"""Mixed models beyond one Gaussian intercept: restricted likelihood, held-out scores, crossed groups, gamma responses.

Rows stay where they are. Gaussian likelihoods depend on a group only through its size and its moments,
so groups of any number are summed by size: the driver holds a few small matrices and searches the variances
on them. The gamma model needs a pass for each step: every group's mode and quadrature are expressions over
its sums, and one row with the likelihood and its slope comes back.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import Fit, _matrix, _moments, linear_fit

#: Levels that the smaller of two crossed groupings may have, and numbers that its sums may hold on the driver.
CROSSED_LEVELS, CROSSED_NUMBERS = 500, 50_000_000
#: Steps of a search for one ratio of variances, and its range.
SEARCH_STEPS, LOW, HIGH = 50, math.log(1e-8), math.log(1e6)


@dataclass
class BySize:
    """Moments of (1, xs, y): their sum over all rows; for each size of a group the number of groups and the sum of outer products of their sums."""

    total: np.ndarray
    size: np.ndarray
    count: np.ndarray
    outer: np.ndarray

    def criterion(self, ratio: float, reml: bool) -> tuple[float, np.ndarray, float]:
        """(likelihood, coefficients, residual variance) at the ratio of the group's variance to the residual one."""
        return _criterion(self.total - np.tensordot(ratio / (1 + ratio * self.size), self.outer, 1), float(self.count @ np.log1p(ratio * self.size)), self.total[0, 0], reml)

    def likelihood(self, beta: np.ndarray, variance: float, ratio: float) -> float:
        """Log-likelihood of all rows at given parameters."""
        m = self.total - np.tensordot(ratio / (1 + ratio * self.size), self.outer, 1)
        r = np.append(-beta, 1.0)
        n, log_det = self.total[0, 0], float(self.count @ np.log1p(ratio * self.size))
        return -0.5 * (n * math.log(2 * math.pi * variance) + log_det + float(r @ m @ r) / variance)


def _criterion(m: np.ndarray, log_det: float, n: float, reml: bool) -> tuple[float, np.ndarray, float]:
    """Profile (restricted) log-likelihood from weighted moments and the log-determinant of the relative covariance."""
    p = len(m) - 1
    beta = np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=None)[0]
    rss = max(float(m[p, p] - beta @ m[:p, p]), 1e-300)
    left = n - p if reml else n
    if reml:
        log_det += float(np.linalg.slogdet(m[:p, :p])[1])
    return -0.5 * (left * (math.log(2 * math.pi * rss / left) + 1) + log_det), beta, rss / left


def _search(f: Callable[[float], float], lo: float = LOW, hi: float = HIGH) -> float:
    """The ratio (0 or between exp(lo) and exp(hi)) that makes f greatest, by a coarse grid and a golden section."""
    grid = np.linspace(lo, hi, 33)
    k = int(np.argmax([f(math.exp(x)) for x in grid]))
    lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    inner = (math.sqrt(5) - 1) / 2
    a, b = hi - inner * (hi - lo), lo + inner * (hi - lo)
    fa, fb = f(math.exp(a)), f(math.exp(b))
    for _ in range(SEARCH_STEPS):
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - inner * (hi - lo)
            fa = f(math.exp(a))
        else:
            lo, a, fa = a, b, fb
            b = lo + inner * (hi - lo)
            fb = f(math.exp(b))
    return max((0.0, math.exp((lo + hi) / 2)), key=f)


def _used(df: DataFrame, *columns: Column) -> DataFrame:
    for c in columns:
        df = df.where(c.isNotNull())
    return df


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _by_size(rows: list, total: np.ndarray, p: int) -> BySize:
    outer = np.array([_matrix(r, p, "o") for r in rows]).reshape(-1, p, p)
    size, count = (np.array([r[c] for r in rows], float) for c in ("size", "groups"))
    return BySize(total, size, count, outer)


def group_sums(df: DataFrame, y: Column, xs: dict[str, Column], group: str) -> BySize:
    """One row for each size of a group reaches the driver."""
    p = len(xs) + 2
    own = _used(df, y, *xs.values()).groupBy(group).agg(*_moments(y, list(xs.values())))
    names = [f"m{i}_{j}" for i, j in _pairs(p)]
    outer = [F.sum(F.col(f"m0_{i}") * F.col(f"m0_{j}")).alias(f"o{i}_{j}") for i, j in _pairs(p)]
    rows = own.groupBy(F.col("m0_0").alias("size")).agg(F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in names], *outer).collect()
    return _by_size(rows, sum((_matrix(r, p) for r in rows), np.zeros((p, p))), p)


def _fitted(sums: BySize, names: list[str], reml: bool) -> Fit:
    ratio = _search(lambda r: sums.criterion(r, reml)[0])
    ll, beta, variance = sums.criterion(ratio, reml)
    left = sums.total[0, 0] - reml * len(beta)
    return Fit(["(Intercept)", *names], beta, ll, len(beta) + 2, sums.total[0, 0], variance * left, math.sqrt(variance), math.sqrt(variance * ratio))


@dataclass
class Nested:
    """A model fitted by restricted likelihood, and the same by plain likelihood, which tests of fixed effects need."""

    reml: Fit
    ml: Fit


def intercept_fit(df: DataFrame, y: Column, xs: dict[str, Column], group: str) -> Nested:
    """Gaussian model with a random intercept for each group, by both criteria from one pass."""
    sums = group_sums(df, y, xs, group)
    return Nested(_fitted(sums, list(xs), True), _fitted(sums, list(xs), False))


def held_out(df: DataFrame, fold: str, y: Column, xs: dict[str, Column], group: str, reml: bool = False, ratio: float | None = None) -> list[dict]:
    """For each fold of a random-intercept model fitted without it: fold, n, log_likelihood, mse, sigma, group_sigma.

    log_likelihood is that of the fold's rows given the others, at the parameters of the others: groups
    that the others know keep what is known of them. mse is of the fixed part. `ratio` of the variances is searched
    for each fold unless given. All folds come from one pass: groups are summed by size, and each
    fold takes out what its rows add. Rows without a fold count for none and are always known.
    """
    p = len(xs) + 2
    names = [f"m{i}_{j}" for i, j in _pairs(p)]
    cells = _used(df, y, *xs.values()).groupBy(F.col(group).alias("__g"), F.col(fold).alias("__f")).agg(*_moments(y, list(xs.values())))
    whole = Window.partitionBy("__g")
    both = cells.select("__g", "__f", *names, *[F.sum(f"m0_{i}").over(whole).alias(f"t{i}") for i in range(p)])
    first = both.groupBy("__g").agg(*[F.first(f"t{i}").alias(f"t{i}") for i in range(p)])
    products = lambda of, sign=F.lit(1): [F.sum(sign * of(i) * of(j)).alias(f"o{i}_{j}") for i, j in _pairs(p)]
    base = first.groupBy(F.col("t0").alias("size")).agg(F.count("*").alias("groups"), *products(lambda i: F.col(f"t{i}"))).collect()
    # A fold takes each of its groups away as it is and puts it back, smaller, without the fold's rows.
    state = lambda sign, left: F.struct(F.lit(sign).alias("sign"), *[(F.col(f"t{i}") - F.col(f"m0_{i}") * left).alias(f"t{i}") for i in range(p)])
    moved = both.where(F.col("__f").isNotNull()).select("__f", F.explode(F.array(state(-1, 0), state(1, 1))).alias("s")).where("s.t0 > 0")
    change = moved.groupBy("__f", F.col("s.t0").alias("size")).agg(F.sum("s.sign").alias("groups"), *products(lambda i: F.col(f"s.t{i}"), F.col("s.sign"))).collect()
    folds = {r["__f"]: _matrix(r, p) for r in cells.groupBy("__f").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    total, out = sum(folds.values(), np.zeros((p, p))), []
    every = _by_size(base, total, p)
    for k in sorted(x for x in folds if x is not None):
        own, test = [r for r in change if r["__f"] == k], folds[k]
        train = _by_size([*base, *own], total - test, p)
        best = _search(lambda r, t=train: t.criterion(r, reml)[0]) if ratio is None else ratio
        _, beta, variance = train.criterion(best, reml)
        r = np.append(-beta, 1.0)
        seen = every.likelihood(beta, variance, best) - train.likelihood(beta, variance, best)
        out.append({"fold": k, "n": test[0, 0], "log_likelihood": seen, "mse": float(r @ test @ r) / test[0, 0], "sigma": math.sqrt(variance), "group_sigma": math.sqrt(variance * best)})
    return out


def _polished(f: Callable[[list[float]], float], ratios: list[float], h: float = 1e-4) -> list[float]:
    """Newton's steps in the logarithms of the ratios that are not 0, as long as f grows."""
    on = [i for i, r in enumerate(ratios) if r > 0]

    def at(x: np.ndarray) -> float:
        out = list(ratios)
        for i, v in zip(on, x, strict=True):
            out[i] = math.exp(v)
        return f(out)

    x = np.log([ratios[i] for i in on])
    e = np.eye(len(on)) * h
    for _ in range(8 if on else 0):
        slope = np.array([(at(x + d) - at(x - d)) / (2 * h) for d in e])
        bend = np.array([[(at(x + d + c) - at(x + d - c) - at(x - d + c) + at(x - d - c)) / (4 * h * h) for c in e] for d in e])
        step = -np.linalg.lstsq(bend, slope, rcond=None)[0]
        if np.abs(step).max() > 1 or at(x + step) < at(x) - 1e-9:
            break
        x = x + step
        if np.abs(step).max() < 1e-9:
            break
    for i, v in zip(on, x, strict=True):
        ratios[i] = math.exp(v)
    return ratios


# ---- two crossed groupings


def crossed_fit(df: DataFrame, y: Column, xs: dict[str, Column], groups: tuple[str, str], reml: bool = False) -> Fit:
    """Gaussian model with random intercepts for two groupings that cross, such as stories and readers.

    The grouping with more levels is summed by size, as in `group_sums`; the levels of the other one are
    columns of those sums, so that its effects are solved for with the fixed ones and its variance enters as a
    penalty. That is exact. The smaller grouping may have CROSSED_LEVELS levels (an error beyond); the larger one any
    number. group_sigma of the result holds both deviations, in the order of `groups`.
    """
    used = _used(df, y, *xs.values()).where(F.col(groups[0]).isNotNull() & F.col(groups[1]).isNotNull())
    p = len(xs) + 2
    levels = used.agg(*[F.count_distinct(g).alias(f"n{i}") for i, g in enumerate(groups)]).first()
    few, many = (groups[0], groups[1]) if levels["n0"] <= levels["n1"] else (groups[1], groups[0])
    if min(levels) > CROSSED_LEVELS:
        raise ValueError(f"the smaller grouping has {min(levels)} levels; {CROSSED_LEVELS} are possible")
    cells = used.groupBy(F.col(many).alias("__g"), F.col(few).alias("__l")).agg(*_moments(y, list(xs.values())))
    names = [f"m{i}_{j}" for i, j in _pairs(p)]
    of_level = sorted(cells.groupBy("__l").agg(*[F.sum(c).alias(c) for c in names]).collect(), key=lambda r: r["__l"])
    place, q = {r["__l"]: i for i, r in enumerate(of_level)}, len(of_level)
    sums = [F.sum(f"m0_{i}").alias(f"t{i}") for i in range(p)]
    own = cells.groupBy("__g").agg(*sums, F.collect_list(F.struct(F.col("__l"), F.col("m0_0").alias("n"))).alias("at"))  # at most one for each of the few levels
    size = p + q

    def add(batches):
        by_size: dict[float, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                v = np.array([row[f"t{i}"] for i in range(p)] + [0.0] * q)
                for cell in row["at"]:
                    v[p + place[cell["__l"]]] = cell["n"]
                held = by_size.setdefault(v[0], [0, np.zeros((size, size))])
                held[0] += 1
                held[1] += np.outer(v, v)
        for n, (groups, m) in by_size.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.float64()), pa.array([groups], pa.int64()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["size", "groups", "m"])

    parts = own.mapInArrow(add, "size double, groups long, m array<double>")
    together = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda u, v: u + v))
    added = F.aggregate(F.collect_list("m"), F.array().cast("array<double>"), together)  # one array for each task
    by_size = parts.groupBy("size").agg(F.sum("groups").alias("groups"), added.alias("m"))
    if by_size.count() * size * size > CROSSED_NUMBERS:
        raise ValueError(f"groups of too many sizes for {q} levels of the smaller grouping")
    rows = by_size.collect()
    raw = np.zeros((size, size))
    for i, r in enumerate(of_level):
        m = _matrix(r, p)
        raw[:p, :p] += m
        raw[p + i, :p] = raw[:p, p + i] = m[0]
        raw[p + i, p + i] = m[0, 0]
    every = BySize(raw, np.array([r["size"] for r in rows]), np.array([float(r["groups"]) for r in rows]), np.array([r["m"] for r in rows]).reshape(-1, size, size))

    def at(ratio: float, other: float) -> tuple[float, np.ndarray, float]:
        """ratio: of the many levels' variance, other: of the few ones'."""
        m = every.total - np.tensordot(ratio / (1 + ratio * every.size), every.outer, 1)
        inner = np.eye(q) + other * m[p:, p:]
        left = m[:p, :p] - other * m[:p, p:] @ np.linalg.solve(inner, m[p:, :p])
        log_det = float(every.count @ np.log1p(ratio * every.size)) + float(np.linalg.slogdet(inner)[1])
        return _criterion(left, log_det, raw[0, 0], reml)

    ratio, other, best = 1.0, 1.0, -math.inf
    for _ in range(20):  # by turns, then Newton's steps for both
        other = _search(lambda r, a=ratio: at(a, r)[0])
        ratio = _search(lambda r, b=other: at(r, b)[0])
        now = at(ratio, other)[0]
        if now - best < 1e-4:
            break
        best = now
    ratio, other = _polished(lambda v: at(*v)[0], [ratio, other])
    ll, beta, variance = at(ratio, other)
    sigmas = {many: math.sqrt(variance * ratio), few: math.sqrt(variance * other)}
    fit = Fit(["(Intercept)", *xs], beta, ll, len(beta) + 3, raw[0, 0], variance * (raw[0, 0] - reml * len(beta)), math.sqrt(variance))
    return replace(fit, group_sigma=tuple(sigmas[g] for g in groups))


# ---- gamma responses


def _bound(values: list[Column], body: Callable[..., Column]) -> Column:
    """`body` over values that are computed once."""
    one = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(one, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def _group_integral(n: Column, s: Column, shape: float, tau: float, nodes: int) -> Column:
    """struct<ll, e, uu>: log of the integral over u of exp(shape (-n u - s exp(-u))) times the normal density of u, and
    the means of exp(-u) and of u squared under it, by adaptive Gauss-Hermite quadrature around the mode."""
    spot, weight = np.polynomial.hermite.hermgauss(nodes)
    spots = F.array(*[F.struct(F.lit(float(z)).alias("z"), F.lit(float(math.log(w) + z * z)).alias("w")) for z, w in zip(spot, weight, strict=True)])
    precision = 1 / tau**2
    begin = F.log(s / n) * (shape * n / (shape * n + precision))
    slope = lambda u: shape * (s * F.exp(-u) - n) - u * precision
    bend = lambda u: shape * s * F.exp(-u) + precision  # noqa: E731  of the negative
    mode = F.aggregate(F.sequence(F.lit(1), F.lit(25)), begin, lambda u, _: u + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), slope(u) / bend(u))))
    height = lambda u: shape * (-n * u - s * F.exp(-u)) - u * u * (precision / 2)

    def around(u0: Column) -> Column:
        def terms(top: Column, wide: Column) -> Column:
            def one(x: Column) -> Column:
                u = u0 + math.sqrt(2) * wide * x["z"]
                return F.struct(F.exp(height(u) - top + x["w"]).alias("p"), u.alias("u"))

            def sums(t: Column) -> Column:
                total = lambda f: F.aggregate(t, F.lit(0.0), lambda a, x: a + f(x))
                return _bound([total(lambda x: x["p"])], lambda z: F.struct(
                    (top + F.log(z) + F.log(math.sqrt(2) * wide) - math.log(math.sqrt(2 * math.pi) * tau)).alias("ll"),
                    (total(lambda x: x["p"] * F.exp(-x["u"])) / z).alias("e"), (total(lambda x: x["p"] * x["u"] * x["u"]) / z).alias("uu"), (total(lambda x: x["p"] * x["u"]) / z).alias("u"),
                ))

            return _bound([F.transform(spots, one)], sums)

        return _bound([height(u0), 1 / F.sqrt(bend(u0))], terms)

    return _bound([mode], around)


def _digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def gamma_intercept_fit(df: DataFrame, y: str, xs: list[str], group: str, nodes: int = 15, steps: int = 60) -> Fit:
    """Gamma model with log link and a normal random intercept for each group, by maximum likelihood.

    Given the coefficients, a group's part of the likelihood depends on its number of rows and the sum of
    y exp(-xb) alone: its integral over the intercept is adaptive quadrature around the mode (nodes = 1: Laplace), an
    expression over grouped sums. Quasi-Newton steps on the driver see one row each: the likelihood and its slope.
    Rows with nulls or y of 0 or less are left out. sigma is 1 / sqrt(shape), group_sigma that of the intercepts.
    """
    own = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)])
    own = own.dropna(subset=["y", *[f"x{k}" for k in range(len(xs))]]).where("y > 0")
    raw = own.agg(*[f(f"x{k}").alias(f"{c}{k}") for k in range(len(xs)) for c, f in (("m", F.avg), ("s", F.stddev_samp))], F.count("*").alias("n")).first()
    if not raw["n"]:
        raise ValueError("no rows with a positive response")
    middle, scale = [raw[f"m{k}"] for k in range(len(xs))], [raw[f"s{k}"] or 1.0 for k in range(len(xs))]
    own = own.select("g", "y", *[((F.col(f"x{k}") - middle[k]) / scale[k]).alias(f"x{k}") for k in range(len(xs))]).persist(StorageLevel.DISK_ONLY)
    try:
        columns = [f"x{k}" for k in range(len(xs))]
        begin = linear_fit(own, F.log("y"), {c: F.col(c) for c in columns})
        p, n = len(xs) + 1, float(raw["n"])
        groups = own.select("g").distinct().count()
        x0 = np.concatenate([begin.coefficients, [-2 * math.log(max(begin.sigma, 1e-3)), math.log(max(begin.sigma, 1e-3) / 2)]])

        def at(v: np.ndarray) -> tuple[float, np.ndarray]:
            """The likelihood's negative and its slope."""
            beta, shape, tau = v[:p], math.exp(v[p]), math.exp(v[p + 1])
            eta = sum((float(b) * F.col(c) for b, c in zip(beta[1:], columns, strict=True)), F.lit(float(beta[0])))
            part = own.select("g", "y", eta.alias("eta"), (F.col("y") * F.exp(-eta)).alias("w"), *columns)
            sums = [F.sum(c).alias(f"a{k}") for k, c in enumerate(columns, 1)] + [F.sum(F.col("w") * F.col(c)).alias(f"b{k}") for k, c in enumerate(columns, 1)]
            by = part.groupBy("g").agg(F.count("*").cast("double").alias("n"), F.sum("w").alias("s"), F.sum("eta").alias("eta"), F.sum(F.log("y")).alias("ly"), *sums)
            by = by.withColumn("q", _group_integral(F.col("n"), F.col("s"), shape, tau, nodes))
            slopes = [F.sum(shape * (F.col("q.e") * F.col("s" if k == 0 else f"b{k}") - F.col("n" if k == 0 else f"a{k}"))).alias(f"d{k}") for k in range(p)]
            inner = F.sum(F.col("ly") - F.col("eta") - F.col("n") * F.col("q.u") - F.col("s") * F.col("q.e")).alias("da")
            r = by.agg(F.sum("q.ll").alias("ll"), F.sum("ly").alias("ly"), F.sum("eta").alias("eta"), F.sum("q.uu").alias("uu"), inner, *slopes).first()
            ll = r["ll"] + (shape - 1) * r["ly"] - shape * r["eta"] + n * (shape * math.log(shape) - math.lgamma(shape))
            slope = [r[f"d{k}"] for k in range(p)] + [shape * (r["da"] + n * (math.log(shape) + 1 - _digamma(shape))), r["uu"] / tau**2 - groups]
            return -ll, -np.array(slope)

        inverse = np.diag([1 / (n * math.exp(x0[p]))] * p + [1 / n, 1 / (2 * groups)])
        best, f = _climb(at, x0, inverse, steps)
    finally:
        own.unpersist()
    beta = best[:p].copy()
    beta[1:] /= scale
    beta[0] -= float(beta[1:] @ np.array(middle)) if xs else 0.0
    return Fit(["(Intercept)", *xs], beta, -f, p + 2, n, math.nan, math.exp(-best[p] / 2), math.exp(best[p + 1]))


def _climb(at: Callable, x: np.ndarray, inverse: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Quasi-Newton descent (BFGS) with halved steps."""
    f, d = at(x)
    for _ in range(steps):
        way = -inverse @ d
        way *= min(1.0, 2.0 / max(np.abs(way).max(), 1e-300))
        if -(way @ d) < 1e-12 * (1 + abs(f)):
            break
        step = 1.0
        while True:
            g, e = at(x + step * way)
            if g <= f + 1e-4 * step * (way @ d) or step < 1e-6:
                break
            step /= 2
        if g >= f:
            break
        s, t = step * way, e - d
        x, f, d = x + s, g, e
        if (st := s @ t) > 1e-14:
            left = np.eye(len(x)) - np.outer(s, t) / st
            inverse = left @ inverse @ left.T + np.outer(s, s) / st
    return x, f
