"""Tables and models for reading-time analyses, from sufficient statistics that Spark sums.

Models never bring rows to the driver: linear fits need one Gram matrix, mixed fits two per size
of a group, summed where the rows are. Groups may be stories or readers, of any number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def analysis_table(rts: DataFrame, surprisal: DataFrame, freqs: DataFrame, iv: DataFrame) -> DataFrame:
    """Reading times with surprisal and frequency of their word and the scores of their sentence, missing ones null,
    and word_length, where the reading times have words."""
    rts = rts.withColumn("word_length", F.length("word")) if "word" in rts.columns else rts
    return rts.join(surprisal, ["item", "zone"], "left").join(freqs, ["item", "zone"], "left").join(iv, ["item", "sentence_id"], "left")


def z_scores(df: DataFrame, columns: list[str], suffix: str = ".x", keep_missing: bool = False) -> DataFrame:
    """`df` with each column less its mean over its sample deviation; missing values become 0, as is the mean, unless kept.

    Mean and deviation are one row, joined to every row; there is no window over all rows.
    """
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    own = df.join(F.broadcast(stats))
    for c in columns:
        z = (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))
        own = own.withColumn(f"{c}{suffix}", z if keep_missing else F.coalesce(z, F.lit(0.0)))
    return own.drop(*[f"__{x}_{c}" for c in columns for x in "ms"])


def fill_missing(df: DataFrame) -> DataFrame:
    """Zero for null in all numeric columns."""
    return df.fillna(0, [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "float", "double", "short")])


def log_frequency(df: DataFrame, freq: str = "freq") -> DataFrame:
    return df.withColumn("log_freq", F.log(F.col(freq) + 1))


def log_frequency_summary(df: DataFrame, freq: str = "freq") -> DataFrame:
    """least, greatest: of the log of freq + 1 over rows that have one; mean_z: the mean of its z-scores, 0 but for rounding."""
    own = z_scores(log_frequency(df.dropna(subset=[freq]), freq), ["log_freq"], "_z", keep_missing=True)
    return own.agg(F.min("log_freq").alias("least"), F.max("log_freq").alias("greatest"), F.avg("log_freq_z").alias("mean_z"))


#: Stories that models are fitted on.
TRAINING_ITEMS = (1, 3, 5, 7, 9)


def training_rows(df: DataFrame, items: tuple[int, ...] = TRAINING_ITEMS, needed: tuple[str, ...] = ("freq",)) -> DataFrame:
    """The rows of the training stories that have what is needed."""
    return df.where(F.col("item").isin(*items)).dropna(subset=[c for c in needed if c in df.columns])


def cell_means(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Means per cell of the numeric columns between two columns, both included."""
    names = df.columns
    span = names[names.index(first) : names.index(last) + 1]
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "float", "double", "short", "decimal")}
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in span if c in numeric and c not in keys])


def log_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin (from 1), low, n: counts of ln(value) in bins of equal width between its extremes; values of 0 or less are left out."""
    logs = df.where(F.col(value) > 0).select(F.log(value).alias("x"))
    ends = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = logs.join(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)) + 1).otherwise(1).cast("int")
    return placed.groupBy(place.alias("bin"), (F.col("lo") + (place - 1) * width).alias("low")).agg(F.count("*").alias("n"))


def _moments(y: Column, xs: list[Column]) -> list[Column]:
    terms = [F.lit(1.0), *xs, y]
    return [F.sum((terms[i] * terms[j]).cast("double")).alias(f"m{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]


def _matrix(row, size: int, name: str = "m") -> np.ndarray:
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = row[f"{name}{i}_{j}"] or 0.0
    return out


@dataclass
class Fit:
    """A fitted model: coefficients (intercept first), log-likelihood, parameters, rows, residual sum of squares."""

    names: list[str]
    coefficients: np.ndarray
    log_likelihood: float
    parameters: int
    n: float
    rss: float
    sigma: float = 0.0
    group_sigma: float = 0.0


def gram(df: DataFrame, y: Column, xs: list[Column]) -> np.ndarray:
    """Sums of products of (1, xs, y) over rows without nulls."""
    used = df
    for c in (y, *xs):
        used = used.where(c.isNotNull())
    return _matrix(used.agg(*_moments(y, xs)).first(), len(xs) + 2)


def linear_fit(df: DataFrame, y: Column, xs: dict[str, Column]) -> Fit:
    """Ordinary least squares from one Gram matrix."""
    m = gram(df, y, list(xs.values()))
    p = len(xs) + 1
    beta = np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=None)[0]
    n, rss = m[0, 0], max(m[p, p] - beta @ m[:p, p], 0.0)
    ll = -0.5 * n * (math.log(2 * math.pi) + math.log(max(rss / max(n, 1), 1e-300)) + 1)
    return Fit(["(Intercept)", *xs], beta, ll, p + 1, n, rss, math.sqrt(rss / max(n - p, 1)))


def mixed_fit(df: DataFrame, y: Column, xs: dict[str, Column], group: str) -> Fit:
    """Maximum likelihood of a Gaussian model with a random intercept per group.

    Given the ratio of the variances, coefficients and likelihood follow from each group's
    moments; the ratio is found by golden section. It weighs groups by their size alone, so what
    they add is summed by size where they are: one row per size of a group reaches the driver.
    """
    used = df
    for c in (y, *xs.values()):
        used = used.where(c.isNotNull())
    p = len(xs) + 1
    own = used.groupBy(group).agg(*_moments(y, list(xs.values())))
    names = [c for c in own.columns if c != group]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    by_size = own.groupBy(F.col("m0_0").alias("size")).agg(F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in names], *[F.sum(F.col(f"m0_{i}") * F.col(f"m0_{j}")).alias(f"o{i}_{j}") for i, j in pairs])
    rows = by_size.collect()
    total = sum((_matrix(r, p + 1) for r in rows), np.zeros((p + 1, p + 1)))
    outer = np.array([_matrix(r, p + 1, "o") for r in rows]).reshape(-1, p + 1, p + 1)
    size, count = (np.array([r[c] for r in rows], float) for c in ("size", "groups"))
    n = total[0, 0]

    def at(ratio: float) -> tuple[float, np.ndarray, float]:
        m = total - np.tensordot(ratio / (1 + ratio * size), outer, 1)
        log_det = float(count @ np.log1p(ratio * size))
        beta = np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=None)[0]
        rss = max(m[p, p] - beta @ m[:p, p], 1e-300)
        return -0.5 * (n * (math.log(2 * math.pi * rss / n) + 1) + log_det), beta, rss

    lo, hi = math.log(1e-8), math.log(1e4)
    inner = (math.sqrt(5) - 1) / 2
    a, b = hi - inner * (hi - lo), lo + inner * (hi - lo)
    fa, fb = at(math.exp(a))[0], at(math.exp(b))[0]
    for _ in range(80):
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - inner * (hi - lo)
            fa = at(math.exp(a))[0]
        else:
            lo, a, fa = a, b, fb
            b = lo + inner * (hi - lo)
            fb = at(math.exp(b))[0]
    best = max((0.0, math.exp((lo + hi) / 2)), key=lambda r: at(r)[0])
    ll, beta, rss = at(best)
    sigma = math.sqrt(rss / n)
    return Fit(["(Intercept)", *xs], beta, ll, p + 2, n, rss, sigma, sigma * math.sqrt(best))


def gamma_fit(df: DataFrame, y: str, xs: list[str]):
    """Gamma regression with log link, fixed effects only: Spark has no random effects for it, and this is not one."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=xs, outputCol="features").transform(df.dropna(subset=[y, *xs]).where(F.col(y) > 0))
    return GeneralizedLinearRegression(family="gamma", link="log", labelCol=y).fit(rows)


def chi_square_tail(x: float, df: int) -> float:
    """Probability that a chi-square variable with df degrees exceeds x."""
    if x <= 0:
        return 1.0
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    # Q(df/2, x/2) by upward recurrence from the first one or two.
    a, h = (0.5, math.erfc(math.sqrt(x / 2))) if df % 2 else (1.0, math.exp(-x / 2))
    while a < df / 2 - 1e-9:
        h += math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1))
        a += 1
    return min(1.0, h)


def likelihood_ratio(small: Fit, large: Fit) -> dict[str, float]:
    """Test of nested models that were fitted by maximum likelihood to the same rows."""
    statistic, df = 2 * (large.log_likelihood - small.log_likelihood), large.parameters - small.parameters
    return {"chi_square": statistic, "df": df, "p": chi_square_tail(statistic, df)}


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def f_test(small: Fit, large: Fit) -> dict[str, float]:
    """Analysis of variance of nested linear models."""
    df1, df2 = len(large.coefficients) - len(small.coefficients), large.n - len(large.coefficients)
    f = ((small.rss - large.rss) / df1) / (large.rss / df2)
    return {"f": f, "df1": df1, "df2": df2, "p": incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * max(f, 0.0)))}


def describe_shape(df: DataFrame, value: str) -> dict[str, float]:
    """n, mean, deviation, bias-corrected skewness and (non-excess) kurtosis."""
    r = df.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.skewness(value).alias("g"), F.kurtosis(value).alias("k")).first()
    n, g, k = r["n"], r["g"], r["k"]
    if n < 4 or g is None:
        return {"n": n, "mean": r["m"], "sd": r["s"], "skewness": None, "kurtosis": None}
    skew = g * math.sqrt(n * (n - 1)) / (n - 2)
    return {"n": n, "mean": r["m"], "sd": r["s"], "skewness": skew, "kurtosis": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6) + 3}


def bootstrap_shape(values: np.ndarray, replicates: int = 500, seed: int = 42) -> np.ndarray:
    """(skewness, kurtosis) of resamples of a bounded sample."""
    rng = np.random.default_rng(seed)
    x = values[rng.integers(0, len(values), (replicates, len(values)))]
    d = x - x.mean(1, keepdims=True)
    v = (d**2).mean(1)
    return np.stack([(d**3).mean(1) / v**1.5, (d**4).mean(1) / v**2], 1)


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf(float(x)) for x in p])


def shapiro_wilk(values: np.ndarray) -> dict[str, float]:
    """W and its p-value for a sample of 12 to 5000 values, by Royston's approximation."""
    from statistics import NormalDist

    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 12 <= n <= 5000 or x[0] == x[-1]:
        raise ValueError("12 to 5000 values that differ are needed")
    m = _normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    norm, u = m @ m, 1 / math.sqrt(n)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(norm)], u)
    prior = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(norm)], u)
    phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prior**2)
    a = m / math.sqrt(phi)
    a[[-1, 0]], a[[-2, 1]] = (last, -last), (prior, -prior)
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    ln = math.log(n)
    mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return {"w": w, "p": 1 - NormalDist().cdf((math.log(max(1 - w, 1e-300)) - mu) / sigma)}


def first_values(df: DataFrame, value: str, order: list[str], n: int = 5000) -> np.ndarray:
    """The first n values in a stated order (a bounded sample, as the test that takes it is)."""
    return np.array([r[0] for r in df.where(F.col(value).isNotNull()).orderBy(*order).limit(n).select(value).collect()], float)


def leave_one_out(df: DataFrame, fold: str, y: Column, xs: dict[str, Column]) -> list[dict]:
    """Per fold: rows, and mean squared error of the linear model that was fitted without it.

    All folds come from one pass: the matrix without a fold is the sum less the fold's own.
    """
    used = df
    for c in (y, *xs.values()):
        used = used.where(c.isNotNull())
    p = len(xs) + 1
    own = {r[fold]: _matrix(r, p + 1) for r in used.groupBy(fold).agg(*_moments(y, list(xs.values()))).collect()}
    total, out = sum(own.values()), []
    for k in sorted(own):
        m, test = total - own[k], own[k]
        beta = np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=None)[0]
        error = test[p, p] - 2 * beta @ test[:p, p] + beta @ test[:p, :p] @ beta
        out.append({"fold": k, "n": test[0, 0], "mse": max(error, 0.0) / max(test[0, 0], 1)})
    return out
