"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier on surface features gives each document its evidence, a log-likelihood
ratio. Soft counts of good documents are then summed per host and per path of a host (grouped
aggregation). Rates are shrunk level by level: a path toward its host, a host toward the
corpus, each by a beta prior whose strength is the method-of-moments estimate of how much the
groups of that level really differ, so that sparse sites rest on their parents. The posterior of
a document combines its evidence with the rate of its path without the document itself (its own soft
count is taken out of its path and host), so its evidence counts once. Any columns can be host and
path; the registered query and the pipeline have the source as host and the language as path, as the
documents have no urls.

The classifier is fitted on a sample of at most TRAINED labelled documents (by hash); all
counts cover all documents.

Defined cases: a null or empty text has the features of no words; null hosts and paths are "";
labels without a quality are ignored, several labels of a document are averaged; without
labels of both kinds the evidence is 0 and every document is kept. Repeated rows each count and
each come back. An empty table gives an empty result. Other columns pass through, those with
the names of a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, shielded

#: Labelled documents that the classifier is fitted on at most.
TRAINED = 20_000
#: Documents with a posterior below this are rejected.
THRESHOLD = 0.5
#: Bounds of a prior's strength in pseudo-documents, and of the evidence of one document.
MIN_STRENGTH, MAX_STRENGTH, MAX_EVIDENCE = 2.0, 10_000.0, 12.0
#: Frequent words of English, French, German and Spanish (fixed values).
FREQUENT = frozenset(
    "the of and to a in is that it was for on are as with be by this at from or an he she they not have "
    "le la les de des du et un une en que qui est dans pour pas sur au aux par avec ce il elle "
    "der die das und ist von zu mit den dem ein eine nicht für auf im sich des auch als es "
    "el los las y en un una que del por con para se no su al lo como más".split()
)
RESULT = ["evidence", "host_rate", "site_rate", "prior_rate", "score", "kept"]


def features(text: str | None) -> list[float]:
    """Shares that tell running text from tables, shouting, noise and loops; all lie in [0, 1] or near it."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    per = 1.0 / max(1, n)
    marks = sum(map(text.count, "#*$%&|<>"))
    return [
        math.log1p(n) / 10,
        min(20.0, (chars - n) * per) / 20,
        marks * per,
        marks / chars,
        text.count("|") * per,
        text.count("!") * per,
        sum(map(str.isupper, words)) * per,
        sum(map(FREQUENT.__contains__, map(str.lower, words))) * per,
        sum(map(eq, words, words[1:])) * per,
        len(set(words)) * per,
        len({x for x in zip(words, words[1:], strict=False)}) * per,
        sum(map(str.isalpha, words)) * per,
        sum(map(str.isdigit, words)) * per,
        text.count("\n") * per,
    ]


class Classifier:
    """Ridge logistic regression on standardised features, with squares; fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25):
        x = self._wide(x)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        self.w = np.zeros(z.shape[1])
        penalty = ridge * len(x) * np.eye(len(self.w))
        penalty[0, 0] = 0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            curve = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * curve[:, None]).T @ z + penalty + 1e-9 * np.eye(len(self.w)), z.T @ (y - p) - penalty @ self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.prior = math.log(rate / (1 - rate))

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.c_[x, x**2]

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = (self._wide(x) - self.mean) / self.scale
        return np.clip(self.w[0] + z @ self.w[1:] - self.prior, -MAX_EVIDENCE, MAX_EVIDENCE)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, quality: str) -> Classifier | None:
    """A classifier from a bounded sample of labelled documents, or None without labels of both kinds."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    own = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(F.col(quality).cast("double")).alias("__y"))
    sample = own.orderBy(F.xxhash64(key), key).limit(TRAINED)  # the bound is documented
    rows = docs.select(key, text).join(F.broadcast(sample), key).select(of(text).alias("x"), "__y").limit(2 * TRAINED).collect()
    y = np.array([float(r["__y"] >= 0.5) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return Classifier(np.array([r["x"] for r in rows]), y)


def with_evidence(docs: DataFrame, model: Classifier | None, text: str) -> DataFrame:
    if model is None:
        return docs.withColumn("evidence", F.lit(0.0))

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(model.evidence(np.array([features(t) for t in texts]).reshape(len(texts), -1)))

    return docs.withColumn("evidence", evidence(F.coalesce(F.col(text), F.lit(""))))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parent_rate: Column) -> float:
    """Pseudo-documents of the beta prior of a level: how little its groups differ from their parents beyond chance."""
    rate = F.col("good") / F.col("n")
    spread = parent_rate * (1 - parent_rate)
    row = groups.agg(
        F.sum(F.col("n") * spread).alias("within"),
        F.sum(F.col("n") * (rate - parent_rate) ** 2).alias("around"),
        F.sum(spread).alias("chance"),
        F.sum("n").alias("n"),
    ).first()
    if not row["n"] or not row["within"]:
        return MAX_STRENGTH
    between = max((row["around"] - row["chance"]) / row["n"], 1e-12)
    return min(max(row["within"] / row["n"] / between - 1, MIN_STRENGTH), MAX_STRENGTH)


def site_rates(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """host, path, host_rate, site_rate (shrunk) and sums, and the rate of a document's path without the
    document, as an expression over its evidence and those columns."""
    logit = scored_prior(scored)
    soft = lambda evidence: 1 / (1 + F.exp(-evidence - F.lit(logit)))
    good = soft(F.col("evidence"))
    paths = materialize(scored.select(host, path, good.alias("p")).groupBy(host, path).agg(F.sum("p").alias("good"), F.count("*").cast("double").alias("n")), "paths")
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    corpus = (total["good"] / total["n"]) if total["n"] else 0.5
    hosts = paths.groupBy(host).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    k_host = _strength(hosts, F.lit(corpus))
    shrunk = lambda good, n, k, parent: (good + k * parent) / (n + k)
    hosts = hosts.select(host, shrunk(F.col("good"), F.col("n"), k_host, F.lit(corpus)).alias("host_rate"), F.col("good").alias("__host_good"), F.col("n").alias("__host_n"))
    joined = paths.join(hosts, host)
    k_path = _strength(joined, F.col("host_rate"))
    rates = joined.select(host, path, "host_rate", shrunk(F.col("good"), F.col("n"), k_path, F.col("host_rate")).alias("site_rate"), F.col("good").alias("__good"), F.col("n").alias("__n"), "__host_good", "__host_n")

    def without(evidence: Column) -> Column:
        own = soft(evidence)
        above = shrunk(F.greatest(F.col("__host_good") - own, F.lit(0.0)), F.col("__host_n") - 1, k_host, F.lit(corpus))
        return shrunk(F.greatest(F.col("__good") - own, F.lit(0.0)), F.col("__n") - 1, k_path, above)

    return rates, without


def scored_prior(scored: DataFrame) -> float:
    """The log odds of a good document in the corpus, by a few steps of expectation maximisation over all documents."""
    logit = 0.0
    for _ in range(EM_STEPS):
        rate = scored.agg(F.avg(1 / (1 + F.exp(-F.col("evidence") - F.lit(logit))))).first()[0]
        rate = min(max(rate if rate is not None else 0.5, 1e-4), 1 - 1e-4)
        logit = math.log(rate / (1 - rate))
    return logit


EM_STEPS = 3


def site_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", quality: str = "quality", keep_text: bool = True
) -> DataFrame:
    """`docs` with evidence, host_rate and site_rate (of all documents), prior_rate (of the site without the
    document), score (posterior of good quality) and kept."""
    model = fit(docs, labels, key, text, quality)
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    scored = with_evidence(docs.select(*kept), model, text)
    scored = scored.withColumns({"__site": F.coalesce(F.col(host).cast("string"), F.lit("")), "__path": F.coalesce(F.col(path).cast("string"), F.lit(""))})
    scored = materialize(scored if keep_text else scored.drop(text), "evidence")
    rates, without = site_rates(scored, "__site", "__path")
    out = attach(scored, materialize(rates, "rates"), ["__site", "__path"]).withColumn("prior_rate", without(F.col("evidence")))
    score = 1 / (1 + F.exp(-F.col("evidence") - _logit(F.col("prior_rate"))))
    out = out.withColumn("score", score).withColumn("kept", F.lit(True) if model is None else F.col("score") >= THRESHOLD)
    return out.drop("__site", "__path", "__good", "__n", "__host_good", "__host_n")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a url, for tables that have urls."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*/([^/?#]*)", 1)


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with the columns of `docs`."""
    return shielded(docs, {*RESULT}, lambda own: site_quality(own, labels).where("kept"))


def op3_site_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality(docs, labels, keep_text=False).select("doc_id", "source", "lang", *RESULT)
