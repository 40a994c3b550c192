"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample of the vectors (TRAINED rows, by
hash); every vector is indexed. A vector goes to the list of its nearest centroid and keeps a
code of its residual, one byte per subspace. A query visits its nearest lists. In each it fills
a table of distances between its residual and all codewords and sums table entries over the
list's codes (asymmetric distances). The best codes of all its lists are reranked by exact
distances on the original vectors.

How many lists are visited follows from the data, not from their number: the fewest that hold
COVERED of the true neighbours of CALIBRATING vectors of the sample (within it, which is sparser than
the whole and so errs to more lists), and of as many queries, should these lie elsewhere. Clustered
vectors need a few lists, vectors without clusters many.

How many candidates are reranked follows from them, too. With each code goes its error, the length of
what it leaves of the vector. With d the distance to the code and e its error, the square of the true
distance lies within 2de of dd + ee; near vectors use a part of that room, which is measured on the
sample (`slack_needed`; all of it is exact). The RERANKED best of a list's codes give a bound of the k-th
distance, then all codes whose room reaches below it are reranked as well: many where codes cannot tell
vectors apart (dense groups, several scales), few elsewhere.

Lists are dealt to groups of about GROUP codes (large lists are cut, small ones put together), and the
queries of a group to blocks, so every task has bounded work, even if one list holds a third of all
vectors. Codes and vectors travel to groups, a query's vector once to each of its groups, and the k best
of each back. Of equal vectors only the k + 1 with the smallest ids are indexed: no other can be among
the k nearest of any query, as ties go to smaller ids. Centroids and codes are found around the sample's
mean in double precision, so that a common offset costs no digits.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those without an id or of another length than most (ties: the shorter length);
an id with several vectors has the smallest of them, in the order of arrays. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialize

#: Vectors of the training sample, rounds of k-means, values of a subspace, codewords of each.
TRAINED, ROUNDS, SUBSPACE, CODEWORDS = 20_000, 8, 4, 256
#: Vectors of the sample whose neighbours tell how many lists to visit, and the share of those that must be met;
#: the share of true neighbours within the room for the error of their codes; candidates of a query and group that are reranked at least.
CALIBRATING, COVERED, WITHIN, RERANKED = 256, 0.97, 0.99, 64
MIN_LISTS, MAX_LISTS = 16, 4_096
#: Codes of a group and queries of a block at most; queries that are held against a group at once.
GROUP, BLOCK, AT_ONCE = 16_384, 4_096, 64


def _nearest(x: np.ndarray, centers: np.ndarray, n: int = 1) -> np.ndarray:
    """Indices of the n nearest centers of each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    norms = (centers * centers).sum(1)
    for a in range(0, len(x), 4096):
        d = norms - 2 * x[a : a + 4096] @ centers.T
        if n == 1:
            out[a : a + 4096, 0] = d.argmin(1)
        else:
            out[a : a + 4096] = np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centers = distinct[np.sort(rng.permutation(len(distinct))[:k])].copy()
    for _ in range(rounds if len(centers) == k else 0):
        at = _nearest(x, centers)[:, 0]
        n = np.bincount(at, minlength=len(centers))
        full = n > 0
        sums = np.stack([np.bincount(at, weights=x[:, i], minlength=len(centers)) for i in range(x.shape[1])], axis=1)
        centers[full] = (sums[full] / n[full, None]).astype(x.dtype)
    return centers


class Quantizer:
    """Coarse centroids and a codebook for each subspace of the residuals, around the mean of the sample."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        self.dims = sample.shape[1]
        self.parts = -(-self.dims // SUBSPACE)
        self.mean = sample.mean(0)
        sample = sample - self.mean
        self.centers = k_means(sample, lists, seed)
        residuals = self._cut(sample - self.centers[_nearest(sample, self.centers)[:, 0]])
        self.books = [k_means(np.ascontiguousarray(residuals[:, p]), CODEWORDS, seed + 1 + p) for p in range(self.parts)]

    def _cut(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * SUBSPACE), x.dtype)
        padded[:, : self.dims] = x
        return padded.reshape(len(x), self.parts, SUBSPACE)

    def lists(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of each row."""
        return _nearest(x - self.mean, self.centers, n)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and code of each row, and the length of what these leave."""
        at = self.lists(x)[:, 0]
        left = self._cut(x - self.mean - self.centers[at])
        codes = np.empty((len(x), self.parts), np.uint8)
        for p, book in enumerate(self.books):
            codes[:, p] = _nearest(left[:, p], book)[:, 0]
            left[:, p] -= book[codes[:, p]]
        return at, codes, np.sqrt((left * left).sum((1, 2)))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)[:, : self.dims]

    def tables(self, queries: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of the queries' residuals in a list to all codewords, by subspace."""
        residuals = self._cut(queries - self.mean - self.centers[which])
        out = np.full((len(queries), self.parts, CODEWORDS), np.inf)
        for p, book in enumerate(self.books):
            r = residuals[:, p]
            out[:, p, : len(book)] = (r * r).sum(1)[:, None] - 2 * r @ book.T + (book * book).sum(1)
        return out

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (squared) of the queries to the codes (by subspace) of a list."""
        tables = self.tables(queries, which)
        out = tables[:, 0, codes[0]]
        for p in range(1, len(codes)):
            out += tables[:, p, codes[p]]
        return out


def _neighbours(asked: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest rows of the sample to each asked row, equal ones left out."""
    out = np.empty((len(asked), min(k, max(len(sample) - 1, 0))), np.int64)
    for i, x in enumerate(asked):
        d = ((sample - x) ** 2).sum(1)
        d[d == 0] = np.inf
        out[i] = np.argsort(d, kind="stable")[: out.shape[1]]
    return out


def lists_needed(quantizer: Quantizer, asked: np.ndarray, sample: np.ndarray, near: np.ndarray, covered: float) -> int:
    """The fewest lists that hold `covered` of the rows `near` of the sample that are the asked rows' nearest."""
    if not near.size:
        return 1
    lists = quantizer.lists(sample)[:, 0]
    order = quantizer.lists(asked, len(quantizer.centers))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None], 1)
    return int(np.quantile(np.take_along_axis(rank, lists[near], 1), covered, method="higher")) + 1


def slack_needed(quantizer: Quantizer, asked: np.ndarray, sample: np.ndarray, near: np.ndarray, within: float) -> float:
    """The part of the room for errors, 0 to 1, in which `within` of the nearest rows of the asked ones lie."""
    if not near.size:
        return 1.0
    flat = near.ravel()
    ours, theirs = np.repeat(asked, near.shape[1], axis=0), sample[flat]
    at, codes, error = quantizer.encode(theirs)
    coded = quantizer.mean + quantizer.centers[at] + quantizer.decode(codes)
    d, true = np.sqrt(((ours - coded) ** 2).sum(1)), ((ours - theirs) ** 2).sum(1)
    room = 2 * d * error
    used = np.where(room > 0, (d * d + error * error - true) / np.where(room > 0, room, 1), 0)
    return float(np.clip(np.quantile(used, within, method="higher"), 0, 1))


def grouped(sizes: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(list, its first group, its groups) of lists with these sizes: large ones are cut, small ones share a group."""
    out, group, held = [], 0, 0
    for which, n in enumerate(sizes.tolist()):
        if n > most:
            group += held > 0
            cuts = -(-n // (most // 2 or 1))  # by hash, so that cuts are uneven
            out.append((which, group, cuts))
            group, held = group + cuts, 0
        elif n:
            if held + n > most:
                group, held = group + 1, 0
            out.append((which, group, 1))
            held += n
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v of the vectors that take part, all of one length."""
    v = F.col(vector)
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull() & F.col(key).isNotNull()).where(F.coalesce(fits, F.lit(False)))
    kind = "double" if vectors.schema[vector].dataType.elementType.typeName() == "double" else "float"
    rows = rows.select(F.col(key).cast("long").alias("id"), v.cast(f"array<{kind}>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", covered: float = COVERED, reranked: int = RERANKED) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found for each row whose id `every` divides."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = materialize(usable(vectors, key, vector), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], result)
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(TRAINED).select("v").toArrow().column("v"))  # bounded by TRAINED
    quantizer = Quantizer(sample, min(MAX_LISTS, max(MIN_LISTS, math.isqrt(n))))
    lists, probes, slack = len(quantizer.centers), 1, 0.0
    queries = rows.where(F.col("id") % every == 0)
    asking = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATING).select("v").toArrow().column("v")
    for some in (sample[:CALIBRATING], _matrix(asking).reshape(len(asking), sample.shape[1])):
        near = _neighbours(some, sample, k)
        probes, slack = max(probes, lists_needed(quantizer, some, sample, near, covered)), max(slack, slack_needed(quantizer, some, sample, near, WITHIN))
    shared = spark.sparkContext.broadcast(quantizer)
    kind = rows.schema["v"].dataType.simpleString()

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                at, codes, error = shared.value.encode(_matrix(batch.column("v")))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(at.astype(np.int32)), raw.cast(pa.binary()), pa.array(error)], names=["id", "v", "list", "code", "error"])

    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "v")
    indexed = materialize(first.mapInArrow(index, f"id long, v {kind}, list int, code binary, error double"), "index")
    # How many codes each list holds, and the groups that has them; at most MAX_LISTS rows reach the driver.
    size = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    in_list = np.array([size.get(i, 0) for i in range(lists)], np.int64)
    groups = grouped(in_list, GROUP)
    place = {which: range(begin, begin + cuts) for which, begin, cuts in groups}

    def visits(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                near = shared.value.lists(_matrix(part.column("v")), lists)
                # A query goes on until the lists it visits hold enough, be their number reached or not.
                enough = (np.cumsum(in_list[near], axis=1) <= k).sum(1) + 1
                at, where, which = [], [], []
                for j, (order, m) in enumerate(zip(near, np.minimum(np.maximum(enough, probes), lists).tolist(), strict=True)):
                    own: dict[int, list[int]] = {}
                    for x in order[:m].tolist():
                        for g in place.get(x, ()):
                            own.setdefault(g, []).append(x)
                    at += [j] * len(own)
                    where += own.keys()
                    which += own.values()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("v").take(take), pa.array(where, pa.int64()), pa.array(which, pa.list_(pa.int32()))], names=["id", "v", "group", "lists"])

    asked = materialize(queries.mapInArrow(visits, f"id long, v {kind}, group long, lists array<int>"), "visits")
    blocks = materialize(asked.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    at = F.broadcast(spark.createDataFrame(groups, "list int, begin long, cuts int"))  # a row for each list
    left = indexed.join(at, "list").select("id", "v", "list", "code", "error", (F.col("begin") + F.pmod(F.xxhash64("id"), F.col("cuts"))).alias("group"))
    left = attach(left, blocks, ["group"], "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = attach(asked, blocks, ["group"], "inner").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")

    def search(ours: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if ours.num_rows and asked.num_rows:
            which = ours.column("list").to_numpy()
            order = np.lexsort((ours.column("id").to_numpy(), which))  # so that ties go to smaller ids
            which, ids = which[order], ours.column("id").to_numpy()[order]
            codes = np.frombuffer(b"".join(ours.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order].T.astype(np.int64)
            y, error = _matrix(ours.column("v"))[order], ours.column("error").to_numpy()[order]
            for a in range(0, asked.num_rows, AT_ONCE):
                some = asked.slice(a, AT_ONCE)
                x, q = _matrix(some.column("v")), some.column("id").to_numpy()
                d = np.full((len(q), len(ids)), np.inf)
                visiting: dict[int, list[int]] = {}
                for j, own in enumerate(some.column("lists").to_pylist()):
                    for w in own:
                        visiting.setdefault(w, []).append(j)
                for w, js in visiting.items():
                    lo, hi = np.searchsorted(which, (w, w + 1))
                    if lo < hi:
                        d[np.array(js), lo:hi] = np.maximum(shared.value.distances(x[js], w, codes[:, lo:hi]), 0)
                d[q[:, None] == ids[None]] = np.inf
                for j, row in enumerate(d):
                    best, score = rerank(row, error, x[j], y, k, reranked, slack)
                    found[0].append(np.full(len(best), q[j], np.int64)), found[1].append(ids[best]), found[2].append(score)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, found), strict=True)))

    keys = ["group", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rerank(squares: np.ndarray, error: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, least: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices and exact distances of the k rows of y nearest to x, by squared distances to their codes (infinite: not asked for)."""
    asked = np.flatnonzero(np.isfinite(squares))
    squares, error = squares[asked], error[asked]
    room = squares + error * error
    exact = lambda at: np.sqrt(((y[asked[at]] - x) ** 2).sum(1))
    best = np.arange(len(asked)) if len(asked) <= least else np.sort(_smallest(room, least))
    score = exact(best)
    if len(best) < len(asked):
        bound = np.partition(score, k - 1)[k - 1] ** 2 if len(score) >= k else np.inf
        low = room - 2 * slack * np.sqrt(squares) * error
        low[best] = np.inf
        more = np.flatnonzero(low <= bound * (1 + 1e-9))
        best, score = np.concatenate([best, more]), np.concatenate([score, exact(more)])
    order = np.lexsort((best, score))[:k]
    # Of one list or several, a smaller index is no smaller id: ties with the k-th all stay.
    if len(order) == k:
        order = np.flatnonzero(score <= score[order[-1]])
    return asked[best[order]], score[order]


def _smallest(d: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n smallest values, earlier ones first among equals."""
    limit = np.partition(d, n - 1)[n - 1]
    below = np.flatnonzero(d < limit)
    return np.concatenate([below, np.flatnonzero(d == limit)[: n - len(below)]])


def op4_ivf_pq(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
