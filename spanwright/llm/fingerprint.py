"""Improbable-feature digests of whole texts, and how alike two of them are.

The features of a text are its windows of WINDOW bytes (UTF-8); a shorter text is one feature by
itself. A window is ranked by how rare its entropy is: the entropies of all windows of all texts
are counted in a thousand steps, and a window in a rarer step is less probable. In each run of
WINDOW neighbouring windows (runs reach over both ends of the text) the least probable one wins,
the first of several; windows that win LEAST_WINS runs or more are the features. Windows with
next to no entropy take part in nothing; a text that has only such ones is one feature.
Each distinct feature is hashed and set in a Bloom filter of BITS bits by HASHES of them; after
FILTER_FEATURES features the next filter of the chain begins.

Two digests are compared filter by filter: each filter of the shorter chain takes its best partner
in the other; common bits count above what chance gives, divided by the most there could be, and
nothing where they lie within three deviations of chance. Filters weigh by their features.

What is counted is one row for each step of entropy, so at most 1,001 rows reach the driver. The
table of ranks can be passed on: digests are comparable if they were made with the same one.

Equal texts have equal digests. Defined cases: a null or empty text has no feature and the digest
"": two such are alike by 1, one and another by 0. Repeated rows are documents of their own.
Rows without an id come last in the order. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, trim_memory

WINDOW, LEAST_WINS = 32, 8
BITS, HASHES, FILTER_FEATURES = 2048, 5, 160
#: Steps of entropy; windows below the first of these take part in nothing.
STEPS, LEAST_STEP = 1000, 100
#: Bytes looked at together, and characters of a block of documents in order.
BLOCK_BYTES, BLOCK_CHARS = 1 << 18, 1_000_000
#: Blocks there are at most; beyond, they grow (tasks stream through them).
MOST_BLOCKS = 50_000

#: Of c equal bytes in a window: c log2 c, in whole units so that running sums are exact.
_PART = np.round(np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)]) * (1 << 20)).astype(np.int64)
_GAIN = np.diff(_PART)


def steps(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of `data` (uint8), as a step from 0 to STEPS."""
    n = len(data) - WINDOW + 1
    ahead, back = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for shift in range(1, WINDOW):  # how often a byte comes again within a window, and came before
        same = (data[shift:] == data[:-shift]).view(np.uint8)
        ahead[:-shift] += same
        back[shift:] += same
    total = np.empty(n, np.int64)
    total[0] = _PART[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(_GAIN[back[WINDOW:]] - _GAIN[ahead[: n - 1]], out=total[1:])
    total[1:] += total[0]
    return STEPS - (total * STEPS) // int(_PART[WINDOW])


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with gaps of two windows of zeros, their begins, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    gap = bytes(2 * WINDOW)
    begins = 2 * WINDOW + np.concatenate([[0], np.cumsum(sizes + 2 * WINDOW)[:-1]]).astype(np.int64)
    return np.frombuffer(gap + gap.join(texts) + gap, np.uint8), begins, sizes


def blocks(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, steps, valid) of blocks of windows, each with a window's room on both sides; valid: inside one text."""
    windows = len(data) - WINDOW + 1
    valid = np.zeros(windows + 1, np.int8)
    inside = sizes >= WINDOW
    np.add.at(valid, begins[inside], 1)
    np.add.at(valid, (begins + sizes - WINDOW + 1)[inside], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    for a in range(0, windows, BLOCK_BYTES):
        lo, hi = max(0, a - WINDOW), min(windows, a + BLOCK_BYTES + WINDOW)
        yield lo, hi, steps(data[lo : hi + WINDOW - 1]), valid[lo:hi]


def step_counts(texts: list[bytes]) -> np.ndarray:
    """Windows of each step."""
    out = np.zeros(STEPS + 1, np.int64)
    data, begins, sizes = laid_out(texts)
    for lo, hi, s, valid in blocks(data, begins, sizes):
        own = slice(0 if lo == 0 else WINDOW, None if hi == len(data) - WINDOW + 1 else hi - lo - WINDOW)
        out += np.bincount(s[own][valid[own]], minlength=STEPS + 1)
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each step, rarest first, ties to the larger entropy; 0xFFFF for steps that take part in nothing."""
    order = sorted(range(LEAST_STEP, STEPS + 1), key=lambda s: (counts[s], -s))
    ranks = np.full(STEPS + 1, 0xFFFF, np.uint16)
    ranks[order] = np.arange(len(order))
    return ranks


def chosen(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Begins of the windows that win LEAST_WINS runs."""
    found = []
    for lo, hi, s, valid in blocks(data, begins, sizes):
        rank = np.where(valid, ranks[s], 0xFFFF).astype(np.int64)
        best = (rank << 32) | np.arange(hi - lo)
        reach = 1
        while reach < WINDOW:  # the least of twice as many, again and again
            best = np.minimum(best[:-reach], best[reach:])
            reach *= 2
        best = best[best >> 32 < 0xFFFF] & 0xFFFFFFFF
        wins = np.bincount(best, minlength=hi - lo)
        first, last = (0 if lo == 0 else WINDOW), (hi - lo if hi == len(data) - WINDOW + 1 else hi - lo - WINDOW)
        found.append(lo + first + np.flatnonzero(wins[first:last] >= LEAST_WINS))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number with its bits mixed."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the window at each place."""
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), 1 << 15):
        own = np.ascontiguousarray(data[at[a : a + (1 << 15), None] + np.arange(WINDOW)]).view("<u8")
        h = np.full(len(own), 0x9E3779B97F4A7C15, np.uint64)
        for k in range(own.shape[1]):
            h = _mixed(h ^ own[:, k])
        out[a : a + (1 << 15)] = h
    return out


Digest = tuple[np.ndarray, np.ndarray]


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """(features of each filter, filters as rows of bytes) of each text."""
    data, begins, sizes = laid_out(texts)
    at = chosen(data, begins, sizes, ranks)
    doc, hashed = np.searchsorted(begins, at, "right") - 1, hashes_at(data, at)
    bare = np.flatnonzero((np.bincount(doc, minlength=len(texts)) == 0) & (sizes > 0))
    if len(bare):  # one feature by itself
        whole = [int.from_bytes(hashlib.sha256(texts[i]).digest()[:8], "little") for i in bare]
        doc, hashed, at = np.concatenate([doc, bare]), np.concatenate([hashed, np.array(whole, np.uint64)]), np.concatenate([at, begins[bare]])
    order = np.lexsort((at, hashed, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (hashed[order][1:] != hashed[order][:-1])
    keep = order[new]
    keep = keep[np.lexsort((at[keep], doc[keep]))]  # distinct ones, in order of the text
    doc, hashed = doc[keep], hashed[keep]
    count = np.bincount(doc, minlength=len(texts))
    filters = -(-count // FILTER_FEATURES)
    base = np.concatenate([[0], np.cumsum(filters)])
    ordinal = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(count)[:-1]])[doc]
    row = base[doc] + ordinal // FILTER_FEATURES
    bits = np.zeros((int(base[-1]), BITS), bool)
    width = np.uint64(BITS.bit_length() - 1)
    for k in range(HASHES):
        bits[row, ((hashed >> (width * np.uint64(k))) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed, held = np.packbits(bits, axis=1), np.bincount(row, minlength=int(base[-1]))
    return [(held[a:b], packed[a:b]) for a, b in zip(base[:-1], base[1:], strict=True)]


def shown(digest: Digest) -> str:
    """A digest as text: the features and the bits (base64) of each filter."""
    return ".".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(digest[0].tolist(), digest[1], strict=True))


def read(text: str) -> Digest:
    """The digest that `shown` wrote."""
    parts = [p.split(":") for p in text.split(".")] if text else []
    rows = [np.frombuffer(base64.b64decode(b), np.uint8) for _, b in parts]
    return np.array([int(n) for n, _ in parts], np.int64), np.array(rows, np.uint8).reshape(-1, BITS // 8)


def likeness(one: Digest, other: Digest) -> float:
    """From 0 to 1: 1 for equal digests."""
    (n, a), (m, b) = (one, other) if len(one[0]) <= len(other[0]) else (other, one)
    if not len(n):
        return float(not len(m))
    a, b = a.view("<u8"), b.view("<u8")
    in_b, total = np.bitwise_count(b).sum(1, dtype=np.int64), 0.0
    for held, f in zip(n.tolist(), a, strict=True):
        own = int(np.bitwise_count(f).sum(dtype=np.int64))
        common = np.bitwise_count(b & f).sum(1, dtype=np.int64)
        chance, most = own * in_b / BITS, np.minimum(own, in_b)
        deviation = np.sqrt(chance * (1 - own / BITS) * (1 - in_b / BITS))
        room = np.maximum(most - chance, 1e-9)
        score = np.where(common > chance + 3 * deviation, (common - chance) / room, 0.0)
        total += held * float(np.clip(score.max(), 0.0, 1.0))
    return min(1.0, total / float(n.sum()))


def rarity_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the steps of entropy by how rare they are in all texts of `docs`."""

    def count(batches):
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist() if t]
            for a, b in groups([len(t) for t in texts]):
                total += step_counts(texts[a:b])
        trim_memory()
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on], pa.int64())], names=["step", "n"])

    counts = np.zeros(STEPS + 1, np.int64)
    for r in docs.select(text).mapInArrow(count, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():  # a row for each step at most
        counts[r["step"]] = r["n"]
    return ranks_of(counts)


def groups(sizes: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` in all, or of one."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """key, n_chars, fingerprint of every row; `ranks` of `rarity_ranks`, or else those of `docs` themselves."""
    ranks = rarity_ranks(docs, text) if ranks is None else ranks
    kind = docs.schema[key].dataType.simpleString()

    def make(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for a, b in groups([len(t) for t in texts]):
                own = texts[a:b]
                made = digests([t.encode() for t in own], ranks)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in own], pa.int64()), pa.array(map(shown, made), pa.string())], names=[key, "n_chars", "fingerprint"])
            trim_memory()

    return docs.select(key, text).mapInArrow(make, f"`{key}` {kind}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of `docs` in blocks of descending key, with the row that follows each block's last one.

    Columns block, __key, __text, __follows (that extra row, behind its block). Blocks are ranges
    of keys between percentiles, so many that a block holds about `block_chars` characters;
    the first row of each block goes to the block before too (that of the first to the last), so
    that texts are shuffled once and no window spans all rows.
    """
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    size = rows.agg(F.sum(F.length("__text")).alias("n"), F.count("__key").alias("keys")).first()
    n = max(1, min(int(size["keys"]), -(-int(size["n"] or 0) // block_chars), MOST_BLOCKS))
    cuts: list = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        cuts = sorted(set(rows.agg(F.percentile_approx("__key", shares, max(10_000, 20 * n)).alias("p")).first()["p"]))
    # Blocks count downwards from the largest keys; rows without a key lie behind all.
    below = _cuts_below(F.col("__key"), cuts) if cuts else F.lit(0)
    rows = rows.withColumn("block", F.when(F.col("__key").isNull(), len(cuts) + 1).otherwise(len(cuts) - below).cast("int"))
    order = F.struct(F.col("__key"), F.xxhash64("__text").alias("h"))
    first = rows.groupBy("block").agg(F.max(order).alias("top")).orderBy("block").collect()  # a row for each block
    before = {r["block"]: first[i - 1]["block"] for i, r in enumerate(first)}
    heads = docs.sparkSession.createDataFrame([(r["block"], before[r["block"]], r["top"]["__key"], r["top"]["h"]) for r in first], f"block int, goes int, k {kind}, h long")
    led = rows.join(F.broadcast(heads), "block", "left")
    is_head = F.col("k").eqNullSafe(F.col("__key")) & F.col("h").eqNullSafe(F.xxhash64("__text"))
    places = F.when(is_head, F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("f")), F.struct(F.col("goes").alias("b"), F.lit(True).alias("f"))))
    places = F.explode(places.otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("f")))))
    return led.select("__key", "__text", places.alias("p")).select(F.col("p.b").alias("block"), F.col("p.f").alias("__follows"), "__key", "__text")


def _cuts_below(key, cuts: list):
    """How many of the ascending `cuts` are below a key, by binary search."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def search(edges):
        go = lambda at, step: F.when(F.get(edges, at + step - 1) < key, at + step).otherwise(at)  # noqa: E731  beyond the end: null, no step
        return F.aggregate(F.lit(steps), F.lit(0), go)

    return let(F.lit(cuts), search)


def against_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: np.ndarray | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Digests of every text and of its edited text, with how alike they and the next text's are.

    Edited: the last third of the code points (rounded down) replaced by the first as many (or
    all) of the next document, by descending key (a whole number; ties by a hash of the text); the
    last one is followed by the first. Columns: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    ranks = rarity_ranks(docs, text) if ranks is None else ranks
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def judged(keys: list, texts: list[str], following: list[bool], key_type: pa.DataType):
        """Rows of all texts that are followed by another one of their block; `following`: not a row itself."""
        n = len(texts) - 1
        edited = []
        for i in range(n):
            cut = len(texts[i]) // 3
            edited.append("" if following[i] else texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        raw = [t.encode() for t in edited]
        made = digests([t.encode() for t in texts] + raw, ranks)
        own, other = made[: n + 1], made[n + 1 :]
        on = [i for i in range(n) if not following[i]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys[i] for i in on], key_type),
                pa.array([len(texts[i]) for i in on], pa.int64()),
                pa.array([hashlib.sha256(raw[i]).hexdigest() for i in on], pa.string()),
                pa.array([shown(own[i]) for i in on], pa.string()),
                pa.array([shown(other[i]) for i in on], pa.string()),
                pa.array([likeness(own[i], other[i]) for i in on], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in on], pa.float64()),
            ],
            names=names,
        )

    def walk(batches):
        last = None  # the row before, whose next one is still to come
        for batch in batches:
            keys, texts, follows = batch.column(0), batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist()
            kind, keys = keys.type, keys.to_pylist()
            for a, b in groups([len(t) for t in texts], BLOCK_CHARS // 2):
                rows = (keys[a:b], texts[a:b], follows[a:b])
                if last is not None:
                    rows = tuple([x, *y] for x, y in zip(last, rows, strict=True))
                last = tuple(x[-1] for x in rows)
                if len(rows[0]) > 1:
                    yield judged(*rows, kind)
            trim_memory()

    rows = with_next(docs, key, text, block_chars).repartition(F.col("block"))
    ordered = rows.sortWithinPartitions(F.col("block"), F.col("__follows"), F.col("__key").desc_nulls_last(), F.xxhash64("__text").desc())
    return ordered.select("__key", "__text", "__follows").mapInArrow(walk, schema)


def op13_improbable_digest(spark, sf_dir):
    return against_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
