"""Sequence packing by non-negative least squares over shallow length combinations.

Documents are tokenised and cut into windows of `window` ids; what remains of a document is one
shorter piece. Lengths fall into bins of GRAIN ids. Combinations of at most DEPTH bins that
fill a window are enumerated, and non-negative least squares finds how often to use each so
that together they use up the histogram. The counts are rounded down, topped up greedily, and
become sequences. Pieces that no combination takes are the residual: they are laid end to
end and cut at window borders, so they leave no padding but in the last sequence.

Only the length histogram (at most `window` rows) reaches the driver. Every piece gets its
number among the pieces of its length without a shuffle: a running number inside its task plus
the counts of the tasks before, and that number gives sequence and place by arithmetic. So a
hot length meets no single task.

Documents may have an order (that of a mix): `pack_in_order`. Then runs of RUN_SEQUENCES sequences of it
are packed each for itself, by the task that reads them: pieces of a length are taken in order,
the residual is laid in order, and sequences are numbered by the earliest place of what they hold.
A run lies in one slice of a file or in one sorted partition, and is all that a task holds. Only the
numbers of sequences of the runs are summed across tasks.

Defined cases: a null or empty text is the end id alone; repeated rows are separate documents;
an empty table gives an empty result. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialize

WINDOW, END_ID, RUN_SEQUENCES = 2048, 1, 1024
GRAIN, DEPTH = 8, 3
#: Characters that a worker tokenises at a time.
BATCH_CHARS = 4_000_000


#: How a byte-level BPE tokenizer splits text before its merges (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The visible characters that stand for bytes in the vocabulary of a byte-level tokenizer."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TextIds:
    """Ids of whole texts by a byte-level BPE tokenizer.

    Splitting and merging run in tiktoken's engine, which is given the tokenizer file's own
    vocabulary and pattern and finds the same ids (tests hold the two together) in less time.
    Texts that hold a special token, and those whose runs of white space are too long for the
    engine's pattern matcher, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = {c: b for b, c in byte_alphabet().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.engine = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes | None:
        """Ids of one text, or None if the engine can't take it."""
        if any(s in text for s in self.special):
            return None
        try:
            return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # its matcher ran out of room
            return None

    def encode(self, text: str) -> bytes:
        """Ids of one text by the tokenizer itself."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = map(self._plain, texts)
        return [self.encode(t) if ids is None else ids for t, ids in zip(texts, found, strict=True)]


_encoders: dict[str, TextIds] = {}


def encoder(path: str) -> TextIds:
    if path not in _encoders:
        _encoders[path] = TextIds(path)
    return _encoders[path]


def batches_of(texts: list[str], most: int = BATCH_CHARS):
    """Ranges of `texts` of at most `most` characters, or of one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def pieces_of(docs: DataFrame, key: str, text: str, tokenizer: str, window: int, end_id: int, all_ids: bool) -> DataFrame:
    """Full windows and the remainder of every document, numbered by length inside each task."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length int, ids_crc32 long, doc_tokens long, ids binary, part long, ordinal long"
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), defaultdict(int), encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            texts = texts.fill_null("").to_pylist()
            for a, b in batches_of(texts):
                row, start, length, crc, total, kept, ordinal = [], [], [], [], [], [], []
                for i, ids in enumerate(encode(texts[a:b]), a):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        x = ids[4 * s : 4 * (s + window)]
                        m = len(x) // 4
                        row.append(i), start.append(s), length.append(m), crc.append(zlib.crc32(x)), total.append(n)
                        kept.append(x if all_ids or m < window else None), ordinal.append(seen[m])
                        seen[m] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()),
                        pa.array(total, pa.int64()), pa.array(kept, pa.binary()), pa.array([part] * len(row), pa.int64()), pa.array(ordinal, pa.int64()),
                    ],
                    names=[key, "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "ordinal"],
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema)


@lru_cache
def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most `depth` bins with the given sum."""

    def below(left: int, largest: int, slots: int):
        if left == 0:
            yield ()
        elif slots:
            for first in range(min(left, largest), 0, -1):
                if first * slots < left:
                    break
                for rest in below(left - first, first, slots - 1):
                    yield (first, *rest)

    return list(below(total, total, depth))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that makes |ax - b| small, by active sets over the normal equations (formed for active columns only)."""
    target = a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-7 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        on = np.flatnonzero(active)
        slope = np.where(active, -np.inf, a.T @ (b - a[:, on] @ x[on]))
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            own = a[:, on]
            solved = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(on)), target[on])
            if (solved > 0).all():
                x[:] = 0
                x[on] = solved
                break
            low = solved <= 0
            step = float(np.min(x[on][low] / np.maximum(x[on][low] - solved[low], 1e-300)))
            x[on] += step * (solved - x[on])
            active[on[low & (x[on] <= 1e-9)]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def solve(histogram: dict[int, int], window: int, grain: int = GRAIN, depth: int = DEPTH) -> tuple[list[tuple], list[tuple], int]:
    """From counts by length: slots (bin, lo, hi, sequence of lo, slot), lengths (length, bin,
    pieces of the bin before, those used, place of the first residual one), number of sequences."""
    bins = -(-window // grain)
    counts = np.zeros(bins + 1, np.int64)
    for length, n in histogram.items():
        counts[-(-length // grain)] += n
    patterns = combinations(bins, depth)
    a = np.zeros((bins + 1, len(patterns)))
    for j, p in enumerate(patterns):
        for b in p:
            a[b, j] += 1
    scale = max(1.0, float(counts.max()))
    repeats = np.floor(non_negative_least_squares(a, counts / scale, 3 * bins) * scale + 1e-6).astype(np.int64)
    left, uses = counts.copy(), np.zeros(len(patterns), np.int64)
    for wish in (repeats, None):  # what was solved for, then a greedy top-up
        for j in sorted(range(len(patterns)), key=lambda j: (-repeats[j], len(patterns[j]), patterns[j])):
            need = defaultdict(int)
            for b in patterns[j]:
                need[b] += 1
            n = min(left[b] // k for b, k in need.items())
            n = n if wish is None else min(n, wish[j])
            uses[j] += n
            for b, k in need.items():
                left[b] -= n * k
    slots, at, sequences = [], np.zeros(bins + 1, np.int64), 0
    for j in np.flatnonzero(uses):
        for slot, b in enumerate(patterns[j]):
            slots.append((int(b), int(at[b]), int(at[b] + uses[j]), sequences, slot))
            at[b] += uses[j]
        sequences += int(uses[j])
    lengths, before, place = [], defaultdict(int), 0
    for length in sorted(histogram):
        b, n = -(-length // grain), histogram[length]
        used = int(min(max(at[b] - before[b], 0), n))
        lengths.append((length, b, before[b], used, place))
        before[b] += n
        place += (n - used) * length
    return slots, lengths, sequences


def placed(pieces: list[tuple[int, bytes]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Places of a run's pieces, which come as (length, ids) in order: (piece, ids skipped in it, length, sequence, offset)."""
    histogram: dict[int, int] = defaultdict(int)
    for n, _ in pieces:
        histogram[n] += 1
    slots, lengths, combined = solve(histogram, window)
    of_length = {x[0]: x[1:4] for x in lengths}
    of_bin: dict[int, list[tuple]] = defaultdict(list)
    for x in slots:
        of_bin[x[0]].append(x[1:])
    bin_slots = {b: [(first + i, slot) for lo, hi, first, slot in sorted(x) for i in range(hi - lo)] for b, x in of_bin.items()}
    found, seen, laid = [], defaultdict(int), 0
    for i, (n, _) in enumerate(pieces):
        b, before, used = of_length[n]
        k = seen[n]
        seen[n] += 1
        if k < used:
            sequence, slot = bin_slots[b][before + k]
            found.append((sequence, slot, i, 0, n))
            continue
        skip = 0
        while skip < n:  # cut at the window's border
            take = min(n - skip, window - laid % window)
            found.append((combined + laid // window, laid % window, i, skip, take))
            skip, laid = skip + take, laid + take
    earliest: dict[int, int] = {}
    for sequence, _, i, _, _ in found:  # residual and combined pieces alike come in order
        earliest.setdefault(sequence, i)
    rank = {q: r for r, q in enumerate(sorted(earliest, key=lambda q: (earliest[q], q)))}
    out, used_up = [], defaultdict(int)
    for sequence, _, i, skip, n in sorted(found):
        out.append((i, skip, n, rank[sequence], used_up[sequence]))
        used_up[sequence] += n
    return out


def pack_in_order(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, order: list[str] | None = None
) -> DataFrame:
    """The rows of `pack`, in sequences that follow the documents' order.

    That is the order of the columns `order`; without them `docs` must be rows of files, whose order is that
    of the files' names and of the rows in them, as a sorted table was written. Nothing is sorted then.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, ids binary, __file string, __slice long, __run long"
    end = int(end_id).to_bytes(4, "little")
    if order:
        docs = docs.orderBy(*order)
    place = [F.lit(None).cast("string"), F.lit(0).cast("long")] if order else [docs.metadataColumn("_metadata")[c] for c in ("file_path", "file_block_start")]

    def packed(batches):
        from pyspark import TaskContext

        encode, here, run, size = encoder(tokenizer), None, 0, 0
        rows: list[tuple] = []  # key, start, ids, ids of the document

        def close():
            names = ["key", "start", "length", "crc", "total", "sequence", "offset", "ids"]
            own: dict[str, list] = {c: [] for c in names}
            for i, skip, n, sequence, offset in placed([(len(r[2]) // 4, r[2]) for r in rows], window):
                k, start, ids, total = rows[i]
                ids = ids[4 * skip : 4 * (skip + n)]
                for c, x in zip(names, (k, start + skip, n, zlib.crc32(ids), total, sequence, offset, ids if with_ids else None), strict=True):
                    own[c].append(x)
            many = len(own["key"])
            arrays = [pa.array(own["key"], kind_of_key), *[pa.array(own[c], pa.int64()) for c in names[1:-1]], pa.array(own["ids"], pa.binary())]
            arrays += [pa.array([here[0]] * many, pa.string()), pa.array([here[1]] * many, pa.int64()), pa.array([run] * many, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids", "__file", "__slice", "__run"])

        for batch in batches:
            keys, texts, files, slices = batch.column(0), batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kind_of_key, keys = keys.type, keys.to_pylist()
            for a, b in batches_of(texts):
                for i, ids in enumerate(encode(texts[a:b]), a):
                    # Numbers in names (part-00001) are ordered as numbers; a sorted partition counts as a file.
                    now = (f"{TaskContext.get().partitionId():012d}" if order else files[i], slices[i])
                    if now != here or size >= RUN_SEQUENCES * window:
                        if rows:
                            yield close()
                        run = run + 1 if now == here else 0
                        here, rows, size = now, [], 0
                    ids += end
                    n = len(ids) // 4
                    rows += [(keys[i], s, ids[4 * s : 4 * (s + window)], n) for s in range(0, n, window)]
                    size += n
        if rows:
            yield close()

    pieces = docs.select(F.col(key), F.col(text), *[c.alias(f"__{i}") for i, c in enumerate(place)]).mapInArrow(packed, schema)
    if not with_ids:
        pieces = pieces.drop("ids")
    pieces = materialize(pieces, "placed")
    # Sequences before each run: those of earlier runs in its file, and of earlier files (a row for each).
    runs = ["__file", "__slice", "__run"]
    sizes = materialize(pieces.groupBy(*runs).agg((F.max("sequence") + 1).alias("n")), "runs")
    number = F.regexp_extract("__file", r"(?:^|/)(?:part-)?(\d+)[^/]*$", 1)
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = sizes.groupBy("__file").agg(F.sum("n").alias("n")).select("__file", earlier(Window.orderBy(F.lpad(number, 12, "0"), "__file")).alias("in_files"))
    sizes = sizes.select(*runs, earlier(Window.partitionBy("__file").orderBy("__slice", "__run")).alias("in_file"))
    begins = sizes.join(F.broadcast(files), "__file").select(*runs, (F.col("in_files") + F.col("in_file")).alias("__begin"))
    out = attach(pieces, begins, runs, "inner").withColumn("sequence_id", F.col("__begin") + F.col("sequence"))
    return out.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    spark = docs.sparkSession
    cut = materialize(pieces_of(docs, key, text, tokenizer, window, end_id, with_ids), "pieces")
    by_task = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "task_lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_task = materialize(by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("earlier"), "n"), "lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    slots, lengths, combined = solve(histogram, window)
    slots = spark.createDataFrame(slots, "bin int, lo long, hi long, first long, slot int")
    lengths = spark.createDataFrame(lengths, "length int, bin int, bin_before long, used long, place long")
    known = attach(cut, by_task.drop("n"), ["part", "length"], "inner").join(F.broadcast(lengths), "length")
    known = known.withColumn("k", F.col("earlier") + F.col("ordinal"))
    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot", "offset"] + ["ids"] * with_ids

    # Taken by a combination: the number in the bin gives sequence and slot.
    number = F.col("bin_before") + F.col("k")
    taken = known.where(F.col("k") < F.col("used")).withColumn("number", number).join(F.broadcast(slots), "bin")
    taken = taken.where((F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    taken = taken.withColumn("sequence_id", F.col("first") + F.col("number") - F.col("lo"))
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    full = taken.where(F.col("length") == window).withColumn("offset", F.lit(0).cast("long"))
    shared = taken.where(F.col("length") < window).select(*[c for c in columns if c != "offset"])
    shared = shared.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)))

    # Residual: its place in one long line of ids, cut at window borders.
    place = F.col("place") + (F.col("k") - F.col("used")) * F.col("length")
    rest = known.where(F.col("k") >= F.col("used")).withColumn("place", place)
    room = F.lit(window) - F.pmod("place", F.lit(window))
    part = lambda skip, n: F.struct(skip.cast("long").alias("skip"), n.cast("int").alias("n"))
    parts = F.when(F.col("length") <= room, F.array(part(F.lit(0), F.col("length")))).otherwise(F.array(part(F.lit(0), room), part(room, F.col("length") - room)))
    rest = rest.withColumn("cut", F.explode(parts))
    ids = F.when(F.col("cut.n") == F.col("length"), F.col("ids")).otherwise(F.col("ids").substr((4 * F.col("cut.skip") + 1).cast("int"), 4 * F.col("cut.n")))
    rest = rest.select(
        key,
        (F.col("start") + F.col("cut.skip")).alias("start"),
        F.col("cut.n").alias("length"),
        F.when(F.col("cut.n") == F.col("length"), F.col("ids_crc32")).otherwise(F.crc32(ids)).alias("ids_crc32"),
        "doc_tokens",
        (F.lit(combined) + F.floor((F.col("place") + F.col("cut.skip")) / window)).cast("long").alias("sequence_id"),
        F.lit(0).alias("slot"),
        F.pmod(F.col("place") + F.col("cut.skip"), F.lit(window)).cast("long").alias("offset"),
        *[ids.alias("ids")] * with_ids,
    )
    out = full.select(*columns).unionByName(shared.select(*columns)).unionByName(rest.select(*columns))
    return out.drop("slot").withColumn("length", F.col("length").cast("long"))


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sequence of `pieces` (with ids): sequence_id, ids in order, padding."""
    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    size = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return own.select("sequence_id", joined.alias("ids"), (F.lit(window) - size).alias("padding"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_nnls_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), with_ids=False)
