"""Alignment of two tokenizers' tokens over whole texts, by segments that are tokenised once.

Texts are cut before runs of white space wherever no token of either vocabulary can reach across:
the first tokenizer's own splitting never joins white space to what stands before it, and for the
second every piece of its vocabulary is looked at for a character followed by that white space. Such
places are token borders of both, and tokens on one side don't depend on the other, so a
document's tokens, groups and links are those of its segments laid end to end.

Documents are taken in chunks of CHUNK_CHARS characters (parts of one input partition). A chunk
numbers its distinct segments; these are dealt to buckets by hash, where each distinct segment is
tokenised and aligned once for all chunks, and the alignments go back to the chunks that asked.
A chunk then composes its documents and counts in how many each pair of ids is linked; counts are
summed over all chunks, and go back to the chunks that hold the pair. What travels are packed Arrow
batches, a row for each chunk and bucket, and rows of counted pairs; texts don't travel.
A bucket holds about BUCKET_CHARS characters' worth of segments, a chunk holds its own, so nothing
that a task holds grows with the corpus. Only the greatest count of each id of the first vocabulary
is broadcast: a row for each id at most.

Defined cases: texts that are null, empty or whose tokens don't give back the same bytes have no
tokens: zeros, an empty string, and no part in the counts of pairs. Repeated rows are documents of
their own. Columns other than key and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize, scratch, trim_memory
from .packing import batches_of, byte_alphabet, tokenizer_path

CHUNK_CHARS, BUCKET_CHARS = 16_000_000, 4_000_000
#: Segments of up to so many characters in a tokenizer call.
CALL_CHARS = 200_000
#: What is put before a segment so that the second tokenizer adds its space there.
ANCHOR = "a"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Pair:
    """The two tokenizers: a byte-level BPE file (A) and a sentencepiece model with byte fallback (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in byte_alphabet().items()}
        self.bytes_a = {i: t.encode() if t in {x.content for x in self.a.get_added_tokens_decoder().values()} else bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.bytes_b = [self._piece(i) for i in range(len(self.b))]
        self.border = border_pattern(path_a, self._plain_pieces())
        self.skip = len(self.b.encode(ANCHOR))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _plain_pieces(self) -> list[str]:
        return [self.b.id_to_piece(i) for i in range(len(self.b)) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]

    def segments(self, text: str) -> list[str]:
        """Segments of a text with the space before it."""
        return self.border.split(f" {text}") if self.border else [f" {text}"]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        if self.border:  # no token reaches from the anchor into what follows
            return a, [ids[self.skip :] for ids in self.b.encode([ANCHOR + s for s in segments], num_threads=1)]
        return a, self.b.encode([s[1:] for s in segments], num_threads=1)


def border_pattern(path_a: str, pieces_b: list[str]) -> re.Pattern | None:
    """Where texts can be cut: before white space that no token of either vocabulary joins to the character before it.

    None if the first tokenizer's file doesn't split as byte-level BPE does, so that nothing is known of it.
    """
    spec = json.loads(Path(path_a).read_text(encoding="utf-8"))
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
        return None
    places = []
    for space in " \n\t\r":
        own = "▁" if space == " " else space
        joined = {x for p in pieces_b for x, y in zip(p, p[1:], strict=False) if y == own and x != "▁" and not x.isspace()}
        if not any(x in joined for x in ANCHOR):
            kept_out = "".join(map(re.escape, sorted(joined)))
            places.append(f"(?<=[^\\s▁{kept_out}])(?={space})")
    return re.compile("|".join(places)) if places else None


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def packed(**columns) -> bytes:
    """Columns as one compressed Arrow batch."""
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as source:
        return source.read_next_batch()


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def flat(array: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list column."""
    offsets = array.offsets.to_numpy()
    return offsets - offsets[0], array.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def align(segment: bytes, a: list[int], b: list[int], bytes_a, bytes_b) -> tuple[str, int, list[int], list[int]] | None:
    """(groups, their number, A ids and B ids of all links) of one segment; None if the tokens' bytes differ from it."""
    if b"".join([bytes_a[i] for i in a]) != segment or b"".join([bytes_b[i] for i in b]) != segment:
        return None
    groups, left, right = [], [], []
    i = j = from_i = from_j = at_a = at_b = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a += len(bytes_a[a[i]])
            i += 1
        else:
            at_b += len(bytes_b[b[j]])
            j += 1
        if at_a == at_b:
            own_a, own_b = a[from_i:i], b[from_j:j]
            groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
            left += [x for x in own_a for _ in own_b]
            right += own_b * len(own_a)
            from_i, from_j = i, j
    return ";".join(groups), len(groups), left, right


def _chunks(path_a: str, path_b: str, buckets: int):
    """Documents as numbers of segments, and each chunk's distinct segments by bucket."""

    def cut(batches):
        from pyspark import TaskContext

        pair, part, chunk = tokenizers(path_a, path_b), TaskContext.get().partitionId(), 0
        numbers: dict[str, int] = {}
        held = 0

        def distinct():
            by_bucket: dict[int, list[int]] = {}
            names = list(numbers)
            for i, s in enumerate(names):
                by_bucket.setdefault(xxhash.xxh64_intdigest(s) % buckets, []).append(i)
            at = (part << 32) + chunk
            for bucket, own in by_bucket.items():
                yield at, bucket, packed(local=pa.array(own, pa.int32()), segment=pa.array([names[i] for i in own], pa.string()))

        def batch_of(rows):
            at, bucket, body = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary())], names=["chunk", "bucket", "body"])

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).fill_null("").to_pylist()
            for a, b in batches_of(texts):
                ids, offsets = [], [0]
                for text in texts[a:b]:
                    if text:
                        ids += [numbers.setdefault(s, len(numbers)) for s in pair.segments(text)]
                        held += len(text)
                    offsets.append(len(ids))
                yield batch_of([((part << 32) + chunk, -1, packed(key=keys.slice(a, b - a), segments=lists(np.array(offsets), np.array(ids, np.int32))))])
                if held >= CHUNK_CHARS:
                    for row in distinct():
                        yield batch_of([row])
                    numbers, held, chunk = {}, 0, chunk + 1
        if numbers:
            for row in distinct():
                yield batch_of([row])
        trim_memory()

    return cut


def _aligned(path_a: str, path_b: str):
    """Alignments of one bucket's segments, for every chunk that asks."""

    def of(table: pa.Table) -> pa.Table:
        pair = tokenizers(path_a, path_b)
        asked = [(c, unpacked(b)) for c, b in zip(table["chunk"].to_pylist(), table["body"].to_pylist(), strict=True)]
        names = list(dict.fromkeys(s for _, x in asked for s in x.column("segment").to_pylist()))
        number, found = {s: i for i, s in enumerate(names)}, []
        for lo, hi in batches_of(names, CALL_CHARS):
            own = names[lo:hi]
            for s, a, b in zip(own, *pair.encode(own), strict=True):
                made = align(s.encode(), a, b, pair.bytes_a, pair.bytes_b)
                found.append((len(a), len(b), *made) if made else (-1, 0, "", 0, [], []))
        counts = np.array([(f[0], f[1], f[3], len(f[4])) for f in found], np.int64).reshape(-1, 4)
        begins = np.concatenate([[0], np.cumsum(counts[:, 3])])
        left, right = (np.array([i for f in found for i in f[k]], np.int32) for k in (4, 5))
        chunks, bodies = [], []
        for chunk, x in asked:
            own = np.array([number[s] for s in x.column("segment").to_pylist()], np.int64)
            links = spread(begins[own], counts[own, 3])
            bodies.append(packed(
                local=x.column("local"), groups=pa.array([found[i][2] for i in own.tolist()], pa.string()),
                **{c: pa.array(counts[own, k].astype(np.int32)) for k, c in enumerate(COUNTS)},
                a=lists(np.concatenate([[0], np.cumsum(counts[own, 3])]), left[links]), b=lists(np.concatenate([[0], np.cumsum(counts[own, 3])]), right[links]),
            ))
            chunks.append(chunk)
        trim_memory()
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "body": pa.array(bodies, pa.binary())})

    return of


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of ranges with these begins and sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _composed(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """Documents of one chunk without the counts of pairs (packed), and the pairs with the number of its documents that hold them."""
    empty = pa.table({c: pa.array([], t) for c, t in (("chunk", pa.int64()), ("body", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("pair", pa.int32()), ("docs", pa.int64()))})
    if not docs.num_rows:
        return empty
    chunk = docs["chunk"][0].as_py()
    known = [unpacked(b) for b in asked["body"].to_pylist()]
    size = sum(len(x) for x in known)
    groups, counts, sizes = np.full(size, "", object), np.zeros((size, len(COUNTS)), np.int64), np.zeros(size, np.int64)
    left, right, begins, at = [], [], np.zeros(size, np.int64), 0
    for x in known:
        local = x.column("local").to_numpy()
        groups[local] = x.column("groups").to_numpy(zero_copy_only=False)
        counts[local] = np.stack([x.column(c).to_numpy() for c in COUNTS], 1)
        offsets, own = flat(x.column("a"))
        begins[local], sizes[local] = at + offsets[:-1], np.diff(offsets)
        left.append(own), right.append(flat(x.column("b"))[1])
        at += len(own)
    both = (np.concatenate(left).astype(np.int64) << 32 | np.concatenate(right)) if left else np.zeros(0, np.int64)
    pairs, which = np.unique(both, return_inverse=True)
    held, bodies = np.zeros(len(pairs), np.int64), []
    for body in docs["body"].to_pylist():
        x = unpacked(body)
        offsets, ids = flat(x.column("segments"))
        doc = np.repeat(np.arange(len(x)), np.diff(offsets))
        bad = np.bincount(doc, counts[ids, 0] < 0, len(x)) > 0 if size else np.zeros(len(x), bool)
        sums, digests = np.zeros((len(x), len(COUNTS)), np.int64), []
        if size:
            np.add.at(sums, doc, counts[ids])
        sums[bad] = 0
        for i, wrong in enumerate(bad.tolist()):
            own = ids[offsets[i] : offsets[i + 1]]
            digests.append("" if wrong or not len(own) else hashlib.sha256(";".join(groups[own].tolist()).encode()).hexdigest())
        # Distinct segments of each document, then its distinct pairs and how often they are linked in it.
        good = ~bad[doc]
        seen, often = np.unique(doc[good].astype(np.int64) << 32 | ids[good], return_counts=True)
        doc_of, segment = seen >> 32, seen & 0xFFFFFFFF
        own = which[spread(begins[segment], sizes[segment])].astype(np.int64) if size else np.zeros(0, np.int64)
        linked, at_first = np.unique(np.repeat(doc_of, sizes[segment]) << 32 | own, return_inverse=True)
        times = np.bincount(at_first, np.repeat(often, sizes[segment]), len(linked)).astype(np.int64)
        pair = (linked & 0xFFFFFFFF).astype(np.int32)
        held += np.bincount(pair, minlength=len(pairs))
        ends = np.concatenate([[0], np.cumsum(np.bincount((linked >> 32).astype(np.int64), minlength=len(x)))])
        bodies.append(packed(key=x.column("key"), groups_sha256=pa.array(digests, pa.string()), **{c: sums[:, k].copy() for k, c in enumerate(COUNTS)}, pair=lists(ends, pair), times=lists(ends, times)))
    on = np.flatnonzero(held)
    trim_memory()
    n, m = len(bodies), len(on)
    return pa.table({
        "chunk": pa.array([chunk] * (n + m), pa.int64()), "body": pa.array(bodies + [None] * m, pa.binary()),
        **{c: pa.array(np.concatenate([np.zeros(n, np.int64), v]), pa.int32()) for c, v in (("a", pairs[on] >> 32), ("b", pairs[on] & 0xFFFFFFFF), ("pair", on))},
        "docs": pa.array(np.concatenate([np.zeros(n, np.int64), held[on]]), pa.int64()),
    })


def _finished(key: str, kind: pa.DataType):
    """Documents of one chunk with the sums over their links."""
    names = [key, *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def of(docs: pa.Table, counted: pa.Table) -> pa.Table:
        pair = counted["pair"].to_numpy()
        count, best = (np.zeros(int(pair.max(initial=-1)) + 1, np.int64) for _ in range(2))
        count[pair], best[pair] = counted["n"].to_numpy(), counted["best"].to_numpy()
        out = []
        for body in docs["body"].to_pylist():
            x = unpacked(body)
            offsets, own = flat(x.column("pair"))
            times, doc = flat(x.column("times"))[1], np.repeat(np.arange(len(x)), np.diff(offsets))
            sums = np.zeros((2, len(x)), np.int64)
            np.add.at(sums[0], doc, times * best[own])
            np.add.at(sums[1], doc, times * count[own])
            out.append(pa.table([x.column("key").cast(kind), *[x.column(c) for c in COUNTS], pa.array(sums[0]), pa.array(sums[1]), x.column("groups_sha256")], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], kind), *[pa.array([], pa.int64())] * 6, pa.array([], pa.string())], names=names)

    return of


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema[key]
    buckets = max(16, -(-int(docs.agg(F.sum(F.length(text))).first()[0] or 0) // BUCKET_CHARS))
    own: list[str] = []
    with scratch(own):
        cut = materialize(docs.select(key, text).mapInArrow(_chunks(path_a, path_b, buckets), "chunk long, bucket int, body binary"), "segments")
        asked = cut.where("bucket >= 0").groupBy("bucket").applyInArrow(_aligned(path_a, path_b), "chunk long, body binary")
        schema = "chunk long, body binary, a int, b int, pair int, docs long"
        by_chunk = lambda df: df.groupBy("chunk")
        made = materialize(by_chunk(cut.where("bucket < 0").select("chunk", "body")).cogroup(by_chunk(asked)).applyInArrow(_composed, schema), "composed")
    delete(docs.sparkSession, own[:1])
    rows = made.where(F.col("body").isNull())
    counts = rows.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    counts = materialize(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary at most
    counts = counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    back = rows.select("chunk", "a", "b", "pair").join(counts, ["a", "b"]).select(F.col("chunk").alias("at"), "pair", "n", "best")
    out = f"`{key}` {field.dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups_sha256 string"
    bodies = made.where(F.col("body").isNotNull()).select("chunk", "body")
    return by_chunk(bodies).cogroup(back.groupBy("at")).applyInArrow(_finished(key, to_arrow_type(field.dataType)), out)


def op11_token_align(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
