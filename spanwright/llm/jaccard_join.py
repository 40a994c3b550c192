"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Two sets with Jaccard
similarity of at least t must share an element among their first n - ceil(t n) + 1, in any
order that all sets use. Here the order is by hash, but shingles found in many sets come last
(counts cover every document), so that a passage or line that many documents share hardly
ever stands in a prefix.

1. Exact copies (equal sets) become one node; nodes of equal size and prefix become one group.
2. The groups of each prefix element meet in a task (elements are dealt by hash, as blocks).
   In a first round only neighbours in size order are paired, and each with the hubs of its list;
   verified links give components, which settles large groups of near copies in a linear number
   of pairs. A list of more than LIST_ROWS groups is cut, and one hub stands in all its parts.
3. In a second round all pairs of groups meet, but for those already in one component: only lists
   with more than one component are dealt at all, and those of more than CELL_ROWS groups as cells, each
   of two parts of the list. A pair must share enough prefix elements for the similarity still to
   be possible (an exact bound); pairs of groups are then expanded to their members and verified
   on whole sets.
4. Components are found by contracting stars: inside tasks first, then by joins.

No pair is dropped but by the exact bounds, so no link between different texts is lost; pairs
inside one component may go untested, as they can't change it.

Defined cases: a null, empty or blank text has no shingles and links with nothing; fewer than
k words are one shingle, the whole sequence; repeated rows are copies of one another; rows
with equal ids share a component; a row with a null id has a null component. Other columns
pass through `unique_documents` and are otherwise ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, bounded, delete, discard, materialize, scratch, trim_memory

WORDS, PERCENT = 4, 85
#: From this number of sets on a shingle is ordered last; at most so many shingles are, the
#: most frequent ones (they go to every task; the others keep their place by hash).
FREQUENT, MOST_FREQUENT = 8, 1 << 19
#: Share of the hash range in which shingles are counted: prefixes come from its low end.
COUNTED = 0.5
#: Bytes that a task buffers before it hands on blocks, pairs that it looks at together, and
#: elements that are dealt to a task.
BUFFERED, PAIRS, PER_TASK = 8 << 20, 100_000, 1_000_000
#: Groups of a list that meet in one task in the first round, and groups of each part of a cell in the second.
LIST_ROWS, CELL_ROWS = 200_000, 8_192
#: Bytes of whole sets that are broadcast.
BROADCAST_BYTES = 10 << 20
#: 64-bit words of a set's parity signature, groups of a list that all others are paired with at first.
SIGNED, HUBS = 8, 2

_MIX = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; words are split by ASCII white space, A-Z lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(h))
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = _scramble(mixed * _MIX + h[i : len(h) - size + 1 + i])
    return np.unique(mixed)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix_of(elements: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first elements in the common order (rare ones by hash, then frequent ones by hash), and how many are rare."""
    size = prefix_length(len(elements), percent)
    if not len(frequent):
        return elements[:size], len(elements)
    found = np.searchsorted(frequent, elements)
    last = frequent[np.minimum(found, len(frequent) - 1)] == elements
    return np.concatenate([elements[~last], elements[last]])[:size], int(len(last) - last.sum())


class _Blocks:
    """Rows of fixed width dealt to buckets by their first field, handed on as (bucket, block)."""

    def __init__(self, dtype: np.dtype, buckets: int):
        self.dtype, self.buckets, self.held, self.size = dtype, buckets, [], 0

    def add(self, rows: np.ndarray) -> bool:
        self.held.append(rows)
        self.size += rows.nbytes
        return self.size >= BUFFERED

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        rows = np.concatenate(self.held)
        self.held, self.size = [], 0
        field = rows if rows.dtype.names is None else rows[rows.dtype.names[0]]
        bucket = (_scramble(field) % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[at[1:], len(rows)]
        blocks = [rows[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])


_COUNT = np.dtype([("element", "<u8"), ("n", "<i8")])


class _Counts(_Blocks):
    """Elements with how often they were held at the time, so that a frequent one is handed on once for many."""

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        elements, n = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        for kind, part in (("block", n == 1), ("counts", n > 1)):
            own = _Blocks(self.dtype if kind == "block" else _COUNT, self.buckets)
            rows = elements[part] if kind == "block" else np.empty(int(part.sum()), _COUNT)
            if kind == "counts":
                rows["element"], rows["n"] = elements[part], n[part]
            own.add(rows)
            for batch in own.flush():
                none = pa.nulls(batch.num_rows, pa.binary())
                blocks = batch.column("block")
                yield pa.RecordBatch.from_arrays([batch.column("bucket"), blocks if kind == "block" else none, none if kind == "block" else blocks], names=["bucket", "block", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of what `_Counts` handed on, and their counts."""
    single, several = [np.empty(0, np.uint64)], [np.empty(0, _COUNT)]
    for b in batches:
        single += [np.frombuffer(x, np.uint64) for x in b.column("block").drop_null().to_pylist()]
        several += [np.frombuffer(x, _COUNT) for x in b.column("counts").drop_null().to_pylist()]
    once, several = np.concatenate(single), np.concatenate(several)
    elements = np.concatenate([once, several["element"]])
    n = np.concatenate([np.ones(len(once), np.int64), several["n"]])
    order = np.argsort(elements, kind="stable")
    elements, n = elements[order], n[order]
    at = np.flatnonzero(np.r_[True, elements[1:] != elements[:-1]]) if len(elements) else np.empty(0, np.int64)
    return elements[at], np.add.reduceat(n, at) if len(at) else n


def _gather(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for b in batches for x in b.column("block").to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _buckets(spark, elements: float) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(elements / PER_TASK) + 1)


def frequent_shingles(docs: DataFrame, text: str, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least FREQUENT sets hold, sorted, and how many do; counted over all documents."""
    limit = _U(int(COUNTED * 2**64))

    def emit(batches):
        out, seen = _Counts(np.dtype(np.uint64), buckets), set()
        for batch in batches:
            for t in batch.column(0):
                s = shingle_set(t.as_py(), k)
                digest = xxhash.xxh3_128_digest(s)
                if digest not in seen:  # a copy in the same task
                    seen.add(digest)
                    if out.add(s[: np.searchsorted(s, limit)]):
                        yield from out.flush()
        yield from out.flush()
        trim_memory()

    def count(batches):
        elements, n = _summed(batches)
        often = n >= FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(elements[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["element", "n"])

    blocks = docs.select(text).mapInArrow(emit, "bucket int, block binary, counts binary")
    counted = blocks.repartition(buckets, "bucket").mapInArrow(count, "element long, n long")
    counted = materialize(counted, "frequent")
    level = F.floor(4 * F.log2("n")).cast("int")  # at most 256 levels
    levels = counted.groupBy(level.alias("level")).count().collect()
    least, total = 0, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["count"]
        if total > MOST_FREQUENT:
            least = r["level"] + 1
            break
    top = counted.where(level >= least).select("element", "n").toArrow()  # a bound on what tasks are sent, not on pairs
    elements = top.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(elements)
    return elements[order], top.column(1).to_numpy().astype(np.int64)[order]


def signature(elements: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall on each of 64 * SIGNED places. Where the signatures of two
    sets differ in h bits, the sets differ in at least h elements."""
    odd = np.bincount((elements % _U(64 * SIGNED)).astype(np.int64), minlength=64 * SIGNED) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def prefixes(docs: DataFrame, key: str, text: str, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc, n (set size), k1, k2 (of the set), g1, g2 (of the prefix), s0... (signature), rare (elements), prefix."""
    signs = [f"s{i}" for i in range(SIGNED)]
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        often = shared.value
        for batch in batches:
            n, rare, sets, groups, found, parity = [], [], [], [], [], [np.empty((0, SIGNED), np.int64)]
            for t in batch.column(1):
                s = shingle_set(t.as_py(), k)
                p, r = prefix_of(s, often, percent) if len(s) else (s, 0)
                n.append(len(s)), rare.append(r), found.append(p.tobytes()), parity.append(signature(s)[None])
                sets.append(xxhash.xxh3_128_digest(s)), groups.append(xxhash.xxh3_128_digest(np.sort(p)))
            halves = [np.frombuffer(b"".join(x), ">i8").astype(np.int64) for x in (sets, groups)]
            parity = np.concatenate(parity)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), *(pa.array(h[i::2]) for h in halves for i in (0, 1)), *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(SIGNED)), pa.array(rare, pa.int32()), pa.array(found, pa.binary())],
                names=["doc", "n", "k1", "k2", "g1", "g2", *signs, "rare", "prefix"],
            )

    schema = f"doc long, n int, k1 long, k2 long, g1 long, g2 long, {', '.join(f'{x} long' for x in signs)}, rare int, prefix binary"
    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(emit, schema)


_POSTING = np.dtype([("key", "<u8"), ("element", "<u8"), ("group", "<i8"), ("n", "<i4"), ("rare", "<i4")])
_LABELLED = np.dtype([("element", "<u8"), ("group", "<i8"), ("label", "<i8"), ("n", "<i4"), ("alone", "<i4"), ("side", "<i4"), *((f"s{i}", "<u8") for i in range(SIGNED))])


def _pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs (smaller id first) with how often they were found."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    c = np.diff(np.r_[at, len(a)])
    return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(na[at].astype(np.int32)), pa.array(nb[at].astype(np.int32)), pa.array(c.astype(np.int64))], names=["a", "b", "na", "nb", "c"])


def neighbours(rows: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """A linear number of pairs of groups in the list of an element: those next to each other by size,
    and each with the HUBS groups that have the fewest rare elements (in a family of near copies,
    those are the ones that were changed least). Behind them, without sizes, the rows (group,
    element) of lists with more than one group: no others are of use to the second round."""

    def fitting(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        low, high = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"]).astype(np.int64)
        fits = (x["key"] == y["key"]) & (x["group"] != y["group"]) & (100 * low >= percent * high)
        x, y = x[fits], y[fits]
        return x["group"], y["group"], x["n"], y["n"]

    rows = rows[np.lexsort((rows["group"], rows["n"], rows["key"]))]
    found = [fitting(rows[:-1], rows[1:])]
    rows = rows[np.lexsort((rows["group"], rows["rare"], rows["key"]))]
    begin = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]]) if len(rows) else np.empty(0, np.int64)
    first = np.repeat(begin, np.diff(np.r_[begin, len(rows)]))
    for hub in range(HUBS):
        behind = np.flatnonzero(np.arange(len(rows)) > first + hub)
        found.append(fitting(rows[first[behind] + hub], rows[behind]))
    yield _pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))
    size = np.repeat(np.diff(np.r_[begin, len(rows)]), np.diff(np.r_[begin, len(rows)]))
    shared = rows[size > 1]
    none = pa.nulls(len(shared), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(shared["group"]), pa.array(shared["element"].view(np.int64)), none, none, pa.nulls(len(shared), pa.int64())], names=["a", "b", "na", "nb", "c"])


def crossing(rows: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """All pairs of groups in the list of an element whose labels differ and whose signatures allow it
    (those of groups with one member), in bounded batches."""
    rows = rows[np.lexsort((rows["group"], rows["label"], rows["element"]))]
    if not len(rows):
        return
    element, label = rows["element"], rows["label"]
    new_list = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
    list_end = np.repeat(np.r_[new_list[1:], len(rows)], np.diff(np.r_[new_list, len(rows)]))
    new_label = np.flatnonzero(np.r_[True, (element[1:] != element[:-1]) | (label[1:] != label[:-1])])
    label_end = np.repeat(np.r_[new_label[1:], len(rows)], np.diff(np.r_[new_label, len(rows)]))
    todo = np.flatnonzero(label_end < list_end)  # rows with another label behind them
    partners = list_end[todo] - label_end[todo]
    upto = np.cumsum(partners)
    begin = 0
    while begin < len(todo):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - partners[begin] + PAIRS, "right")))
        i, m = todo[begin:end], partners[begin:end]
        first = np.repeat(i, m)
        second = np.repeat(label_end[i] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(int(m.sum()))
        x, y = rows[first], rows[second]
        low, high = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"]).astype(np.int64)
        differ = sum((np.bitwise_count(x[f"s{i}"] ^ y[f"s{i}"]).astype(np.int64) for i in range(SIGNED)), np.zeros(len(x), np.int64))
        most = low + high - 2 * -(-percent * (low + high) // (100 + percent))  # elements that they may differ in
        fits = (100 * low >= percent * high) & ((differ <= most) | (x["alone"] == 0) | (y["alone"] == 0))
        fits &= (x["side"] != y["side"]) | (x["side"] == BOTH)  # of a cell, the rows of one part with those of the other
        x, y = x[fits], y[fits]
        yield _pairs(x["group"], y["group"], x["n"], y["n"])
        begin = end


def overlap_needed(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent).cast("long") * (na.cast("long") + nb) / (100 + percent) - 1e-9)


def signatures_allow(percent: int) -> Column:
    """Whether the members a and b (sizes na and nb, signatures a0..., b0...) can be similar enough."""
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SIGNED)), F.lit(0))
    return differ <= F.col("na").cast("long") + F.col("nb") - 2 * overlap_needed(F.col("na"), F.col("nb"), percent)


PAIR = "a long, b long, na int, nb int, c long"


#: The side of a row that meets all rows of its list or cell.
BOTH = 2


class Hot:
    """Elements of lists that are cut: how many parts each has, and the group that stands in all of them."""

    def __init__(self, elements: np.ndarray, parts: np.ndarray, hubs: np.ndarray):
        self.elements, self.parts, self.hubs = elements, parts, hubs

    def find(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where `elements` has hot ones, and which they are."""
        if not len(self.elements):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.elements, elements), len(self.elements) - 1)
        where = np.flatnonzero(self.elements[at] == elements)
        return where, at[where]

    def rows(self, rows: np.ndarray) -> np.ndarray:
        """`rows` of one group with the keys of their parts, and the group's other rows where it is a hub."""
        where, which = self.find(rows["element"])
        if not len(where):
            return rows
        group = rows["group"][where]
        part = _scramble(group.view(np.uint64)) % self.parts[which].astype(np.uint64)
        rows["key"][where] = _scramble(rows["element"][where] + _MIX * (part + _U(1)))
        more = [rows]
        for i in np.flatnonzero(self.hubs[which] == group):
            others = np.arange(self.parts[which[i]], dtype=np.uint64)
            copies = np.repeat(rows[where[i] : where[i] + 1], len(others))
            copies["key"] = _scramble(copies["element"] + _MIX * (others + _U(1)))
            more.append(copies[others != part[i]])
        return np.concatenate(more)


def hot_lists(groups: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> Hot:
    """The lists that may have more than LIST_ROWS groups (of the frequent elements, so at most MOST_FREQUENT)."""
    hot = counts > LIST_ROWS
    elements, parts = frequent[hot], -(-counts[hot] // LIST_ROWS)
    if not len(elements):
        return Hot(elements, parts, np.empty(0, np.int64))
    own = Hot(elements, parts, np.zeros(len(elements), np.int64))

    def least(batches):  # in each task, the group with the fewest rare elements of every hot list
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            doc, rare = batch.column("doc").to_pylist(), batch.column("rare").to_pylist()
            for i, p in enumerate(batch.column("prefix").to_pylist()):
                for e in own.find(np.frombuffer(p, np.uint64))[1].tolist():
                    best[e] = min(best.get(e, (rare[i], doc[i])), (rare[i], doc[i]))
        columns = list(best), [r for r, _ in best.values()], [d for _, d in best.values()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["e", "rare", "doc"])

    found = groups.select("doc", "rare", "prefix").mapInArrow(least, "e long, rare int, doc long")
    for r in found.groupBy("e").agg(F.min_by("doc", F.struct("rare", "doc")).alias("doc")).collect():  # a row for each hot list
        own.hubs[r["e"]] = r["doc"]
    return own


def first_pairs(groups: DataFrame, percent: int, buckets: int, hot: Hot) -> DataFrame:
    """What `neighbours` finds among the groups (doc, n, rare, prefix)."""
    shared = groups.sparkSession.sparkContext.broadcast(hot)

    def deal(batches):
        out, cut = _Blocks(_POSTING, buckets), shared.value
        for batch in batches:
            doc, n, rare = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "n", "rare"))
            for i, p in enumerate(batch.column("prefix").to_pylist()):
                elements = np.frombuffer(p, np.uint64)
                rows = np.empty(len(elements), _POSTING)
                rows["key"], rows["element"], rows["group"], rows["n"], rows["rare"] = elements, elements, doc[i], n[i], rare[i]
                if out.add(cut.rows(rows)):
                    yield from out.flush()
        yield from out.flush()

    def meet(batches):
        yield from neighbours(_gather(batches, _POSTING), percent)
        trim_memory()

    blocks = groups.select("doc", "n", "rare", "prefix").mapInArrow(deal, "bucket int, block binary")
    return blocks.repartition(buckets, "bucket").mapInArrow(meet, PAIR)


def in_cells(postings: DataFrame) -> DataFrame:
    """Postings (element, size of its list, group and others), those of long lists once for each cell that their part is in."""
    parts = F.ceil(F.col("size") / CELL_ROWS).cast("int")
    own = F.pmod(F.xxhash64("group"), F.col("__parts")).cast("int")
    cut = postings.withColumn("__parts", parts).withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    cell = F.xxhash64("element", F.least("__own", "__other"), F.greatest("__own", "__other"))
    side = F.when(F.col("__own") == F.col("__other"), BOTH).otherwise((F.col("__own") > F.col("__other")).cast("int"))
    cut = cut.withColumn("side", side).withColumn("element", F.when(F.col("__parts") > 1, cell).otherwise(F.col("element")))
    return cut.drop("__parts", "__own", "__other", "size")


def second_pairs(postings: DataFrame, percent: int, buckets: int) -> DataFrame:
    """What `crossing` finds among postings (the columns of _LABELLED)."""

    def deal(batches):
        out = _Blocks(_LABELLED, buckets)
        for batch in batches:
            rows = np.empty(batch.num_rows, _LABELLED)
            for name in _LABELLED.names:
                x = batch.column(name).to_numpy(zero_copy_only=False)
                rows[name] = x.view(np.uint64) if _LABELLED[name] == np.uint64 else x
            if out.add(rows):
                yield from out.flush()
        yield from out.flush()

    def meet(batches):
        yield from crossing(_gather(batches, _LABELLED), percent)
        trim_memory()

    blocks = postings.select(*_LABELLED.names).mapInArrow(deal, "bucket int, block binary")
    return blocks.repartition(buckets, "bucket").mapInArrow(meet, PAIR)


def possible_pairs(found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of groups that share enough prefix elements for the similarity to be possible."""
    pairs = found.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
    # Overlap needed, less what can lie behind the prefixes.
    need = overlap_needed(F.col("na"), F.col("nb"), percent)
    rest = lambda n: F.ceil(F.lit(percent).cast("long") * F.col(n) / 100 - 1e-9) - 1  # noqa: E731  elements behind the prefix
    return pairs.where(F.col("c") >= need - F.greatest(rest("na"), rest("nb"))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose whole sets are similar enough."""
    schema = "doc long, elements binary"

    def sets(batches):
        for batch in batches:
            blocks = [shingle_set(t.as_py(), k).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.binary())], names=["doc", "elements"])

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    spark = pairs.sparkSession
    if pairs.limit(1).count() == 0:
        return spark.createDataFrame([], "a long, b long")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    own = docs.select(F.col(key).cast("long").alias("doc"), text).join(bounded(wanted), "doc", "left_semi")
    own = materialize(own.mapInArrow(sets, schema), "sets")
    small = (own.agg(F.sum(F.length("elements") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    side = lambda df: F.broadcast(df) if small else df.hint("merge")
    joined = pairs.select("a", "b").join(side(own.select(F.col("doc").alias("a"), F.col("elements").alias("x"))), "a")
    joined = joined.join(side(own.select(F.col("doc").alias("b"), F.col("elements").alias("y"))), "b").select("a", "b", "x", "y")
    links = materialize(joined.mapInArrow(similar, "a long, b long").distinct(), "links")
    discard(own), discard(wanted)
    return links


def _forest(batches):
    """The links of a task as stars: every node with the smallest node it reaches in this task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """doc, component (the smallest document reachable) of every document in `links` (a, b).

    Large and small stars take turns until nothing changes: a node's larger neighbours are
    linked to its smallest one, then its smaller neighbours are. Both keep what is connected,
    and the number of rounds grows with the logarithm of the longest chain.
    """
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_forest, "u long, v long").distinct(), "stars")
    while True:  # edges have u > v
        n = edges.count()
        side = lambda df, few=n <= BROADCAST_ROWS: F.broadcast(df) if few else df.hint("merge")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u")
        small = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        same = small.count() == n and small.join(side(edges), ["u", "v"], "left_anti").limit(1).count() == 0
        discard(edges), discard(large)
        edges = small
        if same:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    elements = (docs.select(F.sum(F.length(text))).first()[0] or 0) / 5.0
    buckets = _buckets(spark, COUNTED * elements)
    frequent, held = frequent_shingles(docs, text, k, buckets)
    rows = materialize(prefixes(docs, key, text, k, percent, frequent), "prefixes")
    signs = [f"s{i}" for i in range(SIGNED)]
    usable = rows.where((F.col("n") > 0) & F.col("doc").isNotNull())
    nodes = materialize(usable.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("g1").alias("g1"), F.first("g2").alias("g2"), *(F.first(x).alias(x) for x in signs), F.count("*").alias("copies")), "nodes")
    by_prefix = ["n", "g1", "g2"]
    groups = usable.groupBy(*by_prefix).agg(F.min("doc").alias("doc"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"))
    groups = materialize(groups, "groups")
    members = nodes.join(bounded(groups.select(*by_prefix, F.col("doc").alias("group"))), by_prefix)
    members = materialize(members.select("group", "doc", "n", *signs), "members")
    buckets = _buckets(spark, elements * (100 - percent) / 100)

    # First round: neighbours, among the groups of an element and among the members of a group.
    met = materialize(first_pairs(groups, percent, buckets, hot_lists(groups, frequent, held)), "met")
    near = possible_pairs(met.where("c IS NOT NULL"), percent)
    inside = members.where(F.col("group") != F.col("doc")).select(F.col("group").alias("a"), F.col("doc").alias("b"))
    links = verified(materialize(near.unionByName(inside).distinct(), "near"), docs, key, text, k, percent)
    first = components(links)

    # Second round: what the first has left in different components.
    members = members.join(bounded(first), "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    members = materialize(members, "labelled")
    spread = members.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    label = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("group"))
    spread = materialize(spread.select("group", label.alias("label"), (F.col("size") == 1).cast("int").alias("alone")), "spread")
    about = materialize(members.where(F.col("doc") == F.col("group")).select("group", "n", *signs).join(bounded(spread), "group"), "about")
    shared = met.where("c IS NULL").select(F.col("b").alias("element"), F.col("a").alias("group"))
    # Only lists with more than one label have pairs left.
    lists = shared.join(bounded(spread.select("group", "label")), "group").groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    lists = materialize(lists.where("low <> high").select("element", "size"), "lists")
    left = attach(shared, lists, ["element"], "inner").join(bounded(about), "group")
    far = materialize(possible_pairs(second_pairs(in_cells(left), percent, buckets), percent), "far")
    # Members of paired groups, and of groups that are in several components; the signatures rule
    # out most of those that are not similar before their sets are looked at.
    side = lambda df, x: df.select(F.col("group").alias(x), *(F.col(c).alias(c.replace("s", x) if c in signs else f"{c}{x}") for c in ("doc", "n", "label", *signs)))
    possible = (F.col("labela") != F.col("labelb")) & signatures_allow(percent)
    mixed = materialize(members.join(bounded(spread.where(F.col("label") < 0).select("group")), "group", "left_semi"), "mixed")
    one = far.join(bounded(side(members, "a")), "a").select(F.col("b").alias("meets"), *[c for c in side(members, "a").columns if c != "a"])
    across = one.join(bounded(side(members, "b")), (F.col("meets") == F.col("b")) & possible).select("doca", "docb")
    within = side(mixed, "a").join(bounded(side(mixed, "b")), (F.col("a") == F.col("b")) & (F.col("doca") < F.col("docb")) & possible).select("doca", "docb")
    pairs = materialize(across.unionByName(within).select(F.least("doca", "docb").alias("a"), F.greatest("doca", "docb").alias("b")).distinct(), "pairs")
    more = verified(pairs, docs, key, text, k, percent)
    if more.limit(1).count():
        stars = first.select(F.col("doc").alias("a"), F.col("component").alias("b"))
        first = components(stars.unionByName(more))

    copies = nodes.where("copies > 1").select("k1", "k2", F.col("doc").alias("node"))
    out = attach(rows.select("doc", "n", "k1", "k2"), copies, ["k1", "k2"]).withColumn("node", F.when(F.col("n") > 0, F.coalesce("node", "doc")).otherwise(F.col("doc")))
    out = attach(out, first.select(F.col("doc").alias("node"), "component"), ["node"])
    return out.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def unique_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a document of smaller key stands for; columns as they were."""
    tables: list[str] = []
    with scratch(tables):
        found = jaccard_components(docs, key, text, k, percent)
    found = materialize(found, "components")
    delete(docs.sparkSession, tables)
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    kept = docs.join(bounded(gone), key, "left_anti")
    repeated = found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count()
    if repeated:
        kept = kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))
    return kept.select(*docs.columns)


def op10_prefix_join(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
