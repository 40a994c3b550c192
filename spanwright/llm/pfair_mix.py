"""Mixing sources to target weights by Pfair scheduling.

Every source is a task whose blocks are its subtasks. Its rate is its weight's share of the weights
of all sources that still have blocks, so over a slot each it is due a fraction of a block; block i
may run from the slot in which it begins to be due and must run by the slot in which it is due in
full. Earliest deadline first over one block per slot meets all deadlines, as the rates sum to one, so in
every prefix of the mix a source deviates from its target by less than one block. When a source runs
out, the others share the slots by their weights. No document is dropped or repeated.

Weights are whole units. A cycle takes a source's units in blocks from it, or what it has left, so at
the borders of cycles nothing is owed and every cycle can be scheduled by itself: source, block and cycle
give the slot by arithmetic. Cycles differ only where sources run out, so there are at most two kinds for
each number of cycles after which one does. Tasks schedule one cycle of each kind, together at most as
many slots as there are blocks; a kind's cycle has at most the units of all sources. The driver holds
a row for each kind of cycle, none for each source.

Inside a source, documents are taken in the order of a hash. Block borders are set by characters:
a document belongs to the block in which it begins. Places in a source come from sums per
(source, hash bucket) and per FAN buckets, so a source with a third of all rows is spread over many tasks.

Defined cases: a null source is the source ""; a null or empty text has no characters; repeated
rows are all mixed in; sources without a given weight get `default` units. An empty table gives
an empty result. Columns with the names of a result are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialize

#: Characters of a block, units of all weights together where none are given (but at least SOURCE_UNITS a source on average).
BLOCK_CHARS, UNITS, SOURCE_UNITS = 65_536, 1_000, 4
#: Rows that a (source, bucket) group holds, buckets whose sums are summed together.
GROUP_ROWS, FAN = 80, 4096
RESULT = {"mix_source", "mix_block", "mix_slot", "mix_place"}


def one_cycle(units: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source (its position), block and slot of all blocks of a cycle, earliest deadline first within the Pfair windows.

    A source is due `units` blocks in a cycle and has 1 to `units` of them (`counts`).
    """
    u, n = np.asarray(units, np.int64), np.asarray(counts, np.int64)
    by_end = np.argsort(n / u, kind="stable")
    ends = (n / u)[by_end]
    gone = np.concatenate([[0], np.cumsum(n[by_end])])  # blocks of sources that ran out
    rate = u.sum() - np.concatenate([[0], np.cumsum(u[by_end])])  # units of the others
    who = np.repeat(np.arange(len(u)), n)
    block = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    own = u[who]

    def due(i: np.ndarray) -> np.ndarray:
        """`own` times the slot at which i blocks are due."""
        k = np.searchsorted(ends, i / own)
        return gone[k] * own + i * rate[k]

    release, deadline = due(block) // own, -(-due(block + 1) // own)
    order = np.argsort(release, kind="stable")
    waiting = release[order].tolist()
    keyed = (deadline * len(who) + np.arange(len(who)))[order].tolist()
    ready: list[int] = []
    slots, following = np.empty(len(who), np.int64), 0
    for now in range(len(who)):
        while following < len(waiting) and waiting[following] <= now:
            heapq.heappush(ready, keyed[following])
            following += 1
        last, x = divmod(heapq.heappop(ready), len(who))
        if last <= now:
            raise AssertionError("a deadline was missed")
        slots[x] = now
    return who, block, slots


def root_units(sizes: DataFrame, alpha: float) -> Column:
    """Units proportional to chars ** alpha, at least one each: large sources are damped, none is lost."""
    share = F.greatest(F.col("chars"), F.lit(1)).cast("double") ** F.lit(float(alpha))
    of_all = sizes.agg(F.count("*").alias("n"), F.sum(share).alias("share")).first()
    units = max(UNITS, SOURCE_UNITS * of_all["n"])
    return F.greatest(F.lit(1), F.round(F.lit(float(units)) * share / F.lit(of_all["share"] or 1.0))).cast("long")


def scheduled(sources: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Slots in all kinds of cycles from (mix_source, units, blocks), and a function from the number of a cycle
    to its kind and first slot. The slots are rows (mix_source, kind, turn, slot): the turn is the block's number in its cycle.
    """
    whole, rest = F.floor(F.col("blocks") / F.col("units")).cast("long"), F.col("blocks") % F.col("units")
    own = sources.select("mix_source", "units", whole.alias("whole"), rest.alias("rest"))
    changes = own.select(F.explode(F.when(F.col("rest") > 0, F.array("whole", F.col("whole") + 1)).otherwise(F.array("whole"))).alias("c"))
    begins = np.array(sorted({0, *(r["c"] for r in changes.distinct().collect())}), np.int64)

    @F.pandas_udf("long")
    def kind_of(cycle: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begins, cycle, side="right") - 1)

    # All units in the cycles before the last one, which takes what is left (if anything is).
    in_kinds = own.withColumn("last", kind_of("whole")).withColumn("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - (F.col("rest") == 0).cast("long"))))
    in_kinds = in_kinds.select("mix_source", "kind", "units", F.when(F.col("kind") == F.col("last"), F.col("rest")).otherwise(F.col("units")).alias("n"))

    def schedule(cycle: pd.DataFrame) -> pd.DataFrame:
        cycle = cycle.sort_values("mix_source")
        who, turn, slot = one_cycle(cycle["units"].to_numpy(), cycle["n"].to_numpy())
        return pd.DataFrame({"mix_source": cycle["mix_source"].to_numpy()[who], "kind": cycle["kind"].iloc[0], "turn": turn, "slot": slot})

    slots = materialize(in_kinds.groupBy("kind").applyInPandas(schedule, "mix_source string, kind long, turn long, slot long"), "mix_cycles")
    sizes = np.zeros(len(begins), np.int64)
    for r in slots.groupBy("kind").count().collect():
        sizes[r["kind"]] = r["count"]
    first = np.concatenate([[0], np.cumsum(np.diff(begins) * sizes[:-1])])

    @F.pandas_udf("kind long, first long")
    def place_of(cycle: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(begins, cycle, side="right") - 1
        return pd.DataFrame({"kind": k, "first": first[k] + (cycle.to_numpy() - begins[k]) * sizes[k]})

    return slots, place_of


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    source: str = "source",
    text: str = "text",
    size: str | None = None,
    order_by: list[str] | None = None,
    block_chars: int = BLOCK_CHARS,
    default: int = 1,
    alpha: float = 0.5,
) -> DataFrame:
    """`docs` with mix_source, mix_block (in its source), mix_slot and mix_place (in its source).

    Sorted by (mix_slot, mix_place) the rows are the mix. `weights` are whole units per source;
    without them the target is size ** `alpha`. `size` names a column with the sizes, if they
    aren't to be taken from `text`. `order_by` are the columns that are hashed for the order
    inside a source (default: all of `docs`).
    """
    spark = docs.sparkSession
    key, chars, bucket, order = "mix_source", "__size", "__bucket", "__order"
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    if any(u < 1 for u in [*(weights or {}).values(), default]):
        raise ValueError("weights are whole units of at least 1")
    order_by = [c for c in order_by or kept if c in kept]
    taken = F.col(size) if size else F.length(F.col(text))
    named = docs.select(*kept, F.coalesce(F.col(source), F.lit("")).alias(key), F.coalesce(taken, F.lit(0)).cast("long").alias(chars), F.xxhash64(*order_by).alias(order))
    sources = materialize(named.groupBy(key).agg(F.count("*").alias("n"), F.sum(chars).alias("chars")), "mix_sources")
    if weights:
        given = spark.createDataFrame(list(weights.items()), f"{key} string, units long")
        sources = attach(sources, given, [key]).withColumn("units", F.coalesce("units", F.lit(default)))
    else:
        sources = sources.withColumn("units", root_units(sources, alpha))
    # The last block also holds what begins at the very end.
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("chars") / block_chars).cast("long")))
    named = attach(named, sources.select(key, F.floor(F.col("n") / GROUP_ROWS + 1).cast("long").alias("__buckets")), [key], "inner")
    named = named.withColumn(bucket, F.pmod(F.xxhash64(order), F.col("__buckets"))).drop("__buckets")

    # Where each group begins in its source, then where each document does in its group.
    sums = materialize(named.groupBy(key, bucket).agg(F.sum(chars).alias("chars"), F.count("*").alias("n")), "mix_sums").withColumn("above", F.floor(F.col(bucket) / FAN))
    earlier = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    begin = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    above = sums.groupBy(key, "above").agg(F.sum("chars").alias("chars"), F.sum("n").alias("n"))
    above = above.select(key, "above", *[begin(c, earlier([key], "above")).alias(f"above_{c}") for c in ("chars", "n")])
    groups = sums.select("*", *[begin(c, earlier([key, "above"], bucket)).alias(f"own_{c}") for c in ("chars", "n")]).join(above, [key, "above"])
    groups = groups.select(key, bucket, "chars", (F.col("above_chars") + F.col("own_chars")).alias("__before_chars"), (F.col("above_n") + F.col("own_n")).alias("__before_n"))
    groups = attach(groups, sources.select(key, "units", (F.col("blocks") - 1).alias("__last")), [key], "inner")
    block = lambda at: F.least(F.floor(at / block_chars).cast("long"), F.col("__last"))
    groups = materialize(groups.withColumn("__first", block(F.col("__before_chars"))), "mix_groups")

    # The slots of the blocks of each group.
    slots, place_of = scheduled(sources)
    blocks = groups.select(key, "units", F.col(bucket).alias("bucket"), F.explode(F.sequence(F.col("__first"), block(F.col("__before_chars") + F.col("chars")))).alias("block"))
    blocks = blocks.withColumn("cycle", F.floor(F.col("block") / F.col("units")).cast("long")).withColumn("place", place_of("cycle"))
    blocks = blocks.select(key, "bucket", "block", F.col("place.first").alias("first"), F.col("place.kind").alias("kind"), (F.col("block") - F.col("cycle") * F.col("units")).alias("turn"))
    blocks = attach(blocks, slots, [key, "kind", "turn"], "inner")
    taken = blocks.groupBy(key, F.col("bucket").alias(bucket)).agg(F.sort_array(F.collect_list(F.struct("block", (F.col("first") + F.col("slot")).alias("slot")))).alias("__slots"))
    groups = groups.drop("chars", "units").join(taken, [key, bucket])

    inside = Window.partitionBy(key, bucket).orderBy(order, *order_by).rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumns({"__own_chars": begin(chars, inside), "__own_n": F.count(F.lit(1)).over(inside)}).join(groups, [key, bucket])
    own = block(F.col("__before_chars") + F.col("__own_chars"))
    slot = F.get("__slots", (own - F.col("__first")).cast("int"))["slot"]
    return placed.select(*kept, key, own.alias("mix_block"), slot.alias("mix_slot"), (F.col("__before_n") + F.col("__own_n")).alias("mix_place"))


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The documents in the order of the mix, columns as they were."""
    if {c.lower() for c in docs.columns} & RESULT:  # columns that the mix would replace are put aside
        packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(source).alias("__from"), F.length(text).alias("__length"))
        return mix(packed, source="__from", size="__length").orderBy("mix_slot", "mix_place").select("__row.*")
    return mix(docs, source=source, text=text, order_by=[c for c in docs.columns if c != text]).orderBy("mix_slot", "mix_place").select(*docs.columns)


def op1_pfair_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.length("text").alias("chars"))
    return mix(docs, size="chars", order_by=["doc_id"]).drop("chars", "source")
