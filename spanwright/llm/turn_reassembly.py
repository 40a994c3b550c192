"""Conversations put together again from turns that arrive in batches, out of order and repeated.

A stateful Structured Streaming query takes the batches one after another, started anew for each
on one checkpoint. Conversations are dealt to hash buckets, and a bucket is the key of the state.
It keeps three things, each read by its own key and none as a whole:

- a record for each conversation: its first turn, the next one to release, what was kept so far;
- the kept turns that wait for one before them, in blocks of BLOCK_TURNS turn numbers;
- a timing wheel: a list of conversations for each batch in which some may close.

An arrival files its conversation under the batch that closes it if nothing else comes, with a new
generation; the entries of older generations stay where they are and are passed over. A tick, one
row for each bucket and batch, visits the list that is due and empties it; the last one visits all.
Turns that were released, and all turns of a closed conversation, leave the state: what stays is
a record. State holds roles and digests, not texts.

So a task holds one bucket's arrivals of one batch as they stream by, a block of waiting turns and
one list of the wheel; buckets follow the number of rows. Batches are prepared by joins
and aggregates, nothing but the number of rows comes to the driver, and events go to a file sink that
takes each batch once.

Defined cases: rows without a turn are dropped; null roles and texts are empty; rows with a null
conversation are one conversation (its digest for dealing takes an empty id); of rows with the same
turn in one batch, the smallest payload arrives (then the smallest role); other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import forget_at_exit, stage_folder

BATCHES, PATIENCE, BLOCK_TURNS = 10, 2, 256
#: Rows of all batches that a bucket should have, and buckets there are at least.
BUCKET_ROWS, LEAST_BUCKETS = 4_000, 64
EVENTS = "event string, conv string, turn long, batch long, sha256 string, n_missing long, n_breaks long"
ARRIVALS = "bucket int, conv string, turn long, first long, role string, sha256 string, tick int, batch int"
_PLAIN, _TICK, _LAST = 0, 1, 2


class Reassembly(StatefulProcessor):
    """State of one bucket: what arrives, and what a tick closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "conv string", "record string")
        self.waiting = handle.getMapState("waiting", "conv string, block long", "turns string")
        self.wheel = [handle.getListState(f"due{k}", "conv string, generation long") for k in range(PATIENCE + 1)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tick = None
        for frame in rows:
            ticks = frame[frame["tick"] > _PLAIN]
            if len(ticks):
                tick = (int(ticks["batch"].iloc[0]), int(ticks["tick"].iloc[0]) == _LAST)
            arrived = frame[frame["tick"] == _PLAIN].sort_values(["conv", "turn"])
            events: list[tuple] = []
            for conv, own in arrived.groupby("conv", sort=False):
                turns = zip(own["turn"].tolist(), own["role"].tolist(), own["sha256"].tolist(), strict=True)
                self._arrive(conv, int(own["batch"].iloc[0]), int(own["first"].iloc[0]), list(turns), events)
            if events:
                yield _frame(events)
        if tick is not None:
            events = []
            self._tick(*tick, events)
            if events:
                yield _frame(events)

    def close(self) -> None:
        pass

    def _arrive(self, conv: str, batch: int, first: int, turns: list[tuple[int, str, str]], events: list[tuple]) -> None:
        held = self.records.getValue((conv,)) if self.records.containsKey((conv,)) else None
        record = json.loads(held[0]) if held else {"first": first, "next": first, "role": None, "kept": 0, "high": first, "breaks": 0, "due": -1, "generation": 0, "blocks": []}
        if "first" not in record:  # closed
            events += [("reject", conv, turn, batch, sha, None, None) for turn, _, sha in turns]
            return
        if record["due"] != batch + PATIENCE:
            record["due"], record["generation"] = batch + PATIENCE, record["generation"] + 1
            self.wheel[record["due"] % len(self.wheel)].appendValue((conv, record["generation"]))
        known, changed = set(record["blocks"]), set()
        loaded: dict[int, dict[str, list[str]]] = {}

        def block(turn: int) -> dict[str, list[str]]:
            k = turn // BLOCK_TURNS
            if k not in loaded:
                for old in [x for x in loaded if abs(x - k) > 1]:
                    self._put(conv, old, loaded.pop(old), known, changed)
                loaded[k] = json.loads(self.waiting.getValue((conv, k))[0]) if k in known else {}
            return loaded[k]

        def role_of(turn: int) -> str | None:
            """Role of a turn that was kept."""
            if turn < record["next"]:
                return record["role"] if turn == record["next"] - 1 else None
            found = block(turn).get(str(turn))
            return found[0] if found else None

        for turn, role, sha in turns:
            if turn < record["next"] or str(turn) in block(turn):
                continue  # was kept before
            record["breaks"] += (role_of(turn - 1) == role) + (role_of(turn + 1) == role)
            block(turn)[str(turn)] = [role, sha]
            changed.add(turn // BLOCK_TURNS)
            record["kept"] += 1
            record["high"] = max(record["high"], turn)
        while (now := block(record["next"])) and (found := now.pop(str(record["next"]), None)):
            changed.add(record["next"] // BLOCK_TURNS)
            events.append(("release", conv, record["next"], batch, found[1], None, None))
            record["role"], record["next"] = found[0], record["next"] + 1
        for k in list(loaded):
            self._put(conv, k, loaded.pop(k), known, changed)
        record["blocks"] = sorted(known)
        self.records.updateValue((conv,), (json.dumps(record),))

    def _put(self, conv: str, k: int, turns: dict, known: set[int], changed: set[int]) -> None:
        if k not in changed:
            return
        changed.discard(k)
        if turns:
            self.waiting.updateValue((conv, k), (json.dumps(turns),))
            known.add(k)
        elif k in known:
            self.waiting.removeKey((conv, k))
            known.discard(k)

    def _tick(self, batch: int, last: bool, events: list[tuple]) -> None:
        for slot in self.wheel if last else [self.wheel[batch % len(self.wheel)]]:
            if not slot.exists():
                continue
            for conv, generation in list(slot.get()):
                record = json.loads(self.records.getValue((conv,))[0])
                if record.get("generation") == generation:  # else it was filed anew, or is closed
                    self._close(conv, batch, record, events)
            slot.clear()

    def _close(self, conv: str, batch: int, record: dict, events: list[tuple]) -> None:
        digest, comma = hashlib.sha256(), ""
        for k in record["blocks"]:
            for turn in sorted(map(int, json.loads(self.waiting.getValue((conv, k))[0]))):
                digest.update(f"{comma}{turn}".encode())
                comma = ","
            self.waiting.removeKey((conv, k))
        missing = record["high"] - record["first"] + 1 - record["kept"]
        events.append(("close", conv, -1, batch, digest.hexdigest(), missing, record["breaks"]))
        self.records.updateValue((conv,), ("{}",))


def _frame(events: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(events, columns=["event", "conv", "turn", "batch", "sha256", "n_missing", "n_breaks"])
    return out.astype({"n_missing": "Int64", "n_breaks": "Int64"})


def _dealt(conv: str, turn: str) -> Column:
    """h of the contract: the first 32 bits of a digest of conversation and turn."""
    name = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit("")), F.lit(":"), F.col(turn).cast("string"))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def arrivals(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv (an id as JSON, so that null is one too), turn, batch, role, sha256 of the payload, first: what arrives in each batch."""
    rows = conversations.where(F.col(turn).isNotNull())
    rows = rows.select(
        F.to_json(F.struct(F.col(conv).alias("id"))).alias("conv"), F.col(turn).cast("long").alias("turn"), _dealt(conv, turn).alias("h"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    direct = F.struct((F.col("h") % BATCHES).cast("int").alias("batch"), F.col("role").alias("role"))
    again = F.struct(((F.col("h") + 5) % BATCHES).cast("int").alias("batch"), F.lit("user").alias("role"))
    rows = rows.withColumn("sent", F.explode(F.when(F.col("h") % 7 < 2, F.array(direct, again)).otherwise(F.array(direct))))
    payload = F.struct(F.concat(F.col("sent.role"), F.lit("|"), F.col("text")).alias("payload"), F.col("sent.role").alias("role"))
    least = rows.groupBy("conv", "turn", F.col("sent.batch").alias("batch")).agg(F.min(payload).alias("p"))
    least = least.select("conv", "turn", "batch", F.col("p.role").alias("role"), F.sha2(F.col("p.payload").cast("binary"), 256).alias("sha256"))
    first = rows.groupBy("conv").agg(F.min("turn").alias("first"))
    return least.join(first.hint("shuffle_merge"), "conv")


def reassemble(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Events of all conversations: event, conv, turn, batch, sha256, n_missing, n_breaks.

    release: a turn that has all before it; close: nothing came for PATIENCE batches, or the end;
    reject: what came afterwards. The folder of the run goes when the driver ends.
    """
    spark = conversations.sparkSession
    folder = f"{stage_folder(spark)}/turns-{uuid.uuid4().hex}"
    forget_at_exit(spark, folder)
    kind = conversations.schema[conv].dataType.simpleString()
    buckets = max(LEAST_BUCKETS, -(-conversations.count() // BUCKET_ROWS))
    rows = arrivals(conversations, conv, turn, role, text)
    rows = rows.select(F.pmod(F.xxhash64("conv"), F.lit(buckets)).cast("int").alias("bucket"), "conv", "turn", "first", "role", "sha256", F.lit(_PLAIN).alias("tick"), "batch")
    rows.write.partitionBy("batch").parquet(f"{folder}/batches")
    schema = spark.createDataFrame([], ARRIVALS).schema
    cut = spark.read.schema(schema).parquet(f"{folder}/batches")
    ours = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no room set aside for each
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a start runs one batch
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        for batch in range(BATCHES + 1):
            tick = _LAST if batch == BATCHES else _TICK  # no nulls: whole numbers stay whole in pandas
            ticks = spark.range(buckets).selectExpr("cast(id as int) bucket", "'' conv", "0L turn", "0L first", "'' role", "'' sha256", f"{tick} tick", f"{batch} batch")
            now = cut.where(F.col("batch") == batch).unionByName(ticks) if batch < BATCHES else ticks
            now.write.mode("append").parquet(f"{folder}/feed")
            query = (
                spark.readStream.schema(schema).parquet(f"{folder}/feed").groupBy("bucket")
                .transformWithStateInPandas(Reassembly(), outputStructType=EVENTS, outputMode="Append", timeMode="None")
                .writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint")
                .outputMode("append").trigger(availableNow=True).start()
            )
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    events = spark.read.schema(EVENTS).parquet(f"{folder}/events")
    return events.withColumn("conv", F.from_json("conv", f"id {kind}")["id"])


def op12_turn_reassembly(spark, sf_dir):
    events = reassemble(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return events.select("event", "sha256", F.col("conv").cast("long").alias("conv_id"), "turn", "batch", "n_missing", "n_breaks")
