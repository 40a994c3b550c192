"""Reassembled conversations against a plain run over all batches in memory."""

import hashlib
from collections import defaultdict

from spanwright.llm import turn_reassembly


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def plain(rows):
    first, batches, state, out = {}, [defaultdict(dict) for _ in range(10)], {}, []
    for conv, turn, role, text in rows:
        if turn is None:
            continue
        first[conv] = min(first.get(conv, turn), turn)
        h = int(digest(f"{'' if conv is None else conv}:{turn}".encode())[:8], 16)
        for batch, own in [(h % 10, role or "")] + ([((h + 5) % 10, "user")] if h % 7 < 2 else []):
            sent = (f"{own}|{text or ''}".encode(), own)
            batches[batch][conv][turn] = min(sent, batches[batch][conv].get(turn, sent))

    def close(conv, batch):
        kept, s = state[conv]["kept"], state[conv]
        s["closed"] = True
        waiting = ",".join(str(t) for t in sorted(kept) if t >= s["next"])
        breaks = sum(t - 1 in kept and kept[t - 1][1] == kept[t][1] for t in kept)
        out.append(("close", digest(waiting.encode()), conv, -1, batch, max(kept) - first[conv] + 1 - len(kept), breaks))

    for batch in range(10):
        for conv, turns in batches[batch].items():
            s = state.setdefault(conv, {"kept": {}, "next": first[conv], "closed": False})
            if s["closed"]:
                out += [("reject", digest(p), conv, t, batch, None, None) for t, (p, _) in turns.items()]
                continue
            s["last"] = batch
            for t, sent in turns.items():
                s["kept"].setdefault(t, sent)
            while s["next"] in s["kept"]:
                out.append(("release", digest(s["kept"][s["next"]][0]), conv, s["next"], batch, None, None))
                s["next"] += 1
        for conv, s in state.items():
            if not s["closed"] and batch - s["last"] >= 2:
                close(conv, batch)
    for conv, s in state.items():
        if not s["closed"]:
            close(conv, 10)
    return sorted(out, key=repr)


def test_hard_cases(spark, monkeypatch):
    """Long, sparse and repeated conversations, nulls, ties, negative and very large turns, blocks of two turns."""
    monkeypatch.setattr(turn_reassembly, "BLOCK_TURNS", 2)
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(120)]
    rows += [(2, t * 7 - 50, "user", None) for t in range(30)] + [(c, 0, None, "same") for c in range(3, 60)]
    rows += [(None, t, "user", "n") for t in range(4)] + [(70, None, "user", "gone"), (71, 2**60, "a", "x"), (71, 2**60 + 1, "a", "y")]
    rows += [(72, 5, "a|b", "c"), (72, 5, "a", "b|c"), (72, 5, "z", ""), (72, 6, "a", "é"), (72, 6, "a", "z")] * 2
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, batch string")
    got = turn_reassembly.reassemble(frame).select("event", "sha256", "conv", "turn", "batch", "n_missing", "n_breaks")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_query_and_new_folder_each_time(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = turn_reassembly.op12_turn_reassembly(spark, folder).select("event", "sha256", "conv_id", "turn", "batch", "n_missing", "n_breaks")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_empty_table(spark):
    assert turn_reassembly.reassemble(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
