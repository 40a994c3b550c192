"""Improbable-feature digests against a plain version, one window at a time."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from spanwright.llm import fingerprint as fp

TEXTS = ["", "a", "short text", "a" * 200, "x" * 31, "y" * 32, "The licence of this text is what it is. " * 9, "Ünïcödé wörds 日本語 " * 12, "".join(chr(33 + i * 7 % 90) for i in range(700)), "same", "same"]


def step(window: bytes) -> int:
    return fp.STEPS - (sum(int(fp._PART[c]) for c in Counter(window).values()) * fp.STEPS) // int(fp._PART[fp.WINDOW])


def features(text: bytes, ranks) -> list[int]:
    n, wins = len(text) - fp.WINDOW + 1, Counter()
    rank = [int(ranks[step(text[i : i + fp.WINDOW])]) for i in range(max(n, 0))]
    for j in range(1 - fp.WINDOW if n > 0 else 0, n):
        own = [(rank[i], i) for i in range(max(j, 0), min(j + fp.WINDOW, n))]
        if min(own)[0] < 0xFFFF:
            wins[min(own)[1]] += 1
    return sorted(i for i, k in wins.items() if k >= fp.LEAST_WINS)


def test_counts_and_features_like_the_plain_version(monkeypatch):
    raw = [t.encode() for t in TEXTS]
    want = Counter(step(t[i : i + fp.WINDOW]) for t in raw for i in range(len(t) - fp.WINDOW + 1))
    for block in (1 << 18, 64):  # small blocks: their borders lie inside texts
        monkeypatch.setattr(fp, "BLOCK_BYTES", block)
        counts = fp.step_counts(raw)
        assert {i: int(n) for i, n in enumerate(counts) if n} == dict(want)
        ranks = fp.ranks_of(counts)
        data, begins, sizes = fp.laid_out(raw)
        at = fp.chosen(data, begins, sizes, ranks)
        for text, b, n in zip(raw, begins, sizes, strict=True):
            assert [int(x - b) for x in at if b <= x < b + n] == features(text, ranks)


def test_digest_is_that_of_the_text_alone():
    raw = [t.encode() for t in TEXTS]
    ranks = fp.ranks_of(fp.step_counts(raw))
    together, alone = fp.digests(raw, ranks), [fp.digests([t], ranks)[0] for t in raw]
    assert list(map(fp.shown, together)) == list(map(fp.shown, alone))
    assert all(fp.shown(fp.read(fp.shown(d))) == fp.shown(d) and fp.likeness(d, d) == 1.0 for d in together)
    assert fp.likeness(together[0], together[2]) == 0.0 == fp.likeness(together[1], together[2])


def plain(rows, ranks):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (fp.digests([x.encode()], ranks)[0] for x in (text, edited, after))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.shown(a), fp.shown(b), fp.likeness(a, b), fp.likeness(a, c)))
    return out


@pytest.mark.parametrize("block_chars", [1_000_000, 300, 1])
def test_edited_texts_follow_the_order(spark, block_chars):
    rows = [(i * 3 % 29, t) for i, t in enumerate([*TEXTS, None, *TEXTS])]
    rows[4] = (None, rows[4][1])
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, p int")
    ranks = fp.rarity_ranks(frame)
    got = fp.against_edited(frame, ranks=ranks, block_chars=block_chars).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows, ranks), key=repr)
    made = fp.fingerprints(frame, ranks=ranks).collect()
    assert sorted(map(tuple, made), key=repr) == sorted([(r[0], r[1], r[3]) for r in plain(rows, ranks)], key=repr)


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    ranks = fp.ranks_of(fp.step_counts([(t or "").encode() for _, t in rows]))
    got = fp.op13_improbable_digest(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows, ranks), key=repr)
    long = [r for r in got if r["n_chars"] >= 300]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 > 0.1 > np.median([r["near_next"] for r in long])


def test_repeated_ids_and_empty_table(spark):
    rows = [(7, "first text of the id"), (7, "another text of the id"), (7, "first text of the id"), (3, "x")]
    got = fp.against_edited(spark.createDataFrame(rows, "doc_id long, text string"), block_chars=5).collect()
    assert len(got) == 4 and len({r["fingerprint"] for r in got}) == 3
    assert fp.against_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
