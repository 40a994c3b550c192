"""What the corpus operators once left out: each test fails on a version that does less than the whole job."""

import json
import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from spanwright.llm import common, html_main, licence_scan, packing, pfair_mix, warc

PAGES = "page_id long, url string, html string"


# ---- templates of sites

def test_templates_inside_articles_go_and_copies_stay(spark):
    bar = '<div class="x1"><p>Tell a friend</p></div><div class="x2"><p>Read more here</p></div>'
    story = lambda i: "".join(f"<p>story {i} has a part {k} of its own that is told nowhere else</p>" for k in range(4))
    copied = "".join(f"<p>paragraph {k} of an article that is on several pages of this host</p>" for k in range(4))
    own = [(i, "http://h/x", f"<article><h1>Title {i}</h1>{bar}{story(i)}</article>") for i in range(8)]
    copies = [(20 + i, "http://h/y", f"<main><p>{i} October</p>{copied}{bar}</main>") for i in range(8)]
    quote = [(40, "http://h/z", f"<article>{story(40)}<p>paragraph 1 of an article that is on several pages of this host</p></article>")]
    alone = [(50 + i, "http://k/", f"<article><p>{i}</p>{copied}</article>") for i in range(4)]
    got = {r["page_id"]: r for r in html_main.main_text(spark.createDataFrame(own + copies + quote + alone, PAGES)).collect()}
    for i in range(8):
        assert got[i]["n_removed"] == 2 and got[i]["text"].split("\n")[:2] == [f"Title {i}", f"story {i} has a part 0 of its own that is told nowhere else"]
        assert got[20 + i]["n_removed"] == 2 and len(got[20 + i]["text"].split("\n")) == 5
    assert got[40]["n_removed"] == 0 and len(got[40]["text"].split("\n")) == 5
    assert all(got[50 + i]["n_removed"] == 0 and len(got[50 + i]["text"].split("\n")) == 5 for i in range(4))


def test_a_subtree_on_many_pages_is_a_template_below_the_share(spark, monkeypatch):
    rows = [(i, "http://h/x", ("<div><p>section note</p></div>" if i < 6 else "") + f"<div><p>text {i}</p></div>") for i in range(40)]
    pages = spark.createDataFrame(rows, PAGES)
    assert html_main.main_text(pages).where("n_removed > 0").count() == 0
    monkeypatch.setattr(html_main.site_templates, "__defaults__", (3, 0.3, 5))
    assert html_main.main_text(pages).where("n_removed > 0").count() == 6


# ---- mixing

def targets(units, blocks):
    """Blocks due to each source after each slot, in fractions: who still has some shares by units."""
    due = {s: Fraction(0) for s in blocks}
    for _ in range(sum(blocks.values())):
        left = Fraction(1)
        while left:
            active = [s for s in blocks if due[s] < blocks[s]]
            total = sum(units[s] for s in active)
            step = min(left, *((blocks[s] - due[s]) * total / units[s] for s in active))
            for s in active:
                due[s] += step * units[s] / total
            left -= step
        yield due


def within_a_block(order, units, blocks):
    done = dict.fromkeys(blocks, 0)
    for s, due in zip(order, targets(units, blocks), strict=True):
        done[s] += 1
        if not all(abs(due[x] - done[x]) < 1 for x in blocks):
            return False
    return done == blocks


def test_cycles_keep_all_within_a_block():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 20):
        for _ in range(20):
            units = [rng.randint(1, 30) for _ in range(n)]
            counts = [rng.randint(1, u) for u in units]
            who, block, slot = pfair_mix.one_cycle(units, counts)
            order = [w for _, w in sorted(zip(slot.tolist(), who.tolist(), strict=True))]
            assert within_a_block(order, dict(enumerate(units)), dict(enumerate(counts)))
            assert all((slot[who == w][1:] > slot[who == w][:-1]).all() for w in range(n))


def test_many_sources_stay_within_a_block_to_the_end(spark):
    rng = random.Random(4)
    for units, blocks in (
        ({"a": 3, "b": 1, "c": 2}, {"a": 40, "b": 5, "c": 31}),  # they run out one after another
        ({f"s{i}": 1 + i % 5 for i in range(60)} | {"s0": 90}, {f"s{i}": rng.randint(1, 12) for i in range(60)} | {"s0": 400}),
    ):
        rows = [(f"{s}-{k}", s, 100) for s, n in blocks.items() for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id string, source string, n long")
        out = pfair_mix.mix(docs, units, size="n", block_chars=100).collect()
        assert len(out) == len(rows) and sorted(r["mix_slot"] for r in out) == list(range(len(rows)))
        order = [r["source"] for r in sorted(out, key=lambda r: r["mix_slot"])]
        assert all(r["mix_source"] == r["source"] for r in out) and within_a_block(order, units, blocks)


def test_a_cycle_of_600_and_of_100_000_sources():
    units = np.array([900, *(1 + i % 5 for i in range(1, 600))])
    who, _, slot = pfair_mix.one_cycle(units, units)
    done, total = np.zeros(600, np.int64), int(units.sum())
    for t, w in enumerate(who[np.argsort(slot)].tolist(), 1):
        done[w] += 1
        assert (np.abs(units * t - done * total) < total).all()
    units = 1 + np.arange(100_000) % 5
    who, block, slot = pfair_mix.one_cycle(units, np.maximum(units - np.arange(100_000) % 2, 1))
    assert (np.sort(slot) == np.arange(len(who))).all()


def test_groups_of_a_source_are_summed_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "GROUP_ROWS", 2)
    monkeypatch.setattr(pfair_mix, "FAN", 3)
    rows = [(i, "a" if i % 3 else "b", 7 * (i % 11)) for i in range(300)]
    out = pfair_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, n long"), size="n", block_chars=50).collect()
    for s in "ab":
        own = sorted((r for r in out if r["source"] == s), key=lambda r: r["mix_place"])
        assert [r["mix_place"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["mix_block"] == min(at, sum(x["n"] for x in own) - 1) // 50
            at += r["n"]
        slots = [r["mix_slot"] for r in own]
        assert slots == sorted(slots) and len(set(slots)) == len({r["mix_block"] for r in own})


def test_packed_sequences_follow_the_mix(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda chars: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(chars // 6))
    rows = [(f"{s}{i}", words(size), s) for s, n, size in (("a", 60, 20_000), ("b", 1500, 800)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(5)
    monkeypatch.setattr(packing, "RUN_SEQUENCES", 40)
    mixed = common.materialize(corpus_pipeline.mix_sources(spark, docs, "test"), "mixed")
    for given in (docs, mixed):  # rows without an order, and those that the stage before wrote
        out = corpus_pipeline.pack_sequences(spark, given, "test").withColumn("source", F.substring("doc_id", 1, 1))
        pieces = sorted((r["sequence_id"], r["offset"], r["length"], r["source"]) for r in out.collect())
        assert sum(p[2] for p in pieces) == sum(len(packing.encoder(packing.tokenizer_path()).encode(t)) // 4 + 1 for _, t, _ in rows)
        total, own, shares = sum(p[2] for p in pieces), [0, 0], []
        for _, _, length, source in pieces:
            own[source == "a"] += length
            if sum(own) >= total * (len(shares) + 1) / 8 and len(shares) < 8:
                shares.append(own[1] / sum(own))
        assert len(shares) == 8 and all(abs(x - shares[-1]) < 0.15 for x in shares)
        used = {}
        for q, offset, length, _ in pieces:  # no gaps, and no sequence beyond its window
            assert offset == used.get(q, 0)
            used[q] = offset + length
        assert sorted(used) == list(range(len(used))) and max(used.values()) <= 2048
        short = sum(x < 2048 - 3 * 7 for x in used.values())
        assert short <= len(used) // 40 + 5  # one for each run


def test_sequences_follow_the_rows_of_files(spark, tmp_path, monkeypatch):
    """Documents of a run of one sequence each come back in the order in which they were written."""
    monkeypatch.setattr(packing, "RUN_SEQUENCES", 1)
    rows = [(i, "word " * 3000) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.col("doc_id").desc()).write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    first = packing.pack_in_order(read, packing.tokenizer_path()).where("start = 0").orderBy("sequence_id", "offset")
    assert [r["doc_id"] for r in first.collect()] == list(range(59, -1, -1))
    by_column = packing.pack_in_order(read.withColumn("text", F.lit("x")), packing.tokenizer_path(), order=["doc_id"]).orderBy("sequence_id", "offset")
    assert [r["doc_id"] for r in by_column.collect()] == list(range(60))


def test_pieces_of_a_run_are_placed_once():
    rng = random.Random(8)
    for _ in range(30):
        window = rng.choice([16, 64, 256])
        pieces = [(n, bytes(4 * n)) for n in (rng.randint(1, window) for _ in range(rng.randint(1, 200)))]
        found = packing.placed(pieces, window)
        for i, (n, _) in enumerate(pieces):
            own = sorted((skip, take) for x, skip, take, _, _ in found if x == i)
            assert [skip for skip, _ in own] == [sum(t for _, t in own[:k]) for k in range(len(own))] and sum(t for _, t in own) == n
        used = {}
        for _, _, n, q, offset in sorted(found, key=lambda x: x[3:]):
            assert offset == used.get(q, 0)
            used[q] = offset + n
        assert sorted(used) == list(range(len(used))) and max(used.values()) <= window
        begins = {}
        for i, _, _, q, _ in found:
            begins[q] = min(i, begins.get(q, i))
        assert [begins[q] for q in range(len(used))] == sorted(begins.values())


# ---- licences

def test_each_copy_of_a_licence_is_a_span():
    mit, other = ([w.decode() for w in licence_scan.words_of(licence_scan.TEMPLATES[i][1])] for i in (0, 1))
    gap = ["zzz"] * 20
    *_, labels, score, spans = licence_scan.Scanner().scan([" ".join([*mit, *gap, *mit, *mit, *gap, *other, *gap, *mit])])[0]
    n = len(mit)
    begins = [0, n + 20, 2 * n + 20, 3 * n + 60 + len(other)]
    own = licence_scan.TEMPLATES[0][0]
    assert sorted((x["first"], x["last"]) for x in spans if x["label"] == own and x["covered"] == 1.0) == [(b, b + n - 1) for b in begins]
    assert score == 1.0 and own in labels.split(",")


def test_a_licence_in_pieces_keeps_its_label():
    name, text = licence_scan.TEMPLATES[0]
    words = [w.decode() for w in licence_scan.words_of(text)]
    k, gap = len(words) // 3, ["zzz"] * 20
    *_, labels, score, spans = licence_scan.Scanner().scan([" ".join([*words[:k], *gap, *words[k : 2 * k], *gap, *words[2 * k :]])])[0]
    assert name in labels.split(",") and score > 0.95
    assert sorted(x["first"] for x in spans if x["label"] == name) == [0, k + 20, 2 * k + 40]


# ---- WARC

def test_metadata_keeps_repeated_headers():
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\n\r\n<p>x</p>"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nWARC-Concurrent-To: <urn:2>\r\nWARC-Concurrent-To: <urn:3>\r\nContent-Length: %d\r\n\r\n" % len(block)
    about = json.loads(warc.derivatives(head + block)[1][1])
    assert about["http-headers"]["set-cookie"] == ["a=1", "b=2"] and about["http-headers"]["content-type"] == "text/html"
    assert about["source-headers"]["warc-concurrent-to"] == ["<urn:2>", "<urn:3>"] and about["source-headers"]["warc-type"] == "response"
