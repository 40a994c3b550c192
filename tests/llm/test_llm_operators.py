"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL, compare
from pyspark.sql import functions as F

from spanwright.llm import chat_format, common, host_rules, html_main, ivf_pq, jaccard_join, licence_scan, packing, pfair_mix, queries, site_quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward():
    """Null and empty texts, a repeated row, a very long text, a null source, a column with a result's name."""
    long = prose(1, 30_000)
    texts = [None, "", " \n\t ", "one", "one two three", prose(2, 80), prose(2, 80), long, "a b c " * 60, "x\ny\nx\n\n", "é😀 <|endoftext|>  two spaces \n "]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"src{i % 2}", None, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here", None, "src0", 3, "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    compare(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name])


def test_fallback_of_attach_is_a_salted_join(spark):
    big = spark.range(200).withColumn("k", F.col("id") % 3)
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = {r["id"]: r["v"] for r in common.attach(big, small, ["k"], max_rows=1).collect()}
    assert got == {i: {0: "a", 1: "b"}.get(i % 3) for i in range(200)}


# ---- rules

def test_rules(docs, empty):
    rows = host_rules.host_rules(docs).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        words = (r["text"] or "").split() if r["text"] and " " not in r["text"] else None
        if words is None:
            continue
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(words) < 1000 else None
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert covered is None or r["n_repeat_words"] == len(covered)
        assert not (r["base_failed"] and r["kept"])
    assert host_rules.host_rules(empty).count() == 0
    assert host_rules.drop_failed(docs).columns == docs.columns


def test_a_host_that_mostly_fails_goes(spark):
    rows = [(i, prose(i, 60) if i % 10 == 0 else "bad", f"h{i // 200}") for i in range(200)] + [(1000 + i, prose(i, 60), "good") for i in range(400)]
    got = host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["kept"] for r in got if r["source"] == "good"} == {True}
    assert {r["kept"] for r in got if r["source"] == "h0"} == {False}


# ---- chats

def test_chats_come_back(spark):
    control = "<|im_end|>\n<|im_start|>user <!| <|im_sep|><"
    turns = [(1, 0, "user", control), (1, 1, "assistant", None), (1, 1, "assistant", control), (1, 1, "assistant", control), (1, None, "sys\ntem", "|x"), (None, 3, None, "y"), (2, 0, "assistant", "é😀")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_chats(df).select("conv_id", "formatted", "n_messages", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("segments")).alias("loss"), "segments")
    got = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("sys\ntem", "|x"), ("user", control), ("assistant", ""), ("assistant", control), ("assistant", control)]
    assert got[1]["loss"] == control * 2 and got[1]["n_messages"] == 3 and got[None]["loss"] == "" and got[2]["loss"] == "é😀"
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in got.values())
    assert chat_format.format_chats(df.limit(0)).count() == 0


# ---- packing

def test_ids_equal_the_tokenizer():
    encode = packing.TextIds(packing.tokenizer_path())
    rng = random.Random(5)
    pieces = ["don't", " ", "  ", "\n", "\t ", "é😀", "12ab", "...", "<|endoftext|>", " ", "Ünïcode", "a", "　x", "'s", "\x85"]
    texts = ["".join(rng.choice([*pieces, " ", prose(rng.randrange(99), 2)]) for _ in range(rng.randrange(0, 14))) for _ in range(600)] + ["", " ", "  a  b "]
    expected = [np.asarray(e.ids, "<u4").tobytes() for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 40):
        assert encode(texts[i : i + 40]) == expected[i : i + 40]


def test_ids_of_all_characters_and_long_runs_equal_the_tokenizer():
    encode = packing.TextIds(packing.tokenizer_path())
    characters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [sep.join(characters[i : i + 5_000]) for i in range(0, len(characters), 5_000) for sep in ("", " ", "a", " 1")]
    texts += ["x" * 50_000, "a" + "\n" * 1_500_000 + "b", " " * 1_500_000, "\u3000 \t" * 20_000, "7" * 50_000 + "<|endoftext|>"]
    assert all(x == encode.encode(t) for x, t in zip(encode(texts), texts, strict=True))


def test_least_squares_and_plan():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [1, 1, 0]])
    x = packing.non_negative_least_squares(a, a @ np.array([2.0, 0, 3]), 20)
    assert np.allclose(x, [2, 0, 3], atol=1e-4)
    rng = random.Random(3)
    histogram = {rng.randrange(1, 257): rng.randrange(1, 200) for _ in range(60)}
    slots, lengths, sequences = packing.solve(histogram, 256, grain=8)
    used = {}
    for b, lo, hi, first, _ in slots:
        for k in range(lo, hi):
            assert (b, k) not in used
            used[b, k] = first + k - lo
    sizes = {}
    for (b, _), s in used.items():
        sizes[s] = sizes.get(s, 0) + b * 8
    assert set(sizes) == set(range(sequences)) and set(sizes.values()) <= {256}
    assert sum(u for _, _, _, u, _ in lengths) == len(used)


def test_pieces_tile_documents_and_sequences(docs, empty):
    out = packing.pack(docs.where("doc_id IS NOT NULL"), packing.tokenizer_path(), window=64)
    rows = out.collect()
    encode = packing.TextIds(packing.tokenizer_path())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text, *_ in {r[0]: r for r in awkward() if r[0] is not None}.values():
        ids = encode([text or ""])[0] + (1).to_bytes(4, "little")
        copies = 2 if i == 5 else 1
        parts = sorted({(r["start"], r["ids"]) for r in by_doc[i]})
        assert copies * len(ids) == sum(len(r["ids"]) for r in by_doc[i]) and all(r["doc_tokens"] == len(ids) // 4 for r in by_doc[i])
        assert copies > 1 or b"".join(p for _, p in parts) == ids
    packed = {}
    for r in rows:
        packed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in packed.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([0, *[n for _, n in parts[:-1]]])) and sum(n for _, n in parts) <= 64
    joined = {r["sequence_id"]: r for r in packing.sequences(out, 64).collect()}
    assert all(len(r["ids"]) // 4 + r["padding"] == 64 for r in joined.values())
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


# ---- mixing

def test_no_source_is_a_block_off():
    rng = random.Random(2)
    for _ in range(60):
        units = {f"s{i}": rng.randint(1, 40) for i in range(rng.randint(1, 9))}
        total, done = sum(units.values()), dict.fromkeys(units, 0)
        who, _, slot = pfair_mix.one_cycle(list(units.values()), list(units.values()))
        for t, (_, w) in enumerate(sorted(zip(slot.tolist(), who.tolist(), strict=True)), 1):
            done[f"s{w}"] += 1
            assert all(abs(Fraction(u * t, total) - done[x]) < 1 for x, u in units.items())


def test_mix_keeps_every_row(docs, empty):
    out = pfair_mix.mix(docs.withColumn("mix_slot", F.lit("x")), {"src0": 3, "src1": 1}, block_chars=100).collect()
    assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(r[0]) for r in awkward())
    assert {r["mix_source"] for r in out} == {"src0", "src1", ""}
    assert len({(r["mix_slot"], r["mix_place"]) for r in out}) == len(out)
    for s in ("src0", "src1"):
        assert sorted(r["mix_place"] for r in out if r["mix_source"] == s) == list(range(sum(r["mix_source"] == s for r in out)))
    clash = docs.withColumn("mix_slot", F.lit("x"))
    assert pfair_mix.mixed_documents(clash).columns == clash.columns and pfair_mix.mixed_documents(empty).count() == 0
    with pytest.raises(ValueError):
        pfair_mix.mix(docs, {"src0": 0})


# ---- WARC

def test_derivatives_refer_to_their_response(spark):
    page = '<html><head><title>A &amp; B</title></head><body><p>x&lt;y<p>two<script>no</script><a href="/l?a=1&amp;b">l</a></body>'
    pages = spark.createDataFrame([(1, "http://h/p", page, "z"), (2, None, None, "z"), (2, None, None, "z")], "page_id long, url string, html string, record string")
    out = warc.derive(warc.responses_from_pages(pages), keep=["page_id"]).collect()
    assert len(out) == 6
    text, meta = (next(r for r in out if r["page_id"] == 1 and r["record_type"] == t) for t in ("conversion", "metadata"))
    response = warc.response_record("http://h/p", page, 1)
    assert text["refers_to"] == meta["refers_to"] == warc.parse_fields(warc.split_head(response)[0])["warc-record-id"]
    head, at = warc.split_head(bytes(text["record"]))
    fields = warc.parse_fields(head)
    block = bytes(text["record"])[at : at + int(fields["content-length"])]
    assert block.decode() == "x<y\ntwol" and fields["warc-block-digest"] == warc.digest(block) and fields["warc-source-payload-digest"] == warc.digest(page.encode())
    assert b'"title": "A & B"' in bytes(meta["record"]) and b'/l?a=1&b' in bytes(meta["record"])
    broken = spark.createDataFrame([(bytearray(b"WARC/1.0\r\nWARC-Type: request\r\n\r\n"),), (None,)], "record binary")
    assert {r["record_type"] for r in warc.derive(broken).collect()} == {"error"}


def test_reading_files(spark, tmp_path):
    import gzip

    a, b = warc.response_record("http://a", "<p>a", 1), warc.response_record("http://b", "<p>b WARC/1.0", 2)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    (tmp_path / "y.warc").write_bytes(a + b)
    out = warc.derive(warc.read_records(spark, str(tmp_path)), keep=["file", "position"])
    assert out.where("record_type <> 'error'").count() == 8


# ---- quality

def test_classifier_and_shrinkage(spark, docs, empty):
    good = [(i, prose(i, 60) + " the of and to.", "en", f"s{i % 3}") for i in range(150)]
    bad = [(1000 + i, " | ".join(WORDS[: 5 + i % 9]) + " ### $$$" * 5, "en", f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in (good + bad)[::2]] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in site_quality.site_quality(df, labels).collect()}
    assert sum(r["kept"] == (i < 1000) for i, r in got.items()) == len(got)
    rates = {(r["source"], round(r["site_rate"], 12)) for r in got.values()}
    assert len(rates) == 3 and all(0.5 < x < 0.9 for _, x in rates)
    sparse = site_quality.site_quality(df.union(spark.createDataFrame([(5000, bad[0][1], "xx", "rare")], df.schema)), labels).where("source = 'rare'").first()
    assert 0.3 < sparse["site_rate"] < 0.9  # one document says little of its site
    none = site_quality.site_quality(docs, labels.limit(0)).collect()
    assert len(none) == len(awkward()) and all(r["kept"] is True and r["evidence"] == 0 for r in none)
    assert site_quality.site_quality(empty, labels).count() == 0


# ---- nearest neighbours

def test_neighbours_are_found(spark, monkeypatch):
    monkeypatch.setattr(ivf_pq, "GROUP", 100)
    monkeypatch.setattr(ivf_pq, "BLOCK", 2)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 10)).astype(np.float32)
    v[200:420] = v[0]  # a common vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 10), (702, [1.0] * 3), (703, [float("nan")] * 10), (704, [None] * 10), (None, [1.0] * 10), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, hit, total = ivf_pq.nearest(df, every=50).collect(), 0, 0
    exact = v.astype(np.float64)
    for q in range(0, 600, 50):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in own)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        hit, total = hit + len({r["vec_id"] for r in own} & set(best.tolist())), total + 10
        if q == 0 or 200 <= q < 420:
            assert [r["vec_id"] for r in own] == best.tolist()
    assert hit >= 0.9 * total
    assert ivf_pq.nearest(df.limit(0)).count() == 0
    few = ivf_pq.nearest(df.where("vec_id IN (0, 1, 2)")).collect()
    assert [r["vec_id"] for r in few] and len(few) == 2


# ---- pages

def text_of(page):
    p = html_main.Page(page)
    return html_main.article_of(p.texts, p.roots, p.links, [True] * len(p.texts))


def test_articles_are_cut_out():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use</div>
      <article><header><h1>Head &eacute;&amp;</h1></header><p>One <b>two</b>   three<br>four<p>Five<ul><li>a<li>b</ul><div class="ad">Buy</div><form>Mail</form><script>var p="<p>no</p>"</script>
      <div id="comments"><p>nice</p></div></article><aside>side</aside><footer>(c)</footer>"""
    assert text_of(page) == "Head é&\nOne two three four\nFive\na\nb"
    assert text_of("") == "" and text_of("<p>a < b &lt;i&gt;") == "a < b <i>" and text_of('<div class="content"><p>x</div><div>y</div>') == "x"
    assert text_of("<article><p>open") == "open" and text_of("<p title='a>b'>c<!-- d --></p>e") == "c\ne"


def test_templates_of_a_site_go_and_articles_stay(spark):
    menu = "<div><p>All about us</p></div>"
    rows = [(i, f"http://h/{i}", f"{menu}<div><p>story {i}</p></div>") for i in range(6)] + [(10 + i, "http://k/x", "<article><p>same everywhere</p></article>") for i in range(6)] + [(30, None, None), (31, "", ""), (31, "", "")]
    got = {r["page_id"]: r for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "story 3" and got[3]["n_removed"] == 1 and got[12]["text"] == "same everywhere" and got[30]["text"] == "" and got[30]["n_chars"] == 0
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- licences

def test_automaton_equals_longest_common_substrings():
    rng = random.Random(1)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
    automaton = licence_scan.SuffixAutomaton(sequences)
    words = [rng.randrange(4) for _ in range(60)]
    has = lambda s, part: any(s[i : i + len(part)] == part for i in range(len(s) - len(part) + 1))
    for i, (state, length) in enumerate(automaton.statistics(words), 1):
        best = max((n for n in range(min(i, 14) + 1) if any(has(s, words[i - n : i]) for s in sequences)), default=0)
        assert length == best
        for which, end in automaton.ends[state].items() if length else ():
            assert sequences[which][end - length + 1 : end + 1] == words[i - length : i]


def test_licences(docs, empty):
    scan = lambda t: licence_scan.Scanner().scan([t])[0]
    assert scan("MIT License, mit-license GNU general public license")[1:6] == (3, 0, 4, "gpl,mit", "gpl,mit")
    mit = licence_scan.TEMPLATES[0][1].split()
    n, base, first, last, base_labels, labels, score, spans = scan("before " + " ".join([*mit[:40], "inserted", *mit[41:]]) + " after")
    assert (base, first, last, base_labels, labels) == (0, None, None, "", "mit") and score > 0.95 and (spans[0]["first"], spans[0]["last"]) == (1, n - 2)
    assert scan(None) == (0, 0, None, None, "", "", 0.0, [])
    assert licence_scan.scan_licences(docs).count() == len(awkward()) and licence_scan.scan_licences(empty).count() == 0


# ---- similarity join

def brute(texts, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 3 if k == 5 else 1000)
    rng = random.Random(k)
    base, passage = prose(7, 120).split(), prose(8, 60)
    texts = {i: t for i, t in enumerate([None, "", "one", "ONE", "one two", prose(9, 40), prose(9, 40)])}
    for i in range(10, 90):  # a family of near copies, some of them far from most
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    for i in range(100, 130):  # a passage that many share
        texts[i] = f"{prose(i, rng.randrange(5, 60))} {passage}"
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, component_id string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, k=k, percent=percent).collect()}
    assert got == brute(texts, k, percent)
    if k == 4:
        kept = sorted(r["doc_id"] for r in jaccard_join.unique_documents(df.union(df.limit(2)), k=k, percent=percent).collect())
        assert kept == sorted(i for i, (_, c) in got.items() if c == i)
        assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_chains_are_one_component(spark):
    links = [(i, i + 1) for i in range(0, 400)] + [(1000, 999), (2000, 1000)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["doc"]: r["component"] for r in jaccard_join.components(df).collect()}
    assert {got[i] for i in range(1, 401)} == {0} and got[2000] == got[1000] == 999


# ---- pipeline

def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SMALL), name)
        if name != "nnls_packing":
            assert out.columns == docs.columns
        left = {r["doc_id"]: r for r in out.collect()} if name != "nnls_packing" else {}
        if name == "quality_classifier":
            right = sum((i in left) == bool(q) for i, q in labels.items() if i in seen)
            assert right >= 0.97 * sum(i in seen for i in labels)
        elif name == "quality_rules":
            failed = {i for i in seen if len(seen[i].split()) < 50}
            assert not failed & left.keys() and len(left) >= 0.8 * len(seen)
        elif name == "jaccard_join":
            assert left.keys() == {i for i, (_, c) in brute(seen, 5, 80).items() if c == i}
        elif name == "pfair_mix":
            assert left.keys() == seen.keys()
        else:
            encode = packing.TextIds(packing.tokenizer_path())
            assert out.agg(F.sum("length")).first()[0] == sum(len(x) // 4 + 1 for x in encode([t or "" for t in seen.values()]))
        seen, docs = {i: r["text"] for i, r in left.items()}, out
