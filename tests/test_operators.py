"""Worked examples of the composite operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwright.functions import text as T
from spanwright.operators import align, audit, discourse, distance, rt, spans, stats, surprisal, windows


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_placing_forms_from_left_to_right(spark):
    place = lambda text, forms: [tuple(s) for s in one(spark, align.place_forms(F.col("t"), F.lit(0), F.length("t"), F.col("f")), t=text, f=forms)]
    assert place("England,", ["Eng", "land", ","]) == [(0, 3), (3, 7), (7, 8)]
    assert place("“Hi”", ['"', "Hi", '"']) == [(0, 1), (1, 3), (3, 4)]
    assert place("(x)", ["-LRB-", "x", "-RRB-"]) == [(0, 1), (1, 2), (2, 3)]
    assert place("teh cat", ["the", "cat"]) == [(0, 3), (4, 7)]  # a typo takes its length
    assert place("aa", ["a", "a", "a"]) == [(0, 1), (1, 2), (2, 2)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab(é😀", min_size=1, max_size=4), min_size=1, max_size=5))
def test_placed_forms_lie_in_the_text(spark, forms):
    text = "".join(forms)
    found = one(spark, align.place_forms(F.col("t"), F.lit(0), F.length("t"), F.col("f")), t=text, f=forms)
    assert [text[s["char_start"] : s["char_end"]] for s in found] == forms


def test_offsets_and_text(spark):
    words = spark.createDataFrame([(1, 2, "cat"), (1, 1, "The"), (1, 4, "sat."), (2, 1, "é😀")], "item int, zone int, word string")
    story = {r["item"]: r for r in align.story_text(align.token_offsets(words)).collect()}
    assert story[1]["text"] == "The cat sat."
    assert all(story[1]["text"][t["char_start"] : t["char_end"]] == t["word"] for t in story[1]["tokens"])
    assert story[2]["tokens"][0]["char_end"] == 2


def test_parse_alignment_numbers_tokens_by_zone(spark):
    words = spark.createDataFrame([(1, 1, "Don't"), (1, 2, "go.")], "item int, zone int, word string")
    story = align.story_text(align.token_offsets(words))
    parse = spark.createDataFrame(
        [(1, 0, 0, 1, "Do", "VBP", 4, "aux", 1), (1, 0, 1, 2, "n't", "RB", 4, "neg", 1), (1, 0, 2, 3, "x", "X", 4, "dep", None), (1, 0, 3, 4, "go", "VB", 0, "root", 2), (1, 0, 4, 5, ".", ".", 4, "punct", 2)],
        "item int, sentence_index int, pos int, id int, form string, tag string, head int, dep string, zone int",
    )
    rows = sorted(tuple(r) for r in align.align_parse(story, parse).select("g", "form", "char_start", "char_end", "head_g").collect())
    assert rows == [(0, "Do", 0, 2, 3), (1, "n't", 2, 5, 3), (2, "x", None, None, 3), (3, "go", 6, 8, -1), (4, ".", 8, 9, 3)]
    span = align.sentence_spans(align.align_parse(story, parse)).first()
    assert (span["char_start"], span["char_end"], span["zones"]) == (0, 9, [1, 2])


def test_casts_and_token_ids(spark):
    assert one(spark, T.to_int(F.lit("x"))) is None
    assert one(spark, F.struct(*[c.alias(n) for n, c in zip("iz", T.token_id(F.lit("SpaceAfter=No|TokenId=3.14.2")), strict=True)])) == (3, 14)
    assert one(spark, T.token_id(F.lit("_"))[0]) is None
    assert one(spark, T.strip(F.lit("  a b  "))) == "a b"


def test_last_duplicate_wins(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 0), (1, 1, 7.0, 2), (1, 1, 6.0, 1)], "item int, zone int, rt double, pos int")
    assert rt.last_of(df, ["item", "zone"], "pos").first()["rt"] == 7.0


def test_sentence_without_reading_times_has_none(spark):
    df = spark.createDataFrame([(1, 0, 1, None, None), (1, 0, 2, None, None)], "item int, sentence_index int, zone int, mean_rt double, gmean_rt double")
    r = rt.sentence_rollup(df).first()
    assert (r["n_spr_tokens"], r["reading_time_sum_mean"], r["spr_zones"]) == (2, None, [1, 2])


def test_head_role_takes_first_root_or_first_token(spark):
    rows = [("a", 0, 1, "nsubj"), ("a", 1, 5, "dobj"), ("a", 2, 1, "det"), ("b", 3, 4, "x"), ("b", 4, 3, "y")]
    got = {r["m"]: r["grammatical_role"] for r in spans.head_role(spark.createDataFrame(rows, "m string, g int, head_g int, dep string"), ["m"]).collect()}
    assert got == {"a": "dobj", "b": "x"}


def test_locating_segments(spark):
    places = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("char_start"), F.lit(b).alias("char_end")) for n, a, b in (("context", 0, 10), ("target", 11, 20))])
    at = lambda a, b: one(spark, spans.locate(F.lit(a), F.lit(b), places)["name"])
    assert at(2, 5) == "context" and at(11, 20) == "target" and at(8, 13) == "context" and at(30, 40) is None


def test_overlap_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(int(d), int(i), int(s), int(s + w)) for i, (d, s, w) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 3000, n), rng.integers(1, 900, n), strict=True))]
    a, b = make(60), make(60)
    left, right = spark.createDataFrame(a, "doc int, i int, s int, e int"), spark.createDataFrame(b, "doc int, j int, ts int, te int")
    got = {(r["i"], r["j"]) for r in spans.overlap_join(left, right, ["doc"], ("s", "e"), ("ts", "te")).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2]}


def reference_windows(sizes, budget, overlap):
    out, i = [], 0
    while i < len(sizes):
        j, total = i, 0
        while j < len(sizes) and (j == i or total + max(1, sizes[j]) <= budget):
            total += max(1, sizes[j])
            j += 1
        out.append((i, j - 1))
        if j >= len(sizes):
            break
        i = max(i + 1, j - overlap)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=12), st.integers(1, 40), st.integers(0, 6))
def test_window_packing(spark, sizes, budget, overlap):
    got = one(spark, windows.window_bounds(F.col("s"), budget, overlap), s=sizes)
    assert [tuple(w) for w in got] == reference_windows(sizes, budget, overlap)


def test_windows_of_a_very_long_document(spark):
    rows = spark.range(1_000_000).selectExpr("1 doc", "id sentence_index", "cast(id % 9 as int) n_words")
    got = windows.pack_windows(rows, 50, 3).agg(F.count("*").alias("n"), F.max("last_sentence").alias("last"), F.max("n_words").alias("most")).first()
    expected = reference_windows([i % 9 for i in range(3000)], 50, 3)
    some = windows.pack_windows(rows.where("sentence_index < 3000"), 50, 3).orderBy("window").collect()
    assert [(r["first_sentence"], r["last_sentence"]) for r in some] == expected
    assert got["last"] == 999_999 and got["most"] <= 50 and got["n"] > 70_000


def test_components_across_blocks(spark, monkeypatch):
    """Paths, a hub and lone nodes over many blocks, against a plain union-find."""
    rng = np.random.default_rng(5)
    edges = [(1, i, i + 3) for i in range(400)] + [(2, 0, i) for i in range(1, 300, 2)] + [(3, int(a), int(b)) for a, b in rng.integers(0, 500, (260, 2))]
    nodes = [(d, i) for d in (1, 2, 3, 4) for i in range(0, 500)]
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, a, b in edges:
        a, b = sorted((root((d, a)), root((d, b))))
        parent[b] = a
    frames = spark.createDataFrame(edges, "doc int, a int, b int"), spark.createDataFrame(nodes, "doc int, node int")
    for block in (8, 1 << 16):
        monkeypatch.setattr(windows, "COMPONENT_BLOCK", block)
        got = {(r["doc"], r["node"]): r["component"] for r in windows.document_components(*frames).collect()}
        assert got == {n: root(n)[1] for n in nodes}


def test_segments_are_joined_with_zero_width_gaps(spark):
    text, places = discourse.join_segments([("context", F.lit("ab")), ("target", F.lit("")), ("post", F.lit("c "))])
    assert one(spark, text) == "ab c"
    assert [tuple(p) for p in one(spark, places)] == [("context", 0, 2), ("target", 3, 3), ("post", 3, 5)]


def test_grid_and_givenness(spark):
    m = spark.createDataFrame([(1, 0, 0, 7, "nsubj"), (1, 1, 0, 7, "dobj"), (1, 1, 1, 8, ""), (1, 1, 2, 7, "nsubj"), (1, None, 0, 9, "x")], "doc int, sentence_index int, pos int, cluster int, role string")
    grid = {(r["sentence_index"], r["cluster"]): r["roles"] for r in discourse.entity_grid(m).collect() if r["sentence_index"] is not None}
    assert grid == {(0, 7): ["nsubj"], (1, 7): ["dobj", "nsubj"]}
    state = {r["sentence_index"]: (r["given_entities"], r["new_entities"]) for r in discourse.given_new(m).collect()}
    assert state[0] == ([], [7]) and state[1] == ([7], [8]) and not set(state[1][0]) & set(state[1][1])


def test_word_scores_flush_at_marks(spark):
    df = spark.createDataFrame([(1, 0, "Ġa", -1.0), (1, 1, "b", -2.0), (1, 2, "Ġc", -4.0)], "item int, i int, token string, score double")
    assert sorted((r["word_index"], r["surprisal"]) for r in surprisal.word_scores(df, ["item"]).collect()) == [(1, 3.0), (2, 4.0)]
    assert surprisal.last_word_scores(df, ["item"]).first()["surprisal"] == 4.0


def test_context_windows_equal_a_walk_back(spark):
    rng = np.random.default_rng(8)
    words = {item: rng.integers(0, 5, n).tolist() for item, n in enumerate((1, 2, 40, 90))}
    rows = [(item, i, p) for item, ps in words.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "item int, i int, pieces int")
    for size, stride in ((1, 1), (2, 1), (7, 1), (30, 1), (500, 1), (1, 2), (2, 2), (7, 2), (8, 3), (30, 4), (500, 5)):
        expected = {}
        for item, ps in words.items():
            for i in range(len(ps)):
                held, first, n = 0, i, 0
                for c in range(i - 1, max(i - size, -1), -stride):
                    if held >= size:
                        break
                    held, first, n = held + ps[c], c, n + 1
                expected[item, i] = (first, held, n) if size > 1 else (i, 0, 0)
        got = surprisal.context_windows(df, size, stride).collect()
        assert {(r["item"], r["i"]): (r["context_first"], r["context_pieces"], r["context_words"]) for r in got} == expected


MENTION = "key int, k int, cluster int, givenness string, form string, role string, etype string, text string"


def compared(spark, gold, other, f, **options):
    row = lambda k, m: (1, k, *m)
    targets = spark.createDataFrame([row(0, m) for m in gold] + [row(1, m) for m in other], MENTION)
    sides = spark.createDataFrame([(1, 0), (1, 1)], "key int, k int")
    return f(targets, sides, ["key"], **options).first()["distance"]


def m(cluster, given="given", form="definite_np", role="subject", etype="other", text="x"):
    return (cluster, given, form, role, etype, text)


def l1(targets, sides, keys, **options):
    return distance.feature_l1(distance.feature_vectors(targets, keys, **options), sides, keys)


def js(targets, sides, keys, **options):
    return distance.feature_js(distance.feature_vectors(targets, keys, **options), sides, keys)


def test_entity_sets(spark):
    assert compared(spark, [m(1), m(2)], [m(3), m(2)], distance.entity_set) == pytest.approx(2 / 3)
    assert compared(spark, [m(1)], [m(1), m(5, "new")], distance.entity_set) == 0
    assert compared(spark, [], [], distance.entity_set) == 0


@pytest.mark.parametrize("f", [l1, js])
def test_feature_distances(spark, f):
    a, b = [m(1, form="pronoun"), m(2, "new", role="object")], [m(1, form="pronoun"), m(3, "new", "indefinite_np", "object")]
    assert compared(spark, a, a, f) == pytest.approx(0, abs=1e-9)
    assert compared(spark, a, b, f) == pytest.approx(compared(spark, b, a, f))
    assert 0 < compared(spark, a, b, f) < 1
    assert compared(spark, a, [m(9, "given", "bare_np", "other")], f) == pytest.approx(1)
    assert compared(spark, a, [], f) == 1 and compared(spark, [], [], f) == 0


def test_weights_make_a_changed_role_count(spark):
    assert compared(spark, [m(1), m(2, role="object")], [m(1, role="object"), m(2)], l1, weighted=True) == pytest.approx(1)


def test_backing_off_lets_a_changed_form_count_less_than_another_entity(spark):
    form, other = (compared(spark, [m(1)], [x], l1, features="backoff") for x in (m(1, form="pronoun"), m(2)))
    assert form == pytest.approx(0.5) and other == 1
    assert compared(spark, [m(1)], [m(1, form="pronoun")], l1) == 1


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 4), st.integers(0, 4), st.integers(0, 10_000))
def test_transport_equals_the_best_of_all_matchings(n, k, seed):
    costs = np.random.default_rng(seed).random((n, k))
    best = math.inf
    for chosen in itertools.product([*range(k), None], repeat=n):
        used = [c for c in chosen if c is not None]
        if len(set(used)) == len(used):
            best = min(best, sum(costs[i, c] if c is not None else 1 for i, c in enumerate(chosen)) + k - len(used))
    assert distance.transport(costs) == pytest.approx(best / max(n, k, 1) if max(n, k) else 0)


def test_transport_charges_for_what_is_left_over(spark):
    assert compared(spark, [m(1)], [m(1), m(1)], distance.transport_distance) == pytest.approx(0.5)
    assert compared(spark, [m(1)], [m(1)], distance.transport_distance) == 0


def test_graph_prefers_frequent_entities(spark):
    context = spark.createDataFrame([(1, p, c, "other") for p, c in ((0, 1), (0, 2), (1, 1), (2, 1), (3, 3))], "key int, past int, cluster int, role string")
    f = lambda t, s, k: distance.graph_distance(t, s, context, k)
    assert compared(spark, [m(1)], [m(3)], f) == pytest.approx(1)
    assert compared(spark, [m(1)], [m(1)], f) == pytest.approx(0)
    assert compared(spark, [m(1), m(3)], [m(1)], f) < compared(spark, [m(1), m(3)], [m(3)], f)


def test_graph_counts_only_sentences_before_the_one_compared(spark):
    rows = [(d, p, c, "subject" if (p + c) % 3 else "other") for d in range(2) for p in range(5) for c in range(p % 3 + 1)]
    context = spark.createDataFrame(rows, "doc int, past int, cluster int, role string")
    own = [(d, i, k, c, r) for k in (0, 1) for d, i, c, r in ((d, p - k, c, r) for d, p, c, r in rows) if i >= 0]
    targets = spark.createDataFrame(own, "doc int, i int, k int, cluster int, role string")
    sides = targets.select("doc", "i", "k").distinct()
    repeated = context.join(targets.select("doc", "i").distinct(), "doc").where("past < i")
    found = lambda *a, **o: {(r["doc"], r["i"], r["k"]): round(r["distance"], 9) for r in distance.graph_distance(targets, sides, *a, **o).collect()}
    assert found(context, ["doc", "i"], scope=["doc"], at="i") == found(repeated, ["doc", "i"])


def test_rare_transitions_are_surprising(spark):
    rows = [(1, 0, "a"), (1, 1, "a"), (1, 2, "a"), (2, 0, "b"), (2, 1, "a"), (2, 2, "a")]
    got = {r["key"]: r["surprisal"] for r in distance.transition_surprisal(spark.createDataFrame(rows, "key int, k int, transition string"), ["key"]).collect()}
    assert got[1] == pytest.approx(-math.log(3 / 11)) and got[2] == pytest.approx(-math.log(1 / 11))


def test_roles_and_forms(spark):
    role = lambda d: one(spark, distance.role_class(F.lit(d)))
    assert [role(d) for d in ("nsubjpass", "dobj", "nmod:poss", "nmod:of", "advcl")] == ["subject", "object", "possessive", "oblique", "other"]
    form = lambda t, w: one(spark, distance.form_class(F.lit(t), F.lit(w)))
    assert [form("PRP", "He"), form("NNP", "Mary"), form("NN", "A"), form("NN", "The"), form("NN", "dogs")] == ["pronoun", "proper_name", "indefinite_np", "definite_np", "bare_np"]


def test_mixed_model_has_the_likelihood_of_the_dense_one(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(2 + 0.5 * x + b + rng.normal())) for g, b in enumerate(rng.normal(0, 1.5, 12)) for x in rng.normal(0, 1, 9)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    fit = stats.mixed_fit(df, F.col("y"), {"x": F.col("x")}, "g")
    g, x, y = (np.array(c) for c in zip(*rows, strict=True))
    v = fit.sigma**2 * np.eye(len(y)) + fit.group_sigma**2 * (g[:, None] == g[None, :])
    r = y - fit.coefficients[0] - fit.coefficients[1] * x
    assert fit.log_likelihood == pytest.approx(-0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r)), abs=1e-4)
    plain = stats.linear_fit(df, F.col("y"), {"x": F.col("x")})
    assert fit.log_likelihood > plain.log_likelihood
    assert stats.likelihood_ratio(plain, fit)["p"] < 0.01


def test_mixed_model_of_groups_that_differ_in_size(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(1 - x + b + rng.normal())) for g, b in enumerate(rng.normal(0, 2.0, 15)) for x in rng.normal(0, 1, 1 + g % 4)]
    fit = stats.mixed_fit(spark.createDataFrame(rows, "g int, x double, y double"), F.col("y"), {"x": F.col("x")}, "g")
    g, x, y = (np.array(c) for c in zip(*rows, strict=True))
    design = np.stack([np.ones(len(x)), x], 1)

    def dense(ratio):
        v = np.eye(len(y)) + ratio * (g[:, None] == g[None, :])
        beta = np.linalg.solve(design.T @ np.linalg.solve(v, design), design.T @ np.linalg.solve(v, y))
        r = y - design @ beta
        s = r @ np.linalg.solve(v, r) / len(y)
        return -0.5 * (len(y) * (math.log(2 * math.pi * s) + 1) + np.linalg.slogdet(v)[1])

    assert fit.log_likelihood == pytest.approx(max(map(dense, np.exp(np.linspace(-6, 4, 400)))), abs=1e-3)


def test_tails_and_shapes():
    assert stats.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-5)
    assert stats.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-4)
    rng = np.random.default_rng(0)
    assert stats.shapiro_wilk(rng.normal(size=500))["p"] > 0.01 > stats.shapiro_wilk(rng.exponential(size=500))["p"]


def test_representative_heads(spark):
    rows = [(1, "the owner of the dog", 0), (1, "He", 1), (1, "The dog,", 2), (1, "a owner", 3), (2, "it", 0), (3, "", 0)]
    got = {r["c"]: r["head"] for r in audit.representative_heads(spark.createDataFrame(rows, "c int, text string, pos int"), ["c"]).collect()}
    assert got == {1: "owner", 2: "it", 3: "?"}


def test_nested_spans():
    tag = lambda n: f"<{n}>"
    assert audit.nested_html("a<b c", [(0, 3, 0, tag("x")), (2, 3, 0, tag("y"))]) == ("<x>a&lt;<y>b</span></span> c", 0)
    assert audit.nested_html("abcdef", [(0, 3, 0, tag("x")), (2, 5, 0, tag("y")), (4, 6, 1, tag("z"))]) == ("<x>abc</span>d<z>ef</span>", 1)
    assert audit.nested_html("abc", []) == ("abc", 0)
