"""What is moved between tasks: dealt once and small, so that it grows no faster than the tables."""

import itertools
import re

import numpy as np
import pytest
from conftest import SMALL

from spanwright.operators import distance
from spanwright.plans import projection as P
from spanwright.plans import registry


def exchanges(df) -> list[str]:
    """Columns by which the plan of `df` deals rows."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["iv_feature_l1", "iv_feature_js", "iv_backoff", "iv_entity_set", "iv_new_entity", "ot_distance"])
def test_compared_mentions_are_not_dealt_by_alternative_or_feature(spark, name):
    for dealt in exchanges(registry.QUERIES[name](spark, SMALL)):
        assert not re.search(r"\bk#|feature#|cluster#\d+.*\bi#", dealt)


def test_tokens_stay_where_their_document_was_dealt(spark):
    assert len(exchanges(P.offsets(spark, SMALL))) == 1


@pytest.mark.parametrize("n, m", [(1, 3), (3, 2), (3, 3), (2, 4)])
def test_transport_matches_the_shorter_side(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for gap in (1.0, 0.3):
        costs = rng.random((n, m))
        best = min(
            sum(costs[i, j] for i, j in zip(rows, columns, strict=True)) + gap * (n + m - 2 * size)
            for size in range(min(n, m) + 1) for rows in itertools.combinations(range(n), size) for columns in itertools.permutations(range(m), size)
        )
        assert distance.transport(costs, gap) == pytest.approx(best / max(n, m))


def test_rectangular_assignment():
    assert distance.assignment(np.array([[4.0, 1.0, 3.0], [2.0, 0.5, 5.0]])) == 2.5 + 0.5


def test_mentions_are_cut_from_their_sentence_alone(spark):
    from spanwright.operators import discourse

    sentences = spark.createDataFrame([(1, 1, "Two three.", 9, 19, 9)], "doc long, sentence_index int, text string, char_start int, char_end int, text_start int")
    mentions = spark.createDataFrame([(1, 1, 13, 30)], "doc long, sentence_index int, char_start int, char_end int")
    (row,) = discourse.target_mentions(mentions, sentences).collect()
    assert (row["char_start"], row["char_end"], row["mention_text"]) == (4, 10, "three.")


def test_pages_are_rendered_in_small_batches(spark):
    plan = registry.QUERIES["nested_html"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "MapInPandas" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("n, m", [(0, 0), (0, 2), (1, 1), (3, 5), (5, 3), (7, 7), (9, 10), (12, 9)])
def test_many_comparisons_are_solved_as_one_by_one(n, m):
    costs = np.random.default_rng(n * 20 + m).random((6, n, m)).round(1)
    for gap in (1.0, 0.2):
        assert distance.transports(costs, gap) == pytest.approx([distance.transport(c, gap) for c in costs])


def test_sides_of_all_sizes_are_compared(spark):
    rows = [(d, k, c, "new", "f", "subject", None) for d, sizes in enumerate([(3, 0, 9), (0, 0, 4), (12, 10, 1)]) for k, n in enumerate(sizes) for c in range(n)]
    targets = spark.createDataFrame(rows, "doc int, k int, cluster int, givenness string, form string, role string, text string")
    sides = spark.createDataFrame([(d, k) for d in range(3) for k in range(3)], "doc int, k int")
    got = {(r["doc"], r["k"]): round(r["distance"], 6) for r in distance.transport_distance(targets, sides, ["doc"]).collect()}
    assert got == {(0, 1): 1.0, (0, 2): round(6 / 9, 6), (1, 1): 0.0, (1, 2): 1.0, (2, 1): round(2 / 12, 6), (2, 2): round(11 / 12, 6)}


def test_documents_are_dealt_to_more_tasks_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(P, "DEAL", 1_000)
    assert P.tokens(spark, SMALL).rdd.getNumPartitions() > 4


@pytest.mark.parametrize("name", ["first_entity_label", "overlap_join", "target_mentions", "target_entities", "overlap_anti_nominals"])
def test_documents_are_joined_where_they_were_dealt(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"item"}
    assert all("," not in re.sub(r", \d+$", "", dealt) for dealt in exchanges(df))


def test_tables_are_counted_whole_for_the_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "DEAL", 1_000)
    whole = P.table(spark, SMALL, "documents")
    size = int(whole._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert P.tokens(spark, SMALL).rdd.getNumPartitions() == -(-size // 1_000)


def test_stitched_spans_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in registry.QUERIES["stitch_components"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_lines_of_token_files_are_not_shuffled(spark, tmp_path):
    import gzip

    from spanwright.plans.registry import _table_file
    from spanwright.sources import readers

    path = _table_file(spark.createDataFrame([("a", 1, 7), ("b", 2, 7)], "word string, zone int, item int").coalesce(1), "tok")
    df = readers.read_tokens(spark, path)
    assert not [d for d in exchanges(df) if "value" in d] and "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not re.search("SortMergeJoin|SortAggregate", readers.read_tokens(spark, path)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (file,) = {f for f in df.inputFiles()}
    assert gzip.open(file.removeprefix("file://"), "rt").read() == "word\tzone\titem\na\t1\t7\nb\t2\t7\n"
    assert sorted((r["item"], r["zone"], r["word"]) for r in df.collect()) == [(7, 1, "a"), (7, 2, "b")]


def test_compressed_parses_are_read_once(spark):
    plan = registry.QUERIES["conllx_file"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_tags_of_mentions(spark):
    from spanwright.operators import audit

    kind = "char_start int, char_end int, cluster int, n_mentions int, singleton boolean, hue double, role string, ner_label string, status string, source string"
    rows = [(0, 1, 0, 0, None, None, None, "", "", None), (0, 1, 3, 2, False, 137.5, 'n"s', "P&", "given", "np_layer"), (0, 1, 4, 1, True, float("nan"), "x", None, None, "y")]
    df = spark.createDataFrame([(1, 0, "ab", rows, [])], f"doc int, sentence_index int, text string, mentions array<struct<{kind.replace(' ', ': ').replace(',:', ',')}>>, uncovered array<struct<char_start: int, char_end: int>>")
    (row,) = audit.render_sentences(df).collect()
    assert row["html"] == (
        '<small class="number">[0]</small> <span class="lone" data-entity="0" title="mentions: 1, status: new">'
        '<span class="chained_" data-entity="3" style="--hue:137.5" title="entity: 3, mentions: 2, role: n&quot;s, label: P&amp;, status: given">'.replace("chained_", "chain phrase")
        + '<span class="lone" data-entity="4" title="entity: 4, mentions: 1, role: x, status: new">a</span></span></span>b'
    )


def test_parse_tokens_are_placed_once(spark):
    plan = registry.QUERIES["story_records"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode(ts") == 1 and len(re.findall(r"Exchange hashpartitioning\(item#\d+L, \d+\), REPARTITION", plan)) == 3


@pytest.mark.parametrize("word, forms", [("dog", ["dog"]), ("``", ["``"]), ("-LRB-", ["-LRB-"]), ("", [""]), ("dogs", ["dog", "s"]), ("dog", ["cat"])])
def test_a_form_that_is_the_word_is_placed_as_others_are(spark, word, forms):
    from pyspark.sql import functions as F

    from spanwright.operators import align

    words = spark.createDataFrame([(1, 1, "ab", 0), (1, 2, word, 3)], "item int, zone int, word string, char_start int")
    parse = spark.createDataFrame([(1, 0, i, i + 1, f, "t", i, "d", 2) for i, f in enumerate(forms)], "item int, sentence_index int, pos int, id int, form string, tag string, head int, dep string, zone int")
    stories = words.groupBy("item").agg(F.collect_list(F.struct("zone", "word", "char_start")).alias("tokens"))
    want = spark.range(1).select(F.inline(align.place_forms(F.lit(word), F.lit(0), F.lit(len(word)), F.array(*map(F.lit, forms))))).collect()
    for own in (align.align_parse(stories, parse), align.align_parse(stories, parse, words)):
        got = own.orderBy("g").select("char_start", "char_end").collect()
        assert [(a - 3, b - 3) for a, b in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("name", ["iv_feature_l1", "ot_distance"])
def test_facts_of_sentences_meet_their_sides_where_they_were_dealt(spark, name):
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.requireAllClusterKeysForCoPartition", "true")):
        spark.conf.set(key, value)
    try:
        df = registry.QUERIES[name](spark, SMALL)
        assert not [d for d in exchanges(df) if re.search(r"\bi#", d)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_what_tells_mentions_apart_is_collected(spark):
    plan = registry.QUERIES["nested_html"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    collected = [x for x in plan.splitlines() if re.search(r"struct\(char_start.* AS m#", x) and "transform" not in x]
    assert collected and not [x for x in collected if "n_mentions" in x]
