"""Queries over texts give rows for the whole of them, as their registered SQL does."""

import datetime
import random

import pandas as pd
import pytest
from conftest import compare

from spanwright.plans import registry

SPAN_QUERIES = ["overlap_join", "overlap_anti_nominals", "first_entity_label", "locate_segment", "iou_pairs", "stitch_components", "target_mentions"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Two documents of 150 words, and one of a single word."""
    rng = random.Random(3)
    words = lambda n: " ".join("x" * rng.randint(1, 9) + "." * (i % 3 == 2) for i in range(n))
    folder = tmp_path_factory.mktemp("texts")
    rows = [(1, words(150)), (2, words(150)), (3, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", SPAN_QUERIES)
def test_spans_cover_whole_texts(spark, texts, name):
    whole = registry.ORACLE_SQL[name]
    assert "zone <=" not in whole
    compare(registry.QUERIES[name](spark, texts), whole, texts)


def test_nested_html_marks_whole_texts(spark, texts):
    rows = {r["doc"]: r for r in registry.QUERIES["nested_html"](spark, texts).collect()}
    marked = {k: str(r).count("<span") for k, r in rows.items()}
    assert rows.keys() == {1, 2, 3} and marked[3] >= 1 and min(marked[1], marked[2]) > 60


def test_windows_reach_the_last_sentence(spark, texts):
    whole = registry.ORACLE_SQL["window_packing"]
    assert "< 30" not in whole
    out = registry.QUERIES["window_packing"](spark, texts)
    assert {r["doc"]: r["last"] for r in out.groupBy("doc").agg({"last_sentence": "max"}).toDF("doc", "last").collect()} == {1: 49, 2: 49, 3: 0}
    compare(out, whole, texts)


@pytest.mark.parametrize("n_lines", [1, 4, 13, 17])
def test_head_role_has_all_windows_of_a_sentence(spark, tmp_path, n_lines):
    day = datetime.date(1995, 1, 1)
    orders = pd.DataFrame([(1, 7, day)], columns=["o_orderkey", "o_custkey", "o_orderdate"])
    lines = [(1, k, k, 1, 1.0, "ANR"[k % 3], "O", day) for k in range(1, n_lines + 1)]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]
    orders.to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame(lines, columns=names).to_parquet(tmp_path / "lineitem.parquet")
    out = registry.QUERIES["head_role"](spark, str(tmp_path))
    assert sorted(r["win"] for r in out.collect()) == list(range((n_lines - 1) // 3 + 1))
    compare(out, registry.ORACLE_SQL["head_role"], str(tmp_path))
