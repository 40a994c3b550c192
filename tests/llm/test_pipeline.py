"""The corpus pipeline: stages with awkward tables, and runs that don't disturb each other."""

import corpus_pipeline
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_llm_operators import DOCS, awkward, prose

from spanwright.llm import common

NAMES = "kept score evidence n_words base_failed mix_slot mix_place component_id host_rate".split()


def table(spark, rows):
    """Documents with columns named like results of the operators."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in NAMES})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_tables(spark, name, stage):
    rows = [*awkward(), *[(100 + i, prose(50 + i, 90), "en", f"s{i % 2}", 1, "x") for i in range(20)]]
    docs = table(spark, rows)
    out = stage(spark, docs, SMALL)
    got = out.collect()
    if name == "nnls_packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    else:
        assert out.columns == docs.columns and all(r["score"] == "clash" for r in got)
        assert {100 + i for i in range(20)} <= {r["doc_id"] for r in got}
        if name == "jaccard_join":  # one row of each id, and of equal texts; texts without words stay
            ids = sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
            assert len(ids) == len(set(ids)) and {0, 1, 2} <= set(ids) and 6 not in ids
        if name == "pfair_mix":
            assert len(got) == len(rows)
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_results_stay_readable_and_runs_keep_apart(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packed = corpus_pipeline.pack_sequences(spark, docs, SMALL)
    n = packed.count()
    one = corpus_pipeline.run(spark, SMALL)
    corpus_pipeline.mix_sources(spark, docs, SMALL).count()
    other = corpus_pipeline.run(spark, SMALL)
    assert packed.count() == n
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(one) == rows(other)


def test_a_run_deletes_its_tables(spark, tmp_path):
    tables: list[str] = []
    with common.scratch(tables):
        out = corpus_pipeline.run(spark, SMALL)
    import os

    left = {t.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in tables if os.path.exists(t)}
    assert out.count() > 0 and "pfair_mix" in left and not left & {"quality_classifier", "quality_rules", "jaccard_join", "evidence", "host_rules", "sets"}
