"""A corpus pipeline: documents that the quality classifier and the quality rules keep, one of each
group of near copies, mixed to target weights and packed into sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; `run` writes it as Parquet into the
shared folder and reads it back as the next stage's input. All but the last return the columns
of `documents`. A run owns its tables: it deletes a stage's tables when the result was written, and
that result when its successor was. What the last result reads, and the tables of a stage that is
called by itself, stay until the driver ends.

Defined cases, in every stage: null and empty texts count as no words (the rules reject them, the
classifier judges them as it does any text, packing gives them the end id); null sources and languages
are ""; repeated rows are judged alike, and one row of an id stays behind the near-duplicate stage;
rows without an id stand for themselves; other columns pass through, whatever their names. An empty
table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm.common import delete, materialize, scratch
from spanwright.llm.host_rules import drop_failed
from spanwright.llm.jaccard_join import unique_documents
from spanwright.llm.packing import pack_in_order, tokenizer_path
from spanwright.llm.pfair_mix import mixed_documents
from spanwright.llm.site_quality import drop_rejected


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware quality classifier keeps."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return drop_failed(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by 5-word shingles at similarity 0.8."""
    return unique_documents(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair mix of their sources."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 ids, which follow the rows' order in their files.

    That is the mix, as the stage before wrote it. Rows that are not from files have no order, so they are mixed first.
    """
    docs = docs if docs.inputFiles() else materialize(mixed_documents(docs), "mixed")
    return pack_in_order(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("jaccard_join", one_of_each),
    ("pfair_mix", mix_sources),
    ("nnls_packing", pack_sequences),
]

#: Training a classifier, chains of near copies and tokenising are beyond SQL; tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        own: list[str] = []
        with scratch(own):
            docs = materialize(stage(spark, docs, sf_dir), name)
        result = own.pop()  # written last
        delete(spark, own)
        delete(spark, before)
        before = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
