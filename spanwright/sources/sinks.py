"""Writers: JSON lines with nulls, tab-separated scores, one page of HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; absent values are written as null, other alphabets as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_surprisal(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """Tab-separated, with header, quotes only where needed."""
    columns = ["word", "item", "zone", "sentence_id", "sentence_position", "surprisal"]
    df.select(*columns).write.mode(mode).option("sep", "\t").option("header", True).option("escape", '"').option("compression", compression).csv(path)


#: Stories of one page at most; a reader can look at no more, and the driver holds them.
PAGE_STORIES = 500


def write_pages(stories: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder with a page per story (name=...), written where the stories are."""
    from ..operators.audit import page

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["name"] for r in rows], pa.string()), pa.array([page([r]) for r in rows], pa.string())], names=["name", "value"])

    stories.mapInArrow(run, "name string, value string").write.mode(mode).partitionBy("name").option("lineSep", "\n").text(path)


def write_page(stories: DataFrame, path: str) -> int:
    """One self-contained page of at most PAGE_STORIES stories (name, stats, body, ledger). Returns their number."""
    from ..operators.audit import page

    if len(stories.select("name").take(PAGE_STORIES + 1)) > PAGE_STORIES:
        raise ValueError(f"more than {PAGE_STORIES} stories; write a page for each")
    rows = [r.asDict(recursive=True) for r in stories.orderBy(F.try_to_number(F.regexp_extract("name", r"([0-9]+)$", 1), F.lit("999999999")), "name").collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write(page(rows))
    return len(rows)


def counted(df: DataFrame, write: Callable[[DataFrame], None], **metrics: Column) -> dict[str, int]:
    """Metrics of `df` (its rows, and others by name), taken while `write` writes it."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in metrics.items()]))
    return seen.get
