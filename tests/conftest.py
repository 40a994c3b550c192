import os
import sys
from pathlib import Path

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # many small solves beside Spark's own threads

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(frame, columns):
    """Rows of a pandas frame as sorted comparable strings."""
    import math

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, bool):
            return x
        if hasattr(x, "item"):
            x = x.item()
        return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x

    return sorted(repr([plain(x) for x in r]) for r in frame[columns].astype(object).values.tolist())


def compare(df, sql, folder=SMALL):
    """Hold a DataFrame against DuckDB's rows of `sql` over the tables in `folder`."""
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    ours, theirs = df.toPandas(), con.execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows_of(ours, columns) == rows_of(theirs, columns)
