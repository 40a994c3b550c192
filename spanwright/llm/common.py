"""Helpers shared by the corpus operators: shared-folder stages, let-bindings, bounded joins."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; above it `attach` shuffles instead.
BROADCAST_ROWS = 200_000
#: Copies of each row of the small side when `attach` shuffles, so that a hot key is spread.
SALTS = 16

_own_folder: dict[str, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one of our own where it is unset.

    Only in local mode is there a folder of our own: on a cluster nothing else is known to be shared.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spanwright-")
    return _own_folder[app]


_open_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(tables: list[str]) -> Iterator[None]:
    """Note in `tables` where `materialize` writes meanwhile, so that `delete` can take it away when nothing reads it any more."""
    _open_scratch.append(tables)
    try:
        yield
    finally:
        _open_scratch.pop()


def delete(spark: SparkSession, tables: list[str]) -> None:
    """Delete the tables at these paths and forget them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(conf).delete(path, True)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete what lies at this path when the driver ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The table is deleted when the driver ends, if not before.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    for tables in _open_scratch:
        tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files that a table of `materialize` was read from; it must not be used afterwards."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def trim_memory() -> None:
    """Give memory that Python and Arrow hold but don't use back to the system (workers live on between tasks)."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value` computed once: a lambda variable is bound, whereas a column may be inlined at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shielded(docs: DataFrame, names: set[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `f` keeps of `docs`, with their columns; those with `names` (in lower case) are out of its way meanwhile."""
    away = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return f(docs.withColumnsRenamed(away)).select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def attach(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join `small` (unique on `keys`, no nulls in them) to `big`.

    The small side is broadcast only after its rows were counted and found to be at most
    `max_rows`. Beyond that both sides are shuffled, each row of `big` with one of SALTS
    salts and each row of `small` with all of them, so that a hot key meets many tasks. The
    hint is needed: Spark takes the copies for as small as the files of `small`.
    """
    if len(small.limit(max_rows + 1).select(F.lit(1)).take(max_rows + 1)) <= max_rows:
        return big.join(F.broadcast(small), keys, how)
    salt = "__salt"
    rest = [c for c in big.columns if c not in keys and not c.startswith("__")]
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in rest[:4]]), F.lit(SALTS)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*keys, salt], how).drop(salt)


def bounded(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small`, a table of `materialize`, as the right side of a join: broadcast if it has at most `max_rows`, else never.

    Its files say little about its rows: numbers that compress well are far larger in the driver's memory.
    """
    few = small.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(small) if few else small.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
