"""CoNLL-X files as a data source of Spark, in byte ranges, for batches and streams.

`register(spark)`, then `spark.read.format("conllx").load(path)`, or `readStream`. A file is cut into ranges of
`splitBytes`, wherever they fall: a sentence belongs to the range in which its first byte lies, and a task that reads a range
looks back over one line and goes on to the end of its last sentence. So nothing has to be numbered or put in
order behind the reader: rows carry the place of their sentence in bytes, its number inside the range, and the smallest
item of its tokens.

A compressed file (its name ends in .gz, .bz2, .lz4 or .zst) can't be cut and is one range.

Options: `splitBytes` (64 MB); `rows`, which is `tokens`, or `splits` for the number of sentences in each range; for streams,
`filesPerBatch`. Paths are those of `pyarrow.fs` (local ones, and URIs of the stores that it knows): a file, or a folder, whose
files are read in the order of their names, without hidden ones. A stream takes files by name, too: a
file whose name comes before those that were read is an error, so that none is passed over.

Defined cases: lines end with LF or CRLF; a line of white space ends a sentence; comments and rows of fewer than
ten columns count as places of a sentence but give no rows; bytes that are no UTF-8 become U+FFFD; an empty file gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import to_int

TOKENS = "file string, split long, own int, begins long, item int, pos int, id string, form string, tag string, head string, dep string, zone int"
SPLITS = "file string, split long, own int"
_SPACE = b" \t\n\x0b\x0c\r"
_TOKEN_ID = re.compile(r"TokenId=([0-9]+)\.([0-9]+)")
BACK, BATCH = 1 << 16, 8_192
LARGEST = 2**31 - 1
_PACKED = (".gz", ".bz2", ".lz4", ".zst")


class Range(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


def _open(path: str):
    from pyarrow import fs

    own, inside = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)
    return own, inside


def _files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files at `path`, by name."""
    from pyarrow import fs

    own, inside = _open(path)
    (at,) = own.get_file_info([inside])
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    if at.is_file:
        return [(path, at.size)]
    found = [f for f in own.get_file_info(fs.FileSelector(inside)) if f.is_file and f.base_name[0] not in "._"]
    return [(scheme + f.path, f.size) for f in sorted(found, key=lambda f: f.base_name)]


def _ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    whole = lambda f: f.endswith(_PACKED)
    return [Range(f, low, 1 << 62 if whole(f) else min(low + size, n)) for f, n in files for low in range(0, n, n if whole(f) else size)]


def _line_before(stream, at: int) -> int:
    """Where the line begins that holds byte at - 1."""
    end = at - 1
    while end > 0:
        low = max(end - BACK, 0)
        stream.seek(low)
        cut = stream.read(end - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        end = low
    return 0


def _lines(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """Lines from byte `at` on and where they begin, read in blocks."""
    if stream.seekable():
        stream.seek(at)
    left: list[bytes] = []
    while block := stream.read(BACK * 16):
        *whole, rest = block.split(b"\n")
        for line in whole:
            line = b"".join([*left, line])
            left = []
            yield at, line
            at += len(line) + 1
        left.append(rest)
    if last := b"".join(left):
        yield at, last


def sentences(stream, low: int, high: int) -> Iterator[tuple[int, list[bytes]]]:
    """The sentences that begin in [low, high): their first byte and their lines."""
    blank, begins, own = True, -1, []
    for at, line in _lines(stream, _line_before(stream, low) if low else 0):
        if line.strip(_SPACE):
            if own:
                own.append(line)
            elif blank and at >= high:
                return
            elif blank and at >= low:
                begins, own = at, [line]
            blank = False
            if not own and at >= high:
                return  # a sentence of an earlier range
        else:
            if own:
                yield begins, own
                own = []
            blank = True
            if at >= high:
                return
    if own:
        yield begins, own


def _parsed(own: list[bytes]) -> list[list]:
    """item, pos, id, form, tag, head, dep, zone of the rows of a sentence that has an item."""
    rows, items = [], []
    for pos, line in enumerate(own):
        c = line.removesuffix(b"\r").decode("utf-8", "replace").split("\t")
        if len(c) < 10:
            continue
        found = _TOKEN_ID.search(c[9])
        item, zone = (int(x) if int(x) <= LARGEST else None for x in found.groups()) if found else (None, None)
        items += [] if item is None else [item]
        rows.append([pos, c[0], c[1], c[4], c[6], c[7], zone])
    return [[min(items), *r] for r in rows] if items else []


def _read(part: Range, splits: bool):
    import pyarrow as pa

    own, inside = _open(part.file)
    with own.open_input_stream(inside) if inside.endswith(_PACKED) else own.open_input_file(inside) as stream:
        if splits:
            n = sum(1 for _ in sentences(stream, part.low, part.high))
            yield pa.RecordBatch.from_pylist([{"file": part.file, "split": part.low, "own": n}], pa.schema([("file", pa.string()), ("split", pa.int64()), ("own", pa.int32())]))
            return
        text, small, large = pa.string(), pa.int32(), pa.int64()
        kinds = [text, large, small, large, small, small, text, text, text, text, text, small]
        schema = pa.schema(list(zip([f.split()[0] for f in TOKENS.split(", ")], kinds, strict=True)))
        rows: list[list] = []
        for k, (begins, lines) in enumerate(sentences(stream, part.low, part.high)):
            rows += [[part.file, part.low, k, begins, *r] for r in _parsed(lines)]
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)


class _Options:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("splitBytes", 64 << 20))
        self.splits = options.get("rows", "tokens") == "splits"
        self.at_once = int(options.get("filesPerBatch", 1_000))
        if self.size < 1 or self.at_once < 1:
            raise ValueError("splitBytes and filesPerBatch are positive")


class ConllReader(DataSourceReader):
    def __init__(self, options: dict):
        self.own = _Options(options)

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.own.path), self.own.size) or [Range("", 0, 0)]

    def read(self, partition: Range):
        return _read(partition, self.own.splits) if partition.file else iter(())


class ConllStreamReader(DataSourceStreamReader):
    """Offsets are the last name that was read, and how many files stand up to it."""

    def __init__(self, options: dict):
        self.own, self.seen = _Options(options), None

    def initialOffset(self) -> dict:
        self.seen = {"last": "", "n": 0}
        return self.seen

    def latestOffset(self) -> dict:
        files = [f for f, _ in _files(self.own.path)]
        n = self.seen["n"] if self.seen else 0
        if self.seen and files[:n][-1:] != ([self.seen["last"]] if n else []):
            raise ValueError(f"files came or went before {self.seen['last']}, up to which the stream was read")
        files = files[: n + self.own.at_once] if self.seen else files  # where a restart doesn't say how far it is, all
        self.seen = {"last": files[-1] if files else "", "n": len(files)}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = _files(self.own.path)
        if end["n"] < start["n"]:
            raise ValueError("the stream was read further than its files go")
        for at in (start, end):
            if at["n"] and (len(files) < at["n"] or files[at["n"] - 1][0] != at["last"]):
                raise ValueError(f"files came or went before {at['last']}, up to which the stream was read")
        self.seen = end
        return _ranges(files[start["n"] : end["n"]], self.own.size)

    def read(self, partition: Range):
        return _read(partition, self.own.splits)


class ConllSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "conllx"

    def schema(self) -> str:
        return SPLITS if _Options(self.options).splits else TOKENS

    def reader(self, schema) -> ConllReader:
        return ConllReader(self.options)

    def streamReader(self, schema) -> ConllStreamReader:
        return ConllStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConllSource)


def load_conllx(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """What `readers.read_conllx` gives, by the data source: item, sentence_index, pos, id, form, tag, head, dep, zone.

    Sentences of a file are numbered by one row for each range, which every task gets. No line is shuffled.
    """
    register(spark)
    source = spark.read.format("conllx").option("splitBytes", split_bytes)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = source.option("rows", "splits").load(path).select("file", "split", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    rows = source.option("rows", "tokens").load(path).join(F.broadcast(splits), ["file", "split"])
    index = (F.col("before") + F.col("own")).cast("int").alias("sentence_index")
    return rows.select("item", index, "pos", to_int(F.col("id")).alias("id"), "form", "tag", to_int(F.col("head")).alias("head"), "dep", "zone")
