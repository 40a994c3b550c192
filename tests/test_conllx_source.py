"""The CoNLL data source: ranges that cut anywhere, many files, and files that arrive."""

import io

import pytest

from spanwright.sources import readers
from spanwright.sources.conllx import load_conllx, register, sentences

ROW = "{i}\t{form}\t_\t_\tNN\t_\t{head}\tdep\t_\t{misc}"


def text(item):
    row = lambda i, form, head, misc: ROW.format(i=i, form=form, head=head, misc=misc)
    parts = [
        "\n \r\n# one", row(1, "Zoë", 0, f"TokenId={item}.1"), "short\trow", row(2, "ran", 1, f"TokenId={item}.2") + "\r", "\t ",
        row(1, "no", 0, "_"), row(2, "item", 1, "_"), "", "",
        row("x", "last", "1.5", f"A|TokenId={item}.7"), row(2, "large", 1, "TokenId=99999999999.3"), "", "# only a comment", "", row(1, "end", 0, f"TokenId={item}.9"),
    ]
    return "\n".join(parts)


def test_every_cut_gives_the_same_sentences():
    for raw in (text(4).encode(), (text(4) + "\n").encode(), b"", b"\n\n", b"a", b"a\n\nb\n"):
        whole = list(sentences(io.BytesIO(raw), 0, len(raw)))
        for cut in range(1, len(raw)):
            both = [*sentences(io.BytesIO(raw), 0, cut), *sentences(io.BytesIO(raw), cut, len(raw))]
            assert both == whole, cut
        for size in (1, 2, 3, 7):
            assert [s for low in range(0, len(raw), size) for s in sentences(io.BytesIO(raw), low, min(low + size, len(raw)))] == whole
    assert len(list(sentences(io.BytesIO(text(4).encode()), 0, 10_000))) == 5


@pytest.mark.parametrize("size", [1 << 20, 37])
def test_the_source_gives_what_the_reader_gives(spark, tmp_path, size):
    for n in range(3):
        (tmp_path / f"s{n}.conllx").write_bytes(text(n + 1).encode())
    (tmp_path / "empty.conllx").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"1\tx")
    ours, theirs = load_conllx(spark, str(tmp_path), size), readers.read_conllx(spark, str(tmp_path))
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(ours) == rows(theirs) and len(rows(ours)) == 15
    assert rows(load_conllx(spark, f"file://{tmp_path}", size)) == rows(theirs)


def test_files_that_arrive(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()

    def arrive(name, item):
        (tmp_path / "in" / name).write_bytes(text(item).encode())
        query = (
            spark.readStream.format("conllx").option("splitBytes", 50).option("filesPerBatch", 1).load(str(tmp_path / "in"))
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(90)
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("item").count().where("count = 5").collect())

    assert arrive("b.conllx", 1) == [1]
    assert arrive("c.conllx", 2) == [1, 2]  # started anew: only the new file
    with pytest.raises(Exception, match="came or went"):
        arrive("a.conllx", 3)


def test_compressed_files_give_what_plain_ones_give(spark, tmp_path):
    import gzip

    for name in ("plain", "packed"):
        (tmp_path / name).mkdir()
    (tmp_path / "plain" / "a.conllx").write_bytes(text(1).encode())
    (tmp_path / "packed" / "a.conllx.gz").write_bytes(gzip.compress(text(1).encode()))
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    want = rows(load_conllx(spark, str(tmp_path / "plain"), 37))
    assert len(want) == 5 and rows(load_conllx(spark, str(tmp_path / "packed"), 37)) == want == rows(readers.read_conllx(spark, str(tmp_path / "packed")))


def test_readers_shuffle_no_line(spark, tmp_path):
    (tmp_path / "a.conllx").write_bytes(text(1).encode())
    for df in (readers.read_conllx(spark, str(tmp_path)), load_conllx(spark, str(tmp_path), 37)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and " at#" not in plan


def test_sentences_across_splits(spark, tmp_path):
    (tmp_path / "a.conllx").write_bytes(("\n".join(ROW.format(i=i, form="w", head=0, misc=f"TokenId={9 - i}.{i}") for i in range(1, 7)) + "\n\n" + text(3)).encode())
    want = sorted(map(repr, readers.read_conllx(spark, str(tmp_path)).collect()))
    size, cost = (spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert sorted(map(repr, readers.read_conllx(spark, str(tmp_path)).collect())) == want and len(want) == 11
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
