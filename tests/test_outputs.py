"""Raw token files, and outputs that are broken off."""

import os

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from loomery.sources import binaries, commits, sinks


def rows_of(spark, n=400):
    r = np.random.default_rng(1)
    ids = [r.integers(0, 65536, r.integers(0, 90)).tolist() for _ in range(n)]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    rows = [(s, i) for s, i in zip(starts, ids, strict=True) if i]
    flat = [x for _, i in rows for x in i]
    r.shuffle(rows)
    return spark.createDataFrame([(int(s), [int(x) for x in i]) for s, i in rows], "start long, ids array<int>"), flat


@pytest.mark.parametrize("kind", ["uint16", "uint32"])
def test_round_trip(spark, tmp_path, kind):
    rows, flat = rows_of(spark)
    path = str(tmp_path / "tokens")
    index = binaries.write_tokens(rows, path, kind=kind)
    assert index["tokens"] == len(flat) and len(index["files"]) > 1
    raw = b"".join(open(f["name"], "rb").read() for f in index["files"])
    assert np.frombuffer(raw, f"<u{binaries.KINDS[kind]}").tolist() == flat
    for length, split in ((7, 100), (1000, 1), (len(flat), 1 << 20)):
        got = sorted((r.window_id, r.ids) for r in binaries.token_windows(spark, path, length=length, kind=kind, split=split).collect())
        assert got == [(k, flat[k * length : (k + 1) * length]) for k in range(-(-len(flat) // length))]
    assert binaries.read_range(path, index, 17, 1234).tolist() == flat[17:1234]
    # Finished: left as it is; anew only if asked.
    assert binaries.write_tokens(rows.limit(1), path, kind=kind) == index
    assert binaries.write_tokens(rows.where("start = 0"), path, kind=kind, again=True)["tokens"] < 100
    assert len([f for f in os.listdir(path) if f.endswith(".bin")]) == 1


def test_raw_files_without_index(spark, tmp_path):
    for k in range(3):
        np.arange(k * 10, k * 10 + 10, dtype="<u2").tofile(tmp_path / f"{k}.bin")
    got = binaries.token_windows(spark, str(tmp_path), length=12).orderBy("window_id").collect()
    assert [r.ids for r in got] == [list(range(12)), list(range(12, 24)), list(range(24, 30))]
    assert binaries.token_windows(spark, str(tmp_path / "1.bin"), length=99).first().ids == list(range(10, 20))
    (tmp_path / "9.bin").write_bytes(b"odd")
    with pytest.raises(Exception, match="whole number"):
        binaries.token_windows(spark, str(tmp_path)).count()


def test_a_task_reads_its_range_only(tmp_path, monkeypatch):
    np.arange(1000, dtype="<u2").tofile(tmp_path / "a.bin")
    asked = []
    real = binaries.opened(str(tmp_path))

    class File:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read_at(self, n, at):
            asked.append((at, n))
            return (tmp_path / "a.bin").read_bytes()[at : at + n]

    monkeypatch.setattr(binaries, "opened", lambda p: (type("S", (), {"open_input_file": lambda self, n: File()})(), real[1]))
    assert binaries.read_range("x", {"kind": "uint16", "files": [{"name": "a", "tokens": 1000}]}, 300, 305).tolist() == [300, 301, 302, 303, 304]
    assert asked == [(600, 10)]


def test_ids_that_do_not_fit(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1, 70_000])], "start long, ids array<int>")
    with pytest.raises(Exception, match="fit"):
        binaries.write_tokens(rows, str(tmp_path / "t"))
    assert not os.path.exists(tmp_path / "t" / binaries.INDEX)
    assert binaries.write_tokens(rows, str(tmp_path / "t"), kind="uint32")["tokens"] == 2


def test_a_build_that_was_broken_off_is_built_anew(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 3) for i in range(6)], "doc_id long, text string")
    path = str(tmp_path / "s")

    real = DataFrameWriter.parquet

    def fail(self, to, *more, **options):
        if to.endswith("/index"):  # the shards are there
            raise RuntimeError("stopped")
        return real(self, to, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", fail)
    with pytest.raises(RuntimeError):
        sinks.write_stream(docs, path, 8)
    assert os.path.exists(f"{path}/shards") and commits.finished(spark, path) is None
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    index = sinks.write_stream(docs.where("doc_id < 4"), path, 8).orderBy("shard").collect()
    assert [(x.shard, x.n_docs, x.start) for x in index] == [(0, 2, 0), (1, 2, 8)]
    assert spark.read.parquet(f"{path}/shards").count() == 4 and commits.finished(spark, path) == {"size": 8, "max_tokens": None}
    assert sinks.write_stream(docs, path, 99).count() == 2
    # The same for shards by lanes: a folder without a record isn't taken for an output.
    lanes = str(tmp_path / "lanes")
    docs.where("doc_id = 0").withColumn("lane", F.lit(7)).withColumn("shard", F.lit(7)).write.partitionBy("lane", "shard").parquet(lanes)
    sinks.write_shards(docs, lanes, 100)
    assert spark.read.parquet(lanes).count() == 6
    sinks.write_shards(docs.limit(1), lanes, 100)
    assert spark.read.parquet(lanes).count() == 6


def test_records(spark, tmp_path):
    path = str(tmp_path / "x" / "record.json")
    assert commits.get(spark, path) is None
    for value in ({"a": "é"}, [1, 2]):
        commits.put(spark, path, value)
        assert commits.get(spark, path) == value
    assert [f for f in os.listdir(tmp_path / "x") if not f.startswith(".")] == ["record.json"]
