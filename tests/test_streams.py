"""One stream of shards, listings and the shared folder."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomery import session
from loomery.operators import order, shards
from loomery.sources import sinks, tables


def docs_of(spark, lengths, ids=None):
    return spark.createDataFrame([(i, "x" * (n - 1)) for i, n in zip(ids or range(len(lengths)), lengths, strict=True)], "doc_id long, text string")


def test_one_stream_is_next_fit(spark):
    """Blocks of few shards give the shards of the plain walk, with documents longer than a shard or than a block."""
    for seed in range(4):
        r = random.Random(seed)
        lengths = [r.choice([1, 3, 9, 20, 45]) if r.random() < 0.95 else r.choice([51, 130, 700]) for _ in range(300)]
        want = shards.next_fit(lengths, 50).tolist()
        got = shards.cut_stream(docs_of(spark, lengths, [i * 10**15 for i in range(300)]), 50, shards_a_block=3).orderBy("doc_id").collect()
        assert [x.shard for x in got] == want and [x.n for x in got] == lengths


def test_stream_ends(spark, tmp_path):
    """The document that brings the total there is the last, unless it is longer than a shard."""
    docs = docs_of(spark, [4, 4, 20, 4, 4])
    assert [sorted(x.doc_id for x in shards.cut_stream(docs, 10, n).collect())[-1] for n in (1, 8, 9, 29, 99)] == [0, 1, 3, 3, 4]
    index = sinks.write_stream(docs, str(tmp_path / "s"), 10).orderBy("shard").collect()
    assert [(x.shard, x.n_docs, x.tokens, x.start) for x in index] == [(0, 2, 8, 0), (1, 1, 20, 8), (2, 2, 8, 28)]
    assert spark.read.parquet(str(tmp_path / "s" / "shards")).count() == 5
    assert sinks.write_stream(docs, str(tmp_path / "s"), 99).count() == 3  # what is finished stays


def test_sparse_ids(spark):
    """However far apart ids are, buckets hold about as many rows."""
    r = random.Random(1)
    ids = [r.randrange(-(2**62), 2**62) for _ in range(5000)]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    sizes = [r["count"] for r in rows.groupBy(order.even_bucket(rows, "doc_id", 100).alias("b")).count().collect()]
    assert max(sizes) < 300 and len(sizes) < 120
    total = order.running_total(rows, F.lit(1), ["doc_id"], order.even_bucket(rows, "doc_id", 3)).collect()
    assert {r.doc_id: r.before for r in total} == {i: k for k, i in enumerate(sorted(ids))}


def test_source_files(spark, tmp_path):
    for name in ("b.jsonl", "a.parquet", "c.txt"):
        (tmp_path / name).write_text("{}")
    found = tables.source_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["a.parquet", "b.jsonl"]
    record = spark.createDataFrame([(found[0].path, 2), (found[0].path, 2)], "path string, size long")
    assert [r.path for r in tables.source_files(spark, str(tmp_path), record).collect()] == [found[0].path]
    with pytest.raises(FileNotFoundError):
        tables.source_files(spark, str(tmp_path), record.withColumn("size", F.lit(3).cast("long")))


def test_no_machine_local_folder_on_a_cluster():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_folder(unset)
