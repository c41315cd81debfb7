"""Raw token files: tokens as two or four bytes each, one after the other, as a Spark data source.

`token_files` writes each partition to a file of its own as it comes, and an index last: the
files in order of the partitions, with their tokens. What a failed attempt has left is in no index. It
reads by ranges of tokens: a task seeks to its own and reads no more, and windows may lie
across files. A single raw file, or a folder of them without an index, is read as well, files by name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from loomery.sources.documents import opened

NAME, INDEX, KINDS, SPLIT = "token_files", "index.json", {"uint16": 2, "uint32": 4}, 1 << 24


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    tokens: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.kind, self.run = options["path"], options.get("kind", "uint16"), uuid.uuid4().hex[:12]
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{INDEX}").type == fs.FileType.File and not overwrite:
            raise FileExistsError(f"{self.path} is finished; mode overwrite writes it anew")
        system.create_dir(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context, most = TaskContext.get(), np.iinfo(self.kind).max
        name = f"part-{context.partitionId():06d}-{self.run}-{context.taskAttemptId()}.bin"
        system, root = opened(self.path)
        tokens = 0
        with system.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                column = batch["ids"]
                if column.null_count:
                    raise ValueError("ids are null")
                ids = column.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() > most):
                    raise ValueError(f"an id doesn't fit {self.kind}")
                out.write(ids.astype(f"<u{KINDS[self.kind]}").tobytes())
                tokens += len(ids)
        return Part(context.partitionId(), name, tokens)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = opened(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        index = {"kind": self.kind, "tokens": sum(p.tokens for p in parts), "files": [{"name": p.name, "tokens": p.tokens} for p in parts if p.tokens]}
        with system.open_output_stream(f"{root}/{INDEX}.{self.run}") as out:
            out.write(json.dumps(index).encode())
        system.move(f"{root}/{INDEX}.{self.run}", f"{root}/{INDEX}")
        known = {f["name"] for f in index["files"]}
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.base_name.endswith(".bin") and f.base_name not in known:
                system.delete_file(f.path)

    def abort(self, messages: list[Part | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{m.name}")


class Windows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__(None)
        self.low, self.high = low, high


def index_of(path: str, kind: str) -> dict:
    """The index of a folder; of files without one, made from their sizes."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.Directory and system.get_file_info(f"{root}/{INDEX}").type == fs.FileType.File:
        with system.open_input_stream(f"{root}/{INDEX}") as raw:
            found = json.loads(raw.read())
        return found | {"files": [f | {"name": f"{root}/{f['name']}"} for f in found["files"]]}
    files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".bin")]
    for f in files:
        if f.size % KINDS[kind]:
            raise ValueError(f"{f.path}: {f.size} bytes are no whole number of tokens")
    found = [{"name": f.path, "tokens": f.size // KINDS[kind]} for f in sorted(files, key=lambda f: f.path)]
    return {"kind": kind, "tokens": sum(f["tokens"] for f in found), "files": found}


def read_range(path: str, index: dict, low: int, high: int) -> np.ndarray:
    """Tokens [low, high) of all files, one after the other; only their bytes are read."""
    system, _ = opened(path)
    size, at, out = KINDS[index["kind"]], 0, []
    for f in index["files"]:
        a, b = max(low - at, 0), min(high - at, f["tokens"])
        if a < b:
            with system.open_input_file(f["name"]) as raw:
                data = raw.read_at((b - a) * size, a * size)
            if len(data) != (b - a) * size:
                raise OSError(f"{f['name']}: fewer tokens than its index says")
            out.append(np.frombuffer(data, f"<u{size}"))
        at += f["tokens"]
    return np.concatenate([np.zeros(0, f"<u{size}"), *out])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.length = options["path"], int(options.get("length", 1024))
        self.index = index_of(self.path, options.get("kind", "uint16"))
        self.split = max(1, int(options.get("split", SPLIT)) // self.length) * self.length

    def partitions(self) -> list[Windows]:
        return [Windows(low, min(low + self.split, self.index["tokens"])) for low in range(0, self.index["tokens"], self.split)]

    def read(self, partition: Windows) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // self.length) * self.length
        for low in range(partition.low, partition.high, step):
            ids = read_range(self.path, self.index, low, min(low + step, partition.high)).astype(np.int64)
            ends = np.r_[np.arange(0, len(ids), self.length), len(ids)].astype(np.int32)
            windows = pa.array(low // self.length + np.arange(len(ends) - 1), pa.int64())
            yield pa.record_batch([windows, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["window_id", "ids"])


class TokenFiles(DataSource):
    """Options: path; kind (uint16, uint32); for reading, length (tokens of a window) and split (tokens a task reads)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "window_id long, ids array<long>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def write_tokens(rows: DataFrame, path: str, *, order: str = "start", kind: str = "uint16", files: int | None = None, again: bool = False) -> dict:
    """The ids (an array column) of rows, in order, as raw token files; gives the index. A finished output is left as it is, unless again.

    There are as many files as shuffle partitions, unless said otherwise.
    """
    spark = rows.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    system, root = opened(path)
    if again or system.get_file_info(f"{root}/{INDEX}").type != fs.FileType.File:
        spark.dataSource.register(TokenFiles)
        parts = rows.select(order, "ids").repartitionByRange(files, order).sortWithinPartitions(order).selectExpr("CAST(ids AS array<bigint>) AS ids")
        parts.write.format(NAME).option("kind", kind).mode("overwrite").save(path)
    return index_of(path, kind)


def token_windows(spark: SparkSession, path: str, *, length: int = 1024, kind: str = "uint16", split: int = SPLIT) -> DataFrame:
    """window_id and ids of raw token files; the last window has what is left."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(NAME).options(kind=kind, length=str(length), split=str(split)).load(path)
