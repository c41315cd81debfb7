"""A resumable stream of documents, mixed from folders of JSON lines by shares of tokens.

The data source `mixed_documents` hands out one step at a time: for each source a range
of bytes, such that all sources come as near as they can to their shares of the tokens served.
Tasks read the lines that begin in their part of a range, so the driver lists files and
never reads one. A step's end, the bytes taken of each source, is Spark's offset, and is noted in
a progress folder before Spark gets it. When a step's documents are written, their
characters and tokens are reported to the same folder, and only then is the next step cut,
with the measured bytes per token of each source. So what a step holds depends on the
steps before it and on nothing else: a stream that was stopped anywhere, in a step or
between two, goes on as if it hadn't been.

Sources are {"name", "path", "weight"}; a path is a file or a folder, in any file system that Arrow
opens. Files are taken by name and must appear whole; new ones must have names
after those taken. A source without new files waits, while the others' shares grow, and then
catches up. A file that can't be read and a line that isn't UTF-8 are read errors: in strict
mode they end the stream, else they are passed over, and after LIMIT of them in a row the source is
dropped. Blank lines, malformed ones and those without text are left out.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomery.operators.mix import n_tokens

NAME, LIMIT, STEP, SPLIT, ENDINGS = "mixed_documents", 10, 1 << 30, 1 << 26, (".jsonl", ".json", ".jsonl.gz", ".json.gz")
#: Bytes of a file per token where none was measured, and the least ratio.
BYTES_PER_TOKEN, LEAST_RATIO = 4.0, 0.25
SCHEMA = "source string, at long, number long, line string, error string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files of a source, by name."""
    system, root = opened(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and f.path.endswith(ENDINGS))


class Range(InputPartition):
    """The lines that begin in [low, high) of a file; at: the source's bytes before the file."""

    def __init__(self, source: str, root: str, path: str, at: int, low: int, high: int) -> None:
        super().__init__(None)
        self.source, self.root, self.path, self.at, self.low, self.high = source, root, path, at, low, high


def ranges(source: str, root: str, start: int, end: int, split: int) -> Iterator[Range]:
    """The parts of a source's bytes [start, end). A compressed file belongs to its first byte."""
    at = 0
    for path, size in listed(root):
        low, high = max(start - at, 0), min(end - at, size)
        if path.endswith(".gz"):
            if start <= at < end:
                yield Range(source, root, path, at, 0, size)
        elif low < high:
            for cut in range(low, high, split):
                yield Range(source, root, path, at, cut, min(cut + split, high))
        at += size


def lines(part: Range) -> Iterator[tuple[int, int, bytes]]:
    """Place (bytes of the source before it), number in the part and bytes of each line."""
    system, _ = opened(part.root)
    if part.path.endswith(".gz"):
        with system.open_input_stream(part.path, compression=None) as raw:
            for number, line in enumerate(gzip.GzipFile(fileobj=raw)):
                yield part.at, number, line
        return
    with system.open_input_file(part.path) as raw:
        place = max(0, part.low - 1)
        raw.seek(place)
        rest, number = b"", 0
        skip = part.low > 0  # up to the end of the line that began before
        while place < part.high or (rest and not skip):
            chunk = raw.read(1 << 20)
            text = rest + chunk
            pieces = text.split(b"\n")
            rest = pieces.pop()
            for line in pieces:
                if skip:
                    skip = False
                elif place < part.high:
                    yield part.at + place, number, line
                    number += 1
                else:
                    return
                place += len(line) + 1
            if not chunk:
                if rest and not skip and place < part.high:
                    yield part.at + place, number, rest
                return


def read(part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        out = pa.record_batch([pa.array([part.source] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], ["source", "at", "number", "line", "error"])
        rows.clear()
        return out

    size = 0
    try:
        for at, number, line in lines(part):
            try:
                rows.append((at, number, line.decode(), None))
            except UnicodeDecodeError as e:
                rows.append((at, number, None, f"{part.path}: {e.reason}"))
            size += len(line)
            if size > 4 << 20 or len(rows) >= 10_000:
                yield batch()
                size = 0
    except (OSError, EOFError) as e:  # the rest of the file is lost
        rows.append((part.at + part.low, 1 << 40, None, f"{part.path}: {type(e).__name__}: {e}"))
    if rows:
        yield batch()


class Progress:
    """The steps handed out and their reports, as small files in a folder."""

    def __init__(self, path: str) -> None:
        self.system, self.root = opened(path)
        self.system.create_dir(self.root)

    def put(self, kind: str, step: int, value: Any) -> None:
        """Written under another name and moved, so that a file is there whole or not at all."""
        name = f"{self.root}/{kind}-{step:012d}.json"
        with self.system.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(value).encode())
        self.system.move(f"{name}.part", name)

    def get(self, kind: str, step: int) -> Any:
        name = f"{self.root}/{kind}-{step:012d}.json"
        if self.system.get_file_info(name).type != fs.FileType.File:
            return None
        with self.system.open_input_stream(name) as raw:
            return json.loads(raw.read())

    def last(self, kind: str) -> int:
        found = [f.base_name for f in self.system.get_file_info(fs.FileSelector(self.root)) if f.base_name.startswith(f"{kind}-") and f.base_name.endswith(".json")]
        return max((int(n.removeprefix(f"{kind}-").removesuffix(".json")) for n in found), default=-1)


def next_step(sources: Sequence[Mapping], taken: Mapping[str, int], sizes: Mapping[str, int], report: Mapping[str, Mapping], step: int, bytes_per_token: float = BYTES_PER_TOKEN) -> dict[str, int]:
    """The bytes of each source to have been taken after the next step: about `step` bytes, given to those furthest behind their shares of tokens.

    Tokens served are those reported; a source without any is taken to have bytes_per_token.
    """
    left = {s["name"]: sizes[s["name"]] - taken[s["name"]] for s in sources if not report.get(s["name"], {}).get("dropped")}
    live = {s["name"]: float(s["weight"]) for s in sources if left.get(s["name"], 0) > 0}
    ratio, served = {}, {}
    for name in live:
        tokens = report.get(name, {}).get("tokens", 0)
        ratio[name] = max(taken[name] / tokens, LEAST_RATIO) if tokens > 0 else bytes_per_token
        served[name] = tokens
    out = dict(taken)
    # The tokens of a step, at the ratios of the mix; those that are ahead of their share get none, those behind share the rest.
    behind = dict(live)
    while behind:
        all_ = sum(behind.values())
        tokens = step / sum(w / all_ * ratio[n] for n, w in behind.items())
        level = sum(served[n] for n in behind) + tokens
        ahead = [n for n, w in behind.items() if w / all_ * level < served[n]]
        if not ahead:
            break
        behind = {n: w for n, w in behind.items() if n not in ahead}
    for n, w in behind.items():
        out[n] = taken[n] + min(left[n], max(1, round((w / all_ * level - served[n]) * ratio[n])))
    return out


class _Stream(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.sources = json.loads(options["sources"])
        self.step, self.split = int(options.get("step", STEP)), int(options.get("split", SPLIT))
        self.ratio, self.folder = float(options.get("ratio", BYTES_PER_TOKEN)), options["progress"]

    def initialOffset(self) -> dict:
        return {"step": 0, "taken": {s["name"]: int(s.get("skip", 0)) for s in self.sources}}

    def latestOffset(self) -> dict:
        progress = Progress(self.folder)
        last = progress.last("step")
        now = progress.get("step", last) if last > 0 else self.initialOffset()
        report = progress.get("report", now["step"]) if now["step"] else {}
        if report is None:
            return now  # the step has been handed out, and isn't done
        sizes = {s["name"]: sum(size for _, size in listed(s["path"])) for s in self.sources}
        taken = next_step(self.sources, now["taken"], sizes, report, self.step, self.ratio)
        if taken == now["taken"]:
            return now
        after = {"step": now["step"] + 1, "taken": taken}
        progress.put("step", after["step"], after)
        return after

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for s in self.sources for r in ranges(s["name"], s["path"], start["taken"][s["name"]], end["taken"][s["name"]], self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read(partition)


class _Batch(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.sources, self.split = json.loads(options["sources"]), int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        return [r for s in self.sources for r in ranges(s["name"], s["path"], int(s.get("skip", 0)), 1 << 62, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read(partition)


class MixedDocuments(DataSource):
    """The data source. Options: sources (JSON), split (bytes a task reads); for streams progress (a folder), step (bytes), ratio."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _Stream(self.options)


def raw_lines(spark: SparkSession, sources: Sequence[Mapping], split: int = SPLIT) -> DataFrame:
    """source, at, number, line and error of all lines of the sources, as a batch."""
    spark.dataSource.register(MixedDocuments)
    return spark.read.format(NAME).options(sources=json.dumps(list(sources)), split=str(split)).load()


def ends(rows: DataFrame, limit: int = LIMIT, before: Mapping[str, int] | None = None) -> DataFrame:
    """source, at and number of the error after which a source is dropped: the limit-th in a row. before: errors at the end of what came earlier.

    Only sources with so many errors are put in order.
    """
    carried = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("source")), F.lit(0)) if before else F.lit(0)
    many = rows.groupBy("source").agg(F.count("error").alias("n")).where(F.col("n") + carried >= limit).select("source")
    order = Window.partitionBy("source").orderBy("at", "number")
    rows = rows.join(many, "source", "left_semi").withColumn("run", F.count(F.when(F.isnull("error"), 1)).over(order))
    rows = rows.where("error IS NOT NULL").withColumn("in_row", F.row_number().over(Window.partitionBy("source", "run").orderBy("at", "number")) + F.when(F.col("run") == 0, carried).otherwise(0))
    return rows.where(F.col("in_row") >= limit).groupBy("source").agg(F.min(F.struct("at", "number")).alias("end")).select("source", "end.at", "end.number")


def tolerated(rows: DataFrame, *, limit: int = LIMIT, strict: bool = False, before: Mapping[str, int] | None = None) -> DataFrame:
    """The lines that could be read, up to the place where their source is dropped; in strict mode any error is raised."""
    if strict:
        bad = rows.where("error IS NOT NULL").select("source", "error").limit(1).collect()
        if bad:
            raise OSError(f"{bad[0].source}: {bad[0].error}")
    last = ends(rows, limit, before).select("source", F.col("at").alias("end_at"), F.col("number").alias("end_number"))
    kept = rows.where("error IS NULL").join(last, "source", "left")
    return kept.where("end_at IS NULL OR at < end_at OR (at = end_at AND number < end_number)").drop("end_at", "end_number", "error")


def texts(rows: DataFrame, field: str = "text") -> DataFrame:
    """Rows with text, from their lines; without blank or malformed ones and those without text."""
    return rows.withColumn("text", F.from_json("line", f"`{field}` string")[field]).where(F.length("text") > 0).drop("line")


def counts(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """source, n_docs, chars and tokens: what a writer reports."""
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars"), F.sum(tokens if tokens is not None else n_tokens()).alias("tokens"))


def follow(spark: SparkSession, sources: Sequence[Mapping], progress: str, checkpoint: str, write: Callable[[DataFrame, int], None], *, step: int = STEP, split: int = SPLIT, strict: bool = False, tokens: Column | None = None, field: str = "text", limit: int = LIMIT) -> Any:
    """Starts the stream, as a query that ends when all that is there has been read. write(docs, step) gets source, at, number and text of each step, and may get a step again.

    Order by at over the source's weight, then source, to have a step in the order of the mix.
    """
    spark.dataSource.register(MixedDocuments)
    stream = spark.readStream.format(NAME).options(sources=json.dumps(list(sources)), progress=progress, step=str(step), split=str(split)).load()

    def take(rows: DataFrame, batch: int) -> None:
        notes = Progress(progress)
        now = notes.last("step")
        done = (notes.get("report", now - 1) or {}) if now > 1 else {}
        rows = rows.persist()
        try:
            before = {n: r["errors"] for n, r in done.items() if r.get("errors")}
            docs = texts(tolerated(rows, limit=limit, strict=strict, before=before), field)
            write(docs, now)
            report = {s["name"]: dict(done.get(s["name"], {"chars": 0, "tokens": 0, "docs": 0, "errors": 0, "dropped": False})) for s in sources}
            for r in counts(docs, tokens).collect():  # one row a source
                for k, v in (("chars", r.chars), ("tokens", r.tokens), ("docs", r.n_docs)):
                    report[r.source][k] += v
            for r in ends(rows, limit, before).collect():
                report[r.source]["dropped"] = True
            after = rows.groupBy("source").agg(F.max(F.when(F.isnull("error"), F.struct("at", "number"))).alias("good"))
            tail = rows.join(after, "source").where("error IS NOT NULL AND (good IS NULL OR struct(at, number) > good)").groupBy("source", F.isnull("good").alias("all")).count()
            trailing = {r.source: r["count"] + (before.get(r.source, 0) if r["all"] else 0) for r in tail.collect()}
            for name in {r.source for r in after.select("source").collect()}:
                report[name]["errors"] = trailing.get(name, 0)
            notes.put("report", now, report)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()


def follow_all(*args: Any, **kwargs: Any) -> None:
    """`follow`, until no step is left."""
    query = follow(*args, **kwargs)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def positions(progress: str) -> dict[str, dict[str, int]]:
    """Of each source: the bytes taken, and the documents, characters and tokens of the steps that are done."""
    notes = Progress(progress)
    now = notes.last("report")
    if now < 1:
        return {}
    taken, report = notes.get("step", now)["taken"], notes.get("report", now)
    return {name: {"taken": at, **report[name]} for name, at in taken.items()}
