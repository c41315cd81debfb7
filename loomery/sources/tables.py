"""Reading tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.filters import has_text

READERS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".json.gz": "json", ".jsonl.gz": "json"}
CHAT = "messages array<struct<role: string, content: string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, root: str) -> DataFrame:
    """path and size of the readable files under a folder, as rows; only the listing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.lit(False)
    for ending in READERS:
        wanted |= F.col("path").endswith(ending)
    return listed.select("path", F.col("length").alias("size")).where(wanted)


def source_files(spark: SparkSession, root: str, recorded: DataFrame | None = None) -> DataFrame:
    """The readable files under a folder, each once, by path; with a record (path, size), only the recorded ones, all of which must be there."""
    found = files(spark, root)
    if recorded is not None:
        short = short_files(recorded, found).select("path").limit(5).collect()
        if short:
            raise FileNotFoundError(f"missing or of another size: {', '.join(r.path for r in short)}")
        found = found.join(recorded.select("path").distinct(), "path", "left_semi")
    return found.dropDuplicates(["path"]).orderBy("path")


def source(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet or JSON source by its ending, with the columns asked for."""
    ending = next((kind for end, kind in READERS.items() if path.endswith(end)), None)
    if ending is None:
        raise ValueError(f"unknown kind of file: {path}")
    rows = spark.read.format(ending).load(path)
    return rows.select(*columns) if columns else rows


def json_lines(spark: SparkSession, path: str, schema: str, text: str = "text") -> DataFrame:
    """Rows of a JSON-lines file with text; blank and malformed lines and empty texts are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(has_text(text))


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of a JSON-lines file; a malformed line is an error."""
    return spark.read.schema(CHAT).option("mode", "FAILFAST").json(path)


def short_files(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """Recorded files (path, size) that are missing or have another size."""
    present = present.select("path", F.col("size").alias("found"))
    return recorded.join(present, "path", "left").where("found IS NULL OR (size > 0 AND found <> size)")
