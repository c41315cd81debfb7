"""Writing shards, chats, suites and download records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.shards import cut_shards, cut_stream
from loomery.session import stored
from loomery.sources.commits import committed


def write_shards(docs: DataFrame, path: str, size: int) -> None:
    """doc_id and text under path/lane=*/shard=*; a finished output is left as it is."""

    def build() -> dict:
        cut = cut_shards(docs, size).select("doc_id", "lane", "shard")
        docs.select("doc_id", "text").join(cut, "doc_id").write.partitionBy("lane", "shard").parquet(path)
        return {"size": size}

    committed(docs.sparkSession, path, build)


def write_stream(docs: DataFrame, path: str, size: int, max_tokens: int | None = None) -> DataFrame:
    """doc_id, n, start and text under path/shards/shard=*, cut as one stream, and path/index: shard, n_docs, tokens, start. A finished output is left as it is.

    Shards, and within them documents, are in the order of the stream. Gives the index.
    """
    spark = docs.sparkSession

    def build() -> dict:
        cut = stored(cut_stream(docs, size, max_tokens))  # read twice, so that texts and index agree
        texts = docs.select("doc_id", "text").join(cut, "doc_id").repartitionByRange("shard").sortWithinPartitions("shard", "start")
        texts.write.partitionBy("shard").parquet(f"{path}/shards")
        index = cut.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens"), F.min("start").alias("start"))
        index.write.parquet(f"{path}/index")
        return {"size": size, "max_tokens": max_tokens}

    committed(spark, path, build)
    return spark.read.parquet(f"{path}/index")


def manifest(docs: DataFrame, size: int) -> DataFrame:
    """lane, shard, n_docs and tokens of each shard."""
    return cut_shards(docs, size).groupBy("lane", "shard").agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens"))


def merged_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Download records (source, revision, source_tokens, files) after an update.

    A record of a new revision replaces the source's old ones. Within a revision a record
    only grows: the longer list of files stays, and a null, which means the whole source,
    wins over any number of tokens.
    """
    current = new.select("source", "revision").distinct()
    rows = old.join(current, ["source", "revision"], "left_semi").unionByName(new)
    tokens = F.when(F.bool_or(F.isnull("source_tokens")), None).otherwise(F.max("source_tokens"))
    rows = rows.groupBy("source", "revision").agg(tokens.alias("source_tokens"), F.max_by("files", F.size("files")).alias("files"))
    return rows.unionByName(old.join(new.select("source").distinct(), "source", "left_anti"))


def short_of_need(records: DataFrame, need: str = "need") -> DataFrame:
    """Records whose tokens are under 0.999 of the need; whole sources never are."""
    return records.where(F.col("source_tokens") < 0.999 * F.col(need))


def write_suite(records: DataFrame, path: str) -> DataFrame:
    """Benchmark records under path/task=*, as JSON lines; gives task, n."""
    records.write.mode("overwrite").partitionBy("task").json(path)
    return records.groupBy("task").agg(F.count("*").alias("n"))


def write_chats(messages: DataFrame, path: str, append: bool = False) -> None:
    """messages (array of role and content) as JSON lines."""
    messages.select("messages").write.mode("append" if append else "overwrite").json(path)
