"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import stored as written

__all__ = ["BLANKS", "bit_map", "in_bit_map", "repeated", "shuffles", "table", "text_of", "words", "written"]

#: Words are separated by the six ASCII white-space characters only.
BLANKS = r"[\x20\x09-\x0D]+"
MAP_BITS, _CHUNK_BITS = 27, 16


def in_slices(values: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """An array of texts in slices of at most some `most` bytes, so that no worker holds what it makes of a whole batch; none for an empty one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield values.slice(first, last - first)
        first = last


def text_of(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text that isn't null, unchanged and in order."""
    return F.array_remove(F.split(text, BLANKS), "")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def repeated(df: DataFrame, n: str, index: str, most: int | None = None, run: int = 10_000) -> DataFrame:
    """Each row of df as often as its column `n` (1 or more, `most` at most if given) says, with `index` counting from 0.

    Long runs are cut and dealt to all tasks before they are made, so that no task makes a whole one.
    """
    each = lambda rows, most: rows.withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long") - 1)))
    if most is not None and most <= run:
        return each(df, F.col(n))
    short = each(df.where(F.col(n) <= run), F.col(n))
    cut = df.where(F.col(n) > run).withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(run).cast("long"))))
    long = each(cut.repartition(shuffles(df.sparkSession)), F.least(F.lit(run), F.col(n) - F.col("_cut")))
    return short.unionByName(long.withColumn(index, F.col("_cut") + F.col(index)).drop("_cut"))


def bit_map(keys: DataFrame, column: str) -> bytes:
    """Bits at the hashes of a column of longs, modulo 2 ** MAP_BITS: 16 MB at the default, whatever the input.

    To leave out, before a shuffle, what can't match: it lets through too much, the more the fuller it is, and never too little.
    """
    size = 1 << (_CHUNK_BITS - 3)
    out = bytearray(1 << (MAP_BITS - 3))
    for row in bit_chunks(keys, column).collect():  # 16 MB at most, in one job instead of one a partition
        out[row.chunk * size : (row.chunk + 1) * size] = zlib.decompress(row.bits)
    return bytes(out)


def bit_chunks(keys: DataFrame, column: str) -> DataFrame:
    """The parts of a bit map that have bits: chunk and bits, packed by zlib, as few bits take few bytes on their way through the driver."""
    low = F.col(column).bitwiseAND((1 << MAP_BITS) - 1)
    chunks = keys.select(F.shiftright(low, _CHUNK_BITS).alias("chunk"), low.bitwiseAND((1 << _CHUNK_BITS) - 1).cast("int").alias("bit")).distinct()

    def packed(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _CHUNK_BITS, bool)
        bits[rows["bit"].to_numpy()] = True
        return pa.table({"chunk": rows["chunk"][:1], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    return chunks.groupBy("chunk").applyInArrow(packed, "chunk long, bits binary")


def in_bit_map(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (unsigned) is set in a bit map, given as bytes."""
    low = hashes & np.uint64((1 << MAP_BITS) - 1)
    return (bits[low >> np.uint64(3)] >> (7 - (low & np.uint64(7)).astype(np.uint8))) & 1 == 1
