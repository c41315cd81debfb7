"""Overlap with a benchmark by runs of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import ngrams, words
from loomery.session import stored

#: Words of a run; distinct runs of a benchmark that every task may hold, of 8 bytes each (Spark's table of them takes some 32 MB).
N, HELD = 13, 1 << 20


def grams(rows: DataFrame, text: str, n: int = N) -> DataFrame:
    """The columns of rows with gram: each run of n words of the text."""
    return rows.withColumn("_w", words(F.col(text))).withColumn("gram", F.explode(ngrams("_w", n))).drop("_w")


def _hashes(rows: DataFrame, text: str, n: int) -> DataFrame:
    """The columns of rows with h: a hash of each run of n words."""
    rows = rows.withColumn("_w", words(F.col(text)))
    hashes = f"CASE WHEN size(_w) >= {n} THEN transform(sequence(1, size(_w) - {n} + 1), i -> xxhash64(slice(_w, i, {n}))) END"
    return rows.withColumn("h", F.explode(F.expr(hashes))).drop("_w")


def _sharing(rows: DataFrame, wanted: DataFrame, key: str, n: int, held: int) -> DataFrame:
    """The keys of rows (key, _t) of which a run has a hash in wanted (h, distinct), at least; stored.

    Up to `held` hashes are sent to all tasks, and the runs of the rows aren't shuffled. More
    are counted first over the rows' own distinct hashes, so that a common run is shuffled once a task.
    """
    runs = _hashes(rows, "_t", n)
    if wanted.count() <= held:
        return stored(runs.join(F.broadcast(wanted), "h", "left_semi").select(key).distinct())
    common = stored(runs.select("h").distinct().join(wanted, "h", "left_semi"))  # what both hold, no more than wanted
    common = F.broadcast(common) if common.count() <= held else common
    return stored(runs.join(common, "h", "left_semi").select(key).distinct())


def overlapping(rows: DataFrame, key: str, benchmark: DataFrame, text: str = "text", n: int = N, held: int = HELD) -> DataFrame:
    """The keys of rows that share a run of n words with the benchmark.

    Hashes of the runs are compared first; what is left, which is little, is compared word for
    word. A null text has no words; rows without a key are passed over.
    """
    rows = rows.select(key, F.col(text).alias("_t"))
    wanted = benchmark.select(F.col("text").alias("_t"))
    hit = _sharing(rows, stored(_hashes(wanted, "_t", n).select("h").distinct()), key, n, held)
    left = grams(rows.join(hit, key, "left_semi"), "_t", n)
    return left.join(grams(wanted, "_t", n).select("gram").distinct(), "gram", "left_semi").select(key).distinct()


def clean(rows: DataFrame, key: str, benchmark: DataFrame, text: str = "text", n: int = N, held: int = HELD) -> DataFrame:
    """The rows without such a run, and those without a key."""
    return rows.join(stored(overlapping(rows, key, benchmark, text, n, held)), key, "left_anti")
