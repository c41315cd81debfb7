"""Benchmark and preference records, blind grading, prompts and ranked pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import strip
from loomery.operators.order import shuffle_key


def answer_index(labels: str, key: str) -> Column:
    """The place of the answer's label, from 0; null for a label that isn't there."""
    return F.nullif(F.array_position(labels, F.col(key)), F.lit(0)) - 1


def has_pair(prompt: str, chosen: str, rejected: str) -> Column:
    """Whether a prompt and two answers are all there and not empty."""
    full = [F.coalesce(F.col(c) != "", F.lit(False)) for c in (prompt, chosen, rejected)]
    return full[0] & full[1] & full[2]


def blind_order(items: DataFrame, seed: int, key: str) -> DataFrame:
    """items with number, from 1, in a seeded random order; items to be graded by hand are few."""
    return items.withColumn("number", F.row_number().over(Window.orderBy(shuffle_key(seed, key), key)))


def unmatched(grades: DataFrame, keys: DataFrame, number: str = "number") -> DataFrame:
    """Numbers that don't have exactly one grade and one key: number, n_grades, n_keys."""
    count = lambda rows, name: rows.groupBy(number).agg(F.count("*").alias(name))
    both = count(grades, "n_grades").join(count(keys, "n_keys"), number, "full")
    both = both.select(number, F.coalesce("n_grades", F.lit(0)).alias("n_grades"), F.coalesce("n_keys", F.lit(0)).alias("n_keys"))
    return both.where("n_grades <> 1 OR n_keys <> 1")


def transcript(records: DataFrame, fields: Sequence[str], text: str = "value") -> DataFrame:
    """The parts of a record written as ===FIELD=== lines, each up to the next mark, stripped."""
    part = lambda f: strip(F.regexp_extract(F.col(text), rf"(?s)==={f}===\n(.*?)(?:\n===|\z)", 1))
    return records.select("*", *[part(f).alias(f.lower()) for f in fields])


def masked_windows(tokens: DataFrame, length: int, world: int = 1) -> DataFrame:
    """From (at, token, learnt): window_id, at, x, y of windows of `length`, y -100 where the next token isn't learnt.

    Only whole groups of `world` windows count; the tail that doesn't fill one is dropped.
    """
    n = tokens.agg(F.count("*").alias("n"))
    ahead = tokens.select((F.col("at") - 1).alias("at"), F.when(F.col("learnt"), F.col("token")).otherwise(-100).alias("y"))
    rows = tokens.join(ahead, "at").crossJoin(F.broadcast(n))
    windows = F.floor((F.col("n") - 1) / (world * length)) * world
    rows = rows.withColumn("window_id", F.floor(F.col("at") / length)).where(F.col("window_id") < windows)
    return rows.select("window_id", "at", F.col("token").alias("x"), "y")


def padded(arrays: DataFrame, column: str, length: int, pad: int) -> DataFrame:
    """arrays with their column cut or filled up with pad to the length."""
    filled = F.concat(F.col(column), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(column))))
    return arrays.withColumn(column, F.slice(filled, 1, length))


def padded_to_longest(arrays: DataFrame, column: str, pad: int, batch: str | None = None, least: int = 0) -> DataFrame:
    """arrays with their column filled up with pad to the longest of its batch, or of all rows, and to `least` at least."""
    keys = [batch] if batch else []
    sizes = arrays.groupBy(*keys).agg(F.greatest(F.max(F.size(column)), F.lit(least)).alias("_longest"))
    if batch:
        sizes = sizes.withColumnRenamed(batch, "_batch")
        rows = arrays.join(sizes, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    else:
        rows = arrays.crossJoin(F.broadcast(sizes))
    return rows.withColumn(column, F.concat(F.col(column), F.array_repeat(F.lit(pad), F.col("_longest") - F.size(column)))).drop("_longest")


def reward_statistics(pairs: DataFrame, beta: float, groups: Sequence[str] = ()) -> DataFrame:
    """From log-probabilities of chosen and rejected answers under a model and a reference: loss, accuracy, margin."""
    margin = beta * ((F.col("chosen") - F.col("ref_chosen")) - (F.col("rejected") - F.col("ref_rejected")))
    # ln(1 + e^-m) without overflow
    loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    return pairs.groupBy(*groups).agg(F.avg(loss).alias("loss"), F.avg((margin > 0).cast("double")).alias("accuracy"), F.avg(margin).alias("margin"), F.count("*").alias("n"))


def by_trust(pages: DataFrame, query: str, tier: str, position: str, k: int) -> DataFrame:
    """The first k pages of each query, trusted ones first, else in the order they came."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(tier, position))
    return pages.withColumn("place", place).where(F.col("place") <= k)


def grounded_prompt(question: Column, parts: Sequence[tuple[str, Column]], limit: int) -> Column:
    """A question after its sources, each under its label and cut to the limit; sources without text are left out."""
    shown = [F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"[{label}] "), F.substring(text, 1, limit))) for label, text in parts]
    return F.concat_ws("\n\n", *shown, F.concat(F.lit("Question: "), question))
