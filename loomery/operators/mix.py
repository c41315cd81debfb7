"""Mixing, repeating, continuing and cutting streams of documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.order import even_bucket, hex_bucket, running_total, shuffle_key


def n_tokens(text: str = "text") -> Column:
    """Tokens of a byte tokenizer without merges, and one that ends the text."""
    return F.octet_length(F.col(text)).cast("long") + 1


def stride_order(docs: DataFrame, weights: Mapping[str, float], key: str = "lang", seed: int = 7) -> DataFrame:
    """docs of weighted keys with n, shuffled and stride: tokens of the key so far, over its weight.

    Read in order of stride, every prefix holds the keys in proportion to their weights,
    to within about one document of each.
    """
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    docs = docs.where(F.col(key).isin(*weights)).withColumn("n", n_tokens()).withColumn("shuffled", shuffle_key(seed, "doc_id"))
    docs = running_total(docs, "n", ["shuffled", "doc_id"], hex_bucket(docs, "shuffled"), [key], "before")
    return docs.withColumn("stride", F.col("before").cast("double") / F.element_at(pairs, F.col(key))).drop("before")


def take_budget(docs: DataFrame, budget: int, *, value: str = "n", order: str = "stride", tie: str = "doc_id", width: float = 1e5) -> DataFrame:
    """The rows, in order, until their values first reach the budget; the one that reaches it stays."""
    docs = running_total(docs, value, [order, tie], F.floor(F.col(order) / width), name="before")
    return docs.where(F.col("before") < budget)


def share_report(docs: DataFrame, targets: Mapping[str, float], key: str = "lang", limit: float = 2.0) -> DataFrame:
    """Tokens, rows, percent, target percent of each key, and whether it is off by more than `limit` points."""
    per = docs.groupBy(key).agg(F.sum("n").alias("tokens"), F.count("*").alias("n_rows"))
    wanted = F.element_at(F.create_map(*[F.lit(x) for k, w in targets.items() for x in (k, 100.0 * w / sum(targets.values()))]), F.col(key))
    pct = 100 * F.col("tokens").cast("double") / F.sum("tokens").over(Window.partitionBy())
    per = per.withColumn("pct", F.round(pct, 6)).withColumn("target", F.round(wanted, 6))
    return per.withColumn("off_target", F.abs(F.col("pct") - F.col("target")) > limit)


def numbered(docs: DataFrame, groups: list[str], name: str = "seq") -> DataFrame:
    """docs with their place in their group, from 0, by doc_id."""
    return running_total(docs, F.lit(1), ["doc_id"], even_bucket(docs, "doc_id"), groups, name)


def round_robin(docs: DataFrame, part: str = "source") -> DataFrame:
    """docs with position: one row of each part in turn, parts by name, those that run dry drop out.

    That is the order by place in the part, then part; a bucket holds 16 places of all parts.
    """
    return running_total(numbered(docs, [part]), F.lit(1).cast("long"), ["seq", part], F.floor(F.col("seq") / 16), name="position")


def repeated(docs: DataFrame, epochs: Mapping[str, int], key: str = "lang") -> DataFrame:
    """docs once for each pass over their key, with epoch from 0; keys that aren't named have one."""
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in epochs.items() for x in kv]), F.col(key)), F.lit(1))
    return docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), n - 1)))


def continued(docs: DataFrame, taken: DataFrame, part: str = "source") -> DataFrame:
    """What an earlier build, which took the first `taken` rows of each part, has left."""
    docs = numbered(docs, [part])
    return docs.join(taken.select(part, "taken"), part, "left").where(F.col("seq") >= F.coalesce("taken", F.lit(0))).drop("taken")


def char_prefix(docs: DataFrame, target: Column | int, groups: list[str], value: str | Column = "n_chars") -> DataFrame:
    """Of each group, the rows by doc_id until their values first reach the target, with `before`."""
    docs = running_total(docs, value, ["doc_id"], even_bucket(docs, "doc_id"), groups, "before")
    return docs.where(F.col("before") < target)


def file_prefix(files: DataFrame, need: Column, group: str, order: str, size: str = "size") -> DataFrame:
    """Of each group's files in order, the shortest prefix whose sizes reach the need, one at least; no need takes all."""
    order_ = Window.partitionBy(group).orderBy(order)
    files = files.withColumn("before", F.coalesce(F.sum(size).over(order_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = files.withColumn("_first", F.row_number().over(order_) == 1).withColumn("_need", need)
    return files.where("_need IS NULL OR before < _need OR _first").drop("_first", "_need")


def split_prefix(docs: DataFrame, fraction: float, groups: list[str]) -> DataFrame:
    """docs with split: train for the first floor(fraction * count) rows of each group, else val."""
    counts = docs.groupBy(*groups).agg(F.count("*").alias("size"))
    docs = numbered(docs, groups).join(counts, groups)
    return docs.withColumn("split", F.when(F.col("seq") < F.floor(F.lit(fraction) * F.col("size")), "train").otherwise("val")).drop("size")
