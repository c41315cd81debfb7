"""Filters of a model's next-token scores, as tables of (context, token, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chances(logits: DataFrame, key: str = "context", temperature: float = 1.0) -> DataFrame:
    """logits with p, the softmax over each context."""
    most = Window.partitionBy(key)
    rows = logits.withColumn("_e", F.exp((F.col("logit") - F.max("logit").over(most)) / temperature))
    return rows.withColumn("p", F.col("_e") / F.sum("_e").over(most)).drop("_e")


def top_k(logits: DataFrame, k: int, key: str = "context") -> DataFrame:
    """The k largest of each context, with all that equal the k-th."""
    place = F.rank().over(Window.partitionBy(key).orderBy(F.desc("logit")))
    return logits.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def nucleus(logits: DataFrame, mass: float, key: str = "context") -> DataFrame:
    """The likeliest tokens of each context, until those before one hold more than the mass."""
    before = Window.partitionBy(key).orderBy(F.desc("p"), "token").rowsBetween(Window.unboundedPreceding, -1)
    rows = chances(logits, key).withColumn("_b", F.coalesce(F.sum("p").over(before), F.lit(0.0)))
    return rows.where(F.col("_b") <= mass).drop("_b")


def penalised(logits: DataFrame, recent: DataFrame, penalty: float, key: str = "context") -> DataFrame:
    """logits, those of recent tokens (context, token) divided by the penalty if positive, else multiplied."""
    seen = recent.select(key, "token").distinct().withColumn("_s", F.lit(True))
    hit = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return logits.join(seen, [key, "token"], "left").withColumn("logit", F.when(F.col("_s"), hit).otherwise(F.col("logit"))).drop("_s")
