"""Order, running totals and seeded shuffles, without one task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, key: str | Column) -> Column:
    """A key by which rows are in a seeded random order: the md5 of seed and key, in hexadecimal."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def running_total(df: DataFrame, value: str | Column, order: Sequence[str | Column], bucket: Column, groups: Sequence[str] = (), name: str = "before") -> DataFrame:
    """df with `name`: the sum of value over the rows of the same group that come earlier in the order.

    bucket must not fall as the order rises. The sum of each (group, bucket) comes first,
    so that only rows of one bucket are ever sorted together, and only one row for each
    bucket is sorted within a group; numbered buckets are summed in runs of 1,000 of them first.
    """
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    keys = [*groups, "_bucket"]
    sums = df.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    total = lambda column, over: F.coalesce(F.sum(column).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if sums.schema["_bucket"].dataType.typeName() == "long":
        sums = sums.withColumn("_run", F.floor(F.col("_bucket") / 1000))
        runs = sums.groupBy(*groups, "_run").agg(F.sum("_sum").alias("_of_run"))
        runs = runs.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_run").alias("_r"), total("_of_run", Window.partitionBy(*groups).orderBy("_run")).alias("_runs"))
        same = F.col("_run").eqNullSafe(F.col("_r"))
        for k, g in enumerate(groups):
            same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
        sums = sums.withColumn("_start", total("_sum", Window.partitionBy(*groups, "_run").orderBy("_bucket"))).join(runs, same)
        sums = sums.select(*keys, (F.col("_start") + F.col("_runs")).alias("_start"))
    else:
        sums = sums.withColumn("_start", total("_sum", Window.partitionBy(*groups).orderBy("_bucket"))).drop("_sum")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    match = F.lit(True)
    for k in keys:
        match &= df[k].eqNullSafe(sums[k])
    joined = df.join(sums.select(*keys, "_start"), match)
    return joined.select(*[df[c] for c in df.columns if not c.startswith("_")], (F.col("_start") + F.col("_within")).alias(name))


def hex_bucket(df: DataFrame, key: str, rows: int = 1000) -> Column:
    """Numbered buckets of a shuffle key, by as many of its first hexadecimal digits as leave about so many rows of df to each."""
    n, digits = df.count(), 1
    while digits < 15 and 16**digits * rows < n:
        digits += 1
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def id_bucket(key: str, width: int = 1000) -> Column:
    """The bucket of a whole number."""
    return F.floor(F.col(key) / width)


def even_bucket(df: DataFrame, key: str, rows: int = 1000) -> Column:
    """Buckets of a whole number that hold about so many rows of df each, if its values lie evenly, however far apart they are."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    return id_bucket(key, max(1, (high - low + 1) * rows // n) if n else rows)
