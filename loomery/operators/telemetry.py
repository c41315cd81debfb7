"""Telemetry of runs: windows, runs of like rows, trends and latest states."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_windows(samples: DataFrame, seconds: int, high: float = 50.0) -> DataFrame:
    """From (ts, seq, device, load, reading, flagged): figures of windows that begin with the first sample.

    Rows of one time are joined first; a window's figures are means or maxima over its times.
    """
    start = samples.agg(F.min("ts").alias("start"))
    each = samples.groupBy("ts").agg(
        F.count_if(F.col("load") >= high).alias("loaded"), F.max("reading").alias("hottest"), F.sum("reading").alias("total"),
        F.min_by("reading", "seq").alias("first"), F.count_if("flagged").alias("n_flagged"),
    )
    each = each.crossJoin(F.broadcast(start))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    at = F.floor((micros("ts") - micros("start")) / (seconds * 1_000_000))
    mean = lambda c: F.round(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))), 6)
    return each.groupBy(at.alias("window")).agg(
        F.bround(F.avg("loaded")).cast("int").alias("loaded"), F.max("hottest").alias("hottest"), mean("total").alias("total"), mean("first").alias("first"), mean("n_flagged").alias("n_flagged")
    )


def plateau(windows: DataFrame) -> DataFrame:
    """For each level of load, the mean of its last two windows."""
    last = F.row_number().over(Window.partitionBy("loaded").orderBy(F.desc("window")))
    return windows.withColumn("_r", last).where("_r <= 2").groupBy("loaded").agg(F.round(F.avg("hottest"), 6).alias("hottest"), F.round(F.avg("total"), 6).alias("total"))


def runs(rows: DataFrame, flag: Column, key: str, order: str) -> DataFrame:
    """Runs of flagged rows that follow each other within a key: first, last and n."""
    flags = rows.select(key, order, flag.alias("_f"))
    all_, own = Window.partitionBy(key).orderBy(order), Window.partitionBy(key, "_f").orderBy(order)
    island = F.row_number().over(all_) - F.row_number().over(own)
    found = flags.withColumn("_i", island).where("_f").groupBy(key, "_i")
    return found.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_i")


def last_rows(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def trimmed_line(rows: DataFrame, key: str, x: str, y: str, n: int = 500, deviations: float = 2.5) -> DataFrame:
    """A line through each key's last n points, without those far from their mean if two others are left."""
    recent = last_rows(rows, key, x, n)
    centre = recent.groupBy(key).agg(F.avg(y).alias("_m"), F.stddev_pop(y).alias("_s"))
    near = (F.col("_s") == 0) | (F.abs(F.col(y) - F.col("_m")) <= deviations * F.col("_s"))
    recent = recent.join(centre, key).withColumn("_near", near)
    counts = recent.groupBy(key).agg(F.count_if("_near").alias("_n"))
    used = recent.join(counts, key).where((F.col("_n") < 2) | F.col("_near"))
    return used.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def log_line(rows: DataFrame, key: str, x: str, y: str, n: int = 1500) -> DataFrame:
    """y = a + b * ln(x) through each key's last n points with x > 0."""
    recent = last_rows(rows, key, x, n).where(F.col(x) > 0).withColumn("_x", F.log(x))
    return recent.groupBy(key).agg(F.regr_intercept(y, "_x").alias("a"), F.regr_slope(y, "_x").alias("b"))


def latest(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values], F.count("*").alias("n"))


def checkpoint_order(names: DataFrame, name: str = "name") -> DataFrame:
    """names with their step, from the last number in the name; the final one has none and comes last."""
    step = F.nullif(F.regexp_extract(name, r"(\d+)\.\w+$", 1), F.lit("")).cast("long")
    rows = names.withColumn("step", step)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy(F.isnull("step"), "step", name)))


def prunable(names: DataFrame, keep: int) -> DataFrame:
    """What goes when the newest `keep` of each series stay; permanent ones never go."""
    newest = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("step"), F.desc("name")))
    return names.where(~F.col("permanent")).withColumn("_r", newest).where(F.col("_r") > keep).drop("_r")


class Usual:
    """What is usual in a run: the least median, so far, of its last `window` usual values.

    A value is usual if it is at most `most` times that level. The first `least` values are taken as usual.
    """

    def __init__(self, most: float, window: int, least: int) -> None:
        self.most, self.window, self.least = most, window, least
        self.recent: deque[float] = deque()
        self.ranked: list[float] = []
        self.level = math.inf
        self.taken = 0  # values taken as usual so far

    def level_for(self, value: float | None) -> float | None:
        """The level that a value is held against; none for the first ones, and for what is no finite number."""
        if value is None or not math.isfinite(value):
            return None
        n, level = len(self.recent), None
        if n >= self.least:
            level = self.level = min(self.level, (self.ranked[(n - 1) // 2] + self.ranked[n // 2]) / 2)
        if level is None or value <= self.most * level:
            self.recent.append(value)
            self.taken += 1
            insort(self.ranked, value)
            if n == self.window:
                del self.ranked[bisect_left(self.ranked, self.recent.popleft())]
        return level


#: How many times the level, and how many values in a row: for an alert, which can come again after a usual value, and for a halt.
ALERT, HALT, WINDOW, LEAST = (10.0, 20), (100.0, 200), 20_000, 50


def levels(rows: DataFrame, most: float = ALERT[0], window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """From (run, step, value): the same with the level of each value, where it has one.

    The runs are read in order, batch by batch, and no more than a run's last `window` values is held.
    """
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, usual = None, Usual(most, window, least)
        for batch in batches:
            found = []
            for name, value in zip(batch["run"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if name != run:
                    run, usual = name, Usual(most, window, least)
                found.append(usual.level_for(value))
            yield batch.append_column("level", pa.array(found, pa.float64()))

    ordered = rows.select("run", "step", "value").repartition("run").sortWithinPartitions("run", "step", "value")
    return ordered.mapInArrow(follow, "run string, step long, value double, level double").where("level IS NOT NULL")


def watched(rows: DataFrame, run: str, order: str, value: str, alert: tuple[float, int] = ALERT, halt: tuple[float, int] = HALT, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """run, step, event: where a run's values stay far above their usual level.

    There is an alert at the value that makes alert[1] in a row of more than alert[0] times
    the level, and one halt, at the first that makes halt[1] of more than halt[0] times.
    """
    slim = rows.select(F.col(run).cast("string").alias("run"), F.col(order).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    rows = levels(slim, alert[0], window, least)
    by_run = Window.partitionBy("run").orderBy("step", "value")
    for name, (times, _) in (("high", alert), ("extreme", halt)):
        # How many values back the last one lies that isn't: the length of the streak.
        rows = rows.withColumn("at", F.row_number().over(by_run)).withColumn(name, F.col("value") > times * F.col("level"))
        rows = rows.withColumn(name, F.col("at") - F.coalesce(F.max(F.when(~F.col(name), F.col("at"))).over(by_run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    halted = F.coalesce(F.max(F.col("extreme") >= halt[1]).over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    event = F.when((F.col("extreme") >= halt[1]) & ~halted, "halt").when(F.col("high") == alert[1], "alert")
    return rows.select("run", "step", event.alias("event")).where("event IS NOT NULL")
