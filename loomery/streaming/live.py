"""Following a run's log while it grows."""

from __future__ import annotations

import json
import math
import threading
import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomery.operators.telemetry import ALERT, HALT, LEAST, WINDOW, Usual, last_rows

#: The columns of a metrics line; a line has those of its event.
METRICS = "run string, step long, event string, loss double, val_loss double, lr double, grad_norm double, tok_per_s double, ts timestamp"


def metrics(spark: SparkSession, folder: str, schema: str = METRICS, files_at_once: int = 100) -> DataFrame:
    """The stream of metrics lines in a folder of growing numbers of JSON files; malformed lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_at_once).json(folder)


def train_rows(rows: DataFrame) -> DataFrame:
    return rows.where("event IS NULL AND loss IS NOT NULL")


def eval_rows(rows: DataFrame) -> DataFrame:
    return rows.where("event = 'eval' AND val_loss IS NOT NULL")


def seeds(log: DataFrame, last: int = 4000, least: int = LEAST) -> DataFrame:
    """run, values, level and last: what a run's log says is usual, for a watch that starts anew.

    values are the finite positive norms of the run's last rows of training, in order of steps, at
    most `last` of them; level is the least median of `least` of them in a row, each run of
    them after the other; last is the run's last step.
    """
    rows = log.where("event IS NULL AND run IS NOT NULL AND step IS NOT NULL").select("run", "step", "grad_norm")
    rows = last_rows(rows, "run", "step", last)
    good = F.col("grad_norm").isNotNull() & ~F.isnan("grad_norm") & (F.abs("grad_norm") < float("inf")) & (F.col("grad_norm") > 0)
    values = F.sort_array(F.collect_list(F.when(good, F.struct("step", "grad_norm"))))  # at most `last`
    runs = rows.groupBy("run").agg(values.alias("v"), F.max("step").alias("last")).withColumn("values", F.transform("v", lambda x: x.grad_norm))
    part = lambda i: F.sort_array(F.slice("values", i * least + 1, least))
    median = lambda i: (F.get(part(i), F.lit((least - 1) // 2)) + F.get(part(i), F.lit(least // 2))) / 2
    n = F.floor(F.size("values") / least).cast("int")
    return runs.select("run", "values", F.when(n > 0, F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), median))).alias("level"), "last")


class Watch(StatefulProcessor):
    """The watch over one run: what is usual, as values numbered in order, and the streaks so far."""

    def __init__(self, alert: tuple[float, int], halt: tuple[float, int], window: int, least: int) -> None:
        self.alert, self.halt, self.window, self.least = alert, halt, window, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "level double, last long, high long, extreme long, halted boolean, next long")
        self.recent = handle.getMapState("recent", "at long", "value double")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        """The last `window` of the values of `seeds` are taken as usual."""
        for row in initialState.itertuples():
            values = [float(v) for v in row.values_][-self.window :]
            for k, v in enumerate(values):
                self.recent.updateValue((k,), (v,))
            self.mark.update((math.inf if pd.isna(row.level) else float(row.level), int(row.last), 0, 0, False, len(values)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        usual = Usual(self.alert[0], self.window, self.least)
        level, last, high, extreme, halted, after = self.mark.get() if self.mark.exists() else (math.inf, -1, 0, 0, False, 0)
        usual.level = level
        held = sorted((k[0], v[0]) for k, v in self.recent.iterator()) if after else []
        usual.recent.extend(v for _, v in held)
        usual.ranked = sorted(usual.recent)
        first, said = after - len(held), []
        for row in pd.concat(list(rows)).sort_values("step", kind="stable").itertuples():
            if row.step <= last:
                continue
            last, taken = int(row.step), usual.taken
            value = None if pd.isna(row.grad_norm) else float(row.grad_norm)
            level = usual.level_for(value)
            if usual.taken > taken:
                self.recent.updateValue((after,), (value,))
                after += 1
                if after - first > self.window:
                    self.recent.removeKey((first,))
                    first += 1
            if level is None:
                continue
            high = high + 1 if value > self.alert[0] * level else 0
            extreme = extreme + 1 if value > self.halt[0] * level else 0
            if extreme >= self.halt[1] and not halted:
                halted = True
                said.append((key[0], last, "halt"))
            elif high == self.alert[1]:
                said.append((key[0], last, "alert"))
        self.mark.update((usual.level, last, high, extreme, halted, after))
        yield pd.DataFrame(said, columns=["run", "step", "event"])


#: The state store that typed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watched(rows: DataFrame, alert: tuple[float, int] = ALERT, halt: tuple[float, int] = HALT, window: int = WINDOW, least: int = LEAST, seeded: DataFrame | None = None) -> DataFrame:
    """run, step, event: the alerts and halts of `telemetry.watched` over each run's gradient norms.

    What is usual and the streaks so far are kept between batches. Rows of a batch are put in
    order of steps; a step older than the last one seen is passed over. A stream that starts anew, without
    the state of the one before it, can be given the `seeds` of the log: steps in the log are then passed over.
    """
    rows.sparkSession.conf.set(*STORE)
    slim = rows.where("run IS NOT NULL AND step IS NOT NULL").select("run", "step", "grad_norm")
    start = seeded.withColumnRenamed("values", "values_").groupBy("run") if seeded is not None else None
    return slim.groupBy("run").transformWithStateInPandas(Watch(alert, halt, window, least), "run string, step long, event string", "append", "none", initialState=start)


def rates(rows: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean loss and speed of each run in windows of event time; rows later than `late` are left out."""
    rows = rows.withWatermark("ts", late)
    return rows.groupBy("run", F.window("ts", window)).agg(F.avg("loss").alias("loss"), F.avg("tok_per_s").alias("tok_per_s"), F.count("*").alias("n"))


class ProgressLog(StreamingQueryListener):
    """A log of a stream's progress, as JSON lines: how many tokens have been done, and how many a second since the line before.

    The stream observes `tokens` (see `counted`). A line is written at most every `every` seconds, and when a query ends;
    the first says what is to be done. Steps of a query are tokens of all its batches. Only the driver writes.
    """

    def __init__(self, path: str, total: int, every: float = 5.0, clock: Any = time.time) -> None:
        self.path, self.every, self.clock, self.lock = path, every, clock, threading.Lock()
        self.done = self.said = 0
        self.batches: set[tuple[str, int]] = set()
        self.at = clock()
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps({"step": 0, "event": "meta", "total_steps": int(total), "tokens_per_step": 1}) + "\n")

    def add(self, tokens: int, force: bool = False) -> None:
        with self.lock:
            self.done += tokens
            now = self.clock()
            if (not force and now - self.at < self.every) or (force and self.done == self.said):
                return
            rate = (self.done - self.said) / max(now - self.at, 1e-6)
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps({"step": self.done, "tok_per_s": rate}) + "\n")
            self.at, self.said = now, self.done

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        observed = p.observedMetrics.get("progress")
        if observed is not None and (batch := (str(p.id), p.batchId)) not in self.batches:
            self.batches.add(batch)
            self.add(observed["tokens"] or 0)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.add(0, force=True)


def counted(rows: DataFrame, tokens: Any) -> DataFrame:
    """rows, whose tokens a ProgressLog counts as they go by."""
    return rows.observe("progress", F.sum(tokens).alias("tokens"))
