"""A guard over a machine's temperatures: when a run is paused, and when it goes on."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3600.0


@dataclass
class Guard:
    """States armed, pausing, cooling and stopped, moved by one summary of all devices at a time.

    From armed, the first reason of these pauses the run: a device too hot, a hardware
    slowdown, a rise of the idle devices over their baseline, a hot processor. Once no device
    is loaded, or the pause has taken too long, it cools; when cool it goes on, unless it was
    paused too often within the hour, which stops it.
    """

    hottest: float = 90.0
    rise: float = 8.0
    processor: float = 95.0
    resume_rise: float = 2.0
    resume_hottest: float = 60.0
    samples: int = 3
    grace: float = 300.0
    trips_an_hour: int = 3
    state: str = "armed"
    base: float | None = None
    paused: float = 0.0
    firsts: list[float] = field(default_factory=list)
    trips: list[float] = field(default_factory=list)

    def reason(self, hot: float, slowed: bool, rise: float | None, processor: float | None) -> str | None:
        checks = (
            ("device", hot >= self.hottest),
            ("slowdown", slowed),
            ("room", rise is not None and rise >= self.rise),
            ("processor", processor is not None and processor >= self.processor),
        )
        return next((name for name, met in checks if met), None)

    def see(self, now: float, hot: float, idle: float | None, loaded: int, slowed: bool, processor: float | None) -> str | None:
        """What happens at this sample: a trip with its reason, cooling, resumed or stopped; else None."""
        if self.base is None and idle is not None:
            self.firsts.append(idle)
            if len(self.firsts) >= self.samples:
                self.base = sum(self.firsts) / len(self.firsts)
        rise = idle - self.base if self.base is not None and idle is not None else None
        if self.state == "pausing":
            if loaded == 0 or now - self.paused >= self.grace:
                self.state = "cooling"
                return "cooling"
        elif self.state == "cooling":
            if loaded == 0 and (rise is None or rise <= self.resume_rise) and hot <= self.resume_hottest:
                often = sum(now - t < HOUR for t in self.trips) >= self.trips_an_hour
                self.state = "stopped" if often else "armed"
                return "stopped" if often else "resumed"
        elif self.state == "armed":
            why = self.reason(hot, slowed, rise, processor)
            if why:
                self.trips.append(now)
                self.state, self.paused = "pausing", now
                return f"trip: {why}"
        return None


def guarded(samples: DataFrame, box: str = "box", **how) -> DataFrame:
    """From (box, ts seconds, device, temp, util, idle, slowed, processor): box, ts, event.

    Devices are first joined to one row for each time; what is sequential then runs over
    these rows, box by box.
    """
    loaded = F.col("util") >= 50
    times = samples.groupBy(box, "ts").agg(
        F.max("temp").alias("hot"), F.avg(F.when(F.col("idle"), F.col("temp"))).alias("mean"), F.count_if(loaded).alias("loaded"),
        F.coalesce(F.bool_or("slowed"), F.lit(False)).alias("slowed"), F.max("processor").alias("processor"),
    )

    def watch(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ts", "ascending")])
        guard = Guard(**how)
        said = [guard.see(r["ts"], r["hot"], r["mean"], r["loaded"], r["slowed"], r["processor"]) for r in rows.to_pylist()]
        return rows.append_column("event", pa.array(said, pa.string())).filter(pa.array([s is not None for s in said])).select(["box", "ts", "event"])

    slim = times.select(F.col(box).cast("string").alias("box"), F.col("ts").cast("double").alias("ts"), F.col("hot").cast("double").alias("hot"), F.col("mean").cast("double").alias("mean"), "loaded", "slowed", F.col("processor").cast("double").alias("processor"))
    return slim.groupBy("box").applyInArrow(watch, "box string, ts double, event string")
