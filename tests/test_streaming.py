"""The live log: what a stream says over several batches is what the batch operator says."""

import json
import os
import time

from loomery.operators import telemetry
from loomery.streaming import live


def test_watch_over_batches(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    values = [1.0 + 0.01 * (i % 7) for i in range(80)] + [50.0] * 8 + [1.0] * 5 + [50.0] * 8
    rows = [{"run": r, "step": i, "grad_norm": v, "loss": 2.0} for r in ("a", "b") for i, v in enumerate(values)]
    rows.sort(key=lambda x: x["step"])
    for k in range(5):
        path = folder / f"{k}.json"
        path.write_text("\n".join(map(json.dumps, rows[k * 41 : (k + 1) * 41])) + "\nbroken {\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by their times
    how = {"alert": (10.0, 5), "halt": (100.0, 9), "least": 50}
    stream = live.watched(live.train_rows(live.metrics(spark, str(folder), files_at_once=1)), **how)
    query = stream.writeStream.format("memory").queryName("said").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("said").collect()))
    batch = telemetry.watched(spark.createDataFrame(rows), "run", "step", "grad_norm", **how)
    assert got == sorted(map(tuple, batch.collect())) and [x for x in got if x[0] == "a"] == [("a", 84, "alert"), ("a", 97, "alert")]


def test_a_watch_that_starts_anew(spark, tmp_path):
    """Seeded from the log, a second stream says of later steps what an unbroken one says."""
    values = [1.0 + 0.01 * (i % 7) for i in range(120)] + [50.0] * 8 + [1.0] * 5 + [50.0] * 12
    rows = [{"run": r, "step": i, "grad_norm": v, "loss": 2.0} for r in ("a", "b") for i, v in enumerate(values)]
    rows += [{"run": "a", "step": 130, "event": "eval", "val_loss": 1.0}, {"run": "c", "step": 1, "grad_norm": 1.0, "loss": 2.0}]
    how = {"alert": (10.0, 5), "halt": (20.0, 9), "least": 50, "window": 100}

    def said(name, rows, **more):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.json").write_text("\n".join(map(json.dumps, rows)))
        stream = live.watched(live.train_rows(live.metrics(spark, str(tmp_path / name))), **how, **more)
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
        return sorted(map(tuple, spark.table(name).collect()))

    whole = said("whole", rows)
    assert [x[1:] for x in whole if x[0] == "a"] == [(124, "alert"), (137, "alert"), (141, "halt")]
    earlier = [r for r in rows if r["step"] < 120]
    schema = live.METRICS
    seeded = live.seeds(spark.createDataFrame([{"event": None, **r} for r in earlier], schema))
    assert sorted((r.run, len(r["values"]), r.level, r.last) for r in seeded.collect()) == [("a", 120, 1.03, 119), ("b", 120, 1.03, 119), ("c", 1, None, 1)]
    assert said("second", [r for r in rows if r["step"] >= 100], seeded=seeded) == whole


def test_progress_rows(spark, tmp_path):
    """Steps and rates of a stream's tokens, at most every five seconds."""
    from pyspark.sql import functions as F

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.json").write_text(json.dumps({"run": "a", "step": k, "loss": 1.0}))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    now = [100.0]
    log = live.ProgressLog(str(tmp_path / "progress.jsonl"), 40, clock=lambda: now[0])
    spark.streams.addListener(log)
    try:
        stream = live.counted(live.metrics(spark, str(folder), files_at_once=1), F.lit(10))

        def wait(batch, k):
            batch.collect()
            now[0] += 3.0

        query = stream.writeStream.foreachBatch(wait).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        for _ in range(100):
            lines = [json.loads(x) for x in (tmp_path / "progress.jsonl").read_text().splitlines()]
            if lines[-1].get("step") == 40:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert lines[0] == {"step": 0, "event": "meta", "total_steps": 40, "tokens_per_step": 1}
    steps = [x["step"] for x in lines[1:]]
    assert steps == sorted(set(steps)) and steps[-1] == 40 and len(steps) < 4
    assert all(x["tok_per_s"] > 0 for x in lines[1:])


def test_progress_is_throttled(tmp_path):
    now = [0.0]
    log = live.ProgressLog(str(tmp_path / "p.jsonl"), 100, clock=lambda: now[0])
    for at, tokens in ((1, 10), (4, 10), (5, 10), (9, 10), (11, 20)):
        now[0] = at
        log.add(tokens)
    now[0] = 12
    log.add(5, force=True)
    log.add(0, force=True)
    assert [json.loads(x) for x in (tmp_path / "p.jsonl").read_text().splitlines()[1:]] == [{"step": 30, "tok_per_s": 6.0}, {"step": 60, "tok_per_s": 5.0}, {"step": 65, "tok_per_s": 5.0}]
