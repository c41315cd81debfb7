"""Output that counts as finished only once its record is there.

A build writes its parts, then its index, and last a small record under another name, which
is moved into place. What a build that was broken off has left has no record, so the next
one writes it anew; an output with a record is left as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

RECORD = "_committed.json"


def _system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put(spark: SparkSession, path: str, value: Any) -> None:
    """JSON, there whole or not at all; what was there before is replaced."""
    system, place = _system(spark, path)
    _, part = _system(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.part")
    out = system.create(part, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    if not system.rename(part, place):  # some file systems don't replace
        system.delete(place, False)
        if not system.rename(part, place):
            raise OSError(f"{path} can't be written")


def get(spark: SparkSession, path: str) -> Any:
    """The JSON that was put there, or None."""
    system, place = _system(spark, path)
    if not system.exists(place):
        return None
    size = system.getFileStatus(place).getLen()
    raw = system.open(place)
    try:
        return json.loads(bytes(raw.readNBytes(size)).decode())
    finally:
        raw.close()


def remove(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def finished(spark: SparkSession, path: str) -> dict | None:
    """The record of a finished output, or None."""
    return get(spark, f"{path}/{RECORD}")


def committed(spark: SparkSession, path: str, build: Callable[[], dict]) -> dict:
    """The record of the output at path. Unless it is finished, leftovers go, build writes it anew, and what build returns becomes the record."""
    done = finished(spark, path)
    if done is None:
        remove(spark, path)
        done = build()
        put(spark, f"{path}/{RECORD}", done)
    return done
