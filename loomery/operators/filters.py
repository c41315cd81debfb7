"""Row filters of source specs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_filter(minimum: Mapping[str, float] | None = None, exclude: Mapping[str, Sequence] | None = None) -> Column:
    """Keeps rows whose columns reach the minima (a null doesn't) and hold no excluded value (a null stays)."""
    keep = F.lit(True)
    for column, least in (minimum or {}).items():
        keep &= F.coalesce(F.col(column) >= F.lit(least), F.lit(False))
    for column, values in (exclude or {}).items():
        keep &= F.coalesce(~F.col(column).isin(*values), F.lit(True))
    return keep


def has_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def source_label(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def margin_ok(chosen: str, rejected: str, least: float) -> Column:
    """Whether two rewards differ by at least `least`; also if either is missing or no number."""
    gap = F.col(chosen).try_cast("double") - F.col(rejected).try_cast("double")
    return F.coalesce(gap >= least, F.lit(True))


def in_hours(spec: str | None, hour: Column) -> Column:
    """Whether an hour lies in a window such as 22-6, which may pass midnight; a window of no length is always."""
    if not spec:
        return F.lit(True)
    first, end = map(int, spec.split("-"))
    return F.pmod(hour - first, F.lit(24)) < ((end - first) % 24 or 24)


def never_seen(configured: DataFrame, produced: DataFrame, key: str = "source") -> DataFrame:
    """Configured sources that produced nothing."""
    return configured.join(produced.select(key).distinct(), key, "left_anti")
