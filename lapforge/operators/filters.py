"""Selection of channels, half-open time ranges, laps and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME = "timecodes"


def select_channels(df: DataFrame, names: list[str], fixed: list[str]) -> DataFrame:
    """The ``fixed`` columns and the named channels, in the order asked, each once."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"Channels not found: {missing}")
    return df.select(*fixed, *(n for n in dict.fromkeys(names) if n not in fixed))


def time_range(df: DataFrame, start: int, end: int, time: str = TIME) -> DataFrame:
    """Rows with start <= time < end; the predicate reaches the scan."""
    return df.filter((F.col(time) >= start) & (F.col(time) < end))


def overlapping(laps: DataFrame, start: int, end: int) -> DataFrame:
    """Laps that share time with [start, end), not clipped; laps that only touch it go."""
    return laps.filter((F.col("start_time") < end) & (F.col("end_time") > start))


def lap_bounds(laps: DataFrame, num: int, keys: list[str]) -> DataFrame:
    """keys, from_time, to_time of each log's first lap with a number."""
    at = "lap_idx" if "lap_idx" in laps.columns else "start_time"
    found = laps.filter(F.col("num") == num).groupBy(*keys).agg(F.min_by(F.struct("start_time", "end_time"), at).alias("b"))
    return found.select(*keys, F.col("b.start_time").alias("from_time"), F.col("b.end_time").alias("to_time"))


def within(df: DataFrame, bounds: DataFrame, keys: list[str], time: str = TIME) -> DataFrame:
    """Rows in the half-open bounds of their key, with the bounds' other columns.

    An equi-join on the keys with the range as its rest: bounds are a few rows for
    each key, and whether they are broadcast is left to their measured size.
    """
    own = [c for c in bounds.columns if c not in ("from_time", "to_time")]
    joined = df.join(bounds, keys).filter((F.col(time) >= F.col("from_time")) & (F.col(time) < F.col("to_time")))
    return joined.select(*df.columns, *(c for c in own if c not in df.columns))


def by_lap(df: DataFrame, laps: DataFrame, num: int, keys: list[str]) -> DataFrame:
    """Samples of each log's first lap with a number."""
    return within(df, lap_bounds(laps, num, keys), keys)


def session_bounds(laps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, session, from_time, to_time over a session's laps that aren't incomplete."""
    good = laps.filter(F.col("lap_type") != "incomplete")
    return good.groupBy(*keys, "session").agg(F.min_by("start_time", "lap_idx").alias("from_time"), F.max_by("end_time", "lap_idx").alias("to_time"))


def by_session(df: DataFrame, laps: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with the ``session`` whose range holds them; other samples go."""
    return within(df, session_bounds(laps, keys), keys)
