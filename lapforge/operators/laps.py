"""Laps from samples: gaps and islands, classes, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeline import lap_type

LAP, PIT, DIST, TIME = "Lap", "OnPitRoad", "LapDistPct", "timecodes"
SCHEMA = "lap_idx long, num int, start_time long, end_time long, lap_type string, session int, sample_count long"


def _number(df: DataFrame, name: str) -> Column:
    """A 32-bit float of a float or double column; any other type, or none, is 0."""
    kinds = dict(df.dtypes)
    return F.col(name).cast("float") if kinds.get(name) in ("float", "double") else F.lit(0.0).cast("float")


def _lap(df: DataFrame) -> Column:
    """The lap channel as a 32-bit integer; wider integers keep their lowest 32 bits."""
    if dict(df.dtypes)[LAP] != "bigint":
        return F.col(LAP).cast("int")
    half = F.lit(1 << 31)
    return (F.pmod(F.pmod(F.col(LAP), F.lit(1 << 32)) + half, F.lit(1 << 32)) - half).cast("int")


def islands(samples: DataFrame, keys: list[str], order: str = "record_idx") -> DataFrame:
    """keys, lap_idx and the aggregates of each run of samples with one lap number.

    Only change detection needs a window over the samples; it reads the four columns
    that laps depend on, in one exchange by ``keys`` that the grouping shares.
    """
    pit = F.col(PIT).cast("boolean") if PIT in samples.columns else F.lit(False)
    narrow = samples.select(*keys, order, F.col(TIME), _lap(samples).alias("num"), F.coalesce(pit, F.lit(False)).alias("pit"), _number(samples, DIST).alias("dist"))
    by = W.partitionBy(*keys).orderBy(order)
    changed = (F.col("num") != F.lag("num").over(by)).cast("int")
    runs = narrow.withColumn("changed", F.coalesce(changed, F.lit(0)))
    runs = runs.withColumn("lap_idx", F.sum("changed").over(by.rowsBetween(W.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, order)
    last = lambda c: F.max_by(c, order)
    return runs.groupBy(*keys, "lap_idx").agg(
        F.min("num").alias("num"), first(TIME).alias("start_time"), last(TIME).alias("last_time"), F.count(F.lit(1)).alias("sample_count"),
        first("pit").alias("pit_first"), last("pit").alias("pit_last"), first("dist").alias("dist_first"), last("dist").alias("dist_last"),
    )


def laps(samples: DataFrame, keys: list[str], order: str = "record_idx") -> DataFrame:
    """keys and lap_idx, num, start_time, end_time, lap_type, session, sample_count.

    A lap ends where the next one starts, the last one at its own last sample. Every
    lap numbered 0 but the first lap of a log begins a session; other drops of the
    number don't. Without a lap channel there are no laps.
    """
    if LAP not in samples.columns:
        return samples.select(*keys).limit(0).select(*keys, *(F.lit(None).cast(t).alias(n) for n, t in (p.split() for p in SCHEMA.split(", "))))
    by = W.partitionBy(*keys).orderBy("lap_idx")
    resets = F.when((F.col("num") == 0) & (F.col("lap_idx") > 0), 1).otherwise(0)
    return islands(samples, keys, order).select(
        *keys, F.col("lap_idx").cast("long").alias("lap_idx"), F.col("num"), "start_time",
        F.coalesce(F.lead("start_time").over(by), F.col("last_time")).alias("end_time"),
        lap_type(F.col("sample_count"), F.col("pit_first"), F.col("pit_last"), F.col("dist_first"), F.col("dist_last")).alias("lap_type"),
        F.sum(resets).over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int").alias("session"), "sample_count",
    )
