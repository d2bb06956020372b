"""Alignment of channels on one timeline, and the merge into one wide table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metadata import ChannelMetadata, with_metadata
from .resample import resample

TIME = "timecodes"
#: Length of the buckets that a timeline without keys is cut into.
BUCKET_MS = 600_000


def union_timeline(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct times of all tables, by key."""
    return reduce(DataFrame.unionByName, (t.select(*keys, TIME) for t in tables)).distinct()


def merge_shared(df: DataFrame, keys: list[str], order: str = "record_idx") -> DataFrame:
    """Channels that share a time base: one row for each time, its last sample.

    Columns are the keys, the time and the channels by name. No join and no resampling:
    at its own times a channel has its own values.
    """
    last = F.row_number().over(W.partitionBy(*keys, TIME).orderBy(F.desc(order)))
    channels = sorted(c for c in df.columns if c not in (*keys, TIME, order))
    rows = df.withColumn("__last", last).filter("__last = 1")
    return rows.select(*keys, TIME, *(F.col(f"`{c}`") for c in channels))


def merge_long(samples: DataFrame, linear: dict[str, bool], keys: list[str], order: str = "record_idx") -> DataFrame:
    """Channels in long form (keys, channel, time, order, value) as one wide table.

    ``linear`` names the channels, and says which are interpolated.

    All channels are resampled to the union of all times of their key in one pass, with
    the channel as part of the key, then pivoted to columns by name.
    """
    names = sorted(linear)
    if not names:
        return samples.select(*keys, TIME).limit(0)
    samples = samples.filter(F.col("channel").isin(names))
    times = union_timeline([samples], keys)
    targets = times.withColumn("channel", F.explode(F.array(*map(F.lit, names))))
    by = [*keys, "channel"]
    # both readings of a value in one pass; the channel says which one holds
    both = samples.select(*by, TIME, order, F.col("value").alias("line"), F.col("value").alias("step"))
    found = resample(both, targets, by, order, {"line": True, "step": False})
    is_linear = F.col("channel").isin([n for n in names if linear[n]])
    value = F.when(is_linear, F.col("line")).otherwise(F.col("step"))
    return found.groupBy(*keys, TIME).pivot("channel", names).agg(F.first(value))


def merge_tables(tables: dict[str, DataFrame], order: str | None = None) -> DataFrame:
    """Channel tables (time and value) with time bases of their own as one wide table.

    The time comes first, then the channels by name with their types (integers that
    are interpolated become double) and metadata. A channel without samples is null
    throughout. No tables are a programming error of the caller.
    """
    if not tables:
        raise ValueError("no channel to merge")
    times = union_timeline(list(tables.values()), [])
    wide = times
    for name in sorted(tables):
        table = tables[name]
        own = table.select(TIME, name, (F.col(order) if order else F.monotonically_increasing_id()).alias("record_idx"))
        wide = wide.join(resample(own, times, [], bucket_ms=BUCKET_MS), TIME, "left")
    meta = {n: ChannelMetadata.of(tables[n].schema[n]) for n in tables}
    return wide.select(TIME, *(with_metadata(F.col(f"`{n}`"), n, meta[n]) for n in sorted(tables)))
