"""Resampling: values of channels at given times, linear or step.

Samples and targets are put on one timeline; the knots around a target are the last
sample at or before it and the next one after it, found in one sort by running ``last``
and ``lead`` that ignore nulls (a frame that looks forward would be quadratic). Whole
rows are carried as one struct, so the number of windows does not grow with channels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.interpolation import interpolated, stepped
from ..functions.metadata import ChannelMetadata, with_metadata

TIME = "timecodes"
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _value(field: T.StructField, linear: bool, left: Column, right: Column, t: Column) -> Column:
    """A channel's value; integers that are interpolated become double, others keep their type."""
    if not linear:
        return stepped(left, right, field.name)
    kind = T.DoubleType() if isinstance(field.dataType, _INTEGERS) else field.dataType
    return interpolated(left, right, t, field.name).cast(kind)


def resample(samples: DataFrame, targets: DataFrame, keys: list[str], order: str = "record_idx", linear: dict[str, bool] | None = None, bucket_ms: int | None = None) -> DataFrame:
    """keys, timecodes, the targets' other columns, and every channel of ``samples``.

    One row for each target, repeats included. ``linear`` overrides the channels' own
    metadata. Before the first and after the last sample the nearest one holds; of
    samples at one time the last one (by ``order``) counts at it and after it, the first
    one before it. Targets of a key without samples go.

    bucket_ms: cut each key's timeline into buckets of this length, so that a long log
    is not sorted in one task. Every bucket gets the last sample before it and the
    first one after it, which makes the result the same.
    """
    channels = [f for f in samples.schema if f.name not in (*keys, order, TIME)]
    extra = [c for c in targets.columns if c not in (*keys, TIME)]
    knots = samples.select(*keys, F.col(TIME).alias("t"), F.lit(0).alias("kind"), F.col(order).cast("long").alias("ord"), F.struct(F.col(TIME).alias("t"), *(F.col(f"`{f.name}`") for f in channels)).alias("knot"))
    shape = knots.schema["knot"].dataType
    passed = targets.select(*keys, F.col(TIME).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast(shape).alias("knot"), F.struct(F.lit(1).alias("__target"), *(F.col(f"`{c}`") for c in extra)).alias("extra"))
    none = F.lit(None).cast(passed.schema["extra"].dataType)
    line, by = knots.withColumn("extra", none).unionByName(passed), list(keys)
    if bucket_ms:
        bucket = F.floor(F.col("t") / F.lit(bucket_ms)).alias("bucket")
        line, by = line.select("*", bucket), [*keys, "bucket"]
        line = line.unionByName(_carried(line, keys, none))
    names = ", ".join(f"`{k}`" for k in by)
    window = f"(partition by {names} order by t, kind, ord)" if by else "(order by t, kind, ord)"
    w = (W.partitionBy(*by) if by else W).orderBy("t", "kind", "ord")
    placed = line.select("*", F.last("knot", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("left"), F.expr(f"lead(knot, 1) ignore nulls over {window}").alias("right"))
    left, right, t = F.col("left"), F.col("right"), F.col("t")
    out = []
    for f in channels:
        meta = ChannelMetadata.of(f)
        is_linear = meta.interpolate if linear is None else linear.get(f.name, meta.interpolate)
        out.append(with_metadata(_value(f, is_linear, left, right, t), f.name, meta))
    there = placed.filter((F.col("kind") == 1) & (left.isNotNull() | right.isNotNull()))
    return there.select(*keys, t.alias(TIME), *(F.col(f"extra.{c}").alias(c) for c in extra), *out)


def _carried(line: DataFrame, keys: list[str], none: Column) -> DataFrame:
    """For each bucket the last knot of an earlier one and the first knot of a later one."""
    known = F.col("knot").isNotNull()
    at = F.when(known, F.struct("t", "ord"))
    ends = line.groupBy(*keys, "bucket").agg(F.max_by(F.struct("t", "ord", "knot"), at).alias("hi"), F.min_by(F.struct("t", "ord", "knot"), at).alias("lo"), F.count_if(known).alias("n"))
    ends = ends.select(*keys, "bucket", F.when(F.col("n") > 0, F.col("hi")).alias("hi"), F.when(F.col("n") > 0, F.col("lo")).alias("lo"))
    names = ", ".join(f"`{k}`" for k in keys)
    window = f"({'partition by ' + names if keys else ''} order by bucket)"
    w = (W.partitionBy(*keys) if keys else W).orderBy("bucket")  # one row for each bucket
    before = F.last("hi", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.expr(f"lead(lo, 1) ignore nulls over {window}")
    near = ends.select(*keys, "bucket", before.alias("__before"), after.alias("__after")).select(*keys, "bucket", F.explode(F.array("__before", "__after")).alias("__end"))
    return near.filter("__end is not null").select(*keys, F.col("__end.t").alias("t"), F.lit(0).alias("kind"), F.col("__end.ord").alias("ord"), F.col("__end.knot").alias("knot"), none.alias("extra"), "bucket")


def to_channel(samples: DataFrame, reference: DataFrame, keys: list[str], order: str = "record_idx", linear: dict[str, bool] | None = None) -> DataFrame:
    """``samples`` at the times of a reference channel's samples."""
    return resample(samples, reference.select(*keys, TIME), keys, order, linear)
