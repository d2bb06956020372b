"""Values between knots: linear and step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolated(left: Column, right: Column, t: Column, name: str) -> Column:
    """Linear value at ``t`` from the knots before and after it, as double.

    Knots are structs with ``t`` and the channel. Outside the knots the nearest one
    holds; at a knot its own value, the last one's of several. Slopes are formed as
    (y1 - y0) / (x1 - x0) * (x - x0) + y0. Where that is NaN the right knot is tried,
    and equal ends give themselves.
    """
    x0, x1 = left["t"].cast("double"), right["t"].cast("double")
    y0, y1, x = left[name].cast("double"), right[name].cast("double"), t.cast("double")
    slope = (y1 - y0) / F.when(x1 != x0, x1 - x0)
    from_left, from_right = slope * (x - x0) + y0, slope * (x - x1) + y1
    return (
        F.when(left.isNull(), y1)
        .when(right.isNull() | (left["t"] == t), y0)
        .when(~F.isnan(from_left), from_left)
        .when(~F.isnan(from_right), from_right)
        .when(y0 == y1, y0)
        .otherwise(from_left)
    )


def stepped(left: Column, right: Column, name: str) -> Column:
    """The last value at or before the target; before the first knot, the first value."""
    return F.when(left.isNull(), right[name]).otherwise(left[name])
