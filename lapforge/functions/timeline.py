"""Time codes and lap classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST = 9.2e18


def timecodes_from_seconds(seconds: Column) -> Column:
    """Milliseconds as long, halves rounded away from zero.

    NaN counts as 0; what a long can't hold becomes its least or largest value.
    """
    ms = seconds.cast("double") * 1000
    edge = F.when(F.isnan(ms), F.lit(0).cast("long")).when(ms >= _MOST, F.lit((1 << 63) - 1)).when(ms <= -_MOST, F.lit(-(1 << 63)))
    return edge.otherwise(F.round(F.when(F.isnan(ms) | (F.abs(ms) >= _MOST), F.lit(0.0)).otherwise(ms)).cast("long"))


def timecodes_from_micros(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp, halves rounded up."""
    micros = F.unix_micros(ts.cast("timestamp")) + 500
    return F.floor((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("long")


#: Shares of a lap's distance between which a lap that starts or ends is partial.
PARTIAL_FROM, PARTIAL_TO = 0.02, 0.98


def lap_type(samples: Column, pit_first: Column, pit_last: Column, dist_first: Column, dist_last: Column) -> Column:
    """Class of a lap, the first that applies: incomplete, out, in, partial, full.

    Distances compare as 32-bit floats, both borders excluded; NaN is not between them.
    """
    low, high = F.lit(PARTIAL_FROM).cast("float"), F.lit(PARTIAL_TO).cast("float")
    between = lambda d: (d > low) & (d < high)
    return (
        F.when(samples < 2, F.lit("incomplete"))
        .when(pit_first, F.lit("out"))
        .when(pit_last, F.lit("in"))
        .when(between(dist_first) | between(dist_last), F.lit("partial"))
        .otherwise(F.lit("full"))
    )
