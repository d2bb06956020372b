"""Operators: DataFrames in, DataFrames out."""

from .align import merge_long, merge_shared, merge_tables, union_timeline
from .filters import by_lap, by_session, overlapping, select_channels, time_range
from .laps import laps
from .resample import resample, to_channel

__all__ = ["by_lap", "by_session", "laps", "merge_long", "merge_shared", "merge_tables", "overlapping", "resample", "select_channels", "time_range", "to_channel", "union_timeline"]
