"""Column expressions and channel metadata."""

from .interpolation import interpolated, stepped
from .metadata import ChannelMetadata, with_metadata
from .timeline import lap_type, timecodes_from_micros, timecodes_from_seconds

__all__ = ["ChannelMetadata", "interpolated", "lap_type", "stepped", "timecodes_from_micros", "timecodes_from_seconds", "with_metadata"]
