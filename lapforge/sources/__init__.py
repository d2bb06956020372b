"""Binary telemetry logs: layout, data source, session metadata, test encoder."""

from .datasource import TelemetrySource, read, read_stored
from .layout import LayoutError

__all__ = ["LayoutError", "TelemetrySource", "read", "read_stored"]
