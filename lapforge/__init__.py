"""lapforge: a Spark-native engine for telemetry logs and large tables."""

from .functions.metadata import ChannelMetadata
from .log import TelemetryLog, open_log

__version__ = "0.1.0"
__all__ = ["ChannelMetadata", "TelemetryLog", "open_log"]
