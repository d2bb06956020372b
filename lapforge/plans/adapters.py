"""The event table as telemetry: a user is a log, an event a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import ChannelMetadata, with_metadata
from ..functions.timeline import timecodes_from_micros

KEYS = ["user_id"]
#: Channels of the adapter with unit, description and interpolation.
CHANNELS = {
    "K": ChannelMetadata("", "property k", False),
    "Lap": ChannelMetadata("", "day of the week of four", False),
    "LapDistPct": ChannelMetadata("%", "share of a lap", True),
    "OnPitRoad": ChannelMetadata("", "event is an error", False),
    "Value": ChannelMetadata("", "value of the event", True),
}


def telemetry(events: DataFrame) -> DataFrame:
    """user_id, record_idx, timecodes and the channels of the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    value = {
        "K": k,
        "Lap": (F.day("ts") - 1) % 7,
        "LapDistPct": (k.cast("float") / F.lit(100).cast("float")).cast("float"),
        "OnPitRoad": F.col("event_type") == "error",
        "Value": F.col("value"),
    }
    return events.select("user_id", F.col("event_id").alias("record_idx"), timecodes_from_micros(F.col("ts")).alias("timecodes"), *(with_metadata(value[n], n, m) for n, m in CHANNELS.items()))


def long_channels(events: DataFrame) -> DataFrame:
    """user_id, channel (the event type), timecodes, record_idx, value."""
    return events.select("user_id", F.col("event_type").alias("channel"), timecodes_from_micros(F.col("ts")).alias("timecodes"), F.col("event_id").alias("record_idx"), F.col("value").cast("double").alias("value"))


def hourly(samples: DataFrame, keys: list[str], step_ms: int = 3_600_000) -> DataFrame:
    """Targets of a regular grid over each log's time."""
    ends = samples.groupBy(*keys).agg(F.min("timecodes").alias("a"), F.max("timecodes").alias("b"))
    first = F.ceil(F.col("a") / step_ms).cast("long")
    last = F.floor(F.col("b") / step_ms).cast("long")
    return ends.filter(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("g")).select(*keys, (F.col("g") * step_ms).alias("timecodes"))
