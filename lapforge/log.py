"""A telemetry log as lazy DataFrames: select, filter, split, resample, merge.

Every method returns a new log over the same data; nothing runs until an action. The
only eager steps are those that must answer from the data: a missing lap number, the
list of sessions.
"""

from __future__ import annotations

import copy
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.metadata import ChannelMetadata, channel_metadata, to_arrow, with_metadata
from .operators import align, filters
from .operators.laps import laps as laps_of
from .operators.resample import resample
from .sources import datasource, session
from .sources.layout import LayoutError, OnDisk, parse
from .sources.shared import shared_folder

FIXED = ["file_id", "record_idx", "timecodes"]
LAP_COLUMNS = ["num", "start_time", "end_time", "lap_type", "session"]


def open_log(spark: SparkSession, source: str | os.PathLike | bytes | BinaryIO, progress: Callable[[int, int], None] | None = None, ordered: bool = False) -> TelemetryLog:
    """The log at a path, in bytes, or in an open binary file (read from its start).

    A folder or a glob opens all its logs, which must share one layout, as one; their
    metadata then is by file. progress: called with (i, n) for each channel as it is
    planned, from 1 on. ordered: times never decrease from record to record, so a time
    range of the log as opened reads only its own records. A path that can't be read
    raises IOError, bytes that can't RuntimeError, any other source TypeError.
    """
    name, path = "<bytes>", None
    if isinstance(source, (str, os.PathLike)):
        name = path = os.fspath(source)
        if not isinstance(path, str):
            raise TypeError("path must be text")
    elif isinstance(source, (bytes, bytearray, memoryview)):
        path = _spool(spark, bytes(source))
    elif hasattr(source, "read"):
        source.seek(0)
        path = _spool(spark, source.read())
    else:
        raise TypeError(f"Expected a path, bytes or a binary file, got {type(source).__name__}")
    try:
        layouts = {p: parse(OnDisk(p)) for p in datasource.files(path)}
        layout = next(iter(layouts.values()))
        datasource.time_variable(layout)
        datasource.signals(layout)
    except (OSError, LayoutError) as e:
        if name == "<bytes>":
            raise RuntimeError(str(e)) from e
        raise OSError(f"{name}: {e}") from e
    channels = layout.channels()
    for i, _ in enumerate(channels, 1):
        if progress is not None:
            progress(i, len(channels))
    about = {p: session.metadata(x) for p, x in layouts.items()}
    samples = datasource.read(spark, path, ordered=ordered)
    laps = laps_of(datasource.read_signals(spark, path), ["file_id"])
    return TelemetryLog(samples, laps, about if len(about) > 1 else about[next(iter(about))], name, list(layouts), path, ordered)


def _spool(spark: SparkSession, data: bytes) -> str:
    """Bytes as a file in a folder that executors share, as Spark reads files only."""
    path = f"{shared_folder(spark)}/lapforge-{uuid.uuid4().hex}.log"
    with open(path, "wb") as f:
        f.write(data)
    return path


@dataclass(frozen=True, eq=False)
class TelemetryLog:
    """Samples (one row a record), laps, metadata and the name of a log.

    ``files`` are the ids of its files; ``origin`` is its path as long as the samples are
    the file's own, so that a time range can be read instead of filtered.
    """

    samples: DataFrame
    laps: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)
    file_name: str = ""
    files: list[str] = field(default_factory=list)
    origin: str | None = None
    ordered: bool = False

    @property
    def channel_names(self) -> list[str]:
        return [c for c in self.samples.columns if c not in FIXED]

    @property
    def channels(self) -> dict[str, DataFrame]:
        """Each channel as a table of its time and value."""
        return {c: self.samples.select("timecodes", c) for c in self.channel_names}

    @property
    def catalogue(self) -> dict[str, ChannelMetadata]:
        return {c: channel_metadata(self.samples, c) for c in self.channel_names}

    def __repr__(self) -> str:
        return f"TelemetryLog(file_name={self.file_name!r}, channels={len(self.channel_names)})"

    def _with(self, samples: DataFrame, laps: DataFrame | None = None, metadata: dict | None = None) -> TelemetryLog:
        return replace(self, samples=samples, laps=self.laps if laps is None else laps, metadata=self.metadata if metadata is None else metadata, origin=None)

    def select_channels(self, names: list[str]) -> TelemetryLog:
        """Some channels, in this order; a name that is missing raises KeyError."""
        return replace(self._with(filters.select_channels(self.samples, list(names), FIXED)), origin=self.origin)

    def _some(self, names: list[str] | None) -> TelemetryLog:
        return self if names is None else self.select_channels(names)

    def filter_by_time_range(self, start_time: int, end_time: int, channel_names: list[str] | None = None) -> TelemetryLog:
        """Samples of [start_time, end_time), and the laps that share time with it."""
        own = self._some(channel_names)
        return own._with(own._between(start_time, end_time), filters.overlapping(self.laps, start_time, end_time))

    def _between(self, start: int, end: int) -> DataFrame:
        """Samples of [start, end); of a log as opened in the order of time, only these are read."""
        if self.origin is None or not self.ordered:
            return filters.time_range(self.samples, start, end)
        return datasource.read(self.samples.sparkSession, self.origin, self.channel_names, start=start, end=end, ordered=True)

    def filter_by_lap(self, lap_num: int, channel_names: list[str] | None = None) -> TelemetryLog:
        """The first lap of a number, in each file; a number that is missing raises ValueError."""
        if len(self.files) > 1:
            own, bounds = self._some(channel_names), filters.lap_bounds(self.laps, lap_num, ["file_id"])
            near = self.laps.join(bounds, "file_id").filter("start_time < to_time and end_time > from_time")
            return own._with(filters.within(own.samples, bounds, ["file_id"]), near.select(*self.laps.columns))
        found = filters.lap_bounds(self.laps, lap_num, []).filter("from_time is not null").collect()
        if not found:
            there = [r["num"] for r in self.laps.select("num", "start_time").orderBy("start_time").collect()]
            raise ValueError(f"Lap {lap_num} not found. Available laps: {there}")
        return self.filter_by_time_range(found[0]["from_time"], found[0]["to_time"], channel_names)

    def split_sessions(self) -> list[TelemetryLog]:
        """One log for each session with a lap that isn't incomplete, in their order.

        Of a log of several files, a session's samples are those of its number in each.
        """
        many = len(self.files) > 1
        bounds = filters.session_bounds(self.laps, ["file_id"] if many else [])
        out = []
        if many:
            for (number,) in bounds.select("session").distinct().orderBy("session").collect():
                kept = self.laps.filter((F.col("session") == number) & (F.col("lap_type") != "incomplete"))
                out.append(self._with(filters.within(self.samples, bounds.filter(F.col("session") == number).drop("session"), ["file_id"]), kept, copy.copy(self.metadata)))
            return out
        for b in bounds.orderBy("session").collect():
            kept = self.laps.filter((F.col("session") == b["session"]) & (F.col("lap_type") != "incomplete"))
            out.append(self._with(self._between(b["from_time"], b["to_time"]), kept, copy.copy(self.metadata)))
        return out

    def resample_to_timecodes(self, timecodes: list[int] | pa.Array | DataFrame, channel_names: list[str] | None = None, bucket_ms: int | None = None) -> TelemetryLog:
        """Channels at the given times, in their order and with repeats.

        record_idx numbers the targets. An empty log gives an empty one. bucket_ms cuts a
        long log's timeline into buckets that are sorted apart; results are the same.
        """
        own = self._some(channel_names)
        spark = self.samples.sparkSession
        if isinstance(timecodes, DataFrame):
            targets = timecodes.select(F.col("timecodes").cast("long"), F.monotonically_increasing_id().alias("target_pos"))
        else:
            times = timecodes.to_pylist() if isinstance(timecodes, (pa.Array, pa.ChunkedArray)) else list(timecodes)
            targets = spark.createDataFrame(list(zip(times, range(len(times)))), "timecodes long, target_pos long")
        # every file of the log, known without a scan, gets the targets
        files = self.files or [r["file_id"] for r in own.samples.select("file_id").distinct().orderBy("file_id").collect()]
        targets = targets.withColumn("file_id", F.explode(F.array(*map(F.lit, files)).cast("array<string>")))
        at = resample(own.samples, targets, ["file_id"], bucket_ms=bucket_ms)
        return own._with(at.select("file_id", F.col("target_pos").alias("record_idx"), "timecodes", *own.channel_names))

    def resample_to_channel(self, reference_channel: str, channel_names: list[str] | None = None, bucket_ms: int | None = None) -> TelemetryLog:
        """Channels at the times of another one, which need not be among them."""
        if reference_channel not in self.channel_names:
            raise KeyError(f"Reference channel not found: {reference_channel}")
        return self.resample_to_timecodes(self.samples.select("timecodes", "record_idx").orderBy("record_idx").select("timecodes"), channel_names, bucket_ms)

    def get_channels_as_table(self) -> DataFrame:
        """All channels by name over the sorted distinct times; of one time the last sample."""
        if not self.channel_names:
            return self.samples.limit(0).select("timecodes")
        merged = align.merge_shared(self.samples.drop("file_id"), [])
        meta = self.catalogue
        names = sorted(meta)
        kept = [with_metadata(_as_resampled(self.samples, c, meta[c]), c, meta[c]) for c in names]
        return merged.select("timecodes", *kept).orderBy("timecodes")

    def to_arrow(self) -> pa.Table:
        """``get_channels_as_table`` as Arrow, metadata in the fields."""
        return to_arrow(self.get_channels_as_table())

    def laps_table(self) -> DataFrame:
        """The laps' public columns in their order."""
        return self.laps.orderBy("start_time").select(*(c for c in LAP_COLUMNS if c in self.laps.columns))


def _as_resampled(samples: DataFrame, name: str, meta: ChannelMetadata):
    kind = samples.schema[name].dataType.typeName()
    column = F.col(f"`{name}`")
    return column.cast("double") if meta.interpolate and kind in ("short", "integer", "long", "byte") else column
