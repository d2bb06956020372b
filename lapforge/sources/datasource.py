"""Spark data source ``telemetrylog``: one row for each record, one column a channel.

Headers are parsed once on the driver; a partition is a range of records, read by seek
and decoded as a strided NumPy view to Arrow. Columns: file_id, record_idx, timecodes,
then the scalar variables in file order. Options: ``path`` (a file, a folder or a glob
of files with one layout), ``channels`` (comma-separated; all by default),
``arrays`` (true adds array variables; false), ``records`` (in a partition),
``start`` and ``end`` (records of start <= timecodes < end only), ``ordered`` (true where
times never decrease from record to record: the range's ends are then found by a few
seeks, and only its records are read), ``signals`` (true gives, in place of channels, the
raw signals that laps depend on: Lap's four bytes as an integer and whether OnPitRoad's
first byte is set, whatever their declared types, and LapDistPct as a float),
``pushdown`` (true lets filters on record_idx narrow the ranges that are read; it needs
``spark.sql.python.filterPushdown.enabled``, and ``read`` follows that setting).

The source opens files itself, so executors must see the path. For logs in a store that
only Spark reads, ``read_stored`` decodes them from Spark's binaryFile rows.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.metadata import ChannelMetadata
from .layout import InMemory, Layout, LayoutError, OnDisk, Variable, parse

TIME_CHANNEL = "SessionTime"
#: Records decoded to one Arrow batch, and records of one partition.
BATCH, PARTITION = 16_384, 262_144
LEAST_TIME = -(1 << 63)
_SPARK = {"char": T.ShortType(), "bool": T.BooleanType(), "int": T.IntegerType(), "bitfield": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}
_ARROW = {"char": pa.int16(), "bool": pa.bool_(), "int": pa.int32(), "bitfield": pa.int64(), "float": pa.float32(), "double": pa.float64()}
_FIXED = [T.StructField("file_id", T.StringType(), False), T.StructField("record_idx", T.LongType(), False), T.StructField("timecodes", T.LongType(), False)]


def chosen(layout: Layout, names: list[str] | None, arrays: bool) -> list[Variable]:
    """The variables to read: all readable ones, or those asked for by name."""
    there = layout.channels(arrays)
    if names is None:
        return there
    by = {v.name: v for v in there}
    missing = sorted(set(names) - set(by))
    if missing:
        raise KeyError(f"Channels not found: {missing}")
    return [by[n] for n in dict.fromkeys(names)]


#: The signals of laps, and the type whose bytes each is read as; any float for the last.
SIGNALS = {"Lap": 2, "OnPitRoad": 1, "LapDistPct": None}


def signals(layout: Layout) -> list[Variable]:
    """The variables that laps depend on, with the types that they are read as.

    Of a distance that is neither float nor double there is none, as of one that is missing.
    """
    out = []
    for name, code in SIGNALS.items():
        v = layout.variable(name)
        if v is None or (code is None and v.kind not in ("float", "double")):
            continue
        v = replace(v, code=v.code if code is None else code, count=1)
        if v.offset + v.size > layout.record_length:
            raise LayoutError(f"{name} at offset {v.offset} needs {v.size} bytes of a record of {layout.record_length}")
        out.append(v)
    return out


def spark_type(v: Variable) -> T.DataType:
    if v.count == 1:
        return _SPARK[v.kind]
    return T.StringType() if v.kind == "char" else T.ArrayType(_SPARK[v.kind], False)


def schema_of(variables: list[Variable]) -> T.StructType:
    meta = [ChannelMetadata(v.unit, v.desc, v.interpolate).spark() | {"source_type": v.kind} for v in variables]
    return T.StructType([*_FIXED, *(T.StructField(v.name, spark_type(v), False, m) for v, m in zip(variables, meta))])


def time_variable(layout: Layout) -> Variable:
    v = layout.variable(TIME_CHANNEL)
    if v is None or v.kind != "double" or v.count != 1:
        raise LayoutError(f"{TIME_CHANNEL} must be a scalar of type double")
    return v


def timecodes(seconds: np.ndarray) -> np.ndarray:
    """Milliseconds as int64: halves away from zero, NaN 0, too large values the limits."""
    ms = np.asarray(seconds, dtype=np.float64) * 1000
    with np.errstate(invalid="ignore"):
        whole = np.trunc(ms)
        ms = np.where(np.abs(ms - whole) >= 0.5, whole + np.sign(ms), whole)
    limit = float(1 << 63)
    low, high = ms <= -limit, ms >= limit
    out = np.where(np.isnan(ms) | low | high, 0, ms).astype(np.int64)
    out[low], out[high] = -(1 << 63), (1 << 63) - 1
    return out


def decode(raw: bytes, layout: Layout, variables: list[Variable], file_id: str, first: int, start: int = LEAST_TIME, end: int | None = None) -> pa.RecordBatch:
    """Records that follow each other, from record number ``first`` on; those in a range of times."""
    time = time_variable(layout)
    rows = np.frombuffer(raw, dtype=layout.dtype([*variables, time]))
    times, at = timecodes(rows[f"v{len(variables)}"]), np.arange(first, first + len(rows))
    if start > LEAST_TIME or end is not None:
        within = (times >= start) & (times < end if end is not None else True)
        rows, times, at = rows[within], times[within], at[within]
    columns = [pa.array([file_id] * len(rows), type=pa.string()), pa.array(at), pa.array(times)]
    for i, v in enumerate(variables):
        values = np.ascontiguousarray(rows[f"v{i}"])
        if v.count != 1 and v.kind == "char":
            columns.append(pa.array([bytes(x).split(b"\0", 1)[0].decode("utf-8", "replace") for x in values], type=pa.string()))
            continue
        flat = values.reshape(-1) != 0 if v.kind == "bool" else values.reshape(-1)
        made = pa.array(flat).cast(_ARROW[v.kind])
        columns.append(made if v.count == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * v.count), made))
    return pa.RecordBatch.from_arrays(columns, names=["file_id", "record_idx", "timecodes", *(v.name for v in variables)])


def files(path: str) -> list[str]:
    """The files of a path: itself, those in a folder, or those that a glob matches."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(f"{path}/{n}" for n in os.listdir(path) if not n.startswith((".", "_")))
    found = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    if not found:
        raise FileNotFoundError(path)
    return found


def first_at(src: OnDisk, layout: Layout, time: int) -> int:
    """The first record of a time or a later one, by bisection over times that never decrease."""
    at = time_variable(layout).offset
    low, high = 0, layout.record_count
    while low < high:
        mid = (low + high) // 2
        seconds = np.frombuffer(src.part(layout.data_offset + mid * layout.record_length + at, 8), "<f8")
        low, high = (mid + 1, high) if timecodes(seconds)[0] < time else (low, mid)
    return low


@dataclass
class Records(InputPartition):
    path: str
    start: int
    end: int


class TelemetryReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names = [f.name for f in schema.fields[len(_FIXED) :]]
        self.arrays = options.get("arrays", "false").lower() == "true"
        self.step = max(1, int(options.get("records", PARTITION)))
        self.path = options["path"]
        self.low, self.high = 0, 1 << 62
        self.start = int(options.get("start", LEAST_TIME))
        self.end = int(options["end"]) if "end" in options else None
        self.ordered = options.get("ordered", "false").lower() == "true"
        self.signals = options.get("signals", "false").lower() == "true"

    def partitions(self) -> list[Records]:
        out = []
        for path in files(self.path):
            src = OnDisk(path)
            layout = parse(src)
            low, high = min(self.low, layout.record_count), min(self.high, layout.record_count)
            if self.ordered:
                low = max(low, first_at(src, layout, self.start))
                high = high if self.end is None else min(high, first_at(src, layout, self.end))
            out += [Records(path, a, min(a + self.step, high)) for a in range(low, high, self.step)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        src = OnDisk(partition.path)
        layout = parse(src)
        variables = signals(layout) if self.signals else chosen(layout, self.names, self.arrays)
        for a in range(partition.start, partition.end, BATCH):
            n = min(BATCH, partition.end - a)
            raw = src.part(layout.data_offset + a * layout.record_length, n * layout.record_length)
            yield decode(raw, layout, variables, partition.path, a, self.start, self.end)


class PushingReader(TelemetryReader):
    """Reads only the records that filters on record_idx leave; Spark filters again."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("record_idx",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, f.value + 1)
            yield f


class TelemetrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetrylog"

    def schema(self) -> T.StructType:
        names = self.options.get("channels")
        layout = parse(OnDisk(files(self.options["path"])[0]))
        time_variable(layout)
        if self.options.get("signals", "false").lower() == "true":
            return schema_of(signals(layout))
        wanted = None if names is None else [n.strip() for n in names.split(",") if n.strip()]
        return schema_of(chosen(layout, wanted, self.options.get("arrays", "false").lower() == "true"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else TelemetryReader
        return kind(schema, dict(self.options))


def read(spark: SparkSession, path: str, channels: list[str] | None = None, arrays: bool = False, records: int = PARTITION, start: int | None = None, end: int | None = None, ordered: bool = False) -> DataFrame:
    """The records of the logs at ``path``, as a DataFrame; those of start <= timecodes < end."""
    spark.dataSource.register(TelemetrySource)
    reader = spark.read.format("telemetrylog").option("arrays", str(arrays).lower()).option("records", records)
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).option("ordered", str(ordered).lower())
    for name, value in (("start", start), ("end", end), ("channels", None if channels is None else ",".join(channels))):
        if value is not None:
            reader = reader.option(name, value)
    return reader.load(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """The signals of the logs at ``path`` that laps depend on, by their raw bytes."""
    spark.dataSource.register(TelemetrySource)
    return spark.read.format("telemetrylog").option("signals", "true").load(path)


class _Short(Exception):
    """Parsing needs more of a file than was fetched."""


class _Head(InMemory):
    """The first bytes of a file of a known size."""

    def __init__(self, data: bytes, size: int):
        self.data, self.size = data, size

    def part(self, start: int, length: int) -> bytes:
        if start + length > len(self.data):
            raise _Short(start + length)
        return super().part(start, length)


def _stored_layout(found: DataFrame, path: str) -> Layout:
    """The layout of the first stored file; only its head reaches the driver."""
    need = 1 << 16
    while True:
        head = found.selectExpr("octet_length(content) as size", f"substring(content, 1, {need}) as head").limit(1).collect()
        if not head:
            raise FileNotFoundError(path)
        try:
            return parse(_Head(bytes(head[0]["head"]), head[0]["size"]))
        except _Short as short:
            need = short.args[0]


def read_stored(spark: SparkSession, path: str, channels: list[str] | None = None, arrays: bool = False) -> DataFrame:
    """Logs of one layout in any store that Spark reads, a file (under 2 GiB) a row."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = schema_of(chosen(_stored_layout(found, path), channels, arrays))
    names = [f.name for f in schema.fields[len(_FIXED) :]]

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                src = InMemory(raw.as_py())
                layout = parse(src)
                variables = chosen(layout, names, arrays)
                for a in range(0, layout.record_count, BATCH):
                    n = min(BATCH, layout.record_count - a)
                    yield decode(src.part(layout.data_offset + a * layout.record_length, n * layout.record_length), layout, variables, name, a)

    return found.mapInArrow(run, schema)
