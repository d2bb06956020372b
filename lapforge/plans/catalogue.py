"""Registered queries of the engine and the SQL that they are held against."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import ChannelMetadata, catalogue, with_metadata
from ..log import open_log
from ..operators import align, filters
from ..operators.laps import laps as find_laps
from ..operators.resample import resample, to_channel
from ..sources import datasource, encode
from ..sources.layout import InMemory, parse
from ..sources.session import metadata_frame
from ..sources.shared import shared_folder
from .adapters import KEYS, hourly, long_channels, telemetry

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(f):
    QUERIES[f.__name__] = f
    return f


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(_events(spark, sf_dir))


def _laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_laps(_samples(spark, sf_dir), KEYS)


#: A time range, a lap number and a reference channel that queries use.
START, END, LAP = 1704412800000, 1705017600000, 3


@register
def scan_timecodes(spark, sf_dir):
    """S14, T1."""
    return _samples(spark, sf_dir).select("user_id", "record_idx", "timecodes")


@register
def select_channels(spark, sf_dir):
    """P1, P2."""
    return filters.select_channels(_samples(spark, sf_dir), ["Value", "K", "Value"], ["user_id", "record_idx", "timecodes"])


@register
def filter_time_range(spark, sf_dir):
    """F1."""
    return filters.time_range(_samples(spark, sf_dir), START, END)


@register
def laps_extract(spark, sf_dir):
    """L1, L2, A1, A2, W1 to W3."""
    return _laps(spark, sf_dir).select("user_id", "lap_idx", "num", "start_time", "end_time", "sample_count")


@register
def laps_classified(spark, sf_dir):
    """L3 to L5."""
    return _laps(spark, sf_dir).select("user_id", "lap_idx", "lap_type")


@register
def laps_sessions(spark, sf_dir):
    """The whole table of laps."""
    return _laps(spark, sf_dir)


@register
def laps_overlap(spark, sf_dir):
    """F2."""
    return filters.overlapping(_laps(spark, sf_dir), START, END).select("user_id", "lap_idx", "num", "start_time", "end_time")


@register
def filter_by_lap(spark, sf_dir):
    """F3, A6."""
    return filters.by_lap(_samples(spark, sf_dir), _laps(spark, sf_dir), LAP, KEYS)


@register
def split_sessions(spark, sf_dir):
    """F4, A3."""
    return filters.by_session(_samples(spark, sf_dir).select("user_id", "record_idx", "timecodes", "Value"), _laps(spark, sf_dir), KEYS)


@register
def resample_linear_grid(spark, sf_dir):
    """R1, R1a, R1c, W5, W6."""
    samples = _samples(spark, sf_dir).select("user_id", "record_idx", "timecodes", "Value", "K")
    return resample(samples, hourly(samples, KEYS), KEYS, linear={"Value": True, "K": True})


@register
def resample_step_grid(spark, sf_dir):
    """R1b."""
    samples = _samples(spark, sf_dir).select("user_id", "record_idx", "timecodes", "K")
    return resample(samples, hourly(samples, KEYS), KEYS)


@register
def resample_bucketed_grid(spark, sf_dir):
    """R1 over buckets of a timeline, the form for very long logs."""
    samples = _samples(spark, sf_dir).select("user_id", "record_idx", "timecodes", "Value", "K")
    return resample(samples, hourly(samples, KEYS), KEYS, linear={"Value": True, "K": True}, bucket_ms=86_400_000)


@register
def resample_to_channel(spark, sf_dir):
    """Values at the times of clicks."""
    samples = _samples(spark, sf_dir).select("user_id", "record_idx", "timecodes", "Value")
    clicks = long_channels(_events(spark, sf_dir)).filter("channel = 'click'")
    return to_channel(samples, clicks, KEYS)


@register
def union_timeline(spark, sf_dir):
    """J1, A4, O5."""
    events = long_channels(_events(spark, sf_dir))
    return align.union_timeline([events.filter("channel = 'click'"), events.filter("channel = 'view'")], KEYS)


#: The event types, which are the channels of the long form.
TYPES = ("click", "error", "purchase", "signup", "view")


@register
def merge_channels(spark, sf_dir):
    """The general path, each channel on a time base of its own."""
    linear = {t: t not in ("error", "signup") for t in TYPES}
    return align.merge_long(long_channels(_events(spark, sf_dir)), linear, KEYS)


@register
def merge_shared_fast(spark, sf_dir):
    """The path for a shared time base."""
    return align.merge_shared(_samples(spark, sf_dir), KEYS)


@register
def channel_catalog(spark, sf_dir):
    """P3 to P6."""
    return catalogue(_samples(spark, sf_dir), ("user_id", "record_idx", "timecodes"))


@register
def session_distinct(spark, sf_dir):
    """A3, O2."""
    return _laps(spark, sf_dir).select("session").distinct()


YAML = """---
WeekendInfo:
 TrackName: old name
 TrackName: test ring
 TrackDisplayName: Test Ring North
 TrackCity: Town
 TrackCountry: Land
 TrackLength: 4.20 km
 TrackID: 7
 TrackType: road course
 SeriesID: 11
 SeasonID: 12
 SessionID: 13
 SubSessionID: 14
 EventType: Race
 TrackAirTemp: 21.00 C
 TrackSurfaceTemp: 30.00 C
 TrackRelativeHumidity: 55 %
 TrackSkies: Clear
 TrackWindVel: 1.00 m/s
 TrackWindDir: 0.50 rad
SessionInfo:
 CurrentSessionNum: 1
 Sessions:
 - SessionNum: 0
   SessionType: Practice
 - SessionNum: 1
   SessionType: Race
   SessionName: FINAL
DriverInfo:
 DriverCarIdx: 2
 DriverCarGearNumForward: 6
 DriverCarRedLine: 7500
 DriverCarSLShiftRPM: 7000
 DriverCarIdleRPM: 900
 Drivers:
 - CarIdx: 0
   UserName: Pace
   CarIsPaceCar: 1
 - CarIdx: 2
   UserName: A Driver
   UserID: 99
   IRating: 1500
   LicString: A 3.50
   CarScreenName: Car
   CarID: 42
...
"""


#: Events in one of the binary logs that queries write.
LOG_EVENTS = 4096
#: Fixed value: the channels of these logs that queries return.
BINARY = ("record_idx", "timecodes", "Lap", "OnPitRoad", "LapDistPct", "Value", "User", "Tag")


def encoded_events(spark: SparkSession, sf_dir: str, lap: str = "int") -> str:
    """The events as binary logs in a new folder of the shared one; its path. Test data only.

    A log holds the events of a range of ids and is written by the task that has them,
    under another name first, so that a task that runs again leaves whole files.
    """
    folder = f"{shared_folder(spark)}/lapforge-{uuid.uuid4().hex}"
    os.makedirs(folder)
    step = LOG_EVENTS
    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / step).alias("log"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("s"), "user_id", ((F.day("ts") - 1) % 7).alias("lap"), (F.col("event_type") == "error").alias("pit"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")

    def write(table: pa.Table) -> pa.Table:
        at = {c: table.sort_by("event_id")[c].to_numpy() for c in table.column_names}
        data = encode.encode(
            [
                ("SessionTime", "double", "s", "time", at["s"]),
                ("Lap", lap, "", "lap", at["lap"] if lap == "int" else at["lap"].astype("int64") + 0xFFFFFFFD),
                ("OnPitRoad", "bool", "", "pit", at["pit"]),
                ("LapDistPct", "float", "%", "share", at["k"] / 100),
                ("Value", "double", "", "value", at["value"]),
                ("User", "bitfield", "", "user", at["user_id"]),
                ("Tag", "char", "", "tag", at["k"] + 100),
                ("Many", "float", "", "array", np.stack([at["value"]] * 3, axis=1)),
            ],
            YAML.encode() + b"\0\0",
        )
        name = f"{folder}/{table['log'][0].as_py():09d}.log"
        with open(f"{folder}/.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(f.name, name)
        return pa.table({"records": [len(table)]})

    rows.groupBy("log").applyInArrow(write, "records long").agg(F.sum("records")).collect()
    return folder


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with the number of each row's log, from its file's name."""
    return df.withColumn("log", F.regexp_extract("file_id", r"([0-9]+)\.log$", 1).cast("long"))


@register
def binary_scan(spark, sf_dir):
    """Events written as binary logs and read by the data source."""
    return _numbered(datasource.read(spark, encoded_events(spark, sf_dir))).select("log", *BINARY)


@register
def binary_stored_scan(spark, sf_dir):
    """The same through Spark's own file reader."""
    return _numbered(datasource.read_stored(spark, encoded_events(spark, sf_dir)).withColumnRenamed("path", "file_id")).select("log", *BINARY)


@register
def binary_one_channel(spark, sf_dir):
    """One channel, all records."""
    return _numbered(datasource.read(spark, encoded_events(spark, sf_dir), ["Value"])).select("log", "record_idx", "timecodes", "Value")


@register
def binary_records(spark, sf_dir):
    """Some records of each log."""
    return _numbered(datasource.read(spark, encoded_events(spark, sf_dir), ["Value"]).filter("record_idx between 10 and 19")).select("log", "record_idx", "timecodes", "Value")


@register
def binary_time_range(spark, sf_dir):
    """F1 on the source: of logs in the order of time only the range's records are read."""
    return _numbered(datasource.read(spark, encoded_events(spark, sf_dir), ["Value"], start=START, end=END, ordered=True)).select("log", "record_idx", "timecodes", "Value")


@register
def binary_arrays(spark, sf_dir):
    """Array variables, which are read only on demand."""
    many = _numbered(datasource.read(spark, encoded_events(spark, sf_dir), ["Many"], arrays=True))
    return many.select("log", "record_idx", F.size("Many").alias("n"), F.col("Many")[2].alias("last"))


@register
def binary_laps(spark, sf_dir):
    """S1, L1 to L7 over the binary logs."""
    return _numbered(find_laps(datasource.read(spark, encoded_events(spark, sf_dir)), ["file_id"])).drop("file_id")


@register
def binary_raw_lap(spark, sf_dir):
    """L1: a lap number of another declared type counts by its raw 32 bits."""
    return _numbered(find_laps(datasource.read_signals(spark, encoded_events(spark, sf_dir, "bitfield")), ["file_id"])).select("log", "lap_idx", "num", "start_time", "end_time", "sample_count")


@register
def log_resample_bucketed(spark, sf_dir):
    """R1, R3, F5 through the log's methods, over buckets of its timeline."""
    log = open_log(spark, encoded_events(spark, sf_dir), ordered=True).select_channels(["Value", "Lap"])
    grid = [START + i * 3_600_000 for i in range(200)]
    return _numbered(log.resample_to_timecodes(grid, bucket_ms=86_400_000).samples).select("log", "record_idx", "timecodes", "Value", "Lap")


@register
def resample_metadata(spark, sf_dir):
    """R1d, O7: channels keep units, description and kind through resampling, as rows."""
    samples = _samples(spark, sf_dir)
    return catalogue(resample(samples, hourly(samples, KEYS), KEYS), ("user_id", "timecodes"))


@register
def channels_left(spark, sf_dir):
    """The channels that are there but weren't asked for, and those asked for that aren't there."""
    there, asked = set(_samples(spark, sf_dir).columns), {"Value", "K", "Speed"}
    rows = [(n, True) for n in sorted(there - asked - {"user_id", "record_idx", "timecodes"})] + [(n, False) for n in sorted(asked - there)]
    return spark.createDataFrame(rows, "channel string, there boolean")


@register
def merge_two_tables(spark, sf_dir):
    """Channel tables with time bases of their own as one wide table."""
    events = _events(spark, sf_dir)
    of = lambda kind, name: long_channels(events).filter(F.col("channel") == kind).select("timecodes", with_metadata(F.col("value"), name, ChannelMetadata("", "", kind == "click")), "record_idx")
    return align.merge_tables({"clicks": of("click", "clicks"), "views": of("view", "views")}, order="record_idx")


@register
def session_metadata(spark, sf_dir):
    """All metadata of a log but its YAML's own tree, as text by key."""
    layout = parse(InMemory(encode.encode([("SessionTime", "double", "s", "", [])], YAML.encode(), lap_count=3, start_date=1_700_000_000, start=1.5, end=90.25)))
    frame = metadata_frame(spark, {"log": layout})
    pairs = F.explode(F.expr("cast(metadata as map<string, variant>)")).alias("key", "value")
    rows = frame.select("file_id", pairs).filter("key not in ('session_info_yaml', 'session_info', 'car_setup', 'sectors')")
    return rows.select("file_id", "key", F.expr("cast(value as string)").alias("value"))


_E = """
e AS (SELECT user_id, event_id AS record_idx, (epoch_us(ts) + 500) // 1000 AS timecodes, value AS "Value",
  CAST(json_extract_string(props, '$.k') AS INT) AS "K", CAST((day(ts) - 1) % 7 AS INT) AS "Lap",
  CAST(CAST(CAST(json_extract_string(props, '$.k') AS INT) AS FLOAT) / CAST(100 AS FLOAT) AS FLOAT) AS "LapDistPct",
  event_type = 'error' AS "OnPitRoad", event_type AS channel FROM events)"""
_L = """,
c AS (SELECT *, CASE WHEN "Lap" <> lag("Lap") OVER w THEN 1 ELSE 0 END AS chg FROM e WINDOW w AS (PARTITION BY {k} ORDER BY record_idx)),
i AS (SELECT *, SUM(chg) OVER (PARTITION BY {k} ORDER BY record_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lap_idx FROM c),
g AS (SELECT {k}, lap_idx, MIN("Lap") AS num, min_by(timecodes, record_idx) AS start_time, max_by(timecodes, record_idx) AS last_time, COUNT(*) AS n,
  min_by("OnPitRoad", record_idx) AS p0, max_by("OnPitRoad", record_idx) AS p1, min_by("LapDistPct", record_idx) AS d0, max_by("LapDistPct", record_idx) AS d1
  FROM i GROUP BY {k}, lap_idx),
laps AS (SELECT {k}, CAST(lap_idx AS BIGINT) AS lap_idx, num, start_time,
  COALESCE(LEAD(start_time) OVER (PARTITION BY {k} ORDER BY lap_idx), last_time) AS end_time, n AS sample_count,
  CASE WHEN n < 2 THEN 'incomplete' WHEN p0 THEN 'out' WHEN p1 THEN 'in'
    WHEN (d0 > CAST(0.02 AS FLOAT) AND d0 < CAST(0.98 AS FLOAT)) OR (d1 > CAST(0.02 AS FLOAT) AND d1 < CAST(0.98 AS FLOAT)) THEN 'partial' ELSE 'full' END AS lap_type,
  CAST(SUM(CASE WHEN num = 0 AND lap_idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY lap_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS session FROM g)"""
_EL = "WITH" + _E + _L.format(k="user_id")
_GRID = """,
grid AS (SELECT user_id, unnest(generate_series(CAST(ceil(a / 3600000.0) AS BIGINT), CAST(floor(b / 3600000.0) AS BIGINT))) * 3600000 AS t
  FROM (SELECT user_id, MIN(timecodes) AS a, MAX(timecodes) AS b FROM e GROUP BY user_id))"""


#: What ``session_metadata`` finds, as text.
METADATA = {
    "track_name": "test ring", "track_display_name": "Test Ring North", "track_city": "Town", "track_country": "Land", "track_length": "4.20 km",
    "series_id": "11", "season_id": "12", "session_id": "13", "sub_session_id": "14",
    "tick_rate": "60", "record_count": "0", "lap_count": "3", "session_start_date": "1700000000", "start_time": "1.5", "end_time": "90.25",
    "event_type": "Race", "track_id": "7", "track_type": "road course", "weather_temp": "21.00 C", "weather_surface_temp": "30.00 C", "weather_humidity": "55 %", "weather_skies": "Clear", "weather_wind_speed": "1.00 m/s", "weather_wind_dir": "0.50 rad",
    "car_gear_count": "6", "car_redline_rpm": "7500", "car_shift_rpm": "7000", "car_idle_rpm": "900",
    "session_type": "Race", "session_name": "FINAL",
    "driver_name": "A Driver", "driver_user_id": "99", "driver_irating": "1500", "driver_license": "A 3.50", "car_name": "Car", "car_id": "42", "num_drivers": "1",
}


def _between(source: str, target: str, keys: str = "user_id", values: tuple[str, ...] = ("v",)) -> str:
    """CTEs u and s: for each target of ``target`` the knots of ``source`` around it."""
    first = ", ".join(f"first_value(CASE WHEN kind = 0 THEN {v} END IGNORE NULLS) OVER a AS {v}1" for v in values)
    last = ", ".join(f"last_value(CASE WHEN kind = 0 THEN {v} END IGNORE NULLS) OVER b AS {v}0" for v in values)
    nulls = ", ".join("NULL" for _ in values)
    return f""",
u AS (SELECT {keys}, t, 0 AS kind, ord, {', '.join(values)} FROM ({source}) UNION ALL SELECT {keys}, t, 1, NULL, {nulls} FROM ({target})),
s AS (SELECT {keys}, t, kind, last_value(CASE WHEN kind = 0 THEN t END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN kind = 0 THEN t END IGNORE NULLS) OVER a AS t1, {last}, {first} FROM u
  WINDOW b AS (PARTITION BY {keys} ORDER BY t, kind, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY {keys} ORDER BY t, kind, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _linear(v: str) -> str:
    return f"CASE WHEN t0 IS NULL THEN CAST({v}1 AS DOUBLE) WHEN t1 IS NULL OR t0 = t THEN CAST({v}0 AS DOUBLE) ELSE (CAST({v}1 AS DOUBLE) - {v}0) / CAST(t1 - t0 AS DOUBLE) * CAST(t - t0 AS DOUBLE) + {v}0 END"


_GRID_SOURCE = 'SELECT user_id, timecodes AS t, record_idx AS ord, "Value" AS v, "K" AS k FROM e'
_GRID_SQL = "WITH" + _E + _GRID + _between(_GRID_SOURCE, "SELECT user_id, t FROM grid", values=("v", "k")) + f' SELECT user_id, t AS timecodes, {_linear("v")} AS "Value", {_linear("k")} AS "K" FROM s WHERE kind = 1'
_BOTH = '"K", "Lap", "LapDistPct", "OnPitRoad", "Value"'

ORACLES |= {
    "scan_timecodes": "WITH" + _E + " SELECT user_id, record_idx, timecodes FROM e",
    "select_channels": "WITH" + _E + ' SELECT user_id, record_idx, timecodes, "Value", "K" FROM e',
    "filter_time_range": "WITH" + _E + f" SELECT user_id, record_idx, timecodes, {_BOTH} FROM e WHERE timecodes >= {START} AND timecodes < {END}",
    "laps_extract": _EL + " SELECT user_id, lap_idx, num, start_time, end_time, sample_count FROM laps",
    "laps_classified": _EL + " SELECT user_id, lap_idx, lap_type FROM laps",
    "laps_sessions": _EL + " SELECT user_id, lap_idx, num, start_time, end_time, lap_type, session, sample_count FROM laps",
    "laps_overlap": _EL + f" SELECT user_id, lap_idx, num, start_time, end_time FROM laps WHERE start_time < {END} AND end_time > {START}",
    "filter_by_lap": _EL + f" SELECT e.user_id, record_idx, timecodes, {_BOTH} FROM e JOIN (SELECT user_id, min_by(start_time, lap_idx) AS a, min_by(end_time, lap_idx) AS b FROM laps WHERE num = {LAP} GROUP BY user_id) x ON e.user_id = x.user_id AND timecodes >= a AND timecodes < b",
    "split_sessions": _EL + " SELECT e.user_id, record_idx, timecodes, \"Value\", session FROM e JOIN (SELECT user_id, session, min_by(start_time, lap_idx) AS a, max_by(end_time, lap_idx) AS b FROM laps WHERE lap_type <> 'incomplete' GROUP BY user_id, session) x ON e.user_id = x.user_id AND timecodes >= a AND timecodes < b",
    "resample_linear_grid": _GRID_SQL,
    "resample_bucketed_grid": _GRID_SQL,
    "resample_step_grid": "WITH" + _E + _GRID + _between('SELECT user_id, timecodes AS t, record_idx AS ord, "K" AS k FROM e', "SELECT user_id, t FROM grid", values=("k",)) + ' SELECT user_id, t AS timecodes, COALESCE(k0, k1) AS "K" FROM s WHERE kind = 1',
    "resample_to_channel": "WITH" + _E + _between('SELECT user_id, timecodes AS t, record_idx AS ord, "Value" AS v FROM e', "SELECT user_id, timecodes AS t FROM e WHERE channel = 'click'") + f' SELECT user_id, t AS timecodes, {_linear("v")} AS "Value" FROM s WHERE kind = 1',
    "union_timeline": "WITH" + _E + " SELECT user_id, timecodes FROM e WHERE channel = 'click' UNION SELECT user_id, timecodes FROM e WHERE channel = 'view'",
    "merge_channels": "WITH" + _E + ", names AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS channel)"
    + _between('SELECT user_id, channel, timecodes AS t, record_idx AS ord, "Value" AS v FROM e', "SELECT DISTINCT user_id, names.channel, timecodes AS t FROM e CROSS JOIN names", "user_id, channel")
    + f", r AS (SELECT user_id, channel, t, CASE WHEN channel IN ('error', 'signup') THEN COALESCE(v0, v1) ELSE {_linear('v')} END AS v FROM s WHERE kind = 1)"
    + " SELECT user_id, t AS timecodes, " + ", ".join(f"MAX(CASE WHEN channel = '{t}' THEN v END) AS {t}" for t in TYPES) + " FROM r GROUP BY user_id, t",
    "merge_shared_fast": "WITH" + _E + f" SELECT user_id, timecodes, {_BOTH} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, timecodes ORDER BY record_idx DESC) AS rn FROM e) WHERE rn = 1",
    "channel_catalog": "SELECT * FROM (VALUES ('K', '', 'property k', false, 'int'), ('Lap', '', 'day of the week of four', false, 'int'), ('LapDistPct', '%', 'share of a lap', true, 'float'), ('OnPitRoad', '', 'event is an error', false, 'boolean'), ('Value', '', 'value of the event', true, 'double')) AS t(channel, units, \"desc\", interpolate, type)",
    "session_distinct": _EL + " SELECT DISTINCT session FROM laps",
    "session_metadata": "SELECT 'log' AS file_id, * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in METADATA.items()) + ") AS t(key, value)",
    "resample_metadata": "SELECT * FROM (VALUES ('K', '', 'property k', false, 'int'), ('Lap', '', 'day of the week of four', false, 'int'), ('LapDistPct', '%', 'share of a lap', true, 'float'), ('OnPitRoad', '', 'event is an error', false, 'boolean'), ('Value', '', 'value of the event', true, 'double')) AS t(channel, units, \"desc\", interpolate, type)",
    "channels_left": "SELECT * FROM (VALUES ('Lap', true), ('LapDistPct', true), ('OnPitRoad', true), ('Speed', false)) AS t(channel, there)",
    "merge_two_tables": "WITH" + _E + ", o AS (SELECT * FROM e WHERE channel IN ('click', 'view')), names AS (SELECT unnest(['click', 'view']) AS channel)"
    + _between('SELECT channel, timecodes AS t, record_idx AS ord, "Value" AS v FROM o', "SELECT DISTINCT names.channel, timecodes AS t FROM o CROSS JOIN names", "channel")
    + f" SELECT t AS timecodes, MAX(CASE WHEN channel = 'click' THEN {_linear('v')} END) AS clicks, MAX(CASE WHEN channel = 'view' THEN COALESCE(v0, v1) END) AS views FROM s WHERE kind = 1 GROUP BY t",
}
# a binary log holds the events of a range of ids in their order, as records from 0 on
_B = f"WITH b AS (SELECT event_id // {LOG_EVENTS} AS log, CAST(row_number() OVER (PARTITION BY event_id // {LOG_EVENTS} ORDER BY event_id) - 1 AS BIGINT) AS record_idx, CAST(round(epoch_us(ts) / 1e6 * 1000) AS BIGINT) AS timecodes, CAST((day(ts) - 1) % 7 AS INT) AS \"Lap\", event_type = 'error' AS \"OnPitRoad\", CAST(CAST(json_extract_string(props, '$.k') AS INT) / 100.0 AS FLOAT) AS \"LapDistPct\", value AS \"Value\", user_id AS \"User\", CAST(CAST(json_extract_string(props, '$.k') AS INT) + 100 AS SMALLINT) AS \"Tag\" FROM events)"
_BINARY = _B + ' SELECT log, record_idx, timecodes, "Lap", "OnPitRoad", "LapDistPct", "Value", "User", "Tag" FROM b'
ORACLES |= {
    "binary_scan": _BINARY,
    "binary_stored_scan": _BINARY,
    "binary_one_channel": _B + ' SELECT log, record_idx, timecodes, "Value" FROM b',
    "binary_records": _B + ' SELECT log, record_idx, timecodes, "Value" FROM b WHERE record_idx BETWEEN 10 AND 19',
    "binary_time_range": _B + f' SELECT log, record_idx, timecodes, "Value" FROM b WHERE timecodes >= {START} AND timecodes < {END}',
    "binary_arrays": _B + ' SELECT log, record_idx, CAST(3 AS INT) AS n, CAST("Value" AS FLOAT) AS last FROM b',
    "binary_laps": _B + ", e AS (SELECT * FROM b)" + _L.format(k="log") + " SELECT log, lap_idx, num, start_time, end_time, lap_type, session, sample_count FROM laps",
    # numbers from 0xFFFFFFFD on are -3 and up as signed ones, and wrap to 0 after -1
    "binary_raw_lap": _B + ', e AS (SELECT * REPLACE ("Lap" - 3 AS "Lap") FROM b)' + _L.format(k="log") + " SELECT log, lap_idx, num, start_time, end_time, sample_count FROM laps",
    "log_resample_bucketed": _B + f", grid AS (SELECT i AS n, {START} + i * 3600000 AS t FROM range(200) r(i))"
    + _between('SELECT log, timecodes AS t, record_idx AS ord, "Value" AS v, "Lap" AS k FROM b', "SELECT DISTINCT b.log, grid.t FROM b, grid", "log", ("v", "k"))
    + f""" SELECT log, (t - {START}) // 3600000 AS record_idx, t AS timecodes, {_linear("v")} AS "Value", COALESCE(k0, k1) AS "Lap" FROM s WHERE kind = 1""",
}
