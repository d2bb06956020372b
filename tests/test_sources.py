"""The binary layout and its data source."""

from __future__ import annotations

import io

import numpy as np
import pytest

from lapforge import open_log
from lapforge.sources import LayoutError, read, read_stored
from lapforge.sources.datasource import timecodes
from lapforge.sources.encode import encode
from lapforge.sources.layout import InMemory, parse
from lapforge.sources.session import metadata, scanned

N = 50


def columns(n=N):
    i = np.arange(n)
    return [
        ("SessionTime", "double", "s", "seconds", i / 60),
        ("Lap", "int", "", "lap", i // 20),
        ("OnPitRoad", "bool", "", "pit", (i == 0) * 7),
        ("Speed", "float", "m/s", "speed", i * 0.5),
        ("Flags", "bitfield", "", "bits", np.full(n, 0xFFFFFFFF)),
        ("Tag", "char", "", "byte", np.full(n, 0xFF)),
        ("Temps", "float", "C", "three", np.stack([i, i + 1, i + 2], axis=1) if n else np.zeros((0, 3))),
        ("Name", "char", "", "text", np.tile(np.frombuffer(b"ab\0x", np.uint8), (n, 1))),
    ]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "a.log").write_bytes(encode(columns(), lap_count=3))
    return str(tmp_path / "a.log")


def test_scan_types_and_values(spark, path):
    df = read(spark, path)
    assert dict(df.dtypes) == {"file_id": "string", "record_idx": "bigint", "timecodes": "bigint", "SessionTime": "double", "Lap": "int", "OnPitRoad": "boolean", "Speed": "float", "Flags": "bigint", "Tag": "smallint"}
    rows = df.orderBy("record_idx").collect()
    assert len(rows) == N and rows[0].OnPitRoad is True and rows[1].OnPitRoad is False
    assert {r.Flags for r in rows} == {0xFFFFFFFF} and {r.Tag for r in rows} == {255}
    assert [r.timecodes for r in rows] == [int(np.floor(i / 60 * 1000 + 0.5)) for i in range(N)]
    assert df.schema["Speed"].metadata["units"] == "m/s" and df.schema["Speed"].metadata["interpolate"] == "True"
    assert df.schema["Lap"].metadata["interpolate"] == "False"


def test_channels_arrays_and_partitions(spark, path):
    assert read(spark, path, ["Speed", "Lap"]).columns[3:] == ["Speed", "Lap"]
    row = read(spark, path, ["Temps", "Name"], arrays=True).filter("record_idx = 5").first()
    assert row.Temps == [5.0, 6.0, 7.0] and row.Name == "ab"
    small = read(spark, path, records=7)
    assert small.rdd.getNumPartitions() == 8 and small.count() == N
    with pytest.raises(Exception, match="Channels not found"):
        read(spark, path, ["Temps"]).count()


def test_stored_equals_source(spark, path):
    a, b = read(spark, path).drop("file_id"), read_stored(spark, path).drop("file_id")
    assert a.schema == b.schema and sorted(a.collect()) == sorted(b.collect())


def test_folder_of_logs_and_pushdown(spark, path, tmp_path):
    (tmp_path / "b.log").write_bytes(encode(columns(10)))
    assert read(spark, str(tmp_path)).groupBy("file_id").count().count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read(spark, path, records=7).filter("record_idx >= 20 and record_idx < 30")
        assert [r.record_idx for r in got.orderBy("record_idx").collect()] == list(range(20, 30))
        assert got.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_no_records(spark, tmp_path):
    (tmp_path / "e.log").write_bytes(encode(columns(0)))
    log = open_log(spark, str(tmp_path / "e.log"))
    assert log.samples.count() == 0 and log.laps.count() == 0 and log.get_channels_as_table().count() == 0


def test_timecodes():
    s = np.array([0.0005, -0.0005, 0.0015, 0.49999999999999994e-3, np.nan, np.inf, -np.inf, 1.0])
    assert timecodes(s).tolist() == [1, -1, 2, 0, 0, (1 << 63) - 1, -(1 << 63), 1000]


GOOD = encode(columns(3))


@pytest.mark.parametrize(
    "data, message",
    [
        (b"", "File too small for header"),
        (GOOD[:120], "disk sub-header"),
        (encode(columns(3), version=3), "Unsupported log version: 3"),
        (encode(columns(3), records=4), "File too small for 4 records"),
        (encode(columns(3), records=-1), "session_record_count must be non-negative"),
        (GOOD[:144] + b"\x09" + GOOD[145:], "Unknown variable type: 9"),
        (GOOD[:152] + b"\xff\xff\xff\xff" + GOOD[156:], "Variable count must be non-negative"),
        (GOOD[:148] + b"\xff\x00\x00\x00" + GOOD[152:], "exceeds buffer length"),
    ],
)
def test_broken_files(data, message):
    with pytest.raises(LayoutError, match=message):
        parse(InMemory(data))


def test_longer_file_is_fine():
    assert parse(InMemory(GOOD + b"more")).record_count == 3


def test_open_sources(spark, path, tmp_path):
    data = open(path, "rb").read()
    seen = []
    log = open_log(spark, path, lambda i, n: seen.append((i, n)))
    assert seen == [(i, 6) for i in range(1, 7)] and log.file_name == path
    assert open_log(spark, data).file_name == "<bytes>"
    stream = io.BytesIO(data)
    stream.read(10)
    assert open_log(spark, stream).samples.count() == N
    with pytest.raises(TypeError):
        open_log(spark, 5)
    with pytest.raises(OSError, match="nowhere"):
        open_log(spark, "/nowhere.log")
    with pytest.raises(RuntimeError, match="too small"):
        open_log(spark, b"x")
    (tmp_path / "t.log").write_bytes(encode([("SessionTime", "float", "", "", [1.0])]))
    with pytest.raises(OSError, match="SessionTime"):
        open_log(spark, str(tmp_path / "t.log"))


YAML = b"""\0\0---
WeekendInfo:
 TrackName: a ring
 TrackCity:
 SeriesID: 5
SessionInfo:
 CurrentSessionNum: 0
 Sessions:
 - SessionNum: 0
   SessionType: Race
DriverInfo:
 DriverCarIdx: 9
 Drivers:
 - CarIdx: 0
   CarIsPaceCar: 1
 - CarIdx: 1
\0\0"""


def test_metadata():
    found = metadata(parse(InMemory(encode(columns(3), YAML, lap_count=2, start=1.5))))
    assert found["track_name"] == "a ring" and "track_city" not in found and found["series_id"] == "5"
    assert found["session_type"] == "Race" and found["session_name"] is None and "driver_name" not in found
    assert found["num_drivers"] == 1 and found["lap_count"] == 2 and found["start_time"] == 1.5
    assert found["session_info_yaml"].startswith("---") and not found["session_info_yaml"].endswith("\0")
    for raw in (b"---\nWeekendInfo:\nDriverInfo:\n", b"no marker: [", b"", "---\nDriverInfo: {Drivers: [{UserName: J\xe9}]}".encode("latin-1")):
        metadata(parse(InMemory(encode(columns(1), raw))))


def test_only_line_feeds_end_lines():
    found = scanned("TrackName: a b\x85c\x0b\x1cd \r\n TrackCity:  x: y\t\nTrackCountry:\n")
    assert found == {"track_name": "a b\x85c\x0b\x1cd", "track_city": "x: y"}


@pytest.mark.parametrize("kind, values", [("bitfield", np.array([0xFFFFFFFF, 0xFFFFFFFF, 0, 1])), ("int", np.array([-1, -1, 0, 1])), ("float", np.array([1.5, 1.5, 0, -2.0]))])
def test_laps_of_raw_bytes(spark, kind, values):
    """Lap counts by its four bytes, OnPitRoad by its first one, whatever their types."""
    data = encode([("SessionTime", "double", "", "", np.arange(4.0)), ("Lap", kind, "", "", values), ("OnPitRoad", "float", "", "", np.array([0.5, 0.0, 0.0, 1e-45]))])
    raw = values.astype({"bitfield": "<u4", "int": "<i4", "float": "<f4"}[kind]).view("<i4")
    rows = open_log(spark, data).laps.orderBy("lap_idx").collect()
    assert [r.num for r in rows] == [int(raw[0]), int(raw[2]), int(raw[3])]
    # 0.5 has a first byte of 0, the least float one of 1
    assert [r.lap_type for r in rows] == ["full", "incomplete", "incomplete"]


def test_lap_without_room_is_an_error(spark):
    data = encode([("SessionTime", "double", "", "", np.arange(4.0)), ("Lap", "char", "", "", np.arange(4))])
    with pytest.raises(RuntimeError, match="needs 4 bytes"):
        open_log(spark, data)


def test_time_range_of_an_ordered_log_reads_its_records(spark, path):
    whole, ordered = open_log(spark, path), open_log(spark, path, ordered=True)
    for a, b in ((100, 400), (-5, 10**6), (400, 400), (5000, 9000), (0, 17)):
        want = whole.filter_by_time_range(a, b).samples.collect()
        got = ordered.select_channels(["Speed", "Lap"]).filter_by_time_range(a, b).samples
        assert [(r.record_idx, r.Speed, r.Lap) for r in want] == [(r.record_idx, r.Speed, r.Lap) for r in got.orderBy("record_idx").collect()]
    few = read(spark, path, records=1, start=100, end=400, ordered=True)
    assert few.rdd.getNumPartitions() == few.count() == 18
    assert [len(x.samples.collect()) for x in ordered.split_sessions()] == [len(x.samples.collect()) for x in whole.split_sessions()]
    assert sorted(map(tuple, ordered.filter_by_lap(1).samples.collect())) == sorted(map(tuple, whole.filter_by_lap(1).samples.collect()))


def test_logs_of_a_folder_as_one(spark, tmp_path):
    for name, n in (("a", 50), ("b", 30)):
        (tmp_path / f"{name}.log").write_bytes(encode(columns(n)))
    log = open_log(spark, str(tmp_path))
    assert log.files == [f"{tmp_path}/a.log", f"{tmp_path}/b.log"] and set(log.metadata) == set(log.files)
    assert log.filter_by_lap(1).samples.groupBy("file_id").count().count() == 2
    assert [s.samples.count() for s in log.split_sessions()] == [78]
    grid = log.resample_to_timecodes([0, 250, 100], bucket_ms=100).samples
    assert grid.count() == 6 and sorted(map(tuple, grid.collect())) == sorted(map(tuple, log.resample_to_timecodes([0, 250, 100]).samples.collect()))


def test_stored_logs_fetch_only_heads(spark, tmp_path):
    long = encode(columns(), b"---\n" + b"# filler\n" * 20_000)
    (tmp_path / "long.log").write_bytes(long)
    assert read_stored(spark, str(tmp_path / "long.log")).count() == N


def test_shared_folder_or_error(spark, monkeypatch):
    from lapforge.sources import shared

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Elsewhere)
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
