"""Laps, filters, resampling and merging against hand-made and NumPy results."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge import ChannelMetadata, TelemetryLog
from lapforge.functions import lap_type, timecodes_from_seconds, with_metadata
from lapforge.functions.metadata import to_arrow
from lapforge.operators import by_session, laps, merge_long, merge_tables, overlapping, resample, select_channels

SCHEMA = "file_id string, record_idx long, timecodes long, Lap int"


def samples(spark, numbers, file_id="f"):
    return spark.createDataFrame([(file_id, i, i * 10, n) for i, n in enumerate(numbers)], SCHEMA)


@pytest.mark.parametrize(
    "numbers, sessions",
    [([0, 0, 1, 1, 2, 2], [0, 0, 0]), ([0, 1, 0, 1, 2], [0, 0, 1, 1, 1]), ([0, 1, 0, 1, 0, 1, 2, 3], [0, 0, 1, 1, 2, 2, 2, 2]), ([5, 5, 3, 3], [0, 0]), ([4], [0]), ([], [])],
)
def test_sessions(spark, numbers, sessions):
    rows = laps(samples(spark, numbers), ["file_id"]).orderBy("lap_idx").collect()
    assert [r.session for r in rows] == sessions


def test_lap_times_and_missing_channels(spark):
    rows = laps(samples(spark, [0, 0, 1, 1, 1, 2]), ["file_id"]).orderBy("lap_idx").collect()
    assert [(r.num, r.start_time, r.end_time, r.lap_type, r.sample_count) for r in rows] == [(0, 0, 20, "full", 2), (1, 20, 50, "full", 3), (2, 50, 50, "incomplete", 1)]
    assert laps(samples(spark, [1]).drop("Lap"), ["file_id"]).collect() == []


@pytest.mark.parametrize(
    "n, pit0, pit1, d0, d1, expected",
    [
        (1, True, True, 0.5, 0.5, "incomplete"), (2, True, True, 0.5, 0.5, "out"), (2, False, True, 0.5, 0.5, "in"), (2, False, False, 0.5, 0.0, "partial"),
        (2, False, False, 0.0, 0.5, "partial"), (2, False, False, 0.02, 0.98, "full"), (2, False, False, 0.021, 1.0, "partial"), (2, False, False, 0.0, 0.979, "partial"), (2, False, False, math.nan, math.nan, "full"),
    ],
)
def test_lap_type(spark, n, pit0, pit1, d0, d1, expected):
    f = lambda x: F.lit(x).cast("float")
    assert spark.range(1).select(lap_type(F.lit(n), F.lit(pit0), F.lit(pit1), f(d0), f(d1))).first()[0] == expected


def test_timecodes(spark):
    values = [0.0005, -0.0005, 0.0015, 0.49999999999999994e-3, math.nan, math.inf, -math.inf]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(timecodes_from_seconds(F.col("v"))).collect()
    assert [r[0] for r in got] == [1, -1, 2, 0, 0, (1 << 63) - 1, -(1 << 63)]


def reference(xp, fp, targets, linear):
    """Values by NumPy over samples in order."""
    if linear:
        return np.interp(targets, xp, fp)
    return np.asarray(fp)[np.maximum(np.searchsorted(xp, targets, side="right") - 1, 0)]


@pytest.mark.parametrize("bucket", [None, 7, 50])
@pytest.mark.parametrize("linear", [True, False])
def test_resample_random(spark, linear, bucket):
    rng = np.random.default_rng(3)
    knots, targets = [], []
    for key in "ab":
        xp = np.sort(rng.integers(0, 300, 60))
        knots += [(key, i, int(x), float(v)) for i, (x, v) in enumerate(zip(xp, rng.normal(size=60)))]
        targets += [(key, int(t), i) for i, t in enumerate(rng.integers(-20, 330, 120))]
    src = spark.createDataFrame(knots, "k string, record_idx long, timecodes long, v double")
    got = resample(src, spark.createDataFrame(targets, "k string, timecodes long, pos int"), ["k"], linear={"v": linear}, bucket_ms=bucket).collect()
    assert len(got) == len(targets)
    for key in "ab":
        xp, fp = [x for k, _, x, _ in knots if k == key], [v for k, _, _, v in knots if k == key]
        for r in (r for r in got if r.k == key):
            assert r.v == reference(xp, fp, [r.timecodes], linear)[0]


@pytest.mark.parametrize("fp", [[1.0, math.nan, 3.0], [math.inf, 1.0, 2.0], [math.inf, math.inf, -math.inf], [1.0, math.inf, 2.0]])
def test_resample_not_finite(spark, fp):
    src = spark.createDataFrame([(i, i * 10, v) for i, v in enumerate(fp)], "record_idx long, timecodes long, v double")
    targets = [-5, 0, 5, 10, 15, 20, 25]
    got = resample(src, spark.createDataFrame([(t,) for t in targets], "timecodes long"), [], linear={"v": True}).orderBy("timecodes").collect()
    assert np.array_equal([r.v for r in got], np.interp(targets, [0, 10, 20], fp), equal_nan=True)


def log_of(spark):
    meta = {"Speed": ChannelMetadata("m/s", "speed", True), "Count": ChannelMetadata("", "count", True), "Gear": ChannelMetadata("", "gear", False)}
    rows = [("f", 0, 0, 1.0, 1, 1, 0), ("f", 1, 100, 2.0, 4, 2, 0), ("f", 2, 200, 3.0, 6, 3, 1), ("f", 3, 300, 9.0, 8, 4, 1)]
    df = spark.createDataFrame(rows, "file_id string, record_idx long, timecodes long, Speed float, Count int, Gear int, Lap int")
    described = df.select("file_id", "record_idx", "timecodes", *(with_metadata(F.col(n), n, m) for n, m in meta.items()), "Lap")
    return TelemetryLog(described, laps(described, ["file_id"]), {"a": 1}, "x")


def test_log_methods(spark):
    log = log_of(spark)
    assert log.channel_names == ["Speed", "Count", "Gear", "Lap"]
    assert log.select_channels(["Gear", "Speed", "Gear"]).channel_names == ["Gear", "Speed"]
    assert log.select_channels([]).channel_names == []
    with pytest.raises(KeyError, match=r"Channels not found: \['A', 'B'\]"):
        log.select_channels(["B", "Speed", "A"])
    cut = log.filter_by_time_range(100, 200)
    assert [r.timecodes for r in cut.samples.collect()] == [100] and [r.num for r in cut.laps.collect()] == [0]
    # the last lap ends at its last sample, which is left out
    assert [r.timecodes for r in log.filter_by_lap(1, ["Gear"]).samples.collect()] == [200]
    with pytest.raises(ValueError, match=r"Lap 7 not found. Available laps: \[0, 1\]"):
        log.filter_by_lap(7)
    with pytest.raises(KeyError, match="Reference channel not found: No"):
        log.resample_to_channel("No")
    assert log.resample_to_channel("Speed", ["Gear"]).channel_names == ["Gear"]


def test_log_resample_types_order_metadata(spark):
    log = log_of(spark)
    new = log.resample_to_timecodes(pa.array([150, 50, 50, -10, 400]))
    rows = new.samples.orderBy("record_idx").collect()
    assert [r.timecodes for r in rows] == [150, 50, 50, -10, 400]
    assert [r.Speed for r in rows] == [2.5, 1.5, 1.5, 1.0, 9.0] and [r.Count for r in rows] == [5.0, 2.5, 2.5, 1.0, 8.0]
    assert [r.Gear for r in rows] == [2, 1, 1, 1, 4]
    kinds = dict(new.samples.dtypes)
    assert (kinds["Speed"], kinds["Count"], kinds["Gear"]) == ("float", "double", "int")
    assert new.catalogue == log.catalogue
    empty = log.filter_by_time_range(1000, 2000)
    assert empty.get_channels_as_table().count() == 0 and empty.resample_to_timecodes([1]).samples.count() == 0


def test_log_table(spark):
    log = log_of(spark)
    table = log.to_arrow()
    assert table.column_names == ["timecodes", "Count", "Gear", "Lap", "Speed"] and table.num_rows == 4
    assert table.schema.field("Speed").metadata == {b"units": b"m/s", b"desc": b"speed", b"interpolate": b"True"}
    assert ChannelMetadata.from_channel_table(table.select(["timecodes", "Gear"])) == ChannelMetadata("", "gear", False)
    assert ChannelMetadata.from_channel_table(table.select(["timecodes"])) == ChannelMetadata()
    assert table.schema.field("Count").type == pa.float64()
    assert log.select_channels([]).get_channels_as_table().columns == ["timecodes"]


def test_duplicate_times_keep_the_last(spark):
    df = spark.createDataFrame([("f", 0, 5, 1.0), ("f", 1, 5, 2.0), ("f", 2, 6, 3.0)], "file_id string, record_idx long, timecodes long, A double")
    got = TelemetryLog(df, df.limit(0)).get_channels_as_table().collect()
    assert [(r.timecodes, r.A) for r in got] == [(5, 2.0), (6, 3.0)]


def test_sessions_of_a_log(spark):
    numbers = [0, 0, 1, 1, 0, 0, 0, 1, 1, 1]
    df = samples(spark, numbers)
    log = TelemetryLog(df, laps(df, ["file_id"]), {"k": [1]})
    parts = log.split_sessions()
    assert [[r.record_idx for r in p.samples.orderBy("record_idx").collect()] for p in parts] == [[0, 1, 2, 3], [4, 5, 6, 7, 8]]
    assert parts[0].metadata == log.metadata and parts[0].metadata is not log.metadata
    tagged = by_session(df, log.laps, ["file_id"]).groupBy("session").count().orderBy("session").collect()
    assert [(r.session, r["count"]) for r in tagged] == [(0, 4), (1, 5)]


def test_touching_laps_go(spark):
    table = spark.createDataFrame([(0, 0, 10), (1, 10, 20), (2, 20, 30)], "num int, start_time long, end_time long")
    assert [r.num for r in overlapping(table, 10, 20).collect()] == [1]


def test_merge_of_own_time_bases(spark):
    a = spark.createDataFrame([(0, 1.0), (100, 2.0), (200, 3.0)], "timecodes long, A float").select("timecodes", with_metadata(F.col("A"), "A", ChannelMetadata("u", "d", True)))
    b = spark.createDataFrame([(50, 7), (150, 8)], "timecodes long, B int")
    wide = merge_tables({"B": b, "A": a})
    assert wide.columns == ["timecodes", "A", "B"] and isinstance(wide.schema["A"].dataType, T.FloatType)
    assert [tuple(r) for r in wide.orderBy("timecodes").collect()] == [(0, 1.0, 7), (50, 1.5, 7), (100, 2.0, 7), (150, 2.5, 8), (200, 3.0, 8)]
    assert to_arrow(wide).schema.field("A").metadata[b"units"] == b"u"
    long = a.select(F.lit("A").alias("channel"), "timecodes", F.col("A").cast("double").alias("value")).unionByName(b.select(F.lit("B").alias("channel"), "timecodes", F.col("B").cast("double").alias("value")))
    long = long.withColumns({"record_idx": F.col("timecodes"), "file_id": F.lit("f")})
    got = merge_long(long, {"A": True, "B": False}, ["file_id"]).orderBy("timecodes").collect()
    assert [(r.A, r.B) for r in got] == [(1.0, 7.0), (1.5, 7.0), (2.0, 7.0), (2.5, 8.0), (3.0, 8.0)]


def test_select_keeps_metadata(spark):
    log = log_of(spark)
    assert ChannelMetadata.of(select_channels(log.samples, ["Speed"], ["timecodes"]).schema["Speed"]).units == "m/s"


def test_stream(spark, tmp_path):
    from lapforge.streaming import follow, write_bounded

    df = log_of(spark).samples
    df.write.parquet(str(tmp_path / "in"))
    stream = follow(spark, str(tmp_path / "in"), df.schema, ["Speed"], ["timecodes"], 100, 300)
    write_bounded(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(100, 2.0), (200, 3.0)]
