"""Metadata of a log: header numbers, scanned lines, and what its YAML tells."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import Layout

#: Lines of the YAML text and the key that each gives.
LINES = {
    "TrackName": "track_name",
    "TrackDisplayName": "track_display_name",
    "TrackCity": "track_city",
    "TrackCountry": "track_country",
    "TrackLength": "track_length",
    "SeriesID": "series_id",
    "SeasonID": "season_id",
    "SessionID": "session_id",
    "SubSessionID": "sub_session_id",
}
#: Keys from the YAML's weekend, driver info, current session and own driver.
WEEKEND = {"event_type": "EventType", "track_id": "TrackID", "track_type": "TrackType", "weather_temp": "TrackAirTemp", "weather_surface_temp": "TrackSurfaceTemp", "weather_humidity": "TrackRelativeHumidity", "weather_skies": "TrackSkies", "weather_wind_speed": "TrackWindVel", "weather_wind_dir": "TrackWindDir"}
CAR = {"car_gear_count": "DriverCarGearNumForward", "car_redline_rpm": "DriverCarRedLine", "car_shift_rpm": "DriverCarSLShiftRPM", "car_idle_rpm": "DriverCarIdleRPM"}
CURRENT = {"session_type": "SessionType", "session_name": "SessionName"}
DRIVER = {"driver_name": "UserName", "driver_user_id": "UserID", "driver_irating": "IRating", "driver_license": "LicString", "car_name": "CarScreenName", "car_id": "CarID"}


#: Fixed value: white space around a line or a value.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def scanned(yaml: str) -> dict[str, str]:
    """Values of the known lines as text; of several the last, empty ones not at all.

    Only a line feed ends a line, so other separators are part of a value.
    """
    out = {}
    for line in yaml.split("\n"):
        name, colon, rest = line.strip(BLANKS).partition(": ")
        if colon and name in LINES:
            out[LINES[name]] = rest.strip(BLANKS)
    return out


def _table(x: Any) -> dict:
    return x if isinstance(x, dict) else {}


def _rows(x: Any) -> list[dict]:
    return [r for r in x if isinstance(r, dict)] if isinstance(x, list) else []


def derived(yaml: str) -> dict[str, Any]:
    """Keys from the parsed YAML; nothing if it is empty or can't be parsed.

    Sections that are missing or null count as empty. Keys of the current session and
    of the recording driver are there only if these are found.
    """
    import yaml as parser

    try:
        tree = parser.safe_load(yaml) if yaml else None
    except parser.YAMLError:
        return {}
    if not isinstance(tree, dict) or not tree:
        return {}
    weekend, driver, session = (_table(tree.get(k)) for k in ("WeekendInfo", "DriverInfo", "SessionInfo"))
    drivers = _rows(driver.get("Drivers"))
    out: dict[str, Any] = {"session_info": tree}
    out |= {k: weekend.get(v) for k, v in WEEKEND.items()} | {k: driver.get(v) for k, v in CAR.items()}
    for rows, key, wanted, names in ((_rows(session.get("Sessions")), "SessionNum", session.get("CurrentSessionNum"), CURRENT), (drivers, "CarIdx", driver.get("DriverCarIdx"), DRIVER)):
        own = next((r for r in rows if r.get(key) == wanted), None)
        out |= {k: own.get(v) for k, v in names.items()} if own else {}
    out["num_drivers"] = sum(not d.get("CarIsPaceCar") for d in drivers)
    return out | {"car_setup": tree.get("CarSetup"), "sectors": _table(tree.get("SplitTimeInfo")).get("Sectors")}


def metadata(layout: Layout) -> dict[str, Any]:
    """All metadata of a log."""
    numbers = {k: getattr(layout, k) for k in ("tick_rate", "record_count", "lap_count", "session_start_date", "start_time", "end_time")}
    return {"session_info_yaml": layout.yaml} | scanned(layout.yaml) | numbers | derived(layout.yaml)


def metadata_frame(spark: SparkSession, logs: dict[str, Layout]) -> DataFrame:
    """One row a log: file_id and its metadata as a variant, for ``variant_get``."""
    rows = [(name, json.dumps(metadata(layout), default=str)) for name, layout in logs.items()]
    return spark.createDataFrame(rows, "file_id string, json string").select("file_id", F.parse_json("json").alias("metadata"))
