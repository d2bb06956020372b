"""The fixed-record telemetry log: headers, variables, validation.

All numbers are little-endian. A main header of 112 bytes, a disk sub-header of 32, the
variables' headers (144 bytes each), a YAML text, and records of equal length.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Protocol

import numpy as np

HEADER, SUB_AT, SUB, VAR = 112, 112, 32, 144
#: Type codes with their names and NumPy types.
TYPES = {0: ("char", "u1"), 1: ("bool", "u1"), 2: ("int", "<i4"), 3: ("bitfield", "<u4"), 4: ("float", "<f4"), 5: ("double", "<f8")}
#: Fixed value: versions that can be read.
VERSIONS = (1, 2)


class LayoutError(ValueError):
    """A log whose headers or size can't be right."""


class Bytes(Protocol):
    """What parsing reads from: size in bytes, and parts of the file."""

    size: int

    def part(self, start: int, length: int) -> bytes: ...


class InMemory:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def part(self, start: int, length: int) -> bytes:
        return self.data[start : start + length]


class OnDisk:
    def __init__(self, path: str):
        import os

        self.path, self.size = path, os.stat(path).st_size

    def part(self, start: int, length: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(start)
            return f.read(length)


@dataclass(frozen=True)
class Variable:
    """A typed slot of every record."""

    name: str
    code: int
    offset: int
    count: int
    desc: str
    unit: str

    @property
    def kind(self) -> str:
        return TYPES[self.code][0]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(TYPES[self.code][1])

    @property
    def size(self) -> int:
        return self.dtype.itemsize * self.count

    @property
    def interpolate(self) -> bool:
        return self.kind in ("float", "double")


@dataclass(frozen=True)
class Layout:
    """Everything about a log but its records."""

    version: int
    tick_rate: int
    record_length: int
    data_offset: int
    record_count: int
    lap_count: int
    session_start_date: int
    start_time: float
    end_time: float
    variables: tuple[Variable, ...]
    yaml: str

    def variable(self, name: str) -> Variable | None:
        """The last variable of a name."""
        return next((v for v in reversed(self.variables) if v.name == name), None)

    def channels(self, arrays: bool = False) -> list[Variable]:
        """Variables in file order that are read; of one name the last counts."""
        last = {v.name: v for v in self.variables if v.count == 1 or (arrays and v.count > 1)}
        return list(last.values())

    def dtype(self, variables: list[Variable]) -> np.dtype:
        """A NumPy view of a record with these variables at their offsets."""
        return np.dtype({"names": [f"v{i}" for i in range(len(variables))], "formats": [(v.dtype, (v.count,)) if v.count != 1 else v.dtype for v in variables], "offsets": [v.offset for v in variables], "itemsize": self.record_length})


def _whole(value: int, what: str) -> int:
    if value < 0:
        raise LayoutError(f"{what} must be non-negative, got {value}")
    return value


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _need(src: Bytes, end: int, what: str) -> None:
    if src.size < end:
        raise LayoutError(f"File too small for {what}: {src.size} bytes (need {end})")


def _variable(raw: bytes) -> Variable:
    code, offset, count = struct.unpack_from("<3i", raw)
    if code not in TYPES:
        raise LayoutError(f"Unknown variable type: {code}")
    return Variable(_text(raw[16:48]), code, offset, _whole(count, "Variable count"), _text(raw[48:112]), _text(raw[112:144]))


def session_yaml(raw: bytes) -> str:
    """The text from the first ``---`` (else from the first non-NUL) without trailing NULs."""
    at = raw.find(b"---")
    body = raw[at:] if at >= 0 else raw.lstrip(b"\0")
    return body.rstrip(b"\0").decode("utf-8", "replace")


def parse(src: Bytes) -> Layout:
    """Read and check all headers; a file longer than its records is fine."""
    _need(src, HEADER, "header")
    main = src.part(0, HEADER)
    version, _, tick_rate, _, yaml_at, yaml_len, n_vars, vars_at, _, length = struct.unpack_from("<10i", main)
    if version not in VERSIONS:
        raise LayoutError(f"Unsupported log version: {version}")
    data_at = struct.unpack_from("<i", main, 52)[0]
    _need(src, SUB_AT + SUB, "disk sub-header")
    date, start, end, lap_count, records = struct.unpack("<qddii", src.part(SUB_AT, SUB))
    _whole(vars_at, "var_header_offset"), _whole(n_vars, "num_vars")
    _need(src, vars_at + VAR * n_vars, f"{n_vars} variable headers at offset {vars_at}")
    block = src.part(vars_at, VAR * n_vars)
    variables = tuple(_variable(block[i : i + VAR]) for i in range(0, len(block), VAR))
    _whole(yaml_at, "session_info_offset"), _whole(yaml_len, "session_info_len")
    _need(src, yaml_at + yaml_len, "session info")
    _whole(length, "buf_len")
    for v in variables:
        if _whole(v.offset, "var offset") + v.size > length:
            raise LayoutError(f"Variable '{v.name}' offset {v.offset} + size {v.size} exceeds buffer length {length}")
    _whole(data_at, "buf_offset"), _whole(records, "session_record_count")
    _need(src, data_at + length * records, f"{records} records")
    return Layout(version, tick_rate, length, data_at, records, lap_count, date, start, end, variables, session_yaml(src.part(yaml_at, yaml_len)))
