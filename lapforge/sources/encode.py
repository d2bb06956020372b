"""Writes logs in the fixed-record layout, for tests and round trips."""

from __future__ import annotations

import struct

import numpy as np

from .layout import HEADER, SUB, TYPES, VAR

_CODES = {name: code for code, (name, _) in TYPES.items()}


def encode(columns: list[tuple[str, str, str, str, np.ndarray]], yaml: bytes = b"---\n", version: int = 2, tick_rate: int = 60, lap_count: int = 0, records: int | None = None, start_date: int = 0, start: float = 0.0, end: float = 0.0) -> bytes:
    """The bytes of a log; a column is (name, type, unit, description, values).

    Values of shape (records, n) make an array variable. ``records`` may state another
    number than there is, for broken files.
    """
    n = len(columns[0][4]) if columns else 0
    heads, offset, parts = [], 0, []
    for name, kind, unit, desc, values in columns:
        dtype = np.dtype(TYPES[_CODES[kind]][1])
        flat = np.asarray(values).astype(dtype).reshape(n, -1) if n else np.zeros((0, 1), dtype)
        heads.append(struct.pack("<3i4x32s64s32s", _CODES[kind], offset, flat.shape[1], name.encode(), desc.encode(), unit.encode()))
        parts.append(np.ascontiguousarray(flat).view(np.uint8).reshape(n, flat.shape[1] * dtype.itemsize))
        offset += flat.shape[1] * dtype.itemsize
    vars_at = HEADER + SUB
    yaml_at = vars_at + VAR * len(heads)
    data_at = yaml_at + len(yaml)
    main = struct.pack("<10i8x", version, 1, tick_rate, 0, yaml_at, len(yaml), len(heads), vars_at, 1, offset) + struct.pack("<ii8x", 0, data_at) * 4
    sub = struct.pack("<qddii", start_date, start, end, lap_count, n if records is None else records)
    body = np.concatenate(parts, axis=1).tobytes() if parts else b""
    return main + sub + b"".join(heads) + yaml + body
