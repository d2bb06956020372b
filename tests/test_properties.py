"""Properties of the binary layout on generated logs, without Spark."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lapforge.sources.datasource import chosen, decode, timecodes
from lapforge.sources.encode import encode
from lapforge.sources.layout import TYPES, InMemory, parse, session_yaml
from lapforge.sources.session import derived, scanned

LIMITS = {"char": (0, 255), "bool": (0, 1), "int": (-(1 << 31), (1 << 31) - 1), "bitfield": (0, (1 << 32) - 1)}


@st.composite
def logs(draw):
    n = draw(st.integers(0, 20))
    columns = [("SessionTime", "double", "s", "", [float(i) for i in range(n)])]
    for i in range(draw(st.integers(0, 6))):
        kind = draw(st.sampled_from([name for name, _ in TYPES.values()]))
        value = st.integers(*LIMITS[kind]) if kind in LIMITS else st.floats(width=32 if kind == "float" else 64, allow_nan=False)
        columns.append((f"c{i}", kind, "u", "d", draw(st.lists(value, min_size=n, max_size=n))))
    return n, columns


@settings(max_examples=60, deadline=None)
@given(logs(), st.binary(max_size=40))
def test_what_is_written_is_read(log, tail):
    n, columns = log
    data = encode(columns, b"\0---\nA: 1\n\0\0") + tail
    layout = parse(InMemory(data))
    assert layout.record_count == n and layout.yaml == "---\nA: 1\n"
    variables = chosen(layout, None, False)
    assert [v.name for v in variables] == [c[0] for c in columns]
    raw = data[layout.data_offset : layout.data_offset + n * layout.record_length]
    batch = decode(raw, layout, variables, "f", 5)
    assert batch.column(1).to_pylist() == list(range(5, 5 + n))
    for (name, kind, _, _, values), got in zip(columns, batch.columns[3:]):
        assert got.to_pylist() == ([bool(v) for v in values] if kind == "bool" else values), name


@settings(max_examples=200, deadline=None)
@given(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False))
def test_times_round_half_away_from_zero(seconds):
    exact = Decimal(seconds * 1000).quantize(Decimal(1), ROUND_HALF_UP)
    assert timecodes(np.array([seconds]))[0] == int(exact)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_any_session_text_is_taken(raw):
    text = session_yaml(raw)
    assert isinstance(scanned(text), dict) and isinstance(derived(text), dict)


def test_time_limits():
    assert timecodes(np.array([math.nan, 1e300, -1e300])).tolist() == [0, (1 << 63) - 1, -(1 << 63)]
