from __future__ import annotations

import random

import duckdb
import pytest
import xxhash

from lapforge.llm import sql


@pytest.mark.parametrize("seed", [0, 42, (1 << 64) - 1])
def test_xxh64_in_sql(seed):
    """Every tail of 0 to 31 bytes, with and without stripes, in texts of all widths of UTF-8."""
    draw = random.Random(seed)
    texts = ["".join(draw.choice("abcé ñ漢z😀\n") for _ in range(n)) for n in [*range(90), 500, 3000]]
    con = duckdb.connect()
    con.execute("create table given (k int, t varchar)")
    con.executemany("insert into given values (?, ?)", list(enumerate(texts)))
    asked = f"with u as (select k, {sql.reversed_hex('t')} as rv, {seed}::UHUGEINT as seed from given), {sql.xxh64('u', 'k', 'x')} select k, hash from x"
    assert dict(con.execute(asked).fetchall()) == {k: xxhash.xxh64_intdigest(t.encode(), seed) for k, t in enumerate(texts)}
