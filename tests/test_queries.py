"""Registered queries against their SQL, and the guard around the corpus operators."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from lapforge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cursor = sql.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr([dict(zip(names, r))[c] for c in columns]) for r in cursor.fetchall())


def test_every_query_is_checked():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in ("__spark_entry__.py", "lapforge"):
        subprocess.run(["cp", "-r", f"{root}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "lapforge" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
