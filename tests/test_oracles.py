"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from glintframe import queries_detector, queries_more  # noqa: F401  (register their queries)
from glintframe.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    made = QUERIES[name](spark, DATA)
    columns = sorted(made.columns)
    got = sorted(map(tuple, made.select(*columns).collect()))
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    want = sorted(found.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-6)
