"""The registry: every catalogued query against DuckDB on the smallest tables, where those are present."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from tabulon.plans.catalogue import TABLES, oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries()))
def test_against_duckdb(spark, name):
    import duckdb

    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries()[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(cell(v) for v in r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    theirs = base.sql(oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert ours == sorted((tuple(cell(v) for v in r) for r in base.sql(f"SELECT {picked} FROM ({oracle_sql()[name]}) q").fetchall()), key=repr)
