"""Every registered query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quarry import registry

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    rel = duck.sql(registry.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
