"""Every catalogue query with SQL against an independent engine."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from loregrain.plans import catalogue, stateful, workflows

PLANS = catalogue, workflows, stateful
QUERIES, ORACLES = ({k: v for p in PLANS for k, v in getattr(p, name)().items()} for name in ("queries", "oracle_sql"))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.5f}"
    return "null" if value is None else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert mine == sorted(tuple(plain(v) for v in row) for row in want)
