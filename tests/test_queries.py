"""Every query with SQL against DuckDB on the smallest data."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def cell(x):
    return None if x is None or x != x else x


def rows(columns, found) -> list[tuple]:
    """Rows in order of what isn't a fraction, then of fractions without their last digits, so that a key's rows of both sides stand in one place."""
    at = sorted(range(len(columns)), key=columns.__getitem__)
    exact = lambda x: (0, "") if x is None else (2, "") if isinstance(x, float) else (1, repr(x))
    rough = lambda x: format(x + 0.0, ".4e") if isinstance(x, float) else ""
    return sorted((tuple(cell(r[i]) for i in at) for r in found), key=lambda r: ([exact(x) for x in r], [rough(x) for x in r]))


def same(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    pairs = zip(rows(got.columns, got.collect()), rows(want.columns, want.fetchall()), strict=True)
    assert all(same(x, y) for a, b in pairs for x, y in zip(a, b, strict=True))
