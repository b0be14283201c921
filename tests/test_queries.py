"""The library's own queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone.plans import evidence_queries, file_queries, geometry_queries, numeric_queries, registry, voxel_queries

SF = "/root/testdata/sf0.001"
PARTS = (evidence_queries, file_queries, geometry_queries, numeric_queries, voxel_queries)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        at = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(value):
    return float(value) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


def order(row):
    return [f"{x + 0.0:.5g}" if isinstance(x, float) else str(x) for x in row]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", [n for p in PARTS for n in p.QUERIES])
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    found = tables.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = [tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()]
    assert sorted(columns) == sorted(got.columns) and len(rows) == len(want)
    for a, b in zip(*(sorted((tuple(map(plain, r)) for r in x), key=order) for x in (rows, want)), strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-7) for x, y in zip(a, b, strict=True)), (a, b)
