"""Every registered query that has a DuckDB form against it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from palimpsest.plans import assembled, library, lifecycle, listings, reads, registry, runs, upkeep, written  # noqa: F401  the others add to the registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.ORACLE)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, want.fetchall()))
