"""Every query that SQL can express, against DuckDB on the same small tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return sorted(repr([round(v[i], 9) if isinstance(v[i], float) else v[i] for i in at]) for v in values)


def oracle_names():
    from traceguard.llm.registry import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", oracle_names())
def test_matches_sql(spark, name):
    import duckdb

    from traceguard.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
