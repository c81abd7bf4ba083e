"""Every registered query with an oracle matches DuckDB at sf0.001 (the
driver repeats this at sf0.01)."""

import pytest

from scripts.check_oracle import digest
from tests.conftest import SF_SMALL

import __spark_entry__ as E

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from bugroute.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(SQL[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns) == digest(drows, dcols)


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and 0.0 <= rows[0].accuracy <= 1.0
