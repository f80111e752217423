"""Every registered query against its DuckDB oracle at sf0.01 (the
driver's correctness gate), and rows-only runs for the grouped-map and
learned models.  Values are compared after sorting columns by name and
rows, so plan order does not matter."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from qpanel.sources.tables import TABLES  # noqa: E402
from tools.oracle_check import rows_of, type_mismatches  # noqa: E402

SF = "/root/testdata/sf0.01"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "horizon", "n", "rmse", "log_rmse", "smape", "wmape"]
    assert df.count() >= 0


def test_every_query_has_a_docstring():
    for name, fn in QUERIES.items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert type_mismatches(sdf.dtypes, cur.description) == []
    assert rows_of(sdf.columns, srows) == rows_of(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
