"""Every registered query against its SQL on another engine, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cohortlane.oracle import ORACLE
from cohortlane.registered import QUERIES
from compare import table


@pytest.fixture(scope="module")
def con(folder):
    found = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, con, name):
    df = queries()[name](spark, folder)
    result = con.execute(oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 3
