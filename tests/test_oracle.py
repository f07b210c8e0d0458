"""Every registered query against its SQL in DuckDB, on whole tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from pulseyard.plans.oracle import ORACLE
from pulseyard.plans.registered import QUERIES

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in places)) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(map(tuple, df.collect()), df.columns) == ordered(cursor.fetchall(), columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "segment" and df.count() > 0
