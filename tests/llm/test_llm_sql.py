"""Registered queries of the training-data operators against their SQL, on whole tables."""

import duckdb
import pytest
from helpers import SMALL

from pulseyard.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SMALL))
    cursor = duck.execute(ORACLE[name])
    columns = sorted(d[0] for d in cursor.description)
    assert sorted(df.columns) == columns
    place = {d[0]: i for i, d in enumerate(cursor.description)}
    wanted = sorted(repr(tuple(row[place[c]] for c in columns)) for row in cursor.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == wanted


NATIVE = ("op1_mix_sources", "op2_quality_rules", "op4_license_scan", "op5_exact_dedup", "op8_secret_scan", "op9_chat_format", "op12_benchmark_decontamination")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plan(spark, name):
    plan = QUERIES[name](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
