"""Shapes of the physical plans that decide how the queries scale."""

import re

import pytest

from __spark_entry__ import queries
from pulseyard.plans import bindings as b
from pulseyard.plans.oracle import ORACLE
from pulseyard.plans.registered import QUERIES
from pulseyard.session import shared_folder

SMALL = "/root/testdata/sf0.001"


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def initial_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["count_by_key", "slice_stride"])
def test_total_shares_the_shuffle(spark, name):
    assert "ReusedExchange" in executed_plan(queries()[name](spark, SMALL))


def test_ranking_is_limited_before_the_shuffle(spark):
    plan = initial_plan(queries()["stats_all"](spark, SMALL))
    assert re.search(r"WindowGroupLimit.*Partial", plan) and "ReusedExchange" in executed_plan(queries()["stats_all"](spark, SMALL))
    assert "TakeOrderedAndProject" in initial_plan(queries()["count_by_key"](spark, SMALL))


def test_breakdown_aggregates_by_hash(spark):
    assert "SortAggregate" not in initial_plan(queries()["count_by_key"](spark, SMALL))
    assert "SortAggregate" not in initial_plan(queries()["game_summary"](spark, SMALL)).split("Generate")[0]


def test_filters_and_columns_reach_the_scan(spark):
    plan = initial_plan(b.subscriptions(spark, SMALL).filter("status = 'active'").select("customer_id"))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan
    latest = initial_plan(queries()["instance_count"](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", latest)


def test_ingestion_does_not_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    from pulseyard.operators import ingest

    path = str(tmp_path / "raw")
    b.heartbeat_bodies(spark, SMALL).write.parquet(path)
    good, bad = ingest.reject_quarantine(spark.read.parquet(path))
    for df in (good, bad):
        plan = initial_plan(df)
        assert "Exchange" not in plan
        # The body is parsed in one place, also below the filter on the errors.
        assert len(re.findall("parseJson", plan)) == 1
    assert good.count() + bad.count() == spark.read.parquet(path).agg(F.count("*")).first()[0]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("name", ["instance_count", "fleet_totals", "exists_by_key", "q_instances", "game_summary"])
def test_registry_without_position_reads_no_past(spark, name):
    plan = initial_plan(queries()[name](spark, SMALL))
    assert plan.count("events.parquet") == 1 and "_cell" not in plan


@pytest.mark.parametrize("name", ["upsert_latest", "token_registry", "expire_stale"])
def test_newest_rows_by_hash(spark, name):
    plan = initial_plan(queries()[name](spark, SMALL))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_newest_rows_read_narrow_columns_first(spark, tmp_path):
    from pulseyard.operators import registry

    path = str(tmp_path / "beats")
    b.heartbeats(spark, SMALL).write.parquet(path)
    plan = initial_plan(registry.upsert_latest(spark.read.parquet(path)).select("id", "version"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "id:string,received_at:timestamp,seq:bigint" in schemas
    assert all("servers" not in s and "uptime" not in s for s in schemas)


def test_age_bound_reaches_the_scan(spark):
    plan = initial_plan(queries()["expire_stale"](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan)


def test_census_shuffle_does_not_grow_with_the_expiry(spark):
    from pulseyard.operators import timeseries

    beats = b.heartbeats(spark, SMALL)
    # One instance each, so that nothing replaces a heartbeat and it lives for the whole expiry.
    beats = beats.withColumn("id", beats.seq.cast("string")).cache()
    moved = []
    for expiry in (7_200, 720_000):
        spark.sparkContext.setJobGroup(f"census {expiry}", "census")
        df = timeseries.census_at_ticks(beats, tick=60, expiry=expiry, sweep=0)
        df.write.format("noop").mode("overwrite").save()
        tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(f"census {expiry}") for s in tracker.getJobInfo(j).stageIds}
        moved.append(sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages))
    spark.sparkContext.setJobGroup("other", "other")
    assert moved[1] <= 1.5 * moved[0]


def test_history_is_put_in_order_by_cell(spark):
    """No window over runs takes a whole series or a day of it, and the page writes nothing on the way."""
    for name in ("retain_last_n", "slice_stride", "q_history"):
        plan = initial_plan(queries()[name](spark, SMALL))
        assert re.search(r"windowspecdefinition\(metric#\d+, cell#\d+L?, t#\d+L? ASC", plan) or "cell" in plan
        assert "Scan ExistingRDD" not in plan


@pytest.mark.parametrize("name", ["sort_by_game", "sort_by_players"])
def test_no_window_holds_a_game(spark, name):
    plan = initial_plan(queries()[name](spark, SMALL))
    assert re.search(r"windowspecdefinition\(game#\d+, (?:clientnum#\d+L?, )?_part", plan)


def test_gaps_are_filled_in_the_whole_census(spark, tmp_path):
    """Two heartbeats a day apart: 41 slots of ten minutes each, night hours included, and zeros between them."""
    events = [(1, 1_704_078_600, 7, "view", 5.0, '{"k": 1}'), (5, 1_704_165_000, 7, "view", 6.0, '{"k": 1}')]
    schema = "event_id bigint, ts bigint, user_id bigint, event_type string, value double, props string"
    rows = spark.createDataFrame(events, schema).selectExpr("event_id", "timestamp_seconds(ts) AS ts", "user_id", "event_type", "value", "props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    filled = {}
    for r in queries()["fill_gaps"](spark, str(tmp_path)).collect():
        filled.setdefault(r.metric, []).append((r["time"], r["count"]))
    counts = {metric: [count for _, count in sorted(series)] for metric, series in filled.items()}
    assert counts == {
        "client": [5] * 41 + [0] * 103 + [6] * 41,
        "instance": [1] * 41 + [0] * 103 + [1] * 41,
        "server": [1] * 41 + [0] * 103 + [1] * 41,
        "view": [1] + [0] * 143 + [1],
    }


def test_accepted_heartbeats_compute_only_what_is_asked_for(spark):
    """The repairs of addresses, 65 servers in some rows, cost more than the tests; most queries need none of them."""

    def plan(query):
        return queries()[query](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()

    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        assert ":1624" in plan("stamp_sender")  # the address of a sender that gives none
        assert ":1624" not in plan("stamp_received")
        assert ":1624" not in plan("apply_defaults")
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
