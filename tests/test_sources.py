import json

from pyspark.sql import functions as F

from pulseyard.operators import timeseries
from pulseyard.sources import readers, writers

INSTANCE = {"id": "a", "version": "1", "uptime": 1, "ip_address": "9.9.9.9", "webfront_url": None, "last_heartbeat": 3}


def test_snapshot_array_last_wins(spark, tmp_path):
    path = tmp_path / "dump.json"
    first, second = dict(INSTANCE, servers=[]), dict(INSTANCE, uptime=2, servers=[])
    path.write_text(json.dumps([first, dict(first, id="b"), second, dict(first, id="bad", uptime=-1)], indent=1))
    rows = readers.read_snapshot(spark, str(path)).collect()
    assert {r.id: (r.uptime, r.ip_address) for r in rows} == {"a": (2, "9.9.9.9"), "b": (1, "9.9.9.9")}


def test_heartbeat_lines(spark, tmp_path):
    (tmp_path / "remote_ip=9.9.9.9").mkdir()
    (tmp_path / "remote_ip=9.9.9.9" / "x.json").write_text('{"id":"a"}\n{"id":"b"}\n')
    rows = readers.read_heartbeats(spark, str(tmp_path)).collect()
    assert sorted((r.body, r.remote_ip) for r in rows) == [('{"id":"a"}', "9.9.9.9"), ('{"id":"b"}', "9.9.9.9")]
    assert all(r.received_at is not None for r in rows)


def test_history_file(spark, tmp_path):
    assert readers.read_history_json(spark, str(tmp_path / "none.json")).count() == 0
    empty = tmp_path / "empty.json"
    empty.write_text("")
    assert readers.read_history_json(spark, str(empty)).count() == 0
    saved = tmp_path / "history.json"
    saved.write_text(json.dumps({"client_history": [{"count": 5, "time": 60}], "instance_history": [], "server_history": [{"count": 1, "time": 30}]}))
    rows = readers.read_history_json(spark, str(saved)).select("metric", F.unix_seconds("time").alias("t"), "count").collect()
    assert sorted(map(tuple, rows)) == [("client", 60, 5), ("server", 30, 1)]


def test_history_round_trip_replaces(spark, tmp_path):
    history = spark.createDataFrame([("client", 0, 1), ("server", 30, 2)], "metric string, t bigint, count bigint").select(
        "metric", F.timestamp_seconds("t").alias("time"), "count"
    )
    path = str(tmp_path / "history")
    writers.write_history(history, path)
    writers.write_history(history.filter("metric = 'client'"), path)
    assert [r["count"] for r in spark.read.parquet(path).collect()] == [1]


def test_versions_and_instances_round_trip(spark, tmp_path):
    config = spark.createDataFrame([(0, "1", "2"), (1, "3", "4")], "api_version int, current_version_stable string, current_version_prerelease string")
    writers.write_versions(config, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v")).filter("api_version = 1").first()
    assert back.current_version_stable == "3"
    writers.write_instances(config, str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i")).count() == 2


def test_quarantine_table(spark, tmp_path):
    bad = spark.createDataFrame([("x", 86400), ("y", 10)], "body string, t bigint").select("body", F.timestamp_seconds("t").alias("received_at"))
    writers.write_quarantine(bad, str(tmp_path / "q"))
    assert {str(r.day) for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {"1970-01-01", "1970-01-02"}


def test_meta_get_and_set(spark):
    table = spark.createDataFrame([("p1", 1), ("p2", 2)], "plan_id string, subscription_count bigint")
    changes = spark.createDataFrame([("p2", 9), ("p3", 3)], table.schema)
    assert sorted(map(tuple, writers.meta_set(table, changes).collect())) == [("p1", 1), ("p2", 9), ("p3", 3)]
    assert readers.meta_get(table, "p2").first().subscription_count == 2 and readers.meta_get(table).count() == 2


def test_event_bodies(spark):
    good = json.dumps({"event_type": "subscription_created", "content": {"subscription": {"plan_id": "p"}}})
    raw = spark.createDataFrame([(1, good), (2, "plan=1"), (3, None), (4, "[1]"), (5, "{}")], "event_id bigint, body string")
    rows = {r.event_id: r for r in readers.parse_subscription_events(raw).collect()}
    assert (rows[1].event_type, rows[1].plan_id, rows[1].error) == ("subscription_created", "p", None)
    assert all(rows[i].error == "request body must be json" for i in (2, 3, 4))
    # An object without an event type is no event.
    assert rows[5].error == "event_type is required" and rows[5].event_type is None


def test_lines_reach_the_registry(spark, tmp_path):
    """Reader to registry: of two heartbeats in one file the later line wins."""
    from pulseyard.operators import ingest, registry

    lines = [json.dumps({"id": "a", "version": "1", "uptime": n, "servers": []}) for n in range(50)]
    (tmp_path / "beats.json").write_text("\n".join(lines))
    raw = readers.read_heartbeats(spark, str(tmp_path), remote_ip="9.9.9.9")
    assert [r.seq for r in raw.collect()] == sorted({r.seq for r in raw.collect()})
    good, _ = ingest.reject_quarantine(raw)
    assert [r.uptime for r in registry.upsert_latest(good).collect()] == [49]


def test_census_to_history(spark):
    census = spark.createDataFrame([(30, 5, 2, 3)], "tick bigint, clients bigint, instances bigint, servers bigint")
    rows = timeseries.census_to_history(census).collect()
    assert {r.metric: r["count"] for r in rows} == {"client": 5, "instance": 2, "server": 3}
