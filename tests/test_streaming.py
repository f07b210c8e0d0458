import json

import pytest
from pyspark.sql import functions as F

from pulseyard.operators import ingest, registry, subscriptions, timeseries
from pulseyard.streaming import heartbeats as stream
from pulseyard.streaming import subscriptions as counters
from test_ingest import CASES
from test_registry import make_beats
from test_subscriptions import fold, make_events
from test_timeseries import beats_with_servers


def land(df, path, parts=3):
    """Write rows in order as several files, one after the other, since files are read by age."""
    size = df.count() // parts + 1
    for part in range(parts):
        rows = df.filter(F.floor(F.col("seq") / size) == part).coalesce(1)
        rows.write.mode("append").parquet(str(path))
    return str(path)


def read(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, mode, name):
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    writer.start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_ingest_writes_both_tables_once(spark, tmp_path):
    rows = [(json.dumps(doc), "203.0.113.9", i) for i, (doc, _) in enumerate(CASES.values())]
    raw = spark.createDataFrame(rows, "body string, remote_ip string, seq bigint").withColumn(
        "received_at", F.timestamp_seconds("seq")
    )
    raw.repartition(3).write.json(str(tmp_path / "in"))
    valid, bad, checkpoint = (str(tmp_path / n) for n in ("valid", "bad", "cp"))
    for _ in range(2):  # the second run finds nothing new
        source = stream.read_raw_stream(spark, str(tmp_path / "in"), max_files=1)
        stream.ingest_stream(source, valid, bad, checkpoint).trigger(availableNow=True).start().awaitTermination(180)
    good_batch = {r.seq for r in ingest.accepted(ingest.validate_heartbeats(raw)).select("seq").collect()}
    good = [r.seq for r in spark.read.parquet(valid).select("seq").collect()]
    rejected = [r.seq for r in spark.read.parquet(bad).select("seq").collect()]
    assert sorted(good) == sorted(good_batch)
    assert sorted(good + rejected) == list(range(len(CASES)))


def test_registry_equals_batch(spark, tmp_path):
    beats = beats_with_servers(spark, make_beats(6))
    source = read(spark, beats, land(beats, tmp_path / "in"))
    got = run(stream.registry_stream(source), "complete", "registry_out")
    assert sorted(map(str, got.collect())) == sorted(map(str, registry.upsert_latest(beats).collect()))


def test_closed_sessions_equal_batch(spark, tmp_path):
    beats = beats_with_servers(spark, make_beats(7, span=9000))
    source = read(spark, beats, land(beats, tmp_path / "in"))
    got = {tuple(r) for r in run(stream.session_stream(source), "append", "sessions_out").collect()}
    batch = {(r.id, r.start, r.end, r.heartbeats) for r in registry.online_sessions(beats).collect()}
    newest = beats.agg(F.max("t")).first()[0]
    assert got <= batch
    assert {s for s in batch if s[2] < newest - 60} <= got


@pytest.mark.parametrize("sweep", [300, 0])
def test_closed_census_ticks_equal_batch(spark, tmp_path, sweep):
    beats = beats_with_servers(spark, make_beats(8, rows=300, span=6000))
    source = read(spark, beats, land(beats, tmp_path / "in"))
    got = {tuple(r) for r in run(stream.census_stream(source, sweep=sweep), "append", f"census_{sweep}").collect()}
    batch = {
        (r.tick, r.clients, r.instances, r.servers) for r in timeseries.census_at_ticks(beats, sweep=sweep).collect()
    }
    newest = beats.agg(F.max("t")).first()[0]
    assert got <= batch
    assert {t for t in batch if t[0] < newest - 2 * (60 + sweep + 60) - 60} <= got


def test_counts_carry_over_batches(spark, tmp_path):
    rows = sorted(make_events(11, 300), key=lambda r: (r[1], r[0]))
    start = {"hot": 1, "a": 0, "b": 2, "c": 0, "d": 0}
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "event_id bigint, t bigint, event_type string, plan_id string, seq bigint")
    events = frame.withColumn("ts", F.timestamp_seconds("t"))
    counts = str(tmp_path / "counts")
    meta = spark.createDataFrame(list(start.items()), "plan_id string, subscription_count bigint")
    meta.write.parquet(f"{counts}/batch=-1")
    # One landing folder per batch, so that the order between batches is the order of events.
    (tmp_path / "in").mkdir()
    for part in range(3):
        events.filter(F.col("seq") % 300 >= part * 100).filter(F.col("seq") < (part + 1) * 100).select(
            "event_id", "ts", "event_type", "plan_id"
        ).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = counters.read_event_stream(spark, str(tmp_path / "in"))
        query = counters.counter_stream(source, counts, str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    expected, _, _ = fold(rows, start)
    assert {r.plan_id: r.subscription_count for r in spark.read.parquet(f"{counts}/batch=2").collect()} == expected
    assert subscriptions.plan_subscription_count(events, meta).count() == len(start)


def test_history_sink_appends(spark, tmp_path):
    beats = beats_with_servers(spark, make_beats(9, rows=200, span=4000))
    source = read(spark, beats, land(beats, tmp_path / "in"))
    out = str(tmp_path / "history")
    sink = stream.history_sink(stream.census_stream(source), out, str(tmp_path / "cp"))
    sink.trigger(availableNow=True).start().awaitTermination(120)
    batch = {tuple(r) for r in timeseries.census_at_ticks(beats).select("tick", "clients", "instances", "servers").collect()}
    got = {tuple(r) for r in spark.read.parquet(out).select("tick", "clients", "instances", "servers").collect()}
    assert got and got <= batch


def land_by_time(beats, path, parts=4):
    """Files of one span of time each, in order."""
    newest = beats.agg(F.max("t")).first()[0] + 1
    for part in range(parts):
        low, high = newest * part // parts, newest * (part + 1) // parts
        beats.filter((F.col("t") >= low) & (F.col("t") < high)).coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


@pytest.mark.parametrize("expiry, sweep", [(60, 300), (90, 0)])
def test_registry_changes_expire(spark, tmp_path, expiry, sweep):
    """After every trigger the changes make the batch registry at the watermark, and silent instances leave the state."""
    beats = beats_with_servers(spark, make_beats(31, ids=12, rows=120, span=6000)).select("id", "received_at", "seq", "payload", "t")
    source = read(spark, beats, land_by_time(beats, tmp_path / "in"))
    changes = stream.registry_changes(source.drop("t"), lateness=5, expiry=expiry, sweep=sweep)
    name = f"changes_{expiry}"
    query = changes.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(200)
    watermark = beats.agg(F.max("t")).first()[0] - 5
    schema = "id string, received_at timestamp, seq bigint, payload string"
    got = stream.registry_from_changes(spark.table(name), schema).collect()
    latest = registry.upsert_latest(beats).withColumn("last_heartbeat", F.col("t"))
    alive = registry.expire_stale(latest, watermark, expiry=expiry, sweep=sweep).join(registry.first_seen(beats, expiry=expiry, sweep=sweep), "id")
    wanted = {(r.id, r.payload, r.last_heartbeat, r.instance_seq) for r in alive.collect()}
    assert {(r.id, r.payload, r.last_heartbeat, r.instance_seq) for r in got} == wanted and wanted
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] == len(wanted) < beats.select("id").distinct().count()
    removed = spark.table(name).filter("not live")
    assert removed.count() > 0 and removed.filter("at <= last_heartbeat").count() == 0


def test_stored_registry_equals_batch(spark, tmp_path):
    """After every batch the table equals the batch registry over everything, also when a batch is replayed."""
    from pulseyard.streaming import registry_table as table

    beats = beats_with_servers(spark, make_beats(32, ids=20, rows=200, span=3000)).drop("t")
    schema = beats.schema
    path = str(tmp_path / "table")
    seconds = F.unix_seconds("received_at")
    written = []
    for k in range(4):
        batch = beats.filter((seconds >= 750 * k) & (seconds < 750 * (k + 1)))
        for _ in range(2 if k == 2 else 1):
            table.apply_batch(batch, k, path, buckets=8)
        written.append({r[0] for r in batch.select(table._bucket("id", 8)).distinct().collect()})
        now = 750 * (k + 1) - 1
        got = table.stored_registry(spark, path, k, schema, now).collect()
        wanted = registry.current_registry(beats, now, position=True).collect()
        assert {(r.id, r.payload, r.last_heartbeat, r.instance_seq) for r in got} == {(r.id, r.payload, r.last_heartbeat, r.instance_seq) for r in wanted}
    some = [r.id for r in wanted][:2]
    asked = table.stored_instances(spark, path, 3, schema, [*some, "nobody"], now, buckets=8)
    assert sorted(r.id for r in asked.collect()) == sorted(some)
    # A batch with one heartbeat rewrites one bucket, as long as no removal is due.
    one = spark.createDataFrame([("hot", 999_999, "late")], "id string, seq bigint, payload string")
    one = one.select("id", F.lit(0).cast("bigint").alias("x"), "seq", "payload").drop("x").withColumn("received_at", F.timestamp_seconds(F.lit(2999)))
    one = one.withColumn("servers", F.array().cast(schema["servers"].dataType)).select(*beats.columns)
    table.apply_batch(one, 4, path, buckets=8)
    import os

    assert len([d for d in os.listdir(f"{path}/rows/batch=4") if d.startswith("bucket=")]) == 1
    assert {r.payload for r in table.stored_registry(spark, path, 4, schema, 2999).filter("id = 'hot'").collect()} == {"late"}


def test_registry_table_stream(spark, tmp_path):
    from pulseyard.streaming import registry_table as table

    beats = beats_with_servers(spark, make_beats(33, ids=6, rows=80, span=2000))
    source = read(spark, beats, land_by_time(beats, tmp_path / "in", 3)).drop("t")
    path = str(tmp_path / "table")
    query = table.registry_table_stream(source, path, str(tmp_path / "cp"), buckets=4).trigger(availableNow=True).start()
    query.awaitTermination(200)
    now = beats.agg(F.max("t")).first()[0]
    got = table.stored_registry(spark, path, 2, source.schema, now).collect()
    wanted = registry.current_registry(beats.drop("t"), now, position=True).collect()
    assert {(r.id, r.payload, r.instance_seq) for r in got} == {(r.id, r.payload, r.instance_seq) for r in wanted}


def test_raw_events_are_parsed_once_and_counted_once(spark, tmp_path):
    body = lambda kind, plan: json.dumps({"event_type": kind, "content": {"subscription": {"plan_id": plan}}})
    rows = [(f"e{i}", 100 + i, body("subscription_created", f"p{i % 3}")) for i in range(12)]
    rows += rows[:5] + [(None, 103, body("subscription_created", "p0")), (None, 104, body("subscription_created", "p0"))]
    rows += [("bad", 110, "plan=1"), ("none", 111, None), ("list", 112, "[1]"), ("typeless", 113, '{"content": {}}'), ("bad", 114, "plan=1")]
    raw = spark.createDataFrame(rows, "event_id string, t bigint, body string").select("event_id", F.timestamp_seconds("t").alias("received_at"), "body")
    (tmp_path / "in").mkdir()
    raw.repartition(3).write.mode("append").json(str(tmp_path / "in"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for _ in range(2):  # the second run finds nothing new
        source = counters.read_raw_event_stream(spark, str(tmp_path / "in"), max_files=1)
        counters.raw_event_stream(source, good, bad, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    events = spark.read.parquet(good).collect()
    assert sorted(r.event_id or "-" for r in events) == sorted([*(f"e{i}" for i in range(12)), "-", "-"])
    rejected = {r.event_id: r for r in spark.read.parquet(bad).collect()}
    assert set(rejected) == {"bad", "none", "list", "typeless"} and spark.read.parquet(bad).count() == 4
    assert rejected["typeless"].error == "event_type is required" and rejected["bad"].body == "plan=1"


def test_late_events_fold_right(spark, tmp_path):
    """Batches in any order of time; the kept pairs give the counts of one fold over everything."""
    rows = make_events(35, 300)
    start = {"hot": 1, "a": 0, "b": 2, "c": 0, "d": 0}
    frame = spark.createDataFrame(rows, "event_id bigint, t bigint, event_type string, plan_id string").withColumn("ts", F.timestamp_seconds("t"))
    (tmp_path / "in").mkdir()
    for k in (2, 0, 1):
        frame.filter(F.col("t") % 3 == k).select("event_id", "ts", "event_type", "plan_id").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = counters.read_event_stream(spark, str(tmp_path / "in"))
        counters.pair_stream(source, str(tmp_path / "pairs"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    expected, _, _ = fold(rows, start)
    meta = spark.createDataFrame(list(start.items()), "plan_id string, subscription_count bigint")
    assert {r.plan_id: r.subscription_count for r in counters.stored_counts(spark, str(tmp_path / "pairs"), meta).collect()} == expected


def test_statistics_kept_up_equal_recompute(spark, tmp_path):
    """After every batch, with removals and a replay, the stored statistics equal those of the whole history."""
    from pulseyard.plans import bindings as b
    from pulseyard.plans import pages
    from pulseyard.streaming import registry_table as table

    beats = b.heartbeats(spark, "/root/testdata/sf0.001").cache()
    seconds, schema, path = F.unix_seconds("received_at"), beats.schema, str(tmp_path / "table")
    low, high = beats.agg(F.min(seconds), F.max(seconds)).first()
    settings = {"buckets": 4, "expiry": 86_400, "sweep": 7_200}
    sizes = []
    for k in range(4):
        batch = beats.filter((seconds >= low + (high - low) * k / 8) & (seconds < low + (high - low) * (k + 1) / 8))
        for _ in range(2 if k == 1 else 1):
            changed = table.apply_batch(batch, k, path, **settings)
            current = table._read_buckets(spark, path, table._places(spark, path, k), table._full(spark, schema))
            table.apply_statistics(changed, current, k, path)
        now = batch.agg(F.max(seconds)).first()[0]
        wanted = pages.stats(beats.filter(seconds <= now), now, 86_400, 7_200)
        assert sorted(map(str, table.stored_statistics(spark, path, k).collect())) == sorted(map(str, wanted.collect()))
        sizes.append(current.count())
    assert 0 < min(sizes) < beats.select("id").distinct().count()  # some were removed
