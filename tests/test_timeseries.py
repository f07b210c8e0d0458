import math
import random

import pytest
from pyspark.sql import functions as F

from pulseyard.operators import timeseries
from test_registry import make_beats


def beats_with_servers(spark, rows):
    df = spark.createDataFrame(rows, "id string, t bigint, seq bigint, payload string")
    servers = F.transform(
        F.slice(F.array(*[F.lit(i) for i in range(3)]), F.lit(1), (F.col("seq") % 4).cast("int")),
        lambda j: F.struct(((F.col("seq") + j) % 9).cast("int").alias("clientnum")),
    )
    return df.withColumn("received_at", F.timestamp_seconds("t")).withColumn("servers", servers)


def simulate_census(rows, tick, expiry, sweep):
    """Brute force: at each tick the newest beat of each id at or before it, unless purged."""
    out = {}
    for at in range(0, max(r[1] for r in rows) + expiry + sweep + 2 * tick, tick):
        latest = {}
        for key, t, seq, _ in rows:
            if t <= at:
                latest[key] = max(latest.get(key, (-1, -1)), (t, seq))
        alive = []
        for t, seq in latest.values():
            gone = t + expiry + 1 if sweep == 0 else ((t + expiry) // sweep + 1) * sweep
            if gone > at:
                alive.append(seq)
        if alive:
            clients = sum((s + j) % 9 for s in alive for j in range(s % 4))
            out[at] = (clients, len(alive), sum(s % 4 for s in alive))
    return out


@pytest.mark.parametrize("tick, expiry, sweep", [(30, 60, 300), (30, 60, 0), (100, 20, 50), (7, 90, 30)])
def test_census_equals_brute_force(spark, tick, expiry, sweep):
    rows = make_beats(4, rows=120, span=3000)
    got = timeseries.census_at_ticks(beats_with_servers(spark, rows), tick=tick, expiry=expiry, sweep=sweep).collect()
    expected = simulate_census(rows, tick, expiry, sweep)
    assert {r.tick: (r.clients, r.instances, r.servers) for r in got} == expected
    dense = timeseries.census_at_ticks(
        beats_with_servers(spark, rows), tick=tick, expiry=expiry, sweep=sweep, dense=True
    ).collect()
    grid = range(min(expected), max(expected) + 1, tick)
    assert {r.tick: (r.clients, r.instances, r.servers) for r in dense} == {t: expected.get(t, (0, 0, 0)) for t in grid}


def history(spark, series):
    rows = [(m, t, c) for m, samples in series.items() for t, c in samples]
    return spark.createDataFrame(rows, "metric string, t bigint, count bigint").select(
        "metric", F.timestamp_seconds("t").alias("time"), "count"
    )


def random_series(seed, n):
    """Sorted samples with many duplicates of the same time, half of all at one time."""
    rng = random.Random(seed)
    samples = [(rng.randrange(10 * 86400), rng.randrange(4)) for _ in range(n - n // 2)]
    samples += [(5 * 86400 + 7, 0)] * (n // 2)
    return sorted(samples)


def taken(df):
    out = {}
    for r in df.select("metric", F.unix_seconds("time").alias("t"), "count").collect():
        out.setdefault(r.metric, []).append((r.t, r["count"]))
    return {m: sorted(v) for m, v in out.items()}


@pytest.mark.parametrize("keep", [1, 77, 500, 501, 10_000])
def test_retain_equals_list_tail(spark, keep):
    series = {m: random_series(i, 500) for i, m in enumerate(("client", "instance", "server"))}
    got = taken(timeseries.retain_last_n(history(spark, series), keep))
    assert got == {m: samples[-keep:] for m, samples in series.items()}


@pytest.mark.parametrize("start, points", [(0, 500), (0, 50), (37, 50), (499, 7), (500, 7), (900, 7), (3, 1)])
def test_slice_equals_python_slicing(spark, start, points):
    series = {"client": random_series(1, 480), "instance": random_series(2, 500), "server": random_series(3, 700)}
    stride = max(1, math.ceil((500 - start) / points))
    got = timeseries.slice_stride(history(spark, series), start, points)
    picked = {}
    for r in got.select("metric", "idx", F.unix_seconds("time").alias("t"), "count").collect():
        picked.setdefault(r.metric, []).append((r.idx, r.t, r["count"]))
    expected = {
        m: [(i, *samples[i]) for i in range(len(samples))[start::stride]] for m, samples in series.items()
    }
    assert {m: sorted(v) for m, v in picked.items()} == {m: v for m, v in expected.items() if v}


@pytest.mark.parametrize("n, start", [(0, 0), (1, 0), (500, 0), (501, 0), (501, 501), (501, 100), (501, 400), (20, 30)])
def test_zoom_points(spark, n, start):
    series = {"instance": [(30 * i, 1) for i in range(n)], "client": [(0, 1)]}
    row = timeseries.zoom_points(history(spark, series), start).first()
    assert row.total == n and row.stride == max(1, math.ceil((n - start) / 500))
    assert row.next_zoom_point == start + math.ceil((n - start) / 2)
    assert row.previous_zoom_point == (0 if start == n else max(0, start - math.ceil(n - start)))


@pytest.mark.parametrize("age, zeros", [(0, 0), (1, 1), (30, 1), (31, 2), (3000, 100), (-5, 0)])
def test_fill_after_stop(spark, age, zeros):
    series = {m: [(0, 4), (1000, 5)] for m in ("client", "instance", "server")}
    full = timeseries.fill_after_stop(history(spark, series), 1000 + age)
    slots = [(1000 + 30 * (k + 1), 0) for k in range(zeros)]
    assert taken(full) == {m: v + slots for m, v in series.items()}
    stamped = timeseries.fill_after_stop(history(spark, series), 1000 + age, stamp="now")
    assert taken(stamped)["client"] == sorted(series["client"] + [(1000 + age, 0)] * zeros)


def test_fill_after_stop_without_history(spark):
    assert timeseries.fill_after_stop(history(spark, {"client": [(0, 1)]}), 1000).count() == 1


def test_fill_gaps(spark):
    series = {"client": [(0, 3), (30, 4), (120, 5), (125, 6), (180, 7)], "server": [(600, 1)]}
    got = taken(timeseries.fill_gaps(history(spark, series)))
    assert got["client"] == [(0, 3), (30, 4), (60, 0), (90, 0), (120, 5), (125, 6), (150, 0), (180, 7)]
    assert got["server"] == [(600, 1)]


def test_fill_gaps_over_a_long_gap(spark):
    got = timeseries.fill_gaps(history(spark, {"client": [(0, 1), (30 * 50_000, 2)]}))
    assert got.count() == 50_001 and got.select("time").distinct().count() == 50_001


def test_append_and_last_value(spark):
    start = history(spark, {"client": [(0, 3), (30, 4)]})
    samples = spark.createDataFrame([(60.9, 9)], "t double, count bigint").select(F.timestamp_seconds("t").alias("time"), "count")
    grown = timeseries.append_sample(start, samples, "client")
    assert taken(grown)["client"] == [(0, 3), (30, 4), (60, 9)]
    assert taken(timeseries.append_sample(start, samples, "client", override_time=45))["client"][-1] == (45, 9)
    assert timeseries.last_value(grown).first().asDict() == {"client_count": 9, "instance_count": 0, "server_count": 0}
    assert timeseries.last_value(grown.filter("false")).first().client_count == 0


def test_series_labels_leave_servers_out(spark):
    series = {m: [(0, 1), (3000, 2)] for m in ("client", "instance", "server")}
    plotted = timeseries.history_series(timeseries.slice_stride(history(spark, series)), now=3600)
    assert {r.metric for r in plotted.collect()} == {"client", "instance"}
    assert timeseries.first_label(plotted).first().label == "1 hour ago"
