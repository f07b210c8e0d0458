import random

import pytest
from pyspark.sql import functions as F

from pulseyard.operators import nested, registry

BEATS = "id string, t bigint, seq bigint, payload string"


def make_beats(seed, ids=4, rows=400, span=4000):
    rng = random.Random(seed)
    times = sorted(rng.randrange(span) for _ in range(rows))
    # The first instance sends half of everything.
    names = ["hot" if rng.random() < 0.5 else f"i{rng.randrange(ids)}" for _ in times]
    return [(name, t, seq, f"p{seq}") for seq, (name, t) in enumerate(zip(names, times))]


def frame(spark, rows):
    return spark.createDataFrame(rows, BEATS).withColumn("received_at", F.timestamp_seconds("t"))


def simulate(rows, now, expiry, sweep):
    """The registry as a dict with a sweep before the beats of each second."""
    current, lives = {}, []
    by_second = {}
    for row in rows:
        by_second.setdefault(row[1], []).append(row)
    for second in range(0, now + 1):
        due = second % sweep == 0 if sweep else True
        if due:
            for key in [k for k, v in current.items() if second - v[1] > expiry]:
                del current[key]
        for row in by_second.get(second, []):
            opening = current[row[0]][4] if row[0] in current else row[2]
            current[row[0]] = (*row, opening)
    return current


@pytest.mark.parametrize("expiry, sweep", [(60, 300), (60, 0), (20, 50), (90, 30)])
@pytest.mark.parametrize("now", [1500, 2101, 4000])
def test_current_registry_equals_simulation(spark, expiry, sweep, now):
    rows = make_beats(1)
    got = registry.current_registry(frame(spark, rows), now, expiry=expiry, sweep=sweep, position=True).collect()
    expected = simulate(rows, now, expiry, sweep)
    assert {r.id: (r.payload, r.last_heartbeat, r.instance_seq) for r in got} == {
        k: (v[3], v[1], v[4]) for k, v in expected.items()
    }


def test_expiry_is_strict(spark):
    rows = [("a", 940, 0, ""), ("b", 939, 1, "")]
    current = frame(spark, rows).withColumn("last_heartbeat", F.col("t"))
    alive = registry.expire_stale(current, 1000, expiry=60, sweep=0).collect()
    assert [r.id for r in alive] == ["a"]


@pytest.mark.parametrize("sweep", [0, 300])
def test_sessions_equal_sequential_split(spark, sweep):
    rows = make_beats(2, span=9000)
    expected = []
    for key in {r[0] for r in rows}:
        times = [r[1] for r in rows if r[0] == key]
        run = [times[0]]
        for t in times[1:]:
            gone = run[-1] + 61 if sweep == 0 else ((run[-1] + 60) // 300 + 1) * 300
            if t >= gone:
                expected.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        expected.append((key, run[0], run[-1], len(run)))
    got = registry.online_sessions(frame(spark, rows), sweep=sweep).collect()
    assert sorted((r.id, r.start, r["last"], r.heartbeats) for r in got) == sorted(expected)


def test_sessions_equal_session_window(spark):
    rows = make_beats(3, span=9000)
    beats = frame(spark, rows)
    built_in = beats.groupBy("id", F.session_window("received_at", "60 seconds").alias("s")).agg(F.count("*").alias("n"))
    expected = {(r.id, r.a, r.b, r.n) for r in built_in.select("id", F.unix_seconds("s.start").alias("a"), F.unix_seconds("s.end").alias("b"), "n").collect()}
    assert {(r.id, r.start, r.end, r.heartbeats) for r in registry.online_sessions(beats).collect()} == expected


def test_upsert_takes_newest_and_breaks_ties_by_seq(spark):
    rows = [("a", 5, 1, "x"), ("a", 9, 2, "y"), ("a", 9, 3, "z"), ("b", 1, 4, "w")]
    got = registry.upsert_latest(frame(spark, rows)).collect()
    assert {r.id: r.payload for r in got} == {"a": "z", "b": "w"}


def test_lookups(spark):
    known = frame(spark, [("a", 1, 1, "x"), ("b", 2, 2, "y")])
    asked = spark.createDataFrame([("a",), ("a",), ("q",)], "id string")
    assert sorted((r.id, r.found) for r in registry.exists_by_key(asked, known).collect()) == [("a", True), ("a", True), ("q", False)]
    assert [r.id for r in registry.not_found_by_key(asked, known).collect()] == ["q"]
    assert registry.instance_count(known).first().instances == 2


def test_tokens(spark):
    issues = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 5, 3)], "id string, t bigint, token bigint")
    held = registry.token_registry(issues.withColumn("issued_at", F.timestamp_seconds("t"))).collect()
    assert {r.id: (r.token, (r.expires_at - r.issued_at).days) for r in held} == {"a": (2, 30), "b": (3, 30)}


def test_flatten_keeps_parents_and_order(spark):
    rows = [(7, "i7", [("a", 5), ("b", 1)]), (3, "i3", []), (9, "i9", [("c", 5)])]
    instances = spark.createDataFrame(rows, "instance_seq bigint, id string, servers array<struct<game:string,clientnum:int>>")
    flat = nested.attach_parent(instances)
    assert [tuple(r) for r in flat.orderBy("instance_seq", "pos").select("instance_id", "game", "clientnum").collect()] == [
        ("i7", "a", 5), ("i7", "b", 1), ("i9", "c", 5),
    ]
    assert nested.fleet_totals(instances).first().asDict() == {"clients": 11, "instances": 3, "servers": 3}
    empty = nested.fleet_totals(instances.filter("false")).first().asDict()
    assert empty == {"clients": 0, "instances": 0, "servers": 0}


def test_newest_rows_with_nulls_repeats_and_large_numbers(spark):
    rows = [
        ("a", 5, 2**62, "old"), ("a", 5, 2**62 + 1, "new"), ("b", 7, -5, "b1"), ("b", 7, None, "b2"), ("c", None, 1, "only"),
        (None, 3, 1, "n1"), (None, 4, 0, "n2"), ("d", -9, 3, "d1"), ("d", -8, -(2**63), "d2"), ("e", 1, 1, "same"), ("e", 1, 1, "same"),
    ]
    beats = frame(spark, rows)
    got = registry.upsert_latest(beats).collect()
    assert {r.id: r.payload for r in got} == {"a": "new", "b": "b1", "c": "only", None: "n2", "d": "d2", "e": "same"}
    assert len(got) == 6
    assert sorted(map(str, got)) == sorted(map(str, registry.latest_by_aggregate(beats).collect()))
    assert registry.upsert_latest(beats.filter("false")).collect() == []


def test_lookups_at_their_own_time(spark):
    """Each request sees the registry as it was at its second."""
    rows = make_beats(12, rows=150, span=3000)
    rng = random.Random(4)
    asked = [(i, rng.choice(["hot", "i0", "i1", "i2", "i3", "nobody", None]), rng.randrange(3500)) for i in range(120)] + [(900, "hot", None)]
    requests = spark.createDataFrame(asked, "n int, id string, at bigint")
    for expiry, sweep in ((60, 300), (20, 0)):
        got = {r.n: (r.found, r.last_heartbeat, r.heartbeat_seq) for r in registry.registry_as_of(requests, frame(spark, rows), expiry=expiry, sweep=sweep).collect()}
        for n, key, at in asked:
            held = None if at is None else simulate([r for r in rows if r[1] <= at], at, expiry, sweep).get(key)
            assert got[n] == ((True, held[1], held[2]) if held else (False, None, None)), (n, key, at)


def test_row_before_over_cells(spark, monkeypatch):
    monkeypatch.setattr(nested, "PLACES_PER_CELL", 7)
    rng = random.Random(6)
    rows = [(i, "g" if rng.random() < 0.7 else None, rng.randrange(3), i * 3) for i in range(200)]
    servers = spark.createDataFrame(rows, "id int, game string, clientnum int, place long")
    for falling in (None, "clientnum"):
        got = {r.id: r.follows for r in nested.row_before(servers, falling=falling).collect()}
        order = sorted(rows, key=lambda r: (-(r[2] if falling else 0), r[3]))
        last, wanted = {}, {}
        for i, game, _, _ in order:
            wanted[i], last[game] = last.get(game), i
        assert got == wanted
