import datetime
import random

import pytest
from pyspark.sql import functions as F

from pulseyard.functions import format_duration
from pulseyard.operators import breakdown, nested


def python_breakdown(rows, limit=9):
    """Loop over (key, measure) in order: count, share of the total, stable sort."""
    total = sum(m for _, m in rows)
    counts = {}
    for key, measure in rows:
        counts[key] = counts.get(key, 0) + measure
    top = sorted(counts.items(), key=lambda kv: kv[1], reverse=True)[:limit]
    return [(k, c, round(c / max(total, 1) * 100)) for k, c in top]


def shown(df):
    return [(r.key, r["count"], r.percent) for r in df.collect()]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("weighted", [True, False])
def test_equals_loop_in_order(spark, seed, weighted):
    rng = random.Random(seed)
    # One key holds a third of all rows; small measures make many ties.
    keys = [rng.choice(["hot"] * 7 + [f"k{i}" for i in range(14)] + [None]) for _ in range(200)]
    rows = [(k, rng.randrange(3), seq) for seq, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, n int, seq bigint").repartition(7)
    got = breakdown.count_by_key(df, "k", ("seq",), "n" if weighted else None)
    assert shown(got) == python_breakdown([(k, n if weighted else 1) for k, n, _ in rows])


def test_edges(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "k string, n int, seq bigint")
    assert shown(breakdown.count_by_key(df, "k", ("seq",), "n")) == [("a", 0, 0), ("b", 0, 0)]
    assert shown(breakdown.count_by_key(df, "k", ("seq",), "absent")) == [("a", 0, 0), ("b", 0, 0)]
    empty = breakdown.count_by_key(df.filter("false"), "k", ("seq",))
    assert empty.columns == ["key", "count", "total", "percent", "metric_name", "metric_count"] and empty.count() == 0
    eighths = spark.createDataFrame([("a" if i else "b", i) for i in range(8)], "k string, seq bigint")
    assert shown(breakdown.count_by_key(eighths, "k", ("seq",))) == [("a", 7, 88), ("b", 1, 12)]
    by_share = breakdown.count_by_key(eighths, "k", ("seq",), sort_by="percent", limit=1)
    assert shown(by_share) == [("a", 7, 88)]


def test_formatter_changes_kept_counts(spark):
    df = spark.createDataFrame([("a", 90_061, 1), ("b", 59, 2)], "k string, n int, seq bigint")
    got = breakdown.count_by_key(df, "k", ("seq",), "n", formatter=format_duration)
    assert [r["count"] for r in got.collect()] == ["1 day, 1:01:01", "0:00:59"]


def fleet(spark, n=60):
    rng = random.Random(5)
    rows = []
    for seq in range(n):
        servers = [
            (rng.choice("abcdefghijkl"), rng.choice(["m1", "m2", "m3"]), rng.choice(["x", None]), rng.randrange(5))
            for _ in range(rng.randrange(4))
        ]
        rows.append((seq, str(seq % 3), f"ip{seq % 12}", rng.randrange(100_000), servers))
    schema = (
        "instance_seq bigint, version string, ip_address string, uptime int, "
        "servers array<struct<game:string,map:string,gametype:string,clientnum:int>>"
    )
    return rows, spark.createDataFrame(rows, schema)


def test_stats_all_equals_eight_loops(spark):
    rows, df = fleet(spark)
    servers = [s for r in rows for s in r[4]]
    expected = {
        "Instances By Version": python_breakdown([(r[1], 1) for r in rows]),
        "Servers By Game": python_breakdown([(s[0], 1) for s in servers]),
        "Players By Game": python_breakdown([(s[0], s[3]) for s in servers]),
        "Servers By Map": python_breakdown([(s[1], 1) for s in servers]),
        "Players By Map": python_breakdown([(s[1], s[3]) for s in servers]),
        "Servers By Game Type": python_breakdown([(s[2], 1) for s in servers]),
        "Players By Game Type": python_breakdown([(s[2], s[3]) for s in servers]),
        "Uptime By Instance": [
            (k, str(datetime.timedelta(seconds=c)), p) for k, c, p in python_breakdown([(r[2], r[3]) for r in rows])
        ],
    }
    got = {}
    for r in breakdown.stats_all(df.repartition(5)).orderBy("segment", "rank").collect():
        got.setdefault(r.segment, []).append((r.key, r["count"], r.percent))
    assert got == {k: [(a, str(b), c) for a, b, c in v] for k, v in expected.items()}


@pytest.mark.parametrize("partitions", ["1", "8", "64"])
def test_same_result_for_any_partition_count(spark, partitions):
    _, df = fleet(spark)
    reference = sorted(map(tuple, breakdown.stats_all(df).collect()), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, breakdown.stats_all(df.repartition(13)).collect()), key=str) == reference
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_server_order_is_stable(spark):
    _, df = fleet(spark)
    flat = nested.flatten_nested(df)
    rows = [tuple(r) for r in flat.orderBy("instance_seq", "pos").select("game", "clientnum", "instance_seq", "pos").collect()]
    by_game = [tuple(r) for r in nested.sort_by_game(flat).select("game", "clientnum", "instance_seq", "pos").collect()]
    assert by_game == sorted(rows, key=lambda r: r[0])
    by_players = [tuple(r) for r in nested.sort_by_players(flat).select("game", "clientnum", "instance_seq", "pos").collect()]
    assert by_players == sorted(rows, key=lambda r: (r[0], -r[1]))
    summary = {r.game: (r.players, r.servers) for r in nested.game_summary(flat).collect()}
    assert summary == {g: (sum(r[1] for r in rows if r[0] == g), sum(r[0] == g for r in rows)) for g in {r[0] for r in rows}}


def test_number_and_text_are_different_keys(spark):
    rows = spark.createDataFrame([("1", "number", 1), ("1", "string", 2), ("1", "number", 3)], "version string, version_kind string, seq bigint")
    got = breakdown.count_by_key(rows, "version", ("seq",), key_class="version_kind").collect()
    assert [(r["key"], r["count"], r.percent) for r in got] == [("1", 2, 67), ("1", 1, 33)]
