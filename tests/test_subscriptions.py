import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pulseyard.operators import subscriptions as s

META = "plan_id string, subscription_count bigint"


def make_events(seed, n=600):
    """Events in random row order; one plan has half of them, and many share a time."""
    rng = random.Random(seed)
    kinds = [s.CREATED] * 4 + [s.CANCELLED] * 5 + ["invoice_generated"]
    plans = ["hot"] * 8 + ["a", "b", "c", "d"] + ["unknown"]
    rows = [(i, rng.randrange(200), rng.choice(kinds), rng.choice(plans)) for i in range(n)]
    rng.shuffle(rows)
    return rows


def fold(rows, start):
    counts, values, outcomes = dict(start), {}, {}
    for event_id, _, kind, plan in sorted(rows, key=lambda r: (r[1], r[0])):
        if plan not in counts or kind not in (s.CREATED, s.CANCELLED):
            outcomes[event_id] = "error"
            continue
        changed = counts[plan] + (1 if kind == s.CREATED else -1)
        outcomes[event_id] = "applied" if changed >= 0 else "acknowledged"
        counts[plan] = max(changed, 0)
        values[event_id] = counts[plan]
    return counts, values, outcomes


def events_frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, event_type string, plan_id string")
    return df.withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_counter_equals_fold(spark, seed, coalesce):
    rows = make_events(seed)
    start = {"hot": 2, "a": 0, "b": 5, "c": 0, "d": 1, "idle": 4}
    counts, values, outcomes = fold(rows, start)
    meta = spark.createDataFrame(list(start.items()), META)
    # Without merging of small partitions the hot plan is cut into several blocks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        events = events_frame(spark, rows).repartition(6)
        counted = s.clamped_counter(events, meta)
        assert {r.event_id: r.subscription_count for r in counted.collect()} == values
        assert {r.event_id: r.outcome for r in s.event_outcome(events, meta).collect()} == outcomes
        final = s.plan_subscription_count(events, meta)
        assert {r.plan_id: r.subscription_count for r in final.collect()} == counts
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hot_plan_is_cut_into_blocks(spark):
    from pulseyard.operators.ordered import ordered_blocks

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = events_frame(spark, make_events(9, 4000))
        blocks = ordered_blocks(rows, ["plan_id"], ["ts", "event_id"])
        sizes = [r["count"] for r in blocks.groupBy("plan_id", "block").count().filter("plan_id = 'hot'").collect()]
        assert len(sizes) >= 3 and max(sizes) <= 4000 / 8 * 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("cell, most", [(3600, 100_000), (50, 20), (10, 3), (7, 1)])
def test_blocks_of_any_size_fold_alike(spark, cell, most):
    """Hot cells are cut into parts; a block holds few events, and the counts are those of one fold."""
    rows = make_events(21, 500)
    start = {"hot": 2, "a": 0, "b": 5, "c": 0, "d": 1}
    _, values, _ = fold(rows, start)
    meta = spark.createDataFrame(list(start.items()), META)
    counted = s.clamped_counter(events_frame(spark, rows), meta, cell, most).collect()
    assert {r.event_id: r.subscription_count for r in counted} == values
    counting, _ = s._split_events(events_frame(spark, rows), meta)
    blocks = s._placed_events(counting, cell, most).groupBy("plan_id", "cell", "part").count()
    if most == 20:
        assert blocks.agg(F.max("count")).first()[0] <= 40 and blocks.filter("plan_id = 'hot'").count() >= 8


def test_counts_run_nothing_before_the_action(spark, tmp_path):
    """No job and no file while the DataFrame is made; blocks agree between runs."""
    from pulseyard.plans import pages

    meta = spark.createDataFrame([("hot", 2), ("a", 0)], META)
    events = events_frame(spark, make_events(22, 300))
    group = "counts-before-action"
    spark.sparkContext.setJobGroup(group, group)
    frames = [s.clamped_counter(events, meta), s.plan_subscription_count(events, meta), pages.plan_counts(events, meta)]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == []
    spark.sparkContext.setJobGroup("other", "other")
    first, again = frames[0].collect(), frames[0].repartition(3).collect()
    assert sorted(first) == sorted(again)


def test_pairs_compose(spark):
    """Pairs of batches that come in any order give the counts of one fold over everything."""
    rows = make_events(23, 400)
    start = {"hot": 2, "a": 0, "b": 5, "c": 0, "d": 1, "idle": 4}
    counts, _, _ = fold(rows, start)
    meta = spark.createDataFrame(list(start.items()), META)
    events = events_frame(spark, rows)
    batches = [s.event_pairs(events.filter(F.col("t") % 3 == k)) for k in (2, 0, 1)]
    pairs = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert {r.plan_id: r.subscription_count for r in s.counts_from_pairs(pairs, meta).collect()} == counts


def test_cancel_at_zero(spark):
    rows = [(i, i, k, "p") for i, k in enumerate([s.CANCELLED, s.CREATED, s.CANCELLED, s.CANCELLED])]
    meta = spark.createDataFrame([("p", 0)], META)
    got = s.clamped_counter(events_frame(spark, rows), meta).orderBy("event_id").collect()
    assert [(r.subscription_count, r.applied) for r in got] == [(0, False), (1, True), (0, True), (0, False)]


@pytest.fixture(scope="module")
def store(spark):
    customers = spark.createDataFrame([(1, "a@x"), (2, "a@x"), (3, "b@x"), (4, "c@x")], "id bigint, email string")
    subs = spark.createDataFrame(
        [(1, "p1", "active"), (1, "p1", "active"), (1, "p2", "active"), (1, "p3", "cancelled"), (2, "p3", "active"),
         (3, "p4", "active"), (3, "p9", "active")],
        "customer_id bigint, plan_id string, status string",
    )
    meta = spark.createDataFrame(
        [("p1", "u/1.dll"), ("p2", "u/2.JS"), ("p3", "u/3.txt"), ("p4", "u/4.txt")], "plan_id string, content_url string"
    )
    contents = spark.createDataFrame(
        [("u/1.dll", bytearray(b"one")), ("u/2.JS", bytearray(b"two")), ("u/4.txt", None)], "content_url string, payload binary"
    )
    return customers, subs, meta, contents


def test_entitlements(spark, store):
    customers, subs, meta, _ = store
    asked = spark.createDataFrame([("a@x",), ("b@x",), ("c@x",), ("nobody",)], "email string")
    got = s.entitlements(asked, customers, subs, meta).collect()
    # The first customer of a shared email counts, a plan comes once, plans without metadata drop out.
    assert sorted((r.email, r.plan_id) for r in got) == [("a@x", "p1"), ("a@x", "p2"), ("b@x", "p4")]


def test_content_is_sealed_per_request(spark, store):
    customers, subs, meta, contents = store
    asked = spark.createDataFrame(
        [("a@x", "i1"), ("a@x", "i2"), ("b@x", "i1"), ("a@x", None), (None, "i1")], "email string, instance_id string"
    )
    rows = s.subscribed_content(asked, customers, subs, meta, contents).collect()
    assert sorted((r.email, r.instance_id, r.plan_id, r.type) for r in rows) == [
        ("a@x", "i1", "p1", 0), ("a@x", "i1", "p2", 1), ("a@x", "i2", "p1", 0), ("a@x", "i2", "p2", 1),
    ]
    for r in rows:
        data = base64.b64decode(r.content)
        key = hashlib.pbkdf2_hmac("sha512", r.email.encode(), r.instance_id.encode(), 10_000, 32)
        frame = spark.createDataFrame([(bytearray(data[-12:] + data[:-12]), bytearray(key))], "c binary, k binary")
        opened = frame.select(F.aes_decrypt("c", "k", F.lit("GCM")).alias("o")).first().o
        assert bytes(opened) == {"p1": b"one", "p2": b"two"}[r.plan_id]


def test_require_params(spark):
    asked = spark.createDataFrame([("a", "i"), (None, "i"), ("a", None)], "email string, instance_id string")
    assert [r.error is None for r in s.require_params(asked).collect()] == [True, False, False]


def test_catalogue(spark):
    plans = spark.createDataFrame(
        [("p1", "One", "d", 0, "month", "active"), ("p2", "Two", "d", 1250, "year", "active"), ("p3", "Old", "d", 5, "year", "archived")],
        "id string, name string, description string, price bigint, period_unit string, status string",
    )
    meta = spark.createDataFrame([("p2", 7, "me", "h")], "plan_id string, subscription_count bigint, author string, help_url string")
    listed = s.active_plans(plans)
    got = s.plan_catalogue(listed, meta).orderBy("id").collect()
    assert [(r.id, r.price, r.price_label, r.author, r.subscription_count, r.subscribers) for r in got] == [
        ("p1", "0.00", "Free", None, None, 0), ("p2", "12.50", "$12.50 per year", "me", 7, 7),
    ]
    assert [r.id for r in s.plan_catalogue(listed, meta, strict=True).collect()] == ["p2"]
    assert s.active_plans(plans, 1).first().id == "p1"


def test_customer_limit(spark):
    customers = spark.createDataFrame([(i, "a@x") for i in range(9, 0, -1)], "id bigint, email string")
    asked = spark.createDataFrame([("a@x",)] * 3, "email string")
    assert sorted(r.id for r in s.customers_by_email(asked, customers, limit=4).collect()) == [1, 2, 3, 4]
    assert s.customers_by_email(asked, customers).count() == 9
    assert s.first_customer(customers).first().customer_id == 1


def test_a_plan_without_a_stored_count_is_an_error(spark):
    meta = spark.createDataFrame([("none", None), ("zero", 0)], META)
    rows = [(1, 1, "none", "subscription_created"), (2, 2, "zero", "subscription_created")]
    events = spark.createDataFrame(rows, "event_id bigint, t bigint, plan_id string, event_type string").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.event_id: r.outcome for r in s.event_outcome(events, meta).collect()} == {1: "error", 2: "applied"}
