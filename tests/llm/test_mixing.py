from collections import Counter, defaultdict

import pytest
from helpers import awkward, empty, read
from pyspark.sql import functions as F

from pulseyard.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, cap, and share the excess again until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    capped = set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        given = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if given[s] >= most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else given[s] for s in names}
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 20, "d": 300, None: 7}, {"a": 5}, {"z": 0, "y": 9, "x": 100}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    wanted = brute_targets(sizes)
    assert got.keys() == wanted.keys()
    assert all(abs(got[s] - wanted[s]) < 1e-6 for s in wanted)


def test_words_near_target_and_reruns_agree(spark):
    docs = read(spark, "documents").select("doc_id", "text", "source")
    first = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    taken, largest = Counter(), defaultdict(int)
    for r in first:
        assert r["size"] == len(r["text"].split())
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for r in first:
        assert abs(taken[r["source"]] - r["target"]) <= largest[r["source"]]


def test_many_levels_keep_the_sum(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w " * 3).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("source"))
    mixed = mixing.mix_sources(rows, weights=(1, 3), share=0.7)
    got = mixed.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in got)


def test_chances_are_kept(spark):
    """Four texts of other sizes in each of 500 sources: every place is taken as often as its share says."""
    rows = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 4 + 1).cast("int")).alias("text"), (F.col("id") / 4).cast("int").cast("string").alias("source")
    )
    mixed = mixing.mix_sources(rows, weights=(1,), share=0.5)
    mean = {r["place"]: r["m"] for r in mixed.groupBy((F.col("doc_id") % 4).alias("place")).agg(F.mean("copies").alias("m")).collect()}
    assert all(abs(m - 0.5) < 0.1 for m in mean.values())


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    assert [r["size"] for r in got if r["doc_id"] == 3] == [0]
    assert all(0 <= r["copies"] <= 2 for r in got)
    assert mixing.mix_sources(empty(spark)).collect() == []
    kept = mixing.repeat_rows(mixing.mix_sources(docs))
    assert "copies" not in kept.columns and "text" in kept.columns


def test_equal_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 9, "doc_id long, text string, source string")
    got = [r["copies"] for r in mixing.mix_sources(docs, share=1.5).collect()]
    assert sorted(got) in ([1] * 4 + [2] * 5, [1] * 5 + [2] * 4)
