"""Benchmark decontamination against a word-by-word search."""

import random
import re

import pytest
from helpers import awkward, empty

from pulseyard.llm import decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def search(docs, items, threshold, window=10, shingle=3):
    """For each text: words, words hit, sorted items."""
    found = set()
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            found.add((item, tuple(w[i : i + window])))
    out = []
    for _, text in docs:
        w, hit, who = words(text), set(), set()
        for item, phrase in found:
            width = min(shingle, len(phrase))
            count = len(phrase) - width + 1
            for at in range(len(w) - len(phrase) + 1):
                place = w[at : at + len(phrase)]
                same = sum(tuple(place[i : i + width]) == phrase[i : i + width] for i in range(count))
                if same >= threshold * count - 1e-9:
                    hit |= set(range(at, at + len(phrase)))
                    who.add(item)
        named = sorted(str(x) for x in who if x is not None)
        out.append((len(w), len(hit), len(named), named))
    return out


@pytest.mark.parametrize("threshold", [1.0, 0.6])
def test_equals_search(spark, threshold):
    draw = random.Random(5)
    few = ["a", "b", "c", "Dé", "E9", "of", "the"]
    text = lambda n: " ".join(draw.choice(few) + draw.choice(["", ",", " -"]) for _ in range(n))
    items = [(i, text(draw.choice([4, 7, 10, 12, 30]))) for i in range(25)]
    items += [(25, "zz"), (26, "of zz"), (27, ""), (28, None), (29, "?!"), (None, "no id but words"), (3, "one more row of item three"), (12, items[0][1])]
    docs = [(i, text(draw.choice([0, 1, 9, 40, 120]))) for i in range(30)]
    docs += [(30 + i, f"{text(5)} {x or ''} {text(3)}") for i, (_, x) in enumerate(items)]
    # One word of a passage changed, a passage twice and overlapping itself, an id with two texts, a repeated row.
    changed = words(items[3][1])
    changed[len(changed) // 2] = "other"
    docs += [(90, " ".join(changed)), (91, "x x x x x x x x x x x x x x"), (91, "zz of zz zz"), (None, None), (None, "no ID. But words"), (30, docs[30][1])]
    items.append((40, "x x x x x x x x x x x"))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(rows, marks, threshold).collect()
    key = lambda r: (str(r[0]), r[1:])
    wanted = [(d[0], *s, s[1] > 0) for d, s in zip(docs, search(docs, items, threshold), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)


def test_spans(spark):
    docs = spark.createDataFrame([(1, "x y Seven words make this item, just so. z")], "doc_id long, text string")
    items = spark.createDataFrame([(8, "seven words make this item just so")], "item_id long, text string")
    windows = decontamination.item_windows(items)
    (row,) = decontamination.scan(docs, windows).collect()
    assert (row["start"], row["size"], row["phrase"]) == (2, 7, "seven words make this item just so")


def test_prefix_is_what_an_occurrence_must_have(spark):
    """With ``need`` of m shingles to be found, m - need + 1 are joined on, the rarest ones."""
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    shingles = decontamination._window_shingles(decontamination.item_windows(items), 3).cache()
    counts = shingles.selectExpr("hash", "cast(100 - at as long) as n")
    places = lambda t: sorted(r["at"] for r in decontamination._prefixes(shingles, counts, t).collect())
    assert places(1.0) == [7]
    assert places(0.75) == [5, 6, 7]


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "the same words in the same order"), (2, None), (3, "Lorem ipsum dolor sit amet, consetetur sadipscing elitr. Lorem ipsum dolor")], "item_id long, text string")
    docs = docs.selectExpr("*", "1 as id", "2 as key", "3 as words", "4 as hash", "5 as n_hit", "map('a', 1) as items")
    got = decontamination.decontaminate(docs, items)
    assert got.columns == ["doc_id", *decontamination.OUTPUT]
    rows = got.collect()
    assert len(rows) == docs.count()
    assert {(r["n_hit"], tuple(r["items"])) for r in rows if r["doc_id"] in (1, 2)} == {(7, ("1",))}
    longest = [r for r in rows if r["doc_id"] in (6, 7)]
    assert [r["n_hit"] for r in longest] == [11995, 11995] and longest[0]["contaminated"]
    assert all(not r["contaminated"] and r["items"] == [] for r in rows if r["doc_id"] in (None, 3, 4, 5, 8))
    assert decontamination.decontaminate(empty(spark), items).collect() == []
    clean = decontamination.decontaminate(docs, items.filter("item_id = 2")).collect()
    assert len(clean) == docs.count() and not any(r["contaminated"] for r in clean)


def test_words_are_counted_by_the_first_scan(spark):
    """No scan of its own counts words; every row has its count, hit or not."""
    docs = spark.createDataFrame([(1, "One two, THREE"), (1, "One two, THREE"), (2, None), (None, "?! x"), (3, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(8, "b c")], "item_id long, text string")
    got = decontamination.decontaminate(docs, items)
    assert "regexp_count" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["n_words"], r["n_hit"]) for r in got.collect()) == [(0, 0), (1, 0), (3, 0), (3, 0), (4, 2)]
