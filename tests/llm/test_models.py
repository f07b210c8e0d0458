"""Language ID and toxicity on rows they were not fitted on."""

import numpy as np
from helpers import LARGE, MEDIUM, SMALL, awkward, empty, read

from pulseyard.llm import langid, ngrams, toxicity
from pulseyard.llm.queries import QUERIES, crc_fold


def test_languages_held_out(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, str(MEDIUM)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in read(spark, "documents", MEDIUM).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    import zlib

    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_filters_hold_their_members(spark):
    docs = read(spark, "documents", SMALL).select("text", "lang")
    filters = langid.fit_filters(docs, least_share=1e-4)
    counts = langid.gram_counts(docs).toPandas()
    total = counts.groupby("lang")["n"].transform("sum")
    members = counts[counts["n"] >= 1e-4 * total]
    for i, lang in enumerate(filters.languages):
        grams = members.loc[members["lang"] == lang, "gram"].to_numpy().astype(np.uint64)
        assert ((langid.languages_of(grams, filters)[:, 0] >> np.uint64(i)) & np.uint64(1)).all()
    strange = np.random.default_rng(0).integers(0, 2**62, 20_000).astype(np.uint64)
    taken = (langid.languages_of(strange, filters)[:, 0] & np.uint64(1)).mean()
    assert abs(taken - filters.chance[0]) < 0.01


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    filters = langid.fit_filters(docs.select("text", "lang"))
    rows = langid.identify(docs, filters).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    assert langid.identify(empty(spark), filters).collect() == []
    nothing = langid.fit_filters(empty(spark).select("text", "lang"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert docs.filter(crc_fold() == 0).filter("doc_id is null").count() == 2


def test_windows_stay_inside_words():
    codes, owner = ngrams.letter_codes(["Ab c", "", "d"])
    views, middle = ngrams.windows(codes, owner, 3)
    grams = ["".join(chr(int(x)) if x else "_" for x in g) for g in zip(*views, strict=True)]
    assert grams == ["_ab", "ab_", "_c_", "_d_"] and list(middle) == [0, 0, 0, 2]


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(ngrams, "CHARACTERS", 50)
    texts = ["word " * 40, "", "tail"]
    joined = ["", "", ""]
    for numbers, held in ngrams.parts(texts):
        assert sum(map(len, held)) <= 50
        for number, piece in zip(numbers, held, strict=True):
            joined[number] += piece
    assert joined == texts


def test_toxic_documents_held_out(spark):
    """Fit on the labels of even documents, judge the odd ones."""
    docs, labels = read(spark, "documents", LARGE).select("doc_id", "text"), read(spark, "labels", LARGE)
    chain = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] % 2}
    scored = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, chain).select("doc_id", "toxic").collect()}
    assert np.mean([scored[i] for i in truth if truth[i] == 0]) <= 0.01
    assert np.mean([scored[i] for i in truth if truth[i] == 1]) >= 0.85


def test_later_models_see_earlier_odds():
    """The second label is the first one plus noise; its model must lean on the odds of the first."""
    rng = np.random.default_rng(3)
    n = 600
    first = (rng.random(n) < 0.5).astype(int)
    rows = np.repeat(np.arange(n), 8)
    buckets = np.where(rng.random(8 * n) < 0.7, np.where(first[rows] == 1, rng.integers(0, 50, 8 * n), rng.integers(50, 100, 8 * n)), rng.integers(100, 5000, 8 * n))
    key = np.unique(rows * toxicity.BUCKETS + buckets)
    rows, buckets = key // toxicity.BUCKETS, key % toxicity.BUCKETS
    labels = np.column_stack([first, np.where(rng.random(n) < 0.9, first, 1 - first)])
    values = np.ones(len(rows), dtype=np.float32)
    chain = toxicity.fit_chain(rows, buckets, values, labels, np.arange(n) % 5, ["a", "b"])
    assert chain.models[1].earlier.shape == (1,) and chain.models[1].earlier[0] > 0
    assert ((chain.predict(rows, buckets, values, n)[:, 0] > 0.5) == first).mean() > 0.95


def test_toxicity_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 1), (None, 0, 1), (77, 0, 1)], none.schema)
    for labels in (none, odd):
        chain = toxicity.fit(docs, labels)
        rows = toxicity.score(docs, chain).collect()
        assert len(rows) == docs.count()
    assert not any(r["toxic"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert toxicity.score(empty(spark), chain).collect() == []
