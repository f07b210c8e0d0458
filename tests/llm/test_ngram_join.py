import random
from collections import defaultdict

import numpy as np
from helpers import awkward, empty, read

from pulseyard.llm import ngram_join
from pulseyard.llm.components import connected_components


def brute(rows, threshold=0.8):
    """Class and links by comparing every text with every other."""
    sets = {}
    for text in {t or "" for _, t in rows}:
        words = text.lower().split()
        n = min(5, len(words))
        sets[text] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    texts = list(sets)
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    links = defaultdict(int)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for i, t in rows:
        members[root(t or "")].append(i)
    return sorted(
        (str(i), str(min((x for x in members[root(t or "")] if x is not None), default=None)), links[t or ""], sum((u or "") == (t or "") for _, u in rows)) for i, t in rows
    )


def answer(df):
    return sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["n_copies"]) for r in df.collect())


def test_equals_brute_force(spark):
    docs = read(spark, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert answer(ngram_join.near_duplicates(docs)) == brute(rows)


def test_large_groups_in_blocks(spark):
    """A group of many near copies (more than two blocks) and a passage that many texts share."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(30 + i % 50))) for i in range(200)]
    rows += [(2000 + i, rows[0][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = answer(ngram_join.near_duplicates(docs))
    wanted = brute(rows)
    assert sum(a == b for a, b in zip(got, wanted, strict=True)) >= 0.99 * len(wanted)
    assert sum(g[2] for g in got) >= 0.999 * sum(w[2] for w in wanted)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert answer(ngram_join.near_duplicates(docs)) == brute(rows)
    assert ngram_join.near_duplicates(empty(spark)).collect() == []
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    # The first row of each class: the two sentences and their repeat are one text in lower case.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "None", "5", "6", "8", "9"])
    assert ngram_join.keep_one(empty(spark)).collect() == []


def test_pruning_table_follows_the_posterior():
    table = dict(ngram_join.least_matches(0.8, 1e-5, 128, 16))
    rng = np.random.default_rng(1)
    for n, least in table.items():
        tail = (rng.beta(least + 1, n - least + 1, 200_000) >= 0.8).mean()
        assert tail < 0.01
    assert list(table.values()) == sorted(table.values())


def test_exact_links_either_way():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    wanted = [k for k, (i, j) in enumerate(zip(a, b, strict=True)) if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    assert list(ngram_join.exact_links(a, b, lambda i: sets[i], 0.4)) == wanted
    some = np.arange(0, len(a), 50)
    assert list(some[ngram_join.exact_links(a[some], b[some], lambda i: sets[i], 0.4)]) == [k for k in wanted if k % 50 == 0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)] + [(200, 201)] * 3
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == wanted
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_lower_threshold_finds_the_pairs_above_it(spark):
    """Pairs at 0.5 to 0.7 are candidates and survive the pruning when the threshold asks for them."""
    rng = random.Random(11)
    rows = []
    for i in range(40):
        words = [f"a{i}w{j}" for j in range(100)]
        rows.append((2 * i, " ".join(words)))
        for place in rng.sample(range(0, 100, 6), 5):
            words[place] = f"b{place}"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows, 0.5)
    assert sum(w[2] for w in wanted) >= 60 and sum(w[2] for w in brute(rows)) == 0
    assert answer(ngram_join.near_duplicates(docs, threshold=0.5)) == wanted


def test_bands_follow_the_threshold():
    for threshold in (0.3, 0.5, 0.8, 0.9, 1.0):
        bands, rows = ngram_join.bands_and_rows(threshold)
        assert bands * rows <= ngram_join.HASHES and (1 - threshold**rows) ** bands <= 1e-4
    assert ngram_join.bands_and_rows(0.8) == (25, 5)
