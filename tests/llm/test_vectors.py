"""Centroid clustering and whitening against dense reference computations."""

import hashlib

import numpy as np
import pytest
from helpers import MEDIUM, SMALL, read

from pulseyard.llm import centroids, feast, whitening
from pulseyard.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, packed string, cluster string, n string, component map<string,int>"


def awkward_vectors(spark, dims=64):
    """Good vectors with ties and repeats among every kind that is left out, and columns named like outputs."""
    draw = np.random.default_rng(3)
    good = [[float(x) for x in draw.integers(-3, 4, dims) / 256] for _ in range(60)]
    good += [good[0], good[0], [0.0] * dims, [x + 0.001 for x in good[5]]]
    bad = [None, [], good[1][:-1], good[1] + [0.5], [None] + good[2][1:], [float("nan")] + good[2][1:], good[3][:-1] + [float("-inf")]]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[7]), (None, good[8]), (4, good[4]), (4, good[9])]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    clash = ("p", "c", "n", {"a": 1})
    return rows[: len(rows) - len(bad)], spark.createDataFrame([(*r, *clash) for r in rows], SCHEMA)


def integers(rows):
    return np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)


def reference(rows, k=40, rounds=5):
    ids, x = [i for i, _ in rows], integers(rows)
    digest = lambda i: (1, "") if ids[i] is None else (0, hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest())
    order = sorted(range(len(ids)), key=lambda i: (digest(i), x[i].astype("<i4").tobytes()))
    c = x[order[:k]].copy()
    for _ in range(rounds):
        near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        for j in set(near):
            c[j] = x[near == j].sum(axis=0) // (near == j).sum()
    d = ((x[:, None] - c) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    best = d[np.arange(len(x)), near]
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return [(i, int(n), int(b), int(best[near == n].sum()), int(best.sum()), digests[n]) for i, n, b in zip(ids, near, best, strict=True)]


def test_clusters_equal_dense_reference(spark):
    rows, table = awkward_vectors(spark)
    key = lambda r: (str(r[0]), r[1:])
    for parts in (1, 7):
        got, _ = centroids.cluster(table.repartition(parts))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(reference(rows), key=key)


def test_few_and_no_vectors(spark):
    rows, table = awkward_vectors(spark)
    few = table.filter("vec_id < 3")
    got, found = centroids.cluster(few)
    assert len(found) == 3 and {r["distance"] for r in got.collect()} == {0}
    got, found = centroids.cluster(table.filter("vec_id >= 1000"))
    assert got.collect() == [] and len(found) == 0 and got.columns == ["vec_id", *centroids.OUTPUT]
    huge = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(huge)


def test_tables_give_exact_distances():
    draw = np.random.default_rng(4)
    for spread in (3, 200, 1 << 26):
        x, c = draw.integers(-spread, spread, (50, 7)), draw.integers(-spread, spread, (5, 7))
        assert (centroids.squared_distances(x, c) == ((x[:, None] - c) ** 2).sum(axis=2)).all()
    values, place = centroids.occurring(np.array([5, -2, 5, 9]))
    assert values.tolist() == [-2, 5, 9] and place.tolist() == [1, 0, 1, 2]


def covariance_of(x):
    distinct = np.unique(x, axis=0)
    centred = distinct - distinct.mean(axis=0)
    return distinct, centred.T @ centred / len(distinct)


def check_whitening(got, rows, atol):
    x = integers(rows)
    distinct, v = covariance_of(x)
    n, s = len(distinct), distinct.sum(axis=0)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    wanted = (x - s / n) @ vectors / np.sqrt(values)
    frame = sorted(got, key=lambda r: (r["component"], str(r["vec_id"]), r["deviation"], abs(r["whitened"])))
    order = [(str(i), int(((n * y - s) ** 2).sum()), *w) for (i, _), y, w in zip(rows, x, wanted, strict=True)]
    for c in range(4):
        mine = [r for r in frame if r["component"] == c + 1]
        theirs = sorted((i, d, abs(w[c]), w[c]) for i, d, *w in order)
        assert [(str(r["vec_id"]), r["deviation"]) for r in mine] == [t[:2] for t in theirs]
        a, b = np.array([r["whitened"] for r in mine]), np.array([t[3] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < atol
        assert abs(mine[0]["explained"] - values[c] / np.trace(v)) < 1e-12
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9


def test_whitening_equals_dense_reference(spark):
    rows, table = awkward_vectors(spark)
    got, _ = whitening.whiten(table.repartition(5))
    check_whitening(got.collect(), rows, 1e-8)


def test_whitening_of_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, "embeddings", MEDIUM).collect()]
    check_whitening(QUERIES["op13_embedding_whitening"](spark, str(MEDIUM)).collect(), rows, 1e-8)


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same)[0].collect() == []
    assert whitening.whiten(same.filter("vec_id < 0"))[0].collect() == []
    line = spark.createDataFrame([(i, [i / 256, 2 * i / 256, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line)[0].collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)


def test_sums_beyond_doubles(spark):
    """Integers whose products pass 2^53, and a deviation that no long holds."""
    draw = np.random.default_rng(9)
    rows = [(i, [float(x) for x in draw.integers(-(1 << 26), 1 << 26, 3) / 256.0]) for i in range(40)]
    x = integers(rows)
    assert (whitening.exact_products(x) == x.astype(object).T @ x.astype(object)).all()
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0].collect()
    n, s = len(x), x.astype(object).sum(axis=0)
    wanted = {i: int(((n * y.astype(object) - s) ** 2).sum()) for (i, _), y in zip(rows, x, strict=True)}
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in got} == wanted
    assert all(r["deviation"] == (wanted[r["vec_id"]] if wanted[r["vec_id"]] < 1 << 63 else None) for r in got)


def test_inertia_and_feast():
    draw = np.random.default_rng(1)
    for size in (1, 2, 5, 30):
        basis, _ = np.linalg.qr(draw.standard_normal((size, size)))
        for spectrum in (draw.random(size), np.ones(size), 10.0 ** -np.arange(size), np.arange(size) // 2):
            matrix = (basis * spectrum) @ basis.T
            matrix = (matrix + matrix.T) / 2
            shift = float(np.median(spectrum)) + 1e-7
            assert feast.count_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
            values, vectors = feast.largest(matrix, 4)
            wanted = np.sort(spectrum)[::-1][: len(values)]
            assert np.allclose(values, wanted, atol=1e-13 * max(wanted, default=1))
            assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-13
            assert np.abs(matrix @ vectors - vectors * values).max(initial=0) < 1e-13 * max(spectrum.max(), 1e-9)


def test_missed_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        feast.inside(np.diag([1.0, 2.0, 3.0]), 1.5, 3.5, 3)


def test_clusters_of_the_small_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, "embeddings", SMALL).collect()]
    got = QUERIES["op11_centroid_clustering"](spark, str(SMALL)).collect()
    assert sorted(map(tuple, got)) == sorted(reference(rows))
