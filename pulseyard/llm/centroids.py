"""Centroid clustering of integer vectors, with distances gathered from scalar lookup tables."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseyard.session import stored

from .vectors import packed_rows, slices

OUTPUT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

#: Vectors whose distances are held at a time. Tables have a row for each value that occurs among them.
SLICE = 4096


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, and for each entry the place of its value among them."""
    low = values.min()
    width = int(values.max()) - int(low) + 1
    if width > 4 * len(values):
        return np.unique(values, return_inverse=True)
    present = np.zeros(width, dtype=bool)
    shifted = values - low
    present[shifted] = True
    place = np.cumsum(present) - 1
    return np.nonzero(present)[0] + low, place[shifted]


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every vector to every centroid, exact, in 64-bit integers.

    For each dimension a table holds the squared difference of every value that occurs in it to every
    centroid. The distances are sums of table rows; no difference is worked out for a vector.
    """
    total = np.zeros((len(vectors), len(centroids)), dtype=np.int64)
    row = np.empty_like(total)
    for dim in range(vectors.shape[1]):
        values, place = occurring(vectors[:, dim])
        table = np.square(values.astype(np.int64)[:, None] - centroids[:, dim])
        total += np.take(table, place, axis=0, out=row, mode="clip")
    return total


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller among equals, and the squared distance to it."""
    distances = squared_distances(vectors, centroids)
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(vectors)), cluster]


def first_centroids(vectors: DataFrame, k: int, salt: str, dims: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes; ``k`` rows come to the driver, found by a top-k per task.

    Repeated ids stand in the order of their vectors, null ids come last.
    """
    chance = F.sha2(F.concat(F.lit(salt), F.col("row_id").cast("string")), 256)
    rows = vectors.orderBy(chance.asc_nulls_last(), F.hex("packed")).limit(k).collect()
    return np.frombuffer(b"".join(r["packed"] for r in rows), dtype="<i4").reshape(len(rows), dims).astype(np.int64)


def moved_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, every centroid that has vectors to the floor of their mean.

    A task hands on one row of exact sums per centroid; Spark adds them, and ``k`` rows reach the driver.
    """
    k, dims = centroids.shape

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, found in slices(batches, dims, SLICE):
            cluster, _ = nearest(found, centroids)
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            sums[held] += np.add.reduceat(found[order], starts, axis=0)
            counts += np.bincount(cluster, minlength=k)
        used = np.nonzero(counts)[0]
        yield pd.DataFrame({"cluster": used, "n": counts[used], "sums": list(sums[used])})

    parts = vectors.select("packed").mapInPandas(summed, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(dims)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(row_id, cluster, distance) for every vector."""
    dims = centroids.shape[1]
    id_type = vectors.schema["row_id"].dataType.simpleString()

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, found in slices(batches, dims, SLICE):
            cluster, distance = nearest(found, centroids)
            yield pd.DataFrame({"row_id": rows["row_id"], "cluster": cluster, "distance": distance})

    return vectors.mapInPandas(placed, f"row_id {id_type}, cluster int, distance long")


def cluster(
    rows: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    salt: str = "2:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """The id of every usable vector with ``OUTPUT``, and the final centroids.

    Vectors with another number of components, or with a null or non-finite one, are left out; null
    vectors too. A component x becomes ``floor(scale * x)``; if that is beyond 2^27 the job fails
    with a message. Centroids start as the ``k`` vectors with the smallest SHA-256 of salt and id, as many
    as there are if fewer. In each round vectors go to the nearest centroid (squared Euclidean distance, the
    smaller number among equals) and centroids to the exact floor of the mean of theirs; one without
    vectors stays. Then all are assigned once more. Repeated rows count as often as they occur, ties among
    null or repeated ids are settled by the vectors, other columns are ignored, an empty table gives none.

    Vectors are packed once, 4 bytes a component, into a table in the shared folder. Every round reads it
    and sends one row per task and centroid; nothing else moves, so a cluster that holds most vectors is
    no larger a group than another. Distances come from tables over the values that occur in a slice of
    ``SLICE`` vectors (``squared_distances``): memory is bounded, whatever values the data hold.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    vectors = stored(packed_rows(rows, dims, scale, id_col, vector_col))
    centroids = first_centroids(vectors, k, salt, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved_centroids(vectors, centroids)
    if not len(centroids):
        nothing = f"{OUTPUT[0]} int, {OUTPUT[1]} long, {OUTPUT[2]} long, {OUTPUT[3]} long, {OUTPUT[4]} string"
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {id_type}, {nothing}"), centroids
    found = stored(assigned(vectors, centroids))
    per_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = {r["cluster"]: r["cluster_inertia"] for r in per_cluster.collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = F.array(*[F.lit(inertia.get(i)).cast("long") for i in range(len(centroids))])
    by_digest = F.array(*[F.lit(d) for d in digests])
    return found.select(
        F.col("row_id").alias(id_col),
        "cluster",
        "distance",
        F.get(by_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(by_digest, F.col("cluster")).alias("centroid_sha256"),
    ), centroids
