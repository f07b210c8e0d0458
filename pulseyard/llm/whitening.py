"""Whitening of embeddings by the largest eigenpairs of their exact covariance."""

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseyard.session import stored

from . import feast
from .vectors import finite, packed_rows, slices

OUTPUT = ("component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact")

#: Vectors in a matrix at a time.
SLICE = 4096


class Fit(NamedTuple):
    """What whitening needs: all of it is of a size that depends on the dimensions alone."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """``n`` times the distance of the mean from the integer centre, exactly."""
        return [s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)]


def exact_products(centred: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of columns, as exact integers.

    Products of doubles are exact as long as no sum passes 2^53, which is what vectors of ordinary size
    give; larger ones take integers of any length.
    """
    reach = int(np.abs(centred).max(initial=0))
    if reach * reach * max(len(centred), 1) < 1 << 53:
        wide = centred.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    wide = centred.astype(object)
    return wide.T @ wide


def column_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension; one row per task is added up."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, np.zeros(dims, dtype=np.int64)
        for rows, found in slices(batches, dims, SLICE):
            n, sums = n + len(rows), sums + found.sum(axis=0)
        yield pd.DataFrame({"n": [n], "sums": [sums]})

    parts = vectors.select("packed").mapInPandas(summed, "n long, sums array<long>")
    each = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    row = parts.agg(F.sum("n").alias("n"), *each).first()
    return int(row["n"] or 0), [int(row[f"s{d}"] or 0) for d in range(dims)]


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance with divisor ``n``, every entry rounded once from its exact value.

    Vectors are centred before they are multiplied: first on the integers next to the mean, so that sums
    of products stay exact and do not depend on the order of tasks; what the mean is off these integers
    (half a unit at most) is then taken out exactly. A task hands on one row per dimension.
    """
    dims = len(sums)
    fit = Fit(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    centre, rest = fit.centre, fit.rest

    def multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims), dtype=object)
        for _, found in slices(batches, dims, SLICE):
            total = total + exact_products(found - centre)
        products = [[Decimal(int(x)) for x in row] for row in total]
        yield pd.DataFrame({"i": np.arange(dims), "products": products})

    parts = vectors.select("packed").mapInPandas(multiplied, "i int, products array<decimal(38,0)>")
    each = [F.sum(F.get("products", F.lit(j))).alias(f"p{j}") for j in range(dims)]
    out = np.zeros((dims, dims))
    for row in parts.groupBy("i").agg(*each).collect():  # as many rows as dimensions
        i = row["i"]
        out[i] = [(n * int(row[f"p{j}"]) - rest[i] * rest[j]) / (n * n) for j in range(dims)]
    return out


def projections(found: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened coordinates of integer vectors, one column per component."""
    centred = (found - fit.centre) - np.array([r / fit.n for r in fit.rest])
    return centred @ fit.vectors / np.sqrt(fit.values)


def deviations(found: np.ndarray, fit: Fit) -> list[int]:
    """Exact squared length of ``n * x - S`` for every vector."""
    reach = fit.n * int(np.abs(found - fit.centre).max(initial=0)) + max(map(abs, fit.rest), default=0)
    fits = reach * reach * max(len(fit.sums), 1) < 1 << 63
    kind = np.int64 if fits else object
    spread = (found - fit.centre).astype(kind) * (fit.n if fits else int(fit.n)) - np.array(fit.rest, dtype=kind)
    return [int(x) for x in (spread * spread).sum(axis=1)]


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity.

    Spark's ``covar_pop`` keeps centred products and merges them between tasks.
    """
    dims, size = len(fit.sums), len(fit.values)
    names = [f"w{c}" for c in range(size)]

    def whitened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, found in slices(batches, dims, SLICE):
            yield pd.DataFrame(projections(found, fit), columns=names)

    rows = vectors.select("packed").mapInPandas(whitened, ", ".join(f"{name} double" for name in names))
    pairs = [(a, b) for a in range(size) for b in range(a + 1)]
    row = rows.agg(*[F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(
    rows: DataFrame,
    components: int = 4,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, Fit]:
    """The id of every row that remains and, for each component, ``OUTPUT``; and the fit.

    Rows whose vector is null or holds a null or non-finite entry are left out; so are vectors of another
    length than most have (of the longer one, if two lengths are as frequent), and empty ones. An entry c
    becomes ``floor(scale * c)``; beyond 2^27 the job fails with a message. The fit list holds each
    distinct vector once, however many rows repeat it; every remaining row gets its result, repeated rows
    the same. Components are numbered from 1 by falling eigenvalue; directions without variance (1e-13 of
    the trace or less) have none, so a table whose vectors are all equal, or that is empty, gives no rows.
    Components of equal eigenvalues are any orthonormal basis of their space. ``deviation`` is null where
    it does not fit a long; ``deviation_exact`` has it always. Other columns are ignored.

    The fit is exact up to the eigenvectors: integer sums and products that tasks add up in any order,
    then FEAST (see ``feast``) on a matrix of dims x dims on the driver. Only distinct vectors are
    shuffled, four bytes an entry and one copy per task.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    lengths = rows.filter(finite(F.col(vector_col))).groupBy(F.size(vector_col).alias("dims")).agg(F.count(F.lit(1)).alias("rows")).filter("dims > 0")
    most = lengths.orderBy(F.desc("rows"), F.desc("dims")).first()
    dims = most["dims"] if most else 0
    packed = stored(packed_rows(rows, dims, scale, id_col, vector_col))
    distinct = stored(packed.select("packed").distinct())
    n, sums = column_sums(distinct, dims)
    matrix = covariance(distinct, n, sums) if n else np.zeros((0, 0))
    values, vectors = feast.largest(matrix, components)
    fit = Fit(n, sums, values, vectors, float(np.trace(matrix)))
    types = ("int", "long", "long", "double", "double", "double", "decimal(38,0)")
    if not len(values):
        schema = ", ".join(f"{name} {kind}" for name, kind in zip(OUTPUT, types, strict=True))
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {id_type}, {schema}"), fit
    error = identity_error(distinct, fit)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held, found in slices(batches, dims, SLICE):
            exact = [Decimal(x) for x in deviations(found, fit)]
            yield pd.DataFrame({"row_id": held["row_id"], "whitened": list(projections(found, fit)), "deviation_exact": exact})

    done = packed.mapInPandas(placed, f"row_id {id_type}, whitened array<double>, deviation_exact decimal(38,0)")
    shares = F.array(*[F.lit(float(v) / fit.trace) for v in values])
    out = done.select("row_id", "deviation_exact", F.posexplode("whitened").alias("place", "whitened"))
    columns = (
        (F.col("place") + 1).cast("int"),
        F.lit(n).cast("long"),
        F.col("deviation_exact").try_cast("long"),
        F.col("whitened"),
        F.get(shares, F.col("place")),
        F.lit(error),
        F.col("deviation_exact"),
    )
    return out.select(F.col("row_id").alias(id_col), *[c.alias(name) for c, name in zip(columns, OUTPUT, strict=True)]), fit
