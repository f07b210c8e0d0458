"""Integer vectors, packed for the operators on embeddings."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of the integer vectors stay below this; then a squared distance over 2^7 dimensions fits 63 bits.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integer_vector(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component; one beyond ``LARGEST`` is an error, not a wrong result."""

    def floored(x: Column) -> Column:
        value = x.cast("double") * scale
        beyond = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))
        return F.when(F.abs(value) < LARGEST, F.floor(value).cast("int")).otherwise(beyond.cast("int"))

    return F.transform(vector, floored)


def packed_rows(rows: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(row_id, packed) of the finite vectors of ``dims`` components, four bytes each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [np.asarray(v, dtype="<i4").tobytes() for v in batch["whole"]]
            yield pd.DataFrame({"row_id": batch["row_id"], "packed": packed})

    given = rows.select(F.col(id_col).alias("row_id"), F.col(vector_col).alias("whole")).filter(finite(F.col("whole")) & (F.size("whole") == dims))
    id_type = rows.schema[id_col].dataType.simpleString()
    whole = given.withColumn("whole", integer_vector(F.col("whole"), scale))
    return whole.mapInPandas(pack, f"row_id {id_type}, packed binary")


def slices(batches: Iterator[pd.DataFrame], dims: int, most: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Up to ``most`` rows at a time with their vectors as a matrix."""
    for batch in batches:
        for at in range(0, len(batch), most):
            rows = batch.iloc[at : at + most]
            yield rows, np.frombuffer(b"".join(rows["packed"]), dtype="<i4").reshape(len(rows), dims).astype(np.int64)
