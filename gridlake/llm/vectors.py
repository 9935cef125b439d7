"""Vector columns as integer arrays of one length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether the vector is there, has entries, and none of them is null, NaN or infinite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def grid(vector: str, times: float, most: float) -> Column:
    """floor(times * entry) of each entry, held within +-most."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * times, F.lit(most)), F.lit(-most))))


def one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector has the most frequent length (the longest of equally frequent), and that length; 0 if there are none."""
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    first = sizes.orderBy(F.col("c").desc(), F.col("d").desc()).first()
    return (rows.filter(F.size(vector) == first["d"]), first["d"]) if first else (rows, 0)


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """A list column without nulls as a matrix of its rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
