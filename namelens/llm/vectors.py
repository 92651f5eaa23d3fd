"""What the two embedding operators share: which vectors take part, and their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose vector is neither null nor zero and holds finite numbers only, of the commonest length.

    Ties in length go to the shorter. Rows with a null id are left out, as nothing can refer to them.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (lengths.n if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list or binary column of equally long vectors as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
