"""Vector columns: which rows take part, and Arrow conversions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column, zero: bool) -> Column:
    """Not null or empty, all components finite; not all zero unless ``zero``."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zero else F.exists(vec, lambda x: x != 0)
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & some, F.lit(False))


def take_part(table: DataFrame, id_col: str, vec_col: str, zero: bool = False) -> DataFrame:
    """(id, vec) of the rows that take part: usable vectors of the table's most frequent dimension, ids not null."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec"), zero))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(common.select("d")), F.size("vec") == F.col("d"), "left_semi")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)
