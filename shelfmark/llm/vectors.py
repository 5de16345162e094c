"""What the operators on embeddings share: which vectors take part, and copies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(v: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and holds only finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def finite(v: Column) -> Column:
    """Whether a vector is not null and holds finite components only; zero and empty vectors do."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


#: Scaled components end here on both sides, so that sums of their products fit in 64 bits: components of 65,536 and more.
LARGEST = 1 << 24


def scaled(v: Column) -> Column:
    """floor(256 * x) of every component, at most LARGEST and at least -LARGEST."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    return rows.filter(takes_part(F.col("v")) & F.col("vec_id").isNotNull())


def matrix(column) -> np.ndarray:
    """Vectors of one length as float64 rows."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
