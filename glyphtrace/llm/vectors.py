"""Dense vectors out of Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector_col: str) -> Column:
    """Whether a vector has components, all finite and not all zero; never null."""
    v = F.col(vector_col).cast("array<double>")
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(F.coalesce(v, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def usable(df: DataFrame, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """(id, v, more): vectors of doubles; those that are null, empty, zero or hold null or non-finite components are left out."""
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), v.alias("v"), *(c.alias(name) for name, c in more.items()), sound(vector_col).alias("sound_")).filter("sound_").drop("sound_")


def by_dimension(b: pa.RecordBatch, column: str = "v"):
    """(row numbers, matrix) for each dimension in the batch."""
    values = b[column]
    lengths = np.asarray(values.value_lengths()).astype(np.int64)
    flat = np.asarray(values.flatten(), dtype=np.float64)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]
