"""Helpers for searches over a table of vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, vec as double array, dim) of vectors that take part.

    Dropped: null ids, null or empty vectors, vectors with null or non-finite components. Rows that repeat
    an id are folded to one, the smallest vector in array order.
    """
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def matrix(table, column: str, dim: int) -> np.ndarray:
    """A list column of an Arrow table as rows of a matrix."""
    if not table.num_rows:
        return np.zeros((0, dim))
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(column).chunks]).reshape(-1, dim)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]
