"""Embeddings as numpy matrices inside Arrow tasks, and which of them can be worked with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) for each width among the lists of a column that has no nulls."""
    widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, edges = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(widths)))
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, flat[edges[rows][:, None] + np.arange(width)]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of ``width`` components each."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def units(of: np.ndarray) -> np.ndarray:
    """Rows at length 1, whatever their size; none is zero."""
    of = of / np.abs(of).max(axis=1, keepdims=True)
    return of / np.sqrt((of * of).sum(axis=1, keepdims=True))


def is_finite(vector: Column) -> Column:
    """Whether a vector has components, none of which is null or not finite."""
    number = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is above all numbers
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number), F.lit(False))


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Of rows (vec_id, ...) that repeat a vec_id, the greatest."""
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    rest = [c for c in rows.columns if c != "vec_id"]
    return rows.groupBy("vec_id").agg(F.max(F.struct(*rest)).alias("row")).select("vec_id", "row.*").select(*rows.columns)
