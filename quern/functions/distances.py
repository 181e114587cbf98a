"""Vector distances as columns, and the same in numpy for whole blocks of pairs.

A distance takes two array<double> columns. Up to UNROLL dimensions, where the dimension is known, the sum is
written out, which stays inside generated code; beyond that a higher-order function does it. A user's metric is a
scalar callable of two numpy vectors, or with block_metric() one of two matrices, run in Arrow batches; it must be
symmetric, since one value serves both directions of a pair.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 96


def _total(x: Column, y: Column, term: Callable[[Column, Column], Column], dim: int | None) -> Column:
    if dim is None or dim > UNROLL:
        return F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda m, z: m + z)
    parts = [term(F.get(x, F.lit(i)), F.get(y, F.lit(i))) for i in range(dim)]
    while len(parts) > 1:  # a balanced tree keeps the plan shallow
        parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0] if parts else F.lit(0.0)


def euclidean_distance(x: Column, y: Column, dim: int | None = None) -> Column:
    return F.sqrt(_total(x, y, lambda a, b: (a - b) * (a - b), dim))


def manhattan_distance(x: Column, y: Column, dim: int | None = None) -> Column:
    return _total(x, y, lambda a, b: F.abs(a - b), dim)


def cosine_distance(x: Column, y: Column, dim: int | None = None) -> Column:
    """1 - cosine; 1 where either vector is zero."""
    size = lambda v: F.sqrt(_total(v, v, lambda a, b: a * b, dim))
    both = size(x) * size(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(1.0) - _total(x, y, lambda a, b: a * b, dim) / both)


def _l2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def _l1(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y).sum(axis=-1)


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1))
    dot = (x * y).sum(axis=-1)
    return np.where(both == 0, 1.0, 1.0 - dot / np.where(both == 0, 1.0, both))


@dataclass(frozen=True)
class Metric:
    """A distance: column(x, y, dim) for plans, rows(x, y) for arrays of vector pairs."""

    name: str
    column: Callable[..., Column]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]


DISTANCE_FUNCTIONS = {
    "euclidean": Metric("euclidean", euclidean_distance, _l2),
    "cosine": Metric("cosine", cosine_distance, _cosine),
    "manhattan": Metric("manhattan", manhattan_distance, _l1),
}


def get_distance_function(name: str) -> Metric:
    if name not in DISTANCE_FUNCTIONS:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(sorted(DISTANCE_FUNCTIONS))}")
    return DISTANCE_FUNCTIONS[name]


def as_metric(distance: str | Metric | Callable[[np.ndarray, np.ndarray], float] | None) -> Metric:
    """None is Euclidean; a name is looked up; a callable becomes a metric of its own."""
    if distance is None or isinstance(distance, str):
        return get_distance_function(distance or "euclidean")
    if isinstance(distance, Metric):
        return distance

    def rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([float(distance(a, b)) for a, b in zip(*np.broadcast_arrays(x, y))])

    return Metric(getattr(distance, "__name__", "custom"), _in_batches(rows), rows)


def block_metric(distance: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str | None = None) -> Metric:
    """A user's metric from a callable of two matrices, a pair of vectors in each row, that gives a distance a row.

    One call serves thousands of pairs, where as_metric() of a scalar callable makes a call a pair. It too must be
    symmetric.
    """

    def rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.broadcast_arrays(x, y)
        out = np.asarray(distance(x, y), dtype=np.float64)
        if out.shape != (len(x),):
            raise ValueError(f"a block metric must give one distance a row, not the shape {out.shape}")
        return out

    return Metric(name or getattr(distance, "__name__", "custom"), _in_batches(rows), rows)


def _in_batches(rows: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[..., Column]:
    def column(x: Column, y: Column, dim: int | None = None) -> Column:
        @F.pandas_udf("double")
        def apply(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(rows(np.stack(a.to_numpy()), np.stack(b.to_numpy())) if len(a) else [], dtype="float64")

        return apply(x, y)

    return column
