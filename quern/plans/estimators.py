"""fit / get_neighbors wrappers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.operators.graph import to_lists
from quern.plans import descent


class _Estimator:
    _build = None

    def __init__(self, k: int = 10, distance="euclidean", verbose: bool = False, **settings):
        self.k, self.distance, self.verbose, self.settings = k, distance, verbose, settings
        self.result_: descent.Result | None = None

    def fit(self, points: DataFrame):
        """points: id, vec."""
        self.result_ = type(self)._build(points, k=self.k, distance=self.distance, verbose=self.verbose, **self.settings)
        return self

    def get_neighbors(self) -> DataFrame:
        """p, neighbors: ids by ascending distance; n - 1 of them where k is larger."""
        if self.result_ is None:
            raise ValueError("fit must be called first")
        return to_lists(self.result_.graph)

    def get_graph(self) -> DataFrame | None:
        return self.result_.graph if self.result_ else None


class NaiveNNDescent(_Estimator):
    _build = staticmethod(descent.nn_descent_naive)


class OptimizedNNDescent(_Estimator):
    _build = staticmethod(descent.nn_descent_optimized)


class AdaptiveNNDescent(_Estimator):
    _build = staticmethod(descent.nn_descent_adaptive)
