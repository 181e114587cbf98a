"""Column functions: vector distances and hash-seeded randomness."""

from quern.functions.distances import (
    DISTANCE_FUNCTIONS,
    block_metric,
    cosine_distance,
    euclidean_distance,
    get_distance_function,
    manhattan_distance,
)
from quern.functions.rng import normal, uniform

__all__ = [
    "DISTANCE_FUNCTIONS", "block_metric", "cosine_distance", "euclidean_distance", "get_distance_function", "manhattan_distance",
    "normal", "uniform",
]
