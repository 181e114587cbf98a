"""k-nearest-neighbour graphs and large-corpus operators on Spark DataFrames."""

from quern.functions.distances import block_metric, cosine_distance, euclidean_distance, manhattan_distance
from quern.operators.graph import KNNGraph
from quern.operators.tracking import NetSourceTracker, SourceFrequencyTracker
from quern.plans.descent import nn_descent_adaptive, nn_descent_naive, nn_descent_optimized
from quern.plans.estimators import AdaptiveNNDescent, NaiveNNDescent, OptimizedNNDescent
from quern.plans.ml import KNNGraphEstimator, KNNGraphModel
from quern.sources import (
    generate_clustered,
    generate_gaussian,
    generate_high_hubness,
    generate_uniform,
    load_points,
    load_sift,
    read_fvecs,
    read_npy,
)

__version__ = "0.3.0"
__all__ = [
    "AdaptiveNNDescent", "KNNGraph", "KNNGraphEstimator", "KNNGraphModel", "NaiveNNDescent", "NetSourceTracker",
    "OptimizedNNDescent", "SourceFrequencyTracker", "block_metric", "cosine_distance", "euclidean_distance", "generate_clustered", "generate_gaussian", "generate_high_hubness",
    "generate_uniform", "load_points", "load_sift", "manhattan_distance", "nn_descent_adaptive", "nn_descent_naive",
    "nn_descent_optimized", "read_fvecs", "read_npy",
]
