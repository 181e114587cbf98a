"""Vector sources, generators and result sinks."""

from quern.sources.binary import load_points, load_sift, read_fvecs, read_npy
from quern.sources.generators import (
    generate_clustered,
    generate_gaussian,
    generate_high_hubness,
    generate_uniform,
)
from quern.sources.results import read_result, write_result

__all__ = [
    "generate_clustered", "generate_gaussian", "generate_high_hubness", "generate_uniform", "load_points",
    "load_sift", "read_fvecs", "read_npy", "read_result", "write_result",
]
