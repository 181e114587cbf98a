from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.distances import DISTANCE_FUNCTIONS, as_metric, get_distance_function


def both(spark, x, y, name, dim=None):
    m = get_distance_function(name)
    x, y = list(map(float, x)), list(map(float, y))
    row = spark.createDataFrame([(x, y)], "x array<double>, y array<double>").select(m.column(F.col("x"), F.col("y"), dim).alias("d")).first()
    own = float(m.rows(np.array(x), np.array(y)))
    assert row.d == pytest.approx(own, abs=1e-12)
    return own


@pytest.mark.parametrize("dim", [None, 2, 3])
def test_known_distances(spark, dim):
    if dim in (None, 3):
        assert both(spark, [0.0, 0, 0], [3.0, 4, 0], "euclidean", dim) == 5.0
        assert both(spark, [1.0, 2, 3], [4.0, 6, 3], "manhattan", dim) == 7.0
        assert both(spark, [1.0, 2, 3], [1.0, 2, 3], "euclidean", dim) == 0.0
    if dim in (None, 2):
        assert both(spark, [1.0, 0], [0.0, 1], "cosine", dim) == 1.0
        assert abs(both(spark, [1.0, 0], [2.0, 0], "cosine", dim)) < 1e-6
        assert both(spark, [0.0, 0], [2.0, 0], "cosine", dim) == 1.0


def test_registry():
    assert set(DISTANCE_FUNCTIONS) == {"euclidean", "cosine", "manhattan"}
    with pytest.raises(ValueError, match="manhattan"):
        get_distance_function("chebyshev")
    assert as_metric(None).name == "euclidean"


def test_custom_metric(spark):
    m = as_metric(lambda a, b: np.abs(a - b).max())
    row = spark.createDataFrame([([0.0, 5.0], [1.0, 2.0])], "x array<double>, y array<double>").select(m.column(F.col("x"), F.col("y")).alias("d")).first()
    assert row.d == 3.0
