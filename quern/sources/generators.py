"""Point generators. Every component is a hash of (seed, id, place), so rows don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.rng import normal, uniform


def _points(spark: SparkSession, n: int, dim: int, component, ids: DataFrame | None) -> DataFrame:
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: component(F.col("id"), j))
    own = spark.range(n) if ids is None else ids.select("id")
    return own.select("id", vec.alias("vec"))


def generate_uniform(spark: SparkSession, n: int, dim: int, low: float = 0.0, high: float = 1.0, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """id, vec. ids: a table of ids, which get a point each, in place of 0 to n - 1; so also for the other generators."""
    return _points(spark, n, dim, lambda i, j: F.lit(float(low)) + F.lit(float(high - low)) * uniform(seed, "uniform", i, j), ids)


def generate_gaussian(spark: SparkSession, n: int, dim: int, mean: float = 0.0, std: float = 1.0, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    return _points(spark, n, dim, lambda i, j: F.lit(float(mean)) + F.lit(float(std)) * normal(seed, "gaussian", i, j), ids)


def generate_high_hubness(spark: SparkSession, n: int, dim: int = 100, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """Isotropic normal data; in many dimensions few points are in most lists."""
    return generate_gaussian(spark, n, dim, seed=seed, ids=ids)


def generate_clustered(
    spark: SparkSession, n: int, dim: int, n_clusters: int = 10, std: float = 0.3, spread: float = 5.0, seed: int = 42, ids: DataFrame | None = None
) -> DataFrame:
    """id, vec, cluster: n // n_clusters points around each normal centre; the rest make one more cluster."""
    each = max(1, n // n_clusters)

    def component(i: Column, j: Column) -> Column:
        centre = F.lit(float(spread)) * normal(seed, "centre", F.floor(i / each), j)
        return centre + F.lit(float(std)) * normal(seed, "around", i, j)

    return _points(spark, n, dim, component, ids).withColumn("cluster", F.floor(F.col("id") / each))
