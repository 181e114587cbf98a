"""Run results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "recall double, dist_comps bigint, iterations int, "
    "iter_log array<struct<iter: int, updates: bigint, dist: bigint, time: double>>, "
    "time double, mode string, rate double, rho double"
)


def write_result(spark: SparkSession, result: dict, folder: str) -> str:
    """Writes to folder/result_{mode}_{rate}; returns that path."""
    path = f"{folder.rstrip('/')}/result_{result['mode']}_{round(result['rate'] * 100)}"
    row = dict(result) | {"iter_log": [(r["iter"], r["updates"], r["dist"], float(r["time"])) for r in result["iter_log"]]}
    names = [c.strip().split(" ")[0] for c in ("recall", "dist_comps", "iterations", "iter_log", "time", "mode", "rate", "rho")]
    spark.createDataFrame([tuple(row[c] for c in names)], SCHEMA).coalesce(1).write.mode("overwrite").json(path)
    return path


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
