"""Benchmark runs: one configuration, a comparison of variants, and the hubness trio."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from quern.operators.exact import knn_exact, recall
from quern.plans.descent import Settings, descend
from quern.session import local_session, materialize
from quern.sources import generators, load_points, write_result


class Timer:
    """with Timer() as t: ...; t.seconds afterwards."""

    def __enter__(self):
        self.began, self.seconds = time.perf_counter(), 0.0
        return self

    def __exit__(self, *_):
        self.seconds = time.perf_counter() - self.began


def run_config(points: DataFrame, truth: DataFrame, k: int, sample_rate: float, mode: str, rho: float = 0.8, seed: int = 42, distance="euclidean") -> dict:
    """mode random samples candidates uniformly, adaptive by their sources' successes after the warm-up."""
    if mode not in ("random", "adaptive"):
        raise ValueError(f"unknown mode {mode!r}")
    s = Settings(k=k, rho=rho, sample_rate=sample_rate, seed=seed, candidates_weighted=mode == "adaptive")
    with Timer() as t:
        result = descend(points, s, distance)
    found = recall(result.graph, truth).first()["recall"]
    return {
        "recall": round(found, 4), "dist_comps": result.distances, "iterations": len(result.log), "iter_log": result.log,
        "time": round(t.seconds, 1), "mode": mode, "rate": sample_rate, "rho": rho,
    }


def compare(points: DataFrame, k: int, sample_rate: float = 0.5, rho: float = 0.8, seed: int = 42) -> list[dict]:
    """Optimized, adaptive in full, adaptive sampled: seconds, distances, recall."""
    points = materialize(points.select("id", "vec"), "compare")
    truth = materialize(knn_exact(points, k, points.count()), "truth")
    rows = []
    for name, s in (
        ("optimized", Settings(k=k, rho=rho, seed=seed)),
        ("adaptive", Settings(k=k, rho=rho, seed=seed, rho_weighted=True)),
        ("adaptive sampled", Settings(k=k, rho=rho, seed=seed, rho_weighted=True, candidates_weighted=True, sample_rate=sample_rate)),
    ):
        with Timer() as t:
            r = descend(points, s)
        rows.append({"name": name, "seconds": t.seconds, "distances": r.distances, "recall": recall(r.graph, truth).first()["recall"]})
    for r in rows:
        r["overhead"] = 100 * (r["seconds"] / rows[0]["seconds"] - 1)
    return rows


def hubness_trio(spark: SparkSession, n: int = 5_000, k: int = 10, rate: float = 0.5, real: DataFrame | None = None) -> list[dict]:
    """Random against adaptive sampling on real vectors, where given, and on normal data of 100 and 10 dimensions."""
    sets = {"normal 100": generators.generate_high_hubness(spark, n, 100), "normal 10": generators.generate_gaussian(spark, n, 10)}
    if real is not None:
        sets = {"real": real} | sets
    rows = []
    for name, points in sets.items():
        points = materialize(points, "hubness")
        truth = materialize(knn_exact(points, k, points.count()), "truth")
        rows += [run_config(points, truth, k, rate, mode) | {"data": name} for mode in ("random", "adaptive")]
    return rows


def main(args=None, spark: SparkSession | None = None) -> dict:
    """python -m quern.plans.experiments MODE RATE [RHO]: one run on stored vectors, its result as JSON."""
    p = argparse.ArgumentParser(description="One sampled descent measured against the exact graph.")
    p.add_argument("mode", choices=["random", "adaptive"])
    p.add_argument("rate", type=float)
    p.add_argument("rho", type=float, nargs="?", default=0.8)
    p.add_argument("--fvecs", default="data/siftsmall/siftsmall_base.fvecs")
    p.add_argument("--cache", default="data/cache/points.parquet")
    p.add_argument("--out", default="data/cache")
    p.add_argument("--n", type=int, default=10_000)
    p.add_argument("--k", type=int, default=20)
    a = p.parse_args(args)
    spark = spark or local_session("quern-run")
    points = materialize(load_points(spark, a.fvecs, a.cache, a.n), "run")
    truth = materialize(knn_exact(points, a.k, points.count()), "truth")
    result = run_config(points, truth, a.k, a.rate, a.mode, a.rho)
    path = write_result(spark, result, a.out)
    print(f"{path}: recall {result['recall']:.4f}, {result['dist_comps']} distances, {result['iterations']} rounds, {result['time']} s")
    return result


if __name__ == "__main__":
    main()
