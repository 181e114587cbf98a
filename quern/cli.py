"""Command line: python -m quern.cli --data clustered --algorithm all --k 10"""

from __future__ import annotations

import argparse

from quern.operators.exact import knn_exact, recall
from quern.plans import descent
from quern.plans.experiments import Timer
from quern.session import local_session, materialize
from quern.sources import generators, read_fvecs


def parse(args=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Build k-nearest-neighbour graphs and measure them against the exact one.")
    p.add_argument("--data", choices=["uniform", "gaussian", "clustered", "high-hubness", "sift"], default="uniform")
    p.add_argument("--sift-path", default="data/sift/sift_base.fvecs")
    p.add_argument("--n", type=int, default=1000)
    p.add_argument("--dim", type=int, default=50)
    p.add_argument("--n-clusters", type=int, default=10)
    p.add_argument("--algorithm", choices=["naive", "optimized", "adaptive", "all"], default="all")
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--distance", choices=["euclidean", "cosine", "manhattan"], default="euclidean")
    p.add_argument("--max-iter", type=int, default=20)
    p.add_argument("--rho", type=float, default=0.8)
    p.add_argument("--delta", type=float, default=0.001)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--sketch-size", type=int, default=6)
    p.add_argument("--sample-rate", type=float, default=1.0)
    p.add_argument("--warmup", type=int, default=2)
    return p.parse_args(args)


def make_points(spark, a: argparse.Namespace):
    return {
        "uniform": lambda: generators.generate_uniform(spark, a.n, a.dim, seed=a.seed),
        "gaussian": lambda: generators.generate_gaussian(spark, a.n, a.dim, seed=a.seed),
        "clustered": lambda: generators.generate_clustered(spark, a.n, a.dim, a.n_clusters, seed=a.seed).select("id", "vec"),
        "high-hubness": lambda: generators.generate_high_hubness(spark, a.n, a.dim, seed=a.seed),
        "sift": lambda: read_fvecs(spark, a.sift_path, a.n),
    }[a.data]()


def main(args=None, spark=None) -> list[tuple]:
    a = parse(args)
    spark = spark or local_session("quern-cli")
    points = materialize(make_points(spark, a), "cli")
    truth = materialize(knn_exact(points, a.k, points.count(), a.distance), "truth")
    common = {"k": a.k, "distance": a.distance, "max_iterations": a.max_iter, "seed": a.seed, "verbose": not a.quiet}
    sampled = {"rho": a.rho, "delta": a.delta, "sample_rate": a.sample_rate}
    runs = {
        "naive": lambda: descent.nn_descent_naive(points, **common),
        "optimized": lambda: descent.nn_descent_optimized(points, **common, **sampled),
        "adaptive": lambda: descent.nn_descent_adaptive(
            points, **common, **sampled, warmup_iterations=a.warmup, sketch_lg_max_k=a.sketch_size, candidates_weighted=a.sample_rate < 1
        ),
    }
    rows = []
    for name, run in runs.items():
        if a.algorithm in (name, "all"):
            with Timer() as t:
                r = run()
            rows.append((name, recall(r.graph, truth).first()["recall"], r.distances, len(r.log), round(t.seconds, 2)))
    spark.createDataFrame(rows, "algorithm string, recall double, distances bigint, rounds int, seconds double").show()
    return rows


if __name__ == "__main__":
    main()
