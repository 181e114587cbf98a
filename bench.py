"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import importlib
import importlib.util
import json
import os
import time

os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")]))

from quern.operators.exact import knn_exact, recall  # noqa: E402
from quern.plans import catalog, descent  # noqa: E402
from quern.session import local_session, materialize  # noqa: E402
from quern.sources import generate_clustered  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ("knn_exact_l2", "knn_exact_cosine", "knn_exact_l1", "descent_optimized_r2", "descent_adaptive_r3", "recall_descent_vs_exact")
N, DIM, K = 10_000, 128, 20


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 2)


def main() -> None:
    spark = local_session("quern-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000).selectExpr("sum(id)").collect()
    seconds, extra = {}, {}
    for name in HEADLINE:
        seconds[name] = timed(lambda: catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    points = materialize(generate_clustered(spark, N, DIM, 50, std=1.5).select("id", "vec"), "bench")
    truth = None

    def exact() -> None:
        nonlocal truth
        truth = materialize(knn_exact(points, K, N), "truth")

    seconds["exact_10k_d128_k20"] = timed(exact)
    half = descent.Settings(k=K, rho=0.8, sample_rate=0.5, candidates_weighted=True)
    for name, s in (("optimized_10k_d128_k20", descent.Settings(k=K, rho=0.8)), ("adaptive_50_10k_d128_k20", half)):
        result = None

        def run() -> None:
            nonlocal result
            result = descent.descend(points, s)

        seconds[name] = timed(run)
        extra[name] = {"recall": round(recall(result.graph, truth).first()["recall"], 4), "distances": result.distances, "rounds": len(result.log)}
    if importlib.util.find_spec("quern.llm"):
        own = importlib.import_module("quern.llm.entries").QUERIES
        for name in sorted(own, key=lambda x: int(x[2:].split("_")[0])):
            seconds[name] = timed(lambda: own[name](spark, SF).write.format("noop").mode("overwrite").save())
    total = round(sum(seconds.values()), 2)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/")), "quality": extra}), flush=True)


if __name__ == "__main__":
    main()
