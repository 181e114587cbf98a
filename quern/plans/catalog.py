"""Every operator as a query over the embeddings table, and the SQL that gives the same rows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.distances import block_metric
from quern.operators import candidates as cand
from quern.operators import exact, graph, points, tracking
from quern.plans import descent, oracle
from quern.session import materialize, scratch_dir
from quern.sources import generators, results

K, RHO, SEED, RATE = oracle.K, 0.8, oracle.SEED, oracle.RATE
METRICS = {"l2": "euclidean", "cosine": "cosine", "l1": "manhattan"}
ADAPTIVE = descent.Settings(k=K, rho=RHO, seed=SEED, rho_weighted=True)
OPTIMIZED = descent.Settings(k=K, rho=RHO, seed=SEED)


class Run:
    """The table's points and the graphs of the first rounds, each made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, distance: str = "euclidean"):
        self.points = materialize(points.as_points(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "points")
        self.n, dim = points.dimension(self.points)
        self.distances = graph.Distances(self.points, self.n, dim, distance)
        self.graphs: list[DataFrame] = []
        self.found: list[DataFrame] = [None]
        self.counts = tracking.empty_counts(self.points)

    def graph(self, t: int, s: descent.Settings = OPTIMIZED) -> DataFrame:
        while len(self.graphs) <= t:
            if not self.graphs:
                self.graphs.append(materialize(graph.initial_graph(self.points, K, self.n, SEED, self.distances), "graph"))
                continue
            i = len(self.graphs)
            merged, found = descent.refine_round(self.graphs[-1], self.counts, s, i, self.distances)
            self.graphs.append(materialize(merged, "graph"))
            self.found.append(found)
            if s.tracked:
                delta = tracking.successes(found, self.graphs[-1])
                self.counts = materialize(tracking.prune(tracking.record(self.counts, delta), s.sketch_lg_max_k), "counts")
        return self.graphs[t]

    def sampled(self) -> DataFrame:
        return cand.rho_sample(cand.new_old_lists(self.graph(1)), OPTIMIZED.sample_size, SEED, 2)

    def hops(self) -> DataFrame:
        return cand.two_hop(self.graph(1), self.sampled())


def _rounded(edges: DataFrame) -> DataFrame:
    return edges.select("p", "q", F.round("dist", 4).alias("dist"), "is_new")


def _exact(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pts = materialize(points.as_points(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "points")
        n, _ = points.dimension(pts)
        return exact.knn_exact(pts, K, n, metric).select("p", "rank", "q", F.round("dist", 4).alias("dist"))

    return query


def _pairs(metric):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pts = materialize(points.as_points(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "points")
        n, dim = points.dimension(pts)
        pairs = graph.random_edges(pts, K, n, SEED)
        return exact.pair_distances(pts, pairs, metric, dim).select("p", "q", F.round("dist", 6).alias("dist"))

    return query


def _on_run(f, distance: str = "euclidean"):
    return lambda spark, sf_dir: f(Run(spark, sf_dir, distance))


def _update_count(r: Run) -> DataFrame:
    after = r.graph(1).where("is_new").agg(F.count(F.lit(1)).alias("updates"))
    return after.crossJoin(r.found[1].agg(F.count(F.lit(1)).alias("dist")))  # one row each


def _naive(r: Run, rounds: int) -> DataFrame:
    edges = r.graph(0)
    for _ in range(rounds):
        edges = materialize(descent.naive_round(edges, K, r.distances)[0], "graph")
    return edges


def _tracked(r: Run, t: int = 1) -> DataFrame:
    r.graph(t, ADAPTIVE)
    return r.counts


def _log(r: Run) -> DataFrame:
    s = OPTIMIZED
    return descent.descend(r.points, s, rounds=2).log_frame().drop("time")


def _weights(r: Run, damped: bool = False) -> DataFrame:
    counts = _tracked(r)
    return tracking.candidate_weights(r.hops(), counts, exact.in_degree(r.graph(1)) if damped else None, K)


def _weights_rounded(r: Run, damped: bool = False) -> DataFrame:
    return _weights(r, damped).withColumn("weight", F.round("weight", 6))


def _net(r: Run) -> DataFrame:
    r.graph(2, ADAPTIVE)
    took = r.graph(1).where("is_new").select(F.col("p").alias("v"), F.col("q").alias("c"))
    brought = r.found[1].join(took, ["v", "c"])
    gone = graph.evicted(r.graph(1), r.graph(2)).select(F.col("p").alias("v"), F.col("q").alias("c"))
    lost = brought.join(gone, ["v", "c"]).select("v", F.col("source").alias("u"), F.lit(1).alias("freq"))
    return tracking.penalize(r.counts, lost)


def _recall(r: Run) -> DataFrame:
    truth = exact.knn_exact(r.points, K, r.n)
    return exact.recall(r.graph(2), truth).withColumn("recall", F.round("recall", 6))


def _converged(s: descent.Settings, naive: bool = False):
    return lambda r: graph.neighbors(descent.descend(r.points, s, naive=naive).graph).select("p", "rank", "q", F.round("dist", 4).alias("dist"))


def _flat(pts: DataFrame) -> DataFrame:
    return pts.select("id", F.posexplode("vec").alias("j", "x")).select("id", F.col("j").cast("bigint").alias("j"), F.round("x", 6).alias("x"))


def _generated(make):
    """A generated point for each row of the table, its components a row each."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = points.as_points(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("id")
        return _flat(make(spark, ids.count(), ids))

    return query


def _lists(r: Run) -> DataFrame:
    return graph.to_lists(r.graph(2)).select("p", F.posexplode("neighbors").alias("rank", "q")).select("p", (F.col("rank") + 1).alias("rank"), "q")


def _largest(a, b):
    """A user's metric on matrices: the largest difference of a component, a row."""
    return abs(a - b).max(axis=1)


def _sketch(r: Run) -> DataFrame:
    """v, n, sources, within: each point's successes of two rounds, its sources, and whether all sketched counts are in their bound."""
    r.graph(2)
    exact_counts, tracker = None, tracking.SketchTracker(r.points, 8)
    for t in (1, 2):
        tracker.record(tracking.success_events(r.found[t], r.graphs[t]))
        own = tracking.successes(r.found[t], r.graphs[t])
        exact_counts = own if exact_counts is None else tracking.record(exact_counts, own)
    there = exact_counts.groupBy("v").agg(F.sum("freq").cast("bigint").alias("n"), F.count(F.lit(1)).alias("sources"))
    both = exact_counts.join(tracker.estimates().select("v", "u", F.col("freq").alias("near")), ["v", "u"], "left").join(there, "v")
    off = F.abs(F.col("freq") - F.coalesce("near", F.lit(0)))
    return both.groupBy("v", "n", "sources").agg(F.bool_and(off <= F.ceil(F.col("n") * tracker.error())).alias("within"))


def _json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's result, with its recall, written as JSON and read again."""
    r = Run(spark, sf_dir)
    began = time.perf_counter()
    found = descent.descend(r.points, OPTIMIZED, rounds=2)
    spent = time.perf_counter() - began
    share = exact.recall(found.graph, exact.knn_exact(r.points, K, r.n)).first()["recall"]
    run = {"recall": share, "dist_comps": found.distances, "iterations": len(found.log), "iter_log": found.log, "time": spent, "mode": "random", "rate": 1.0, "rho": RHO}
    path = results.write_result(spark, run, f"{scratch_dir(spark)}/quern/results-{uuid.uuid4().hex}")
    rows = results.read_result(spark, path).select(F.round("recall", 6).alias("recall"), "dist_comps", "iterations", "mode", "rate", F.explode("iter_log").alias("_e"))
    return rows.select("recall", "dist_comps", "iterations", "mode", "rate", F.col("_e.iter").alias("iter"), F.col("_e.updates").alias("updates"), F.col("_e.dist").alias("dist"))


HALF = {"rho": RHO, "k": K, "seed": SEED, "sample_rate": RATE}

QUERIES = {f"knn_exact_{m}": _exact(name) for m, name in METRICS.items()}
QUERIES |= {f"pair_distance_{m}": _pairs(name) for m, name in METRICS.items()}
QUERIES |= {
    "graph_init": _on_run(lambda r: graph.random_edges(r.points, K, r.n, SEED)),
    "graph_init_distances": _on_run(lambda r: _rounded(r.graph(0))),
    "reverse_neighbors": _on_run(lambda r: graph.reverse_edges(r.graph(0))),
    "in_degree": _on_run(lambda r: exact.in_degree(r.graph(1))),
    "hubness_skew": _on_run(lambda r: exact.hubness(r.graph(1), r.points).select("n", F.round("mean", 6).alias("mean"), "biggest", F.round("skew", 6).alias("skew"))),
    "new_old_lists": _on_run(lambda r: cand.new_old_lists(r.graph(1))),
    "rho_sample_uniform": _on_run(lambda r: r.sampled()),
    "naive_two_hop": _on_run(lambda r: cand.naive_two_hop(r.graph(0)).groupBy("v", "c").agg(F.count(F.lit(1)).alias("n_paths"))),
    "candidates_two_hop": _on_run(lambda r: r.hops()),
    "candidate_sources": _on_run(lambda r: cand.candidates(r.hops())),
    "candidate_sample_uniform": _on_run(lambda r: cand.sample_candidates(cand.candidates(r.hops()), RATE, SEED, 2)),
    "topk_merge": _on_run(lambda r: _rounded(r.graph(1))),
    "update_count": _on_run(_update_count),
    "evicted_edges": _on_run(lambda r: graph.evicted(r.graph(0), r.graph(1))),
    "descent_naive_r2": _on_run(lambda r: _rounded(_naive(r, 2))),
    "descent_optimized_r2": _on_run(lambda r: _rounded(r.graph(2))),
    "neighbor_lists": _on_run(_lists),
    "iteration_log_r2": _on_run(_log),
    "source_success": _on_run(_tracked),
    "source_prune": _on_run(lambda r: tracking.prune(_tracked(r), 2)),
    "neighbor_weights": _on_run(lambda r: tracking.neighbor_weights(cand.new_old_lists(r.graph(1, ADAPTIVE)), r.counts)),
    "rho_sample_weighted": _on_run(
        lambda r: cand.rho_sample(tracking.neighbor_weights(cand.new_old_lists(r.graph(1, ADAPTIVE)), r.counts), ADAPTIVE.sample_size, SEED, 2, F.col("weight"))
    ),
    "candidate_weights": _on_run(_weights_rounded),
    "candidate_sample_weighted": _on_run(lambda r: cand.sample_candidates(_weights(r), RATE, SEED, 2, F.col("weight")).drop("weight")),
    "hub_damped_weights": _on_run(lambda r: _weights_rounded(r, damped=True)),
    "net_scores": _on_run(_net),
    "descent_adaptive_r3": _on_run(lambda r: _rounded(r.graph(3, ADAPTIVE))),
    "descent_benchmark_adaptive_r3": _on_run(lambda r: _rounded(r.graph(3, descent.Settings(candidates_weighted=True, **HALF)))),
    "descent_benchmark_random_r2": _on_run(lambda r: _rounded(r.graph(2, descent.Settings(**HALF)))),
    "recall_descent_vs_exact": _on_run(_recall),
    "gen_uniform": _generated(lambda spark, n, ids: generators.generate_uniform(spark, n, 8, 2.0, 5.0, SEED, ids)),
    "gen_gaussian": _generated(lambda spark, n, ids: generators.generate_gaussian(spark, n, 8, 5.0, 2.0, SEED, ids)),
    "gen_high_hubness": _generated(lambda spark, n, ids: generators.generate_high_hubness(spark, n, 100, SEED, ids)),
    "gen_clustered": _generated(lambda spark, n, ids: generators.generate_clustered(spark, n, 8, 7, seed=SEED, ids=ids)),
    "pair_distance_custom": _pairs(block_metric(_largest)),
    "new_neighbors": _on_run(lambda r: graph.neighbors(r.graph(1), True).select("p", "rank", "q")),
    "old_neighbors": _on_run(lambda r: graph.neighbors(r.graph(1), False).select("p", "rank", "q")),
    "source_frequency": _on_run(lambda r: tracking.frequency(_tracked(r), graph.reverse_edges(r.graph(1, ADAPTIVE)))),
    "topk_sources": _on_run(lambda r: tracking.top_sources(_tracked(r), 5)),
    "source_sketch": _on_run(_sketch),
    "json_result": _json_result,
    "descent_naive_converged": _on_run(_converged(OPTIMIZED, naive=True)),
    "descent_optimized_converged": _on_run(_converged(OPTIMIZED)),
    "descent_adaptive_converged": _on_run(_converged(ADAPTIVE)),
    "descent_net_converged": _on_run(_converged(descent.Settings(candidates_weighted=True, penalties=True, damp_hubs=True, **HALF))),
}

SQL = oracle.build()
