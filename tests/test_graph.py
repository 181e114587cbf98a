from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import candidates, exact, graph, points, tracking
from quern.plans import descent, experiments
from quern.plans.estimators import AdaptiveNNDescent, NaiveNNDescent, OptimizedNNDescent
from quern.plans.experiments import compare, hubness_trio, main, run_config
from quern.session import materialize
from quern.sources import generators


def edges(spark, rows):
    return spark.createDataFrame(rows, "p bigint, q bigint, dist double, is_new boolean")


@pytest.fixture(scope="module")
def small(spark):
    return materialize(generators.generate_uniform(spark, 50, 10, seed=42), "small")


def brute(pts, k, distance=lambda a, b: np.sqrt(((a - b) ** 2).sum())):
    rows = sorted((r.id, np.array(r.vec)) for r in pts.collect())
    return {i: [j for _, j in sorted((distance(x, y), j) for j, y in rows if j != i)[:k]] for i, x in rows}


def lists(frame):
    out = {}
    for r in frame.orderBy("p", "rank").collect():
        out.setdefault(r.p, []).append(r.q)
    return out


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "cosine"])
def test_exact_matches_brute_force(spark, small, name):
    by = {
        "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "manhattan": lambda a, b: np.abs(a - b).sum(),
        "cosine": lambda a, b: 1 - a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)),
    }[name]
    assert lists(exact.knn_exact(small, 5, 50, name, side=16)) == brute(small, 5, by)


def test_exact_with_copies_and_large_k(spark):
    pts = spark.createDataFrame([(i, [float(i // 3), 0.0]) for i in range(9)], "id bigint, vec array<double>")
    found = lists(exact.knn_exact(pts, 20, 9))
    assert found[4] == [3, 5, 0, 1, 2, 6, 7, 8]
    assert exact.knn_exact(pts.limit(0), 3, 0).count() == 0


def test_points_are_checked(spark):
    for rows in ([(1, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [float("nan")])], [(None, [1.0])]):
        with pytest.raises(ValueError):
            points.dimension(spark.createDataFrame(rows, "id bigint, vec array<double>"))


def test_random_graph(spark, small):
    for n, k in ((50, 5), (4, 10)):
        e = [tuple(r) for r in graph.random_edges(small.where(F.col("id") < n), k, n, 1).collect()]
        assert len(e) == len(set(e)) == n * min(k, n - 1)
        assert all(p != q for p, q in e)
    shifted = small.select((F.col("id") * 7 + 3).alias("id"), "vec")
    own = graph.random_edges(shifted, 5, 50, 1)
    assert own.count() == 250 and own.where("(q - 3) % 7 <> 0").count() == 0


def test_merge_keeps_the_nearest(spark):
    b = edges(spark, [(0, 1, 1.0, True), (0, 2, 0.5, True)])
    new = edges(spark, [(0, 3, 0.3, True), (0, 4, 2.0, True), (0, 2, 0.5, True), (0, 0, 0.0, True)]).drop("is_new")
    got = {(r.q, r.is_new) for r in graph.merge(b, new, 2).collect()}
    assert got == {(3, True), (2, False)}
    tie = spark.createDataFrame([(0, 0, 1.0)], "p bigint, q bigint, dist double").withColumn("q", F.lit(-1).cast("bigint"))
    assert {r.q for r in graph.merge(b, tie, 2).collect()} == {1, 2}  # what is there wins a tie
    assert [(r.p, r.q) for r in graph.evicted(b, graph.merge(b, new, 2)).collect()] == [(0, 1)]


def test_reverse(spark):
    b = edges(spark, [(0, 1, 1.0, True), (0, 2, 0.5, True), (1, 0, 0.8, True)])
    assert {(r.v, r.u) for r in graph.reverse_edges(b).collect()} == {(1, 0), (2, 0), (0, 1)}
    assert {r.q: r.degree for r in exact.in_degree(b).collect()} == {0: 1, 1: 1, 2: 1}
    assert [r.q for r in graph.neighbors(b, True).where("p = 0").orderBy("rank").collect()] == [2, 1]


def test_tracker(spark):
    s = tracking.record(tracking.empty_counts(spark.range(1)), spark.createDataFrame([(0, 5, 1), (0, 5, 1), (0, 6, 1), (1, 5, 3)], "v bigint, u bigint, freq bigint"))
    get = lambda t: {(r.v, r.u): r.freq for r in t.collect()}
    assert get(s) == {(0, 5): 2, (0, 6): 1, (1, 5): 3}
    keys = spark.createDataFrame([(0, 5), (0, 9)], "v bigint, u bigint")
    assert get(tracking.frequency(s, keys)) == {(0, 5): 2, (0, 9): 0}
    loss = spark.createDataFrame([(0, 5, 1), (0, 6, 9), (7, 7, 1)], "v bigint, u bigint, freq bigint")
    assert get(tracking.penalize(s, loss)) == {(0, 5): 1, (1, 5): 3}
    many = spark.createDataFrame([(0, i, i + 1) for i in range(9)], "v bigint, u bigint, freq bigint")
    assert set(get(tracking.prune(many, 3))) == {(0, u) for u in (5, 6, 7, 8)}
    assert len(get(tracking.prune(many, 4))) == 9


def test_weights_and_damping(spark):
    found = spark.createDataFrame([(0, 10, 1, False), (0, 20, 2, False), (0, 30, 3, True)], "v bigint, c bigint, u bigint, from_old boolean")
    s = spark.createDataFrame([(0, 1, 10), (0, 2, 1)], "v bigint, u bigint, freq bigint")
    w = {r.c: r.weight for r in tracking.candidate_weights(found, s).collect()}
    assert w == {10: 6.0, 20: 1.5, 30: 1.0}
    deg = spark.createDataFrame([(1, 20), (2, 5)], "q bigint, degree bigint")
    w = {r.c: r.weight for r in tracking.candidate_weights(found, s, deg, k=10).collect()}
    assert w == {10: 1 + 0.5 * 10 / 4, 20: 1.5, 30: 1.0}


def test_weighted_draws_favour_weight(spark):
    c = spark.range(400).selectExpr("id as v", "explode(array(10L, 20L, 30L, 40L, 50L)) as c", "0L as source")
    c = c.withColumn("weight", F.when(F.col("c") == 10, 51.0).otherwise(1.0))
    got = {r.c: r.n for r in candidates.sample_candidates(c, 0.4, 42, 1, F.col("weight")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(got.values()) == 800 and got[10] > 2 * got[50]


@pytest.mark.parametrize("kind", [NaiveNNDescent, OptimizedNNDescent, AdaptiveNNDescent])
def test_estimators(spark, small, kind):
    est = kind(k=5, seed=42)
    assert est.get_graph() is None
    with pytest.raises(ValueError):
        est.get_neighbors()
    got = {r.p: r.neighbors for r in est.fit(small).get_neighbors().collect()}
    truth = brute(small, 5)
    assert all(len(set(v)) == 5 and p not in v for p, v in got.items()) and len(got) == 50
    assert sum(len(set(got[p]) & set(truth[p])) for p in got) / 250 > 0.7


def test_early_stop_and_sampling(spark, small):
    assert len(descent.nn_descent_optimized(small, 5, delta=0.5, max_iterations=100).log) < 20
    full = descent.nn_descent_optimized(small, 5, max_iterations=2)
    half = descent.nn_descent_optimized(small, 5, max_iterations=2, sample_rate=0.5)
    assert half.distances < full.distances
    truth = exact.knn_exact(small, 5, 50)
    got = run_config(small, truth, 5, 0.5, "adaptive")
    assert set(got) == {"recall", "dist_comps", "iterations", "iter_log", "time", "mode", "rate", "rho"}


def test_distances_never_grow(spark, small):
    sums = []
    for rounds in (1, 2, 3):
        g = descent.descend(small, descent.Settings(k=5), rounds=rounds).graph
        sums.append(g.agg(F.sum("dist")).first()[0])
    assert sums == sorted(sums, reverse=True)


def test_partitions_do_not_matter(spark, small):
    a = descent.descend(small.repartition(1), descent.Settings(k=5, rho_weighted=True, warmup_iterations=1), rounds=2).graph
    b = descent.descend(small.repartition(7), descent.Settings(k=5, rho_weighted=True, warmup_iterations=1), rounds=2).graph
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_tracker_state(spark):
    delta = spark.createDataFrame([(0, 5, 2), (0, 6, 1), (1, 5, 3)], "v bigint, u bigint, freq bigint")
    t = tracking.NetSourceTracker(delta, lg_max=3)
    t.record(delta)
    t.record(delta)
    assert t.total_updates == 12 and {(r.v, r.u): r.freq for r in t.counts.collect()} == {(0, 5): 4, (0, 6): 2, (1, 5): 6}
    t.penalize(spark.createDataFrame([(0, 6, 2), (1, 5, 1)], "v bigint, u bigint, freq bigint"))
    assert {(r.v, r.u): r.freq for r in t.top(1).collect()} == {(0, 5): 4, (1, 5): 5}
    t.reset()
    assert t.total_updates == 0 and t.counts.isEmpty()


def test_experiments(spark, tmp_path, monkeypatch):
    pts = materialize(generators.generate_uniform(spark, 60, 4, seed=1), "small")
    rows = compare(pts, 5)
    assert [r["name"] for r in rows] == ["optimized", "adaptive", "adaptive sampled"] and rows[0]["overhead"] == 0 and rows[0]["recall"] > 0.8
    monkeypatch.setattr(experiments, "run_config", lambda points, truth, k, rate, mode: {"mode": mode, "n": truth.count()})
    found = hubness_trio(spark, n=60, k=5, real=pts)
    monkeypatch.undo()
    assert all(r["n"] == 300 for r in found)
    assert [(r["data"], r["mode"]) for r in found] == [(d, m) for d in ("real", "normal 100", "normal 10") for m in ("random", "adaptive")]
    pts.write.parquet(str(tmp_path / "points"))
    run = main(["adaptive", "0.5", "--fvecs", str(tmp_path / "none"), "--cache", str(tmp_path / "points"), "--out", str(tmp_path), "--k", "5"], spark)
    assert run["mode"] == "adaptive" and (tmp_path / "result_adaptive_50").exists()


def test_public_names():
    import quern

    assert all(hasattr(quern, x) for x in quern.__all__)
