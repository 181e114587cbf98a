"""What large inputs rest on: block cells, observed counters, rounds that go on, merged sketches, few shuffles."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.distances import as_metric, block_metric
from quern.operators import candidates, exact, graph, points, tracking
from quern.plans import descent
from quern.plans.ml import KNNGraphEstimator, KNNGraphModel
from quern.session import listed, materialize
from quern.sources import generators

POINT = "id bigint, vec array<double>"


@pytest.fixture(scope="module")
def small(spark):
    return materialize(generators.generate_clustered(spark, 120, 6, 5, seed=3).select("id", "vec"), "small")


def edges(frame):
    return sorted(map(tuple, frame.select("p", "q", "dist", "is_new").collect()))


@pytest.mark.parametrize("blocks,salts", [(1, 1), (4, 1), (3, 2)])
def test_block_cells_measure_every_pair(spark, small, blocks, salts):
    pairs = graph.random_edges(small, 7, 120, 5)
    x = {r.id: np.array(r.vec) for r in small.collect()}
    got = {(r.p, r.q): r.dist for r in graph.block_distances(small, pairs, as_metric("euclidean"), blocks, salts).collect()}
    assert set(got) == {tuple(r) for r in pairs.collect()}
    assert all(abs(d - np.sqrt(((x[p] - x[q]) ** 2).sum())) < 1e-12 for (p, q), d in got.items())


def test_a_vector_is_sent_once_to_a_cell(spark, small):
    """A hub that is in every pair reaches each of its cells once."""
    pairs = spark.range(1, 120).select(F.lit(0).cast("bigint").alias("p"), F.col("id").alias("q"))
    plan = graph.block_distances(small, pairs, as_metric("euclidean"), 4)
    assert plan.count() == 119
    hub = pairs.select(F.pmod(F.xxhash64("q"), F.lit(4))).distinct().count()
    own = pairs.select(F.least(F.pmod(F.xxhash64("p"), F.lit(4)), F.pmod(F.xxhash64("q"), F.lit(4))).alias("a"), F.greatest(F.pmod(F.xxhash64("p"), F.lit(4)), F.pmod(F.xxhash64("q"), F.lit(4))).alias("b"))
    assert own.distinct().count() == hub


def test_descent_by_blocks_gives_the_same_edges(spark, small, monkeypatch):
    s = descent.Settings(k=5, rho=0.8)
    first = descent.descend(small, s, rounds=2)
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(graph, "BLOCK_BYTES", 120 * 6 * 8 // 3)
    monkeypatch.setattr(graph, "CELL_PAIRS", 100)
    second = descent.descend(small, s, rounds=2)
    assert edges(first.graph) == edges(second.graph)
    assert [(r["updates"], r["dist"]) for r in first.log] == [(r["updates"], r["dist"]) for r in second.log]


@pytest.mark.parametrize("name", ["euclidean", "cosine", "manhattan"])
def test_exact_search_near_copies(spark, name):
    """Distances far below the product's error, copies, and a zero vector: the same as measuring all."""
    rng = np.random.default_rng(2)
    x = 1e4 + np.concatenate([rng.normal(size=(40, 5)) * 1e-5, rng.normal(size=(40, 5))])
    x[7] = x[8] = x[9]
    x[50] = 0
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POINT)
    rows = as_metric(name).rows
    want = {i: sorted((float(rows(y[None], x[i][None])[0]), j) for j, y in enumerate(x) if j != i)[:6] for i in range(80)}
    got = {}
    for r in exact.knn_exact(pts, 6, 80, name, side=30).orderBy("p", "rank").collect():
        got.setdefault(r.p, []).append((r.dist, r.q))
    assert got == want


def test_a_vector_is_sent_once_a_block(spark, monkeypatch):
    """Square cells: with 6 blocks each vector goes to 6 cells, and a block with itself counts once."""
    pts = materialize(generators.generate_uniform(spark, 600, 4), "pts")
    sent, own = [], type(pts).repartition
    monkeypatch.setattr(type(pts), "repartition", lambda self, *a: sent.append(self) or own(self, *a))
    frame = exact.knn_exact(pts, 3, 600, side=100)
    assert sent[0].count() == 600 * 6 and sent[0].select("low", "high").distinct().count() == 21
    assert frame.count() == 1_800


def test_block_metric(spark, small):
    scalar, block = lambda a, b: float(np.abs(a - b).max()), block_metric(lambda a, b: np.abs(a - b).max(axis=1))
    x = np.random.default_rng(1).normal(size=(50, 4))
    assert np.array_equal(as_metric(scalar).rows(x, x[0]), block.rows(x, x[0]))
    pairs = graph.random_edges(small, 4, 120, 5)
    both = [sorted(map(tuple, exact.pair_distances(small, pairs, m).collect())) for m in (scalar, block)]
    assert both[0] == both[1] and len(both[0]) == 480
    with pytest.raises(ValueError, match="one distance a row"):
        block_metric(lambda a, b: np.abs(a - b)).rows(x, x)


def test_observed_counters(spark, small):
    d = materialize(small, "seen", n=F.count(F.lit(1)), most=F.max("id"))
    assert d.counts == {"n": 120, "most": 119} and d.count() == 120
    assert materialize(small.where("id < 0"), "seen", n=F.count(F.lit(1))).counts == {"n": 0}
    result = descent.descend(small, descent.Settings(k=4), rounds=1)
    assert result.log[0]["updates"] == result.graph.where("is_new").count()


@pytest.mark.parametrize("settings", [{}, {"candidates_weighted": True, "penalties": True, "damp_hubs": True, "sample_rate": 0.5}])
def test_rounds_go_on(spark, small, tmp_path, settings):
    """Broken off after two rounds and once within the third, then ended: as without a break."""
    s, folder = descent.Settings(k=4, rho=0.8, **settings), f"file://{tmp_path}/run"
    whole = descent.descend(small, s)
    assert len(whole.log) > 3
    descent.descend(small, s, rounds=2, folder=folder)
    assert {n.split("-")[0] for n in listed(spark, folder)} <= {"edges", "counts", "via", "manifest"}
    assert [n for n in listed(spark, folder) if n.startswith("edges")] == ["edges-2"]
    own, calls = descent.Rounds.finish, []

    def broken(self, round_no, *args, **tables):
        calls.append(round_no)
        if round_no == 3:
            raise RuntimeError("lost")
        own(self, round_no, *args, **tables)

    descent.Rounds.finish = broken
    try:
        with pytest.raises(RuntimeError, match="lost"):
            descent.descend(small, s, folder=folder)
    finally:
        descent.Rounds.finish = own
    assert calls == [3]
    again = descent.descend(small, s, folder=folder)
    assert edges(again.graph) == edges(whole.graph)
    assert [(r["iter"], r["updates"], r["dist"]) for r in again.log] == [(r["iter"], r["updates"], r["dist"]) for r in whole.log]
    assert edges(descent.descend(small, s, folder=folder).graph) == edges(whole.graph)  # ended: nothing is left to do
    with pytest.raises(ValueError, match="other points or settings"):
        descent.descend(small, descent.Settings(k=3), folder=folder)


def test_scratch_is_deleted(spark, small):
    from quern.session import scratch_dir

    folder = f"{scratch_dir(spark)}/quern"
    before = set(listed(spark, folder))
    result = descent.descend(small, descent.Settings(k=4, rho=0.8, rho_weighted=True), rounds=3)
    left = {n.split("-")[0] for n in set(listed(spark, folder)) - before}
    assert left <= {"points", "edges", "counts"} and len(set(listed(spark, folder)) - before) <= 3
    assert result.graph.count() == 480


def shuffles(frame):
    """Exchanges of the plan as it is made, equal ones once."""
    plan = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|Single|Round)", plan))


def test_few_shuffles_a_round(spark, small):
    """From edges to candidates, and from measured pairs to edges."""
    s = descent.Settings(k=5)
    e = materialize(graph.initial_graph(small, 5, 120, 1, graph.Distances(small, 120, 6)), "e")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = candidates.rho_sample(candidates.new_old_lists(e), 4, 1, 1)
        assert shuffles(lists) == 1
        assert shuffles(graph.merge(e, graph.proposals(e), 5)) == 1
        fused = candidates.fresh_candidates(e, lists)
        assert shuffles(fused) < shuffles(candidates.candidates(candidates.two_hop(e, lists)))
        assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, candidates.candidates(candidates.two_hop(e, lists)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert s.sample_size == 2


def test_sketches_merge_within_their_bound(spark):
    rng = np.random.default_rng(0)
    tracker, exact_counts = tracking.SketchTracker(spark.range(1), 16), {}
    for _ in range(3):
        rows = [(int(v), int(min(u, 200))) for v, u in zip(rng.integers(0, 3, 2_000), rng.zipf(1.3, 2_000))]
        rows += [(9, u) for u in (1, 1, 2)]
        for r in rows:
            exact_counts[r] = exact_counts.get(r, 0) + 1
        tracker.record(spark.createDataFrame(rows, "v bigint, u bigint"))
    assert tracker.total_updates == sum(exact_counts.values())
    got = {(r.v, r.u): (r.freq, r.n) for r in tracker.estimates().collect()}
    n = {v: sum(c for (a, _), c in exact_counts.items() if a == v) for v in (0, 1, 2, 9)}
    for (v, u), c in exact_counts.items():
        assert abs(got.get((v, u), (0, 0))[0] - c) <= tracker.error() * n[v] + 1
    assert got[9, 1] == (6, 9) and got[9, 2] == (3, 9)  # few sources: exact
    assert max(sum(1 for a, _ in got if a == v) for v in n) <= 16
    tracker.reset()
    assert tracker.estimates().count() == 0 and tracker.total_updates == 0


def test_ml_stage(spark, small, tmp_path):
    table = small.withColumnsRenamed({"id": "key", "vec": "features"}).withColumn("p", F.lit(1))
    stage = KNNGraphEstimator(k=4, rho=0.8, algorithm="adaptive", idCol="key", vectorCol="features", outputCol="near")
    stage.save(str(tmp_path / "stage"))
    again = KNNGraphEstimator.load(str(tmp_path / "stage"))
    assert again.get("k") == 4 and again.get("algorithm") == "adaptive" and again.get("delta") == 0.001
    model = again.fit(table)
    model.save(str(tmp_path / "model"))
    loaded = KNNGraphModel.load(str(tmp_path / "model"))
    assert loaded.get("outputCol") == "near" and edges(loaded.edges) == edges(model.edges)
    rows = loaded.transform(table).collect()
    assert len(rows) == 120 and all(len(r.near) == 4 and r.key not in r.near for r in rows) and set(rows[0].asDict()) == {"key", "features", "p", "near"}
    want = descent.nn_descent_adaptive(small, 4, rho=0.8)
    assert edges(want.graph) == edges(model.edges)


def test_core_without_the_corpus_parts_needs():
    """Where a library that only the corpus part needs is missing, the core's queries stay."""
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = sys.modules['tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'knn_exact_l2' in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) >= 50
