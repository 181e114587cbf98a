"""What a round shuffles: paths once, pairs in bounded tasks, and only proposals that can come in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import candidates, exact, graph, tracking
from quern.plans import descent
from quern.session import materialize
from quern.sources import generators


@pytest.fixture(scope="module")
def edges(spark):
    points = materialize(generators.generate_clustered(spark, 90, 5, 4, seed=8).select("id", "vec"), "few")
    own = graph.initial_graph(points, 4, 90, 3, graph.Distances(points, 90, 5))
    return materialize(own.withColumn("is_new", F.pmod(F.col("p") + F.col("q"), F.lit(3)) > 0), "edges")


def test_weighted_candidates_by_one_shuffle(spark, edges):
    """Weighed paths were joined, dropped and grouped in a shuffle each before."""
    lists = candidates.rho_sample(candidates.new_old_lists(edges), 3, 7, 1)
    counts = lists.where("u % 2 = 0").select("v", "u", (F.col("u") % 5).alias("freq"))
    for degrees in (None, exact.in_degree(edges)):
        want = tracking.candidate_weights(candidates.two_hop(edges, lists), counts, degrees, 4)
        own = candidates.weighted_candidates(edges, lists, counts, degrees, 4)
        rows = lambda f: sorted((r.v, r.c, r.source, round(r.weight, 9)) for r in f.collect())
        assert rows(own) == rows(want)


def test_only_proposals_that_come_in_are_merged(spark, edges):
    """All measured pairs were shuffled to both of their points before."""
    far = edges.groupBy("p").agg(F.max("dist").alias("far"))
    near = edges.alias("a").join(far.alias("f"), F.col("a.p") == F.col("f.p")).select("a.p", (F.col("a.q") + 1).alias("q"), (F.col("far") * F.rand(1) * 2).alias("dist"))
    ties = edges.join(far, "p").select("p", F.lit(1_000).cast("bigint").alias("q"), F.col("far").alias("dist"))
    proposed = materialize(near.unionByName(ties), "proposed")
    short = edges.where("q % 4 > 0 or p % 2 > 0")  # some points have fewer than k edges
    for e in (edges, short):
        kept = graph.within_reach(e, proposed, 4, 90)
        assert sorted(graph.merge(e, kept, 4).collect()) == sorted(graph.merge(e, proposed, 4).collect())
    assert graph.within_reach(edges, proposed, 4, 90).count() < proposed.count() * 0.6
    assert graph.within_reach(edges, proposed, 4, graph.REACH_POINTS + 1) is proposed


def test_pairs_of_a_task_are_bounded(spark):
    """The number of tasks was Spark's own before, whatever the number of pairs."""
    pairs = spark.range(50).select((F.col("id") % 7).alias("v"), (F.col("id") % 5).alias("c"))
    many = descent.canonical(pairs, 40 * descent.TASK_PAIRS)
    assert many.rdd.getNumPartitions() == 40
    assert sorted(many.collect()) == sorted(descent.canonical(pairs).collect())


def test_a_merge_has_tasks_by_its_pairs(spark, edges, monkeypatch):
    """descent_naive_r2: all that was proposed went to Spark's own number of tasks before."""
    seen, own = [], graph.merge
    monkeypatch.setattr(graph, "merge", lambda e, proposed, k, tasks=0: seen.append(tasks) or own(e, proposed, k, tasks))
    monkeypatch.setattr(descent, "TASK_PAIRS", 200)
    points = materialize(generators.generate_clustered(spark, 90, 5, 4, seed=8).select("id", "vec"), "few")
    after, _ = descent.naive_round(edges, 4, graph.Distances(points, 90, 5))
    assert seen == [15]  # 2 * 90 * 4 * 4 proposals at most
    monkeypatch.setattr(descent, "TASK_PAIRS", 500_000)
    assert sorted(after.collect()) == sorted(descent.naive_round(edges, 4, graph.Distances(points, 90, 5))[0].collect())
