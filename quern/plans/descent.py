"""Iterative refinement of the graph: rounds of joins, with the edges written to shared storage in between.

Rounds are synchronous: every point reads the same graph, all proposals are merged at once, so a result doesn't
depend on partitioning. A round is two plans, cut by written tables; its two counters are observed as these are written.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import candidates as cand
from quern.operators import graph, tracking
from quern.operators.points import dimension
from quern.session import discard, listed, materialize, read_text, write_text


@dataclass(frozen=True)
class Settings:
    k: int = 10
    rho: float = 0.5
    delta: float = 0.001
    max_iterations: int = 20
    sample_rate: float = 1.0
    seed: int = 42
    rho_weighted: bool = False  # after the warm-up, sample neighbours by their successes
    candidates_weighted: bool = False  # after the warm-up, sample candidates by their sources' successes
    warmup_iterations: int = 2
    warmup_sampled: bool = True  # the warm-up too applies sample_rate
    sketch_lg_max_k: int = 6
    penalties: bool = False  # an evicted edge costs the source that brought it
    damp_hubs: bool = False

    @property
    def sample_size(self) -> int:
        return max(1, int(self.rho * self.k))

    @property
    def tracked(self) -> bool:
        return self.rho_weighted or self.candidates_weighted


PRESETS = {
    "optimized": {},
    "adaptive": {"rho_weighted": True},
    "benchmark_random": {"rho": 0.8},
    "benchmark_adaptive": {"rho": 0.8, "candidates_weighted": True},
}


@dataclass
class Result:
    graph: DataFrame
    log: list[dict] = field(default_factory=list)
    counts: DataFrame | None = None

    @property
    def distances(self) -> int:
        return sum(r["dist"] for r in self.log)

    def log_frame(self) -> DataFrame:
        rows = [(r["iter"], r["updates"], r["dist"], float(r["time"])) for r in self.log]
        return self.graph.sparkSession.createDataFrame(rows, "iter int, updates bigint, dist bigint, time double")


#: Pairs of a task, about, where they are made distinct, measured and merged; up to FEW_TASKS tasks Spark's own number does.
TASK_PAIRS, FEW_TASKS = 500_000, 8


def task_count(n_pairs: int) -> int:
    """Tasks for so many pairs, so that a task's memory doesn't grow with them; 0 where they are few or not counted."""
    tasks = math.ceil(n_pairs / TASK_PAIRS)
    return tasks if tasks > FEW_TASKS else 0


def canonical(pairs: DataFrame, n_pairs: int = 0) -> DataFrame:
    """p < q, once each: a distance serves both directions and every v. n_pairs: how many they are at most, where that is
    known."""
    own, tasks = pairs.select(F.least("v", "c").alias("p"), F.greatest("v", "c").alias("q")), task_count(n_pairs)
    return (own.repartition(tasks, "p", "q") if tasks else own).distinct()


def naive_round(edges: DataFrame, k: int, distances: graph.Distances) -> tuple[DataFrame, DataFrame]:
    """(merged edges, paths looked at)."""
    found = cand.naive_two_hop(edges)
    paths = distances.n * k * k
    measured = graph.proposals(distances(canonical(found, paths), paths))
    return graph.merge(edges, graph.within_reach(edges, measured, k, distances.n), k, task_count(2 * paths)), found


def sampled_candidates(edges: DataFrame, counts: DataFrame | None, s: Settings, round_no: int) -> DataFrame:
    """v, c, source: the candidates that a round evaluates."""
    warm = round_no <= s.warmup_iterations
    lists = cand.new_old_lists(edges)
    if s.rho_weighted and not warm:
        lists = tracking.neighbor_weights(lists, counts)
        sampled = cand.rho_sample(lists, s.sample_size, s.seed, round_no, F.col("weight"))
    else:
        sampled = cand.rho_sample(lists, s.sample_size, s.seed, round_no)
    rate = 1.0 if s.tracked and warm and not s.warmup_sampled else s.sample_rate
    if s.candidates_weighted and not warm and rate < 1:
        degrees = graph_degrees(edges) if s.damp_hubs else None
        own = cand.weighted_candidates(edges, sampled, counts, degrees, s.k)
        return cand.sample_candidates(own, rate, s.seed, round_no, F.col("weight")).drop("weight")
    return cand.sample_candidates(cand.fresh_candidates(edges, sampled), rate, s.seed, round_no)


def refine_round(
    edges: DataFrame, counts: DataFrame | None, s: Settings, round_no: int, distances: graph.Distances
) -> tuple[DataFrame, DataFrame]:
    """(merged edges, evaluated candidates v, c, source, written, with their number in counts)."""
    cands = materialize(sampled_candidates(edges, counts, s, round_no), "candidates", n=F.count(F.lit(1)))
    n_pairs = cands.counts["n"]
    measured = graph.proposals(distances(canonical(cands, n_pairs), n_pairs))
    return graph.merge(edges, graph.within_reach(edges, measured, s.k, distances.n), s.k, task_count(2 * n_pairs)), cands


def graph_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("q").agg(F.count(F.lit(1)).alias("degree"))


class Rounds:
    """The tables that a descent carries from round to round: edges, counts, and who brought which edge (via).

    Without a folder they are scratch, deleted once the next round's are there. With one, each finished round leaves a
    manifest beside its tables; a later call with the same points and settings goes on after the last of them. A
    manifest appears whole or not at all, and only then the tables of the round before it go.
    """

    NAMES = ("edges", "counts", "via")

    def __init__(self, spark: SparkSession, folder: str | None, mark: str):
        self.spark, self.folder, self.mark = spark, folder.rstrip("/") if folder else None, mark
        self.held: dict[str, DataFrame | None] = {}

    def found(self) -> tuple[int, list[dict], bool]:
        """The last finished round, its log, and whether the descent ended there; -1 where there is none."""
        done = [x for x in listed(self.spark, self.folder) if x.startswith("manifest-")] if self.folder else []
        done = [x for x in done if not x.endswith(".part")]
        if not done:
            return -1, [], False
        m = json.loads(read_text(self.spark, f"{self.folder}/{max(done)}"))
        if m["mark"] != self.mark:
            raise ValueError(f"{self.folder} holds the rounds of other points or settings")
        for name, kind in m["tables"].items():
            frame = self.spark.read.schema(kind).parquet(f"{self.folder}/{name}-{m['round']}")
            frame.scratch_path = f"{self.folder}/{name}-{m['round']}"
            self.held[name] = frame
        return m["round"], m["log"], m["ended"]

    def write(self, name: str, frame: DataFrame, round_no: int, **counts) -> DataFrame:
        return materialize(frame, name, f"{self.folder}/{name}-{round_no}" if self.folder else None, **counts)

    def finish(self, round_no: int, log: list[dict], ended: bool, **tables: DataFrame | None) -> None:
        """Makes the round the last finished one, and deletes the tables it replaces."""
        tables = {k: t for k, t in tables.items() if t is not None and getattr(t, "scratch_path", None)}
        if self.folder:
            kinds = {k: ", ".join(f"{c} {kind}" for c, kind in t.dtypes) for k, t in tables.items()}
            text = {"mark": self.mark, "round": round_no, "log": log, "ended": ended, "tables": kinds}
            write_text(self.spark, f"{self.folder}/manifest-{round_no:05d}", json.dumps(text))
        kept = {t.scratch_path for t in tables.values()}
        discard(*[t for t in self.held.values() if t is not None and getattr(t, "scratch_path", None) not in kept])
        self.held = tables


def _mark(points: DataFrame, s: Settings, metric: str, naive: bool) -> str:
    """What a descent's result depends on: the settings but for where it ends, and a digest of the points."""
    digest = points.agg(F.bit_xor(F.xxhash64("id", "vec"))).first()[0]
    return f"{replace(s, max_iterations=0)} {metric} {naive} {digest}"


def descend(
    points: DataFrame, s: Settings, distance="euclidean", naive: bool = False, rounds: int | None = None, verbose: bool = False, folder: str | None = None
) -> Result:
    """Refines a random graph until a round brings fewer than delta * n * k edges (naive: none), or for rounds.

    A round writes its candidates and its edges; what they count is observed on the way. folder: in shared storage,
    where an ended or broken-off descent goes on after its last finished round; the graph stays there.
    """
    points = materialize(points.select("id", "vec"), "points")
    n, dim = dimension(points)
    k = min(s.k, max(0, n - 1))
    if k == 0:
        return Result(points.select(F.col("id").alias("p"), F.col("id").alias("q"), F.lit(0.0).alias("dist"), F.lit(True).alias("is_new")).limit(0))
    distances = graph.Distances(points, n, dim, distance)
    store = Rounds(points.sparkSession, folder, _mark(points, s, distances.metric.name, naive) if folder else "")
    last, log, ended = store.found()
    if last < 0:
        edges = store.write("edges", graph.initial_graph(points, k, n, s.seed, distances), 0)
        store.finish(0, log, False, edges=edges)
    edges, via = store.held["edges"], store.held.get("via")
    counts = store.held.get("counts", tracking.empty_counts(edges))
    for i in range(max(0, last) + 1, 0 if ended and rounds is None else (rounds or s.max_iterations) + 1):
        began = time.perf_counter()
        if naive:
            merged, found = naive_round(edges, k, distances)
            evaluated = found.count()
        else:
            merged, found = refine_round(edges, counts, s, i, distances)
            evaluated = found.counts["n"]
        after = store.write("edges", merged, i, updates=F.count_if("is_new"))
        updates = after.counts["updates"]
        if s.tracked and not naive:
            delta = tracking.successes(found, after)
            counts = tracking.prune(tracking.record(counts, delta), s.sketch_lg_max_k)
            if s.penalties:
                counts, via = _penalized(counts, via, found, after, graph.evicted(edges, after))
                via = store.write("via", via, i)
            counts = store.write("counts", counts, i)
        edges = after
        log.append({"iter": i, "updates": updates, "dist": evaluated, "time": round(time.perf_counter() - began, 1)})
        ended = updates == 0 if naive else updates < s.delta * n * k
        store.finish(i, log, ended, edges=edges, counts=counts, via=via)
        discard(None if naive else found)
        if verbose:
            print(f"  round {i}: {updates} updates, {evaluated} distances")
        if rounds is None and ended:
            break
    return Result(edges, log, counts)


def _penalized(counts, via, found, after, gone):
    """Takes one from the source that brought an edge which is now evicted; via keeps who brought what."""
    brought = found.select("v", "c", "source").join(after.where("is_new").select(F.col("p").alias("v"), F.col("q").alias("c")), ["v", "c"])
    if via is not None:
        lost = via.join(gone.select(F.col("p").alias("v"), F.col("q").alias("c")), ["v", "c"])
        counts = tracking.penalize(counts, lost.select("v", F.col("source").alias("u"), F.lit(1).alias("freq")))
        brought = via.join(gone.select(F.col("p").alias("v"), F.col("q").alias("c")), ["v", "c"], "left_anti").unionByName(brought)
    return counts, brought


def nn_descent_naive(
    points: DataFrame, k: int = 10, distance="euclidean", max_iterations: int = 20, seed: int = 42, verbose: bool = False, folder: str | None = None
) -> Result:
    return descend(points, Settings(k=k, max_iterations=max_iterations, seed=seed), distance, naive=True, verbose=verbose, folder=folder)


def nn_descent_optimized(points: DataFrame, k: int = 10, distance="euclidean", verbose: bool = False, folder: str | None = None, **settings) -> Result:
    return descend(points, Settings(k=k, **settings), distance, verbose=verbose, folder=folder)


def nn_descent_adaptive(points: DataFrame, k: int = 10, distance="euclidean", verbose: bool = False, folder: str | None = None, **settings) -> Result:
    return descend(points, Settings(k=k, **({"rho_weighted": True} | settings)), distance, verbose=verbose, folder=folder)
