"""The graph as an edge relation B(p, q, dist, is_new), at most k rows for each p."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.distances import Metric, as_metric
from quern.functions.rng import uniform
from quern.operators.exact import recall, top_k
from quern.operators.points import indexed, to_matrix

#: Vectors are broadcast to the distance step up to so many bytes; beyond that they go to cells of two blocks of
#: BLOCK_BYTES, each with CELL_PAIRS pairs, about.
BROADCAST_BYTES, BLOCK_BYTES, CELL_PAIRS = 64_000_000, 64_000_000, 4_000_000
#: Points at most whose farthest edges are broadcast, at 16 bytes each.
REACH_POINTS = 2_000_000


def draws(k: int) -> int:
    """Hashed draws per point, of which k distinct others are kept."""
    return 3 * k + 16


def random_edges(points: DataFrame, k: int, n: int, seed: int) -> DataFrame:
    """p, q: min(k, n - 1) distinct others of each point, by hash.

    Each point draws row numbers, so no pair of points is formed; only where n is not much larger than k, and so
    bounded, are all others ranked instead.
    """
    own = indexed(points, n)
    if n <= 4 * k + 4:
        pairs = own.select(F.col("id").alias("p")).crossJoin(F.broadcast(own.select(F.col("id").alias("q")))).where("p <> q")
        return top_k(pairs, k, uniform(seed, "init", F.col("p"), F.col("q")), "q").select("p", "q")
    drawn = own.select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(draws(k) - 1))).alias("j"))
    drawn = drawn.withColumn("idx", F.floor(uniform(seed, "init", F.col("p"), F.col("j")) * n))
    drawn = drawn.join(own.select("idx", F.col("id").alias("q")), "idx").where("p <> q")
    return top_k(drawn.groupBy("p", "q").agg(F.min("j").alias("j")), k, "j").select("p", "q")


def block_distances(points: DataFrame, pairs: DataFrame, metric: Metric, blocks: int, salts: int = 1) -> DataFrame:
    """p, q, dist of the pairs (p, q), measured where two blocks of vectors meet.

    Points are dealt to blocks and a pair goes to the cell of its two blocks; salts deal a cell's pairs to so many
    tasks. A vector is sent once to each cell that has a pair of it, however many pairs those are.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    salt = F.pmod(F.xxhash64("p", "q"), F.lit(salts)).cast("int").alias("s")
    own = pairs.select("p", "q", F.least(block("p"), block("q")).alias("a"), F.greatest(block("p"), block("q")).alias("b"), salt)
    asked = own.select("a", "b", "s", F.explode(F.array("p", "q")).alias("of")).distinct()
    asked = asked.groupBy("of").agg(F.collect_list(F.struct("a", "b", "s")).alias("cells"))  # at most blocks * salts
    sent = points.join(asked, F.col("id") == F.col("of")).select(F.explode("cells").alias("cell"), "id", "vec")
    sent = sent.select(F.col("cell.a").alias("x"), F.col("cell.b").alias("y"), F.col("cell.s").alias("z"), "id", "vec")
    rows = metric.rows

    def work(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("id").to_numpy()
        flat = vectors.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x, by = flat.reshape(len(ids), -1) if len(ids) else flat, np.argsort(ids)
        p, q = (by[np.searchsorted(ids, pairs.column(c).to_numpy(), sorter=by)] if len(pairs) else by[:0] for c in ("p", "q"))
        dist = [rows(x[p[s : s + 4_096]], x[q[s : s + 4_096]]) for s in range(0, len(p), 4_096)]
        return pa.table({"p": pairs.column("p"), "q": pairs.column("q"), "dist": np.concatenate(dist) if dist else np.zeros(0)})

    cells = own.groupBy("a", "b", "s").cogroup(sent.groupBy("x", "y", "z"))
    return cells.applyInArrow(work, "p bigint, q bigint, dist double")


class Distances:
    """Measures pairs; broadcasts the vectors where they are small enough, else sends them by blocks to the pairs."""

    def __init__(self, points: DataFrame, n: int, dim: int, distance="euclidean", most: int | None = None):
        self.points, self.metric, self.n = points, as_metric(distance), n
        size, most = n * dim * 8, BROADCAST_BYTES if most is None else most
        self.matrix, self.blocks = None, max(1, math.ceil(size / BLOCK_BYTES))
        if n and size <= most:
            self.matrix = points.sparkSession.sparkContext.broadcast(to_matrix(points))

    def __call__(self, pairs: DataFrame, n_pairs: int = 0) -> DataFrame:
        """p, q, dist of the pairs (p, q). n_pairs: how many they are, about, where that is known."""
        if self.matrix is None:
            salts = math.ceil(n_pairs / (CELL_PAIRS * self.blocks * (self.blocks + 1) / 2))
            return block_distances(self.points, pairs.select("p", "q"), self.metric, self.blocks, max(1, salts))
        matrix, rows = self.matrix, self.metric.rows

        def work(batches):
            ids, x = matrix.value
            for b in batches:
                p, q = (np.searchsorted(ids, b.column(i).to_numpy()) for i in (0, 1))
                dist = [rows(x[p[s : s + 4_096]], x[q[s : s + 4_096]]) for s in range(0, len(p), 4_096)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(dist) if dist else np.zeros(0))], ["p", "q", "dist"])

        return pairs.select("p", "q").mapInArrow(work, "p bigint, q bigint, dist double")


def initial_graph(points: DataFrame, k: int, n: int, seed: int, distances: Distances) -> DataFrame:
    return distances(random_edges(points, k, n, seed)).withColumn("is_new", F.lit(True))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """v, u: u has v in its list."""
    return edges.select(F.col("q").alias("v"), F.col("p").alias("u"))


def neighbors(edges: DataFrame, is_new: bool | None = None) -> DataFrame:
    own = edges if is_new is None else edges.where(F.col("is_new") == is_new)
    return top_k(own, 2**31 - 1, "dist", "q").select("p", F.col("_rank").alias("rank"), "q", "dist", "is_new")


def mark_all_old(edges: DataFrame) -> DataFrame:
    return edges.withColumn("is_new", F.lit(False))


def proposals(measured: DataFrame) -> DataFrame:
    """Both directions of the measured pairs."""
    ways = F.array(F.struct(F.col("p"), F.col("q")), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))
    return measured.select(F.explode(ways).alias("way"), "dist").select("way.p", "way.q", "dist")


def within_reach(edges: DataFrame, proposed: DataFrame, k: int, n: int) -> DataFrame:
    """The proposals that merge() can take: where p has k edges, those nearer than its farthest; any other loses to it.

    The farthest are broadcast, so that the rest is not shuffled, for up to REACH_POINTS points; beyond that all go on.
    """
    if n > REACH_POINTS:
        return proposed
    far = edges.groupBy(F.col("p").alias("_p")).agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("_far")).where("_far is not null")
    return proposed.join(F.broadcast(far), F.col("p") == F.col("_p"), "left").where("_far is null or dist < _far").select("p", "q", "dist")


def merge(edges: DataFrame, proposed: DataFrame, k: int, tasks: int = 0) -> DataFrame:
    """Each p's k nearest of its edges and the proposals; an edge that is there wins a tie, then the smaller q.

    is_new tells what came in. A proposal that is an edge already, or a loop, changes nothing. One shuffle by p serves
    the grouping by (p, q) and the ranking. tasks: how many share the work, by default as many as Spark finds.
    """
    fresh = proposed.where("p <> q").select("p", "q", "dist", F.lit(True).alias("is_new"))
    both = mark_all_old(edges).select("p", "q", "dist", "is_new").unionByName(fresh)
    own = (both.repartition(tasks, "p") if tasks else both.repartition("p")).groupBy("p", "q").agg(F.min("dist").alias("dist"), F.min("is_new").alias("is_new"))
    return top_k(own, k, "dist", "is_new", "q").select("p", "q", "dist", "is_new")


def evicted(before: DataFrame, after: DataFrame) -> DataFrame:
    """p, q of edges that are gone."""
    return before.select("p", "q").join(after.select("p", "q"), ["p", "q"], "left_anti")


def to_lists(edges: DataFrame) -> DataFrame:
    """p, neighbors: ids by ascending distance, without padding."""
    parts = edges.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("dist", "q"))).alias("_l"))
    return parts.select("p", F.col("_l.q").alias("neighbors"))


class KNNGraph:
    """An edge relation with the operations on it as methods; each that changes it gives a new graph."""

    def __init__(self, edges: DataFrame, k: int):
        self.edges, self.k = edges, k

    @classmethod
    def random(cls, points: DataFrame, k: int, n: int, dim: int, seed: int = 42, distance="euclidean") -> KNNGraph:
        return cls(initial_graph(points, k, n, seed, Distances(points, n, dim, distance)), k)

    def update(self, proposed: DataFrame) -> KNNGraph:
        return KNNGraph(merge(self.edges, proposed, self.k), self.k)

    def mark_all_old(self) -> KNNGraph:
        return KNNGraph(mark_all_old(self.edges), self.k)

    def neighbors(self, is_new: bool | None = None) -> DataFrame:
        return neighbors(self.edges, is_new)

    def reverse(self) -> DataFrame:
        return reverse_edges(self.edges)

    def to_lists(self) -> DataFrame:
        return to_lists(self.edges)

    def recall(self, truth: DataFrame) -> float:
        return recall(self.edges, truth).first()["recall"]
