"""Exact k nearest neighbours and the measures built on them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.distances import Metric, as_metric

#: Points of a block at most, and bytes of its vectors; bytes of a stripe's scores, and of a batch of direct distances.
SIDE, SIDE_BYTES, STRIPE_BYTES, BATCH_BYTES = 12_288, 64_000_000, 96_000_000, 1_000_000
#: Blocks at least, as far as points allow, so that small inputs use all cores.
SPREAD = 4
#: A point whose scores are this many times less certain than most is measured directly.
ODD = 16
#: Largest sum of a pair's levels, which 16 bits hold.
LEVELS = 65_000


def top_k(edges: DataFrame, k: int, *order) -> DataFrame:
    """Of each p its first k edges; the limit is pushed below the shuffle."""
    w = W.partitionBy("p").orderBy(*order)
    return edges.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def pair_distances(points: DataFrame, pairs: DataFrame, distance="euclidean", dim: int | None = None) -> DataFrame:
    """pairs (p, q) with dist, all as columns."""
    metric = as_metric(distance)
    a = points.select(F.col("id").alias("p"), F.col("vec").alias("_x"))
    b = points.select(F.col("id").alias("q"), F.col("vec").alias("_y"))
    return pairs.join(a, "p").join(b, "q").withColumn("dist", metric.column(F.col("_x"), F.col("_y"), dim)).drop("_x", "_y")


class _Scores:
    """Scores of all pairs of two blocks, in single or 16-bit precision, and how far each may be from the truth.

    rows(low, high) has the scores of these y to all x: they have the distances' order but for their error, which for
    x[j] and y[i] is at most off_x[j] + off_y[i]. An infinite one tells that the point has no score to rely on.
    """

    far: float

    def __init__(self, metric: Metric, x: np.ndarray, y: np.ndarray):
        self._make = {"euclidean": self._squares, "cosine": self._angles, "manhattan": self._levels}[metric.name]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            self._make(x, y)

    @staticmethod
    def known(metric: Metric, dim: int) -> bool:
        return dim > 0 and (metric.name in ("euclidean", "cosine") or metric.name == "manhattan" and dim <= LEVELS // 64)

    def _products(self, x: np.ndarray, y: np.ndarray, sizes_x: np.ndarray, sizes_y: np.ndarray) -> None:
        """|x|^2 + |y|^2 - 2 x y by one product. The rounding of 32 bits moves it by a share of |x|^2 + |y|^2."""
        one = lambda v: np.ones((len(v), 1))
        share, self.far = 8 * (x.shape[1] + 6) * float(np.finfo(np.float32).eps), np.float32(3e38)
        odd = lambda s: ~np.isfinite(s) | (s > 1e30)
        self.off_x, self.off_y = (np.where(odd(s), np.inf, share * s + 1e-34) for s in (sizes_x, sizes_y))
        self._a = np.concatenate([-2 * x, sizes_x[:, None], one(x)], axis=1)
        self._b = np.concatenate([y, one(y), sizes_y[:, None]], axis=1)
        self._a[odd(sizes_x)], self._b[odd(sizes_y)] = 0, 0
        self._a, self._b = np.ascontiguousarray(self._a.T, np.float32), self._b.astype(np.float32)

    def _squares(self, x: np.ndarray, y: np.ndarray) -> None:
        middle = x.mean(0)  # a point far off makes this no better, and no wrong
        x, y = x - middle, y - middle
        self._products(x, y, (x * x).sum(1), (y * y).sum(1))

    def _angles(self, x: np.ndarray, y: np.ndarray) -> None:
        parts = []
        for v in (x, y):
            size = (v * v).sum(1)
            unit = v / np.where(size == 0, 1, np.sqrt(size))[:, None]
            zero = ~v.any(1)
            fair = zero | ((size > 1e-200) & (size < 1e200))
            parts.append((np.where(fair[:, None], unit, 0), np.where(fair, 1.0, np.inf)))
        (x, sx), (y, sy) = parts
        self._products(x, y, sx, sy)

    def _levels(self, x: np.ndarray, y: np.ndarray) -> None:
        """Components become whole levels between the quantiles that hold most; the sum of the differences of two points'
        levels is off by at most what rounding moved these points. Sum of |a - b| is 2 max(a, b) - a - b."""
        top, self.far = LEVELS // x.shape[1], np.uint16(65_535)
        low, high = np.quantile(np.concatenate([x, y]), [0.0005, 0.9995])
        step = (high - low) / top if high > low else 1.0
        parts = []
        for v in (x, y):
            level = np.clip(np.rint((v - low) / step), 0, top)
            off = np.abs((v - low) / step - level).sum(1) * (1 + 1e-9) + 1e-3
            parts.append((np.where(np.isfinite(level), level, 0).astype(np.uint16), np.where(np.isfinite(off), off, np.inf)))
        (a, self.off_x), (b, self.off_y) = parts
        self._a, self._b = np.ascontiguousarray(a.T), b
        self._sums = a.sum(1, dtype=np.uint16), b.sum(1, dtype=np.uint16)

    @property
    def width(self) -> int:
        """Bytes of a score."""
        return self._a.itemsize

    def keep(self, x: np.ndarray, y: np.ndarray) -> None:
        """Only these places of x and y."""
        self._a, self._b, self.off_x, self.off_y = np.ascontiguousarray(self._a[:, x]), self._b[y], self.off_x[x], self.off_y[y]
        if self.width == 2:
            self._sums = self._sums[0][x], self._sums[1][y]

    def rows(self, low: int, high: int) -> np.ndarray:
        if self.width == 4:
            return self._b[low:high] @ self._a
        out = np.empty((high - low, self._a.shape[1]), np.uint16)
        for i in range(low, high, 32):
            own = self._b[i : min(i + 32, high)]
            for c in range(0, out.shape[1], 1_024):  # both buffers stay in the processor's cache
                part = self._a[:, c : c + 1_024]
                total = np.zeros((len(own), part.shape[1]), np.uint16)
                most = np.empty_like(total)
                for j in range(len(part)):
                    np.maximum(part[j], own[:, j, None], out=most)
                    np.add(total, most, out=total)
                total += total
                total -= self._sums[0][c : c + 1_024]  # modulo 2^16, which the result is under
                total -= self._sums[1][i : i + len(own), None]
                out[i - low : i - low + len(own), c : c + 1_024] = total
        return out


def _candidates(scores: np.ndarray, k: int, slack: np.ndarray, far, before: np.ndarray | None = None):
    """Row and column of the scores within slack of their column's k-th least, and the k least that are known now.

    before: those of other rows. Rows are taken in groups whose least scores bound the k-th, so that only the groups
    that reach it are looked at one by one.
    """
    groups = max(1, len(scores) // max(256, 16 * k))
    firsts = len(scores) // groups
    least = scores[: firsts * groups].reshape(groups, firsts, scores.shape[1]).min(0)
    least = np.concatenate([least, scores[firsts * groups :]])
    known = least if before is None else np.concatenate([before, least])
    edge = np.full(scores.shape[1], far)
    if len(known) >= k:
        known = np.partition(known, k - 1, axis=0)[:k]
        reach = known[-1] + slack
        edge = np.ceil(np.minimum(reach, far)).astype(far.dtype) if far.dtype.kind == "u" else np.nextafter(np.minimum(reach, far).astype(far.dtype), far)
    own, col = np.nonzero(least <= edge)
    one = own >= firsts  # rows beyond the groups
    at = (own[~one, None] + firsts * np.arange(groups)).ravel()
    to = np.repeat(col[~one], groups)
    hit = scores[at, to] <= edge[to]
    return np.concatenate([at[hit], own[one] - firsts + firsts * groups]), np.concatenate([to[hit], col[one]]), known


def _first(asked: np.ndarray, place: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int):
    """Of each asked place its k nearest, ties to smaller ids."""
    order = np.lexsort((ids[place], dist, asked))
    asked, place, dist = asked[order], place[order], dist[order]
    first = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
    return asked[first], place[first], dist[first]


def _direct(metric: Metric, x: np.ndarray, ids: np.ndarray, y: np.ndarray, own: np.ndarray, k: int):
    """Query places, row places and distances of each query's k nearest other rows, all pairs measured."""
    out, batch = [], max(1, BATCH_BYTES // (8 * max(1, x.size)))
    for low in range(0, len(y) if len(x) else 0, batch):
        dist = np.stack([metric.rows(x, v) for v in y[low : low + batch]])
        itself = own[low : low + batch, None] == ids[None]
        dist[itself] = np.inf
        i, j = np.nonzero((dist <= np.partition(dist, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1, None]) & ~itself)
        i, j, dist = _first(i, j, ids, dist[i, j], k)
        out.append((low + i, j, dist))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]


def _measured(metric: Metric, x: np.ndarray, j: np.ndarray, y: np.ndarray, i: np.ndarray) -> np.ndarray:
    return np.concatenate([metric.rows(x[j[s : s + 4_096]], y[i[s : s + 4_096]]) for s in range(0, len(i), 4_096)] or [np.zeros(0)])


def _both_ways(metric: Metric, x: np.ndarray, ids: np.ndarray, y: np.ndarray, own: np.ndarray, k: int, same: bool):
    """Yields asked ids, found ids and distances that hold each point's k nearest of the other block (same: of its own).

    Where the metric has scores, a pair has one for both ways, and only what their error can't tell from the k nearest is
    measured exactly; points of odd scores are measured against all.
    """
    if not len(x) or not len(y):
        return

    def plain(a: np.ndarray, b: np.ndarray):
        """Of x's places a for the queries at y's places b."""
        i, j, dist = _direct(metric, x[a], ids[a], y[b], own[b], k)
        yield own[b][i], ids[a][j], dist

    def back(a: np.ndarray, b: np.ndarray):
        i, j, dist = _direct(metric, y[b], own[b], x[a], ids[a], k)
        yield ids[a][i], own[b][j], dist

    ways = (plain,) if same else (plain, back)
    if not _Scores.known(metric, x.shape[1]):
        for way in ways:
            yield from way(np.arange(len(x)), np.arange(len(y)))
        return
    scores = _Scores(metric, x, y)
    odd_x, odd_y = (off > ODD * np.median(off) if np.isfinite(np.median(off)) else ~np.isfinite(off) for off in (scores.off_x, scores.off_y))
    a, b = np.flatnonzero(~odd_x), np.flatnonzero(~odd_y)
    for way in ways:
        yield from way(np.flatnonzero(odd_x), np.arange(len(y)))
        yield from way(a, np.flatnonzero(odd_y))
    if not len(a) or not len(b):
        return
    scores.keep(a, b)
    x, ids, y, own = x[a], ids[a], y[b], own[b]
    to_y, to_x = 2 * (scores.off_x.max() + scores.off_y), 2 * (scores.off_y.max() + scores.off_x)
    stripe, least, kept = max(256, STRIPE_BYTES // (scores.width * len(x))), None, []
    for low in range(0, len(y), stripe):
        s = scores.rows(low, min(low + stripe, len(y)))
        if same:
            s[np.arange(len(s)), low + np.arange(len(s))] = scores.far
        j, i, _ = _candidates(s.T, k, to_y[low : low + len(s)], scores.far)
        other = ids[j] != own[low + i]
        i, j = low + i[other], j[other]
        i, j, dist = _first(i, j, ids, _measured(metric, x, j, y, i), k)
        yield own[i], ids[j], dist
        if not same:
            i, j, least = _candidates(s, k, to_x, scores.far, least)  # its columns are x's
            kept.append((j, low + i, _measured(metric, x, j, y, low + i)))
    if kept:
        j, i, dist = (np.concatenate(c) for c in zip(*kept))
        j, i, dist = _first(j, i, own, dist, k)
        yield ids[j], own[i], dist


def block_count(n: int, dim: int, side: int | None = None) -> int:
    """Blocks of so many points: of side at most, by default SIDE or what SIDE_BYTES hold, and SPREAD at least."""
    side = side or max(256, min(SIDE, SIDE_BYTES // (8 * max(1, dim))))
    return max(1, math.ceil(n / side), min(SPREAD, math.ceil(n / 128)))


def knn_exact(points: DataFrame, k: int, n: int, distance="euclidean", side: int | None = None) -> DataFrame:
    """p, rank, q, dist of every point's k nearest others: all if fewer; ties to smaller ids.

    Points are dealt to blocks, and a task takes two blocks and searches each for the other's points, so a vector is
    sent once for each block. side: points of a block, by default SIDE or as many as SIDE_BYTES hold. A cell's memory and
    time are bounded, however many points there are, and no pair leaves it unless it is a block's best; these are ranked
    in a second step.
    """
    metric = as_metric(distance)
    dim = 0 if side else (points.select(F.size("vec").alias("d")).first() or [1])[0]
    blocks = block_count(n, dim, side)
    dealt = points.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "vec")

    def cell(t: pa.Table) -> pa.Table:
        low, high, own = (t.column(c).to_numpy() for c in ("low", "high", "own"))
        parts = []
        for block in dict.fromkeys((low[0], high[0])):
            part = t.take(pa.array(np.flatnonzero(own == block)))
            flat = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            parts.append((part.column("id").to_numpy(), flat.reshape(len(part), -1)))
        (ids, x), (asked, y) = parts[0], parts[-1]
        found = list(_both_ways(metric, x, ids, y, asked, k, same=low[0] == high[0]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table(dict(zip(("p", "q", "dist"), cols)))

    cells = dealt.repartition(blocks * (blocks + 1), "low", "high").groupBy("low", "high")
    best = cells.applyInArrow(cell, "p bigint, q bigint, dist double")
    return top_k(best, k, "dist", "q").select("p", F.col("_rank").alias("rank"), "q", "dist")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """hits, total, recall of the pairs (p, q) of truth that found has; recall 0 where truth is empty."""
    got = truth.select("p", "q").join(found.select("p", "q", F.lit(1).alias("_hit")).distinct(), ["p", "q"], "left")
    r = got.agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    return r.select("hits", "total", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(0.0)).alias("recall"))


def in_degree(edges: DataFrame) -> DataFrame:
    """q, degree: in how many lists each point is."""
    return edges.groupBy("q").agg(F.count(F.lit(1)).alias("degree"))


def hubness(edges: DataFrame, points: DataFrame) -> DataFrame:
    """n, mean, biggest, skew of the in-degrees, points in no list included."""
    d = points.select(F.col("id").alias("q")).join(in_degree(edges), "q", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.avg("degree").alias("mean"), F.max("degree").alias("biggest"),
        F.skewness(F.col("degree").cast("double")).alias("skew"),
    )
