"""Which neighbours led to improvements: success counts S(v, u, freq), their bounds, and the weights they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import discard, materialize

BASE, BOOST = 1.0, 0.5


def empty_counts(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "v bigint, u bigint, freq bigint")


def successes(cands: DataFrame, after: DataFrame) -> DataFrame:
    """v, u, freq: one for the first source of each candidate that v's own list took in."""
    return success_events(cands, after).groupBy("v", "u").agg(F.count(F.lit(1)).alias("freq"))


def success_events(cands: DataFrame, after: DataFrame) -> DataFrame:
    """v, u: a row for each candidate that v's own list took in, with its first source."""
    took = after.where("is_new").select(F.col("p").alias("v"), F.col("q").alias("c"))
    return cands.join(took, ["v", "c"]).select("v", F.col("source").alias("u"))


def record(counts: DataFrame, delta: DataFrame) -> DataFrame:
    return counts.unionByName(delta).groupBy("v", "u").agg(F.sum("freq").cast("bigint").alias("freq"))


def penalize(counts: DataFrame, penalties: DataFrame) -> DataFrame:
    """Subtracts; what falls to 0 goes; unknown keys change nothing. Apply after a round's successes."""
    p = penalties.groupBy("v", "u").agg(F.sum("freq").alias("_p"))
    own = counts.join(p, ["v", "u"], "left").withColumn("freq", F.col("freq") - F.coalesce("_p", F.lit(0)))
    return own.where("freq > 0").select("v", "u", F.col("freq").cast("bigint").alias("freq"))


def prune(counts: DataFrame, lg_max: int) -> DataFrame:
    """A v with more than 2^lg_max counts keeps the larger half of 2^lg_max; ties to smaller ids."""
    most = 2**lg_max
    w = W.partitionBy("v")
    own = counts.withColumn("_n", F.count(F.lit(1)).over(w))
    own = own.withColumn("_r", F.row_number().over(w.orderBy(F.col("freq").desc(), "u")))
    return own.where((F.col("_n") <= most) | (F.col("_r") <= most // 2)).select("v", "u", "freq")


def frequency(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (v, u) with freq, 0 where unknown."""
    return keys.join(counts, ["v", "u"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("bigint"))


def neighbor_weights(lists: DataFrame, counts: DataFrame, base: float = BASE, boost: float = BOOST) -> DataFrame:
    """lists (v, u, is_new) with weight base + boost * freq(v, u)."""
    own = lists.join(counts, ["v", "u"], "left")
    return own.select("v", "u", "is_new", (F.lit(base) + F.lit(boost) * F.coalesce("freq", F.lit(0))).alias("weight"))


def source_gains(found: DataFrame, counts: DataFrame, degrees: DataFrame | None = None, k: int = 10) -> DataFrame:
    """found (v, u, ...) with _f, the count of (v, u); with degrees less for a u in more than k lists."""
    own = found.join(counts, ["v", "u"], "left").withColumn("_f", F.coalesce("freq", F.lit(0)).cast("double"))
    if degrees is not None:
        own = own.join(degrees.select(F.col("q").alias("u"), "degree"), "u", "left")
        ratio = F.coalesce("degree", F.lit(k)) / F.lit(float(k))
        own = own.withColumn("_f", F.when(ratio > 1, F.col("_f") / (ratio * ratio)).otherwise(F.col("_f")))
    return own


def candidate_weights(
    found: DataFrame, counts: DataFrame, degrees: DataFrame | None = None, k: int = 10, base: float = BASE, boost: float = BOOST
) -> DataFrame:
    """v, c, source, weight: base + boost * (summed counts of all ways that led to c).

    With degrees (q, degree) a source in more than k lists counts less, by the square of degree / k.
    """
    own = source_gains(found, counts, degrees, k)
    order = F.struct("from_old", "u")
    agg = own.groupBy("v", "c").agg(F.min(order).alias("_s"), F.sum("_f").alias("_f"))
    return agg.select("v", "c", F.col("_s.u").alias("source"), (F.lit(base) + F.lit(boost) * F.col("_f")).alias("weight"))


def top_sources(counts: DataFrame, k: int) -> DataFrame:
    """v, u, freq: each v's k most frequent sources, ties to smaller ids; the limit is pushed below the shuffle."""
    order = W.partitionBy("v").orderBy(F.col("freq").desc(), "u")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("v", "u", "freq")


class SketchTracker:
    """Success counts in bounded space: a frequent-items sketch for each v, merged from round to round.

    Each round's successes, a row each, go into sketches by v (approx_top_k_accumulate), which are combined with those
    so far (approx_top_k_combine) and written. A sketch holds at most 3/4 of its map, and an estimate is off by at
    most error() of the v's successes; while a v has no more sources than it holds, counts are exact.
    """

    def __init__(self, like: DataFrame, items: int = 64):
        """items: the size of a sketch's map, a power of two."""
        self.items, self._like = items, like
        self.reset()

    def reset(self) -> None:
        self.sketches: DataFrame | None = None
        self.total_updates = 0

    def error(self) -> float:
        """The bound of the error, as a share of a v's successes."""
        return 3.5 / self.items

    def record(self, events: DataFrame) -> None:
        """events: v, u, a row a success."""
        own = events.groupBy("v").agg(F.expr(f"approx_top_k_accumulate(u, {self.items})").alias("sketch"), F.count(F.lit(1)).alias("n"))
        before = self.sketches
        if before is not None:
            both = before.unionByName(own).groupBy("v")
            own = both.agg(F.expr(f"approx_top_k_combine(sketch, {self.items})").alias("sketch"), F.sum("n").alias("n"))
        self.sketches = materialize(own, "sketches", total=F.coalesce(F.sum("n"), F.lit(0)))
        self.total_updates = self.sketches.counts["total"]
        discard(before)

    def estimates(self) -> DataFrame:
        """v, u, freq, n (successes of v): the sources that the sketches hold."""
        if self.sketches is None:
            return empty_counts(self._like).withColumn("n", F.col("freq"))
        own = self.sketches.select("v", "n", F.explode(F.expr(f"approx_top_k_estimate(sketch, {self.items})")).alias("e"))
        return own.select("v", F.col("e.item").alias("u"), F.col("e.count").alias("freq"), "n")


class SourceFrequencyTracker:
    """Counts of successes by (v, u), at most 2^lg_max for each v, kept as a written table from round to round."""

    def __init__(self, like: DataFrame, lg_max: int = 6):
        self.lg_max, self._like = lg_max, like
        self.reset()

    def reset(self) -> None:
        """Forget all counts."""
        self.counts, self.total_updates = empty_counts(self._like), 0

    def record(self, delta: DataFrame) -> None:
        """delta: v, u, freq. total_updates goes up by the successes recorded."""
        delta = materialize(delta.select("v", "u", F.col("freq").cast("bigint").alias("freq")), "successes")
        self.total_updates += delta.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
        before, self.counts = self.counts, materialize(prune(record(self.counts, delta), self.lg_max), "counts")
        discard(before, delta)

    def frequency(self, keys: DataFrame) -> DataFrame:
        return frequency(self.counts, keys)

    def neighbor_weights(self, lists: DataFrame, base: float = BASE, boost: float = BOOST) -> DataFrame:
        return neighbor_weights(lists, self.counts, base, boost)

    def candidate_weights(self, found: DataFrame, base: float = BASE, boost: float = BOOST) -> DataFrame:
        return candidate_weights(found, self.counts, base=base, boost=boost)

    def top(self, k: int) -> DataFrame:
        return top_sources(self.counts, k)


class NetSourceTracker(SourceFrequencyTracker):
    """The same with penalties, and with sources in more than k lists counting less."""

    def penalize(self, penalties: DataFrame) -> None:
        before, self.counts = self.counts, materialize(penalize(self.counts, penalties), "counts")
        discard(before)

    def candidate_weights(self, found: DataFrame, degrees: DataFrame | None = None, k: int = 10, base: float = BASE, boost: float = BOOST) -> DataFrame:
        return candidate_weights(found, self.counts, degrees, k, base, boost)
