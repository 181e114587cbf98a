"""Candidate discovery: neighbours of neighbours, as joins on the edge relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.rng import race, uniform
from quern.operators import tracking


def naive_two_hop(edges: DataFrame) -> DataFrame:
    """v, c, u over every path v -> u -> c with c <> v; paths are not merged and neighbours not left out."""
    a = edges.select(F.col("p").alias("v"), F.col("q").alias("u"))
    b = edges.select(F.col("p").alias("u"), F.col("q").alias("c"))
    return a.join(b, "u").where("c <> v").select("v", "c", "u")


def new_old_lists(edges: DataFrame) -> DataFrame:
    """v, u, is_new: forward and reverse neighbours, each flag's list without repeats. u may be in both."""
    there = edges.select(F.col("p").alias("v"), F.col("q").alias("u"), "is_new")
    back = edges.select(F.col("q").alias("v"), F.col("p").alias("u"), "is_new")
    return there.unionByName(back).repartition("v").distinct()  # and the sampling by v needs no other shuffle


def rho_sample(lists: DataFrame, size: int, seed: int, round_no: int, weight: Column | None = None) -> DataFrame:
    """At most size of each (v, is_new), without replacement, uniform or by the weight column."""
    u = uniform(seed, f"rho|{round_no}", F.col("v"), F.col("u"))
    order = W.partitionBy("v", "is_new").orderBy(race(u, F.lit(1.0) if weight is None else weight), "u")
    return lists.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).select("v", "u", "is_new")


def _paths(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """v, c, u, from_old: what new neighbours' lists, and old neighbours' sampled new lists, lead to, but for v itself."""
    new, old = sampled.where("is_new").select("v", "u"), sampled.where("not is_new").select("v", "u")
    via_new = new.join(edges.select(F.col("p").alias("u"), F.col("q").alias("c")), "u").select("v", "c", "u", F.lit(False).alias("from_old"))
    hop = new.select(F.col("v").alias("u"), F.col("u").alias("c"))
    via_old = old.join(hop, "u").select("v", "c", "u", F.lit(True).alias("from_old"))
    return via_new.unionByName(via_old).where("c <> v")


def two_hop(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """v, c, u, from_old of all ways that lead to a candidate; v itself and v's present neighbours are left out."""
    return _paths(edges, sampled).join(edges.select(F.col("p").alias("v"), F.col("q").alias("c")), ["v", "c"], "left_anti")


def fresh_candidates(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """candidates(two_hop(edges, sampled)) by one shuffle: present neighbours go into the grouping and drop what they meet."""
    return _grouped(edges, sampled.withColumn("_f", F.lit(0.0))).select("v", "c", "source")


def weighted_candidates(edges: DataFrame, sampled: DataFrame, counts: DataFrame, degrees: DataFrame | None = None, k: int = 10) -> DataFrame:
    """tracking.candidate_weights(two_hop(edges, sampled), ...) by one shuffle of the paths: their sources are weighed before they fan out."""
    own = tracking.source_gains(sampled, counts, degrees, k)
    return _grouped(edges, own).select("v", "c", "source", (F.lit(tracking.BASE) + F.lit(tracking.BOOST) * F.col("_f")).alias("weight"))


def _grouped(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """v, c, source, _f (summed over all ways) of fresh candidates. sampled: v, u, is_new, _f.

    A way's source is sent to v with its list as an array, which is taken apart behind the shuffle.
    """
    lists = edges.groupBy(F.col("p").alias("u")).agg(F.collect_list("q").alias("cs"))
    hop = sampled.where("is_new").groupBy(F.col("v").alias("u")).agg(F.collect_list("u").alias("cs"))
    via_new = sampled.where("is_new").select("v", "u", "_f").join(lists, "u").select("v", "u", "_f", F.lit(False).alias("from_old"), "cs")
    via_old = sampled.where("not is_new").select("v", "u", "_f").join(hop, "u").select("v", "u", "_f", F.lit(True).alias("from_old"), "cs")
    there = lists.select(F.col("u").alias("v"), F.lit(None).cast("bigint").alias("u"), F.lit(0.0).alias("_f"), F.lit(None).cast("boolean").alias("from_old"), "cs")
    both = via_new.unionByName(via_old).unionByName(there).repartition("v").select("v", "u", "_f", "from_old", F.explode("cs").alias("c")).where("c <> v")
    own = both.groupBy("v", "c").agg(
        F.min(F.when(F.col("u").isNotNull(), F.struct("from_old", "u"))).alias("_s"), F.count(F.when(F.col("u").isNull(), 1)).alias("_there"), F.sum("_f").alias("_f")
    )
    return own.where("_there = 0").select("v", "c", F.col("_s.u").alias("source"), "_f")


def candidates(found: DataFrame) -> DataFrame:
    """v, c, source: each candidate once, with who led to it first: new neighbours before old, then the smaller id."""
    order = F.struct("from_old", "u")
    return found.groupBy("v", "c").agg(F.min(order).alias("_f")).select("v", "c", F.col("_f.u").alias("source"))


def sample_candidates(cands: DataFrame, rate: float, seed: int, round_no: int, weight: Column | None = None) -> DataFrame:
    """Of each v's candidates max(1, floor(rate * how many)), uniform or by the weight column."""
    if rate >= 1:
        return cands
    u = uniform(seed, f"cand|{round_no}", F.col("v"), F.col("c"))
    order = W.partitionBy("v").orderBy(race(u, F.lit(1.0) if weight is None else weight), "c")
    own = cands.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("v")))
    return own.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(rate)))).drop("_r", "_n")
