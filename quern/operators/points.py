"""Point tables: id bigint, vec array<double>."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import materialize


def as_points(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def dimension(points: DataFrame) -> tuple[int, int]:
    """(rows, dimension); raises where a vector is null, of another length, not finite, or an id repeats or is null."""
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    r = points.agg(
        F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.countDistinct("id").alias("distinct"),
        F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"), F.count("vec").alias("vecs"),
        F.coalesce(F.sum(F.when(odd, 1).otherwise(0)), F.lit(0)).alias("odd"),
    ).first()
    if r.vecs != r.n or r.odd or r.lo != r.hi:
        raise ValueError(f"vectors must be finite, not null and of one length: {r}")
    if r.ids != r.n or r.distinct != r.n:
        raise ValueError(f"ids must be there and differ: {r}")
    return r.n, r.lo or 0


def indexed(points: DataFrame, n: int) -> DataFrame:
    """id, idx with idx 0 .. n-1 in order of id. Ids that are these numbers already cost one aggregate."""
    lo, hi = points.agg(F.min("id"), F.max("id")).first()
    if n and (lo, hi) == (0, n - 1):
        return points.select("id", F.col("id").alias("idx"))
    dealt = materialize(points.select("id").repartitionByRange("id").select("id", F.spark_partition_id().alias("_p")), "index")
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    starts = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_first"))
    own = dealt.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("id")) - 1)
    return own.join(starts, "_p").select("id", (F.col("_first") + F.col("_r")).alias("idx"))


def to_matrix(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids ascending, vectors) on the driver; callers check the size first."""
    table = points.orderBy("id").toArrow()
    vec = table.column("vec").combine_chunks()
    return table.column("id").to_numpy(), vec.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
