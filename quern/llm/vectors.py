"""What the two vector searches share: cleaning, copies, and dealing blocks of queries to segments of rows.

Rows are known by id, vector and number, so an id may repeat: each of its rows is a candidate of every other row,
and each asks for itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean(table: DataFrame, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    """id, v (array<double>), and columns kept, of the rows that take part: with an id, and a finite vector without nulls."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *keep)
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~odd)


def first_copies(rows: DataFrame, k: int, *kind: str) -> DataFrame:
    """Of equal vectors (of a kind) the k + 1 rows of smallest ids: equal scores go to smaller ids, so no query needs a further copy.

    The limit is pushed into each mapper before the shuffle, so a vector that a third of the rows share is cheap.
    """
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("v", *kind).orderBy("id"))).where(f"_n <= {k + 1}").drop("_n")


def asked(rows: DataFrame, condition, *kind: str) -> DataFrame:
    """id, v, kind, turn, times: the different queries; turn tells those of one id apart, times is how many rows each stands for."""
    own = rows.where(condition).groupBy("id", "v", *kind).agg(F.count(F.lit(1)).alias("times"))
    return own.withColumn("turn", F.row_number().over(W.partitionBy("id").orderBy("v", *kind)))


def deal(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, segment: int, block: int, extra=()) -> DataFrame:
    """Every (segment of rows, block of queries) cell as one group, keyed by seg, blk and dim.

    A row is copied once a block and a query once a segment, so blocks are large; small tables get a cell a core.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    segs = max(1, math.ceil(n_rows / segment))
    blks = max(1, math.ceil(n_queries / block), min(math.ceil(cores / segs), math.ceil(n_queries / 64)))
    dim, none = F.size("v").alias("dim"), F.lit(0).cast("long")
    own = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(segs)).cast("int").alias("seg"),
        F.explode(F.sequence(F.lit(0), F.lit(blks - 1))).alias("blk"), dim, none.alias("turn"), none.alias("times"), "id", "v", *extra,
    )
    queries = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(segs - 1))).alias("seg"),
        F.pmod(F.xxhash64("id", "turn"), F.lit(blks)).cast("int").alias("blk"), dim, F.col("turn").cast("long"), "times", "id", "v", *extra,
    )
    return own.unionByName(queries).repartition(segs * blks, "seg", "blk", "dim")


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    flat = column.combine_chunks()
    return np.ascontiguousarray(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1), dtype=dtype)


def split(cell: pa.Table):
    """The cell's rows by ascending id, and its queries by id and turn; only queries have a turn."""
    asked = cell.column("turn").to_numpy() > 0
    take = lambda mask: cell.take(pa.array(np.flatnonzero(mask))).sort_by([("id", "ascending"), ("turn", "ascending")])
    return take(~asked), take(asked)


def own_row(ids: np.ndarray, rows: np.ndarray, own_id: int, own: np.ndarray, among: np.ndarray | None = None) -> int:
    """The place of a row (among some) with the query's id and vector, one of those that may be it; -1 if none is here. ids ascend."""
    low, high = np.searchsorted(ids, [own_id, own_id + 1])
    same = (rows[low:high] == own).all(axis=1) if among is None else (rows[low:high] == own).all(axis=1) & among[low:high]
    same = np.flatnonzero(same) if high > low else ()
    return int(low + same[0]) if len(same) else -1


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def ranked(found: DataFrame, k: int, *then) -> DataFrame:
    """query_id, rank, vec_id, score from the cells' best; a query that stands for several rows is given as often."""
    order = W.partitionBy("query_id", "turn").orderBy(F.col("score").desc(), *then, "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("query_id", "rank", "vec_id", "score")
