"""Hard negatives by a full sort of each anchor's scores.

Components become integers, floor(scale * x), and a row's score is its integer inner product with the anchor. Anchors
are a stated set, searched against all rows in blocks: rows are dealt to segments, anchors to blocks, and a task takes
one cell, where it computes the scores of all the segment's rows by one matrix product for a batch of anchors.

Twice over: first a cell gives each anchor's best rows of its own label, and the cells' best, ranked, are the anchor's
positives. Then a cell sorts all its scores for an anchor by (score, id), binary-searches each positive's upper limit,
and reads on from there the first k rows of another label, down to the lower limit. The cells' k, ranked, are the
negatives. No cell gives more than a few rows an anchor, so nothing is gathered but what may be part of the result.

Of equal vectors with one label only the first by id can be in any list, so a vector that a third of the rows share
costs a few rows; the limit is applied by each mapper before the shuffle.

Defined results: rows with a null id or label, or a null, empty, partly null or non-finite vector take no part; rows
of one id are rows of their own, and each of equal anchors gets its rows; vectors of different lengths never meet;
ties go to smaller ids; a negative positive score has no negative (80 % of it is more than it); an empty table gives
no rows; further columns are ignored. An integer component is held within the largest size at which no score of that
length leaves a long: about 268 million either way at 64 dimensions, where x is over a million.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import vectors
from quern.session import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is between these parts of the positive's.
LEAST, MOST, OF = 80, 100, 100
EVERY, MOVED, LABELS = 100, 7, 10
SEGMENT, BLOCK, BATCH = 16_384, 8_192, 64


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held so that no inner product leaves 62 bits; as doubles where products stay exact in them."""
    d = x.shape[1]
    most = float(math.isqrt(2**62 // max(1, d)))
    whole = np.clip(np.floor(x * scale), -most, most)
    return whole if np.abs(whole).max(initial=0) ** 2 * d < 2.0**52 else whole.astype(np.int64)


def _products(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """asked x rows, exactly, as longs."""
    d = rows.shape[1]
    if rows.dtype == asked.dtype == np.float64 and np.abs(rows).max(initial=0) * np.abs(asked).max(initial=0) * d < 2.0**52:
        return (asked @ rows.T).astype(np.int64)
    return asked.astype(np.int64) @ rows.astype(np.int64).T


def sorted_scores(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, ties by id."""
    return np.lexsort((ids, -scores))


def first_between(falling: np.ndarray, positive: int, k: int) -> slice:
    """Where in falling scores the first k lie that are in a positive's limits."""
    upper = np.searchsorted(-falling, -(positive * MOST // OF), side="left")
    lower = np.searchsorted(-falling, positive * -LEAST // OF, side="right")  # the floor of -x is minus the ceiling of x
    return slice(int(upper), max(int(upper), min(int(lower), int(upper) + k)))


def _cells(k: int, scale: int, negatives: bool):
    """Per anchor: its k best others of its label; with negatives, each positive's first k of other labels."""

    def run(cell: pa.Table) -> pa.Table:
        rows, asked = vectors.split(cell)
        out: list[tuple] = []
        if len(rows) and len(asked):
            x, y = (integers(vectors.matrix(t.column("v"), np.float64), scale) for t in (rows, asked))
            originals = [vectors.matrix(t.column("v"), np.float64) for t in (rows, asked)]
            ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            asked_ids, turn, times, asked_labels = (asked.column(c).to_numpy() for c in ("id", "turn", "times", "label"))
            positives = asked.column("positives").to_pylist()
            for low in range(0, len(y), BATCH):
                for i, scores in enumerate(_products(x, y[low : low + BATCH]), low):
                    mark = (asked_ids[i], turn[i], times[i])
                    if not negatives:
                        at = np.flatnonzero(labels == asked_labels[i])
                        at = at[at != vectors.own_row(ids, originals[0], int(asked_ids[i]), originals[1][i], labels == asked_labels[i])]
                        at = at[vectors.best(scores[at], ids[at], k)]
                        out += [(*mark, 0, 0, 0, ids[j], scores[j]) for j in at]
                        continue
                    order = sorted_scores(scores, ids)
                    order = order[labels[order] != asked_labels[i]]
                    falling = scores[order]
                    for number, p in enumerate(positives[i] or ()):
                        at = order[first_between(falling, p["score"], k)]
                        out += [(*mark, number, p["id"], p["score"], ids[j], scores[j]) for j in at]
        cols = list(zip(*out)) if out else [()] * 8
        return pa.table([pa.array(c, pa.int64()) for c in cols], NAMES)

    return run


NAMES = ["anchor_id", "turn", "times", "number", "positive_id", "positive_score", "found_id", "score"]
SCHEMA = ", ".join(f"{c} long" for c in NAMES)


def prepared(table: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """id, v, label of the rows that take part."""
    own = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), label.cast("long").alias("label"))
    own = own.where(F.col("label").isNotNull())
    return vectors.clean(own, "id", "v", "label")


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
    segment: int = SEGMENT, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: prepared(). anchors: the condition on id and label of the rows that are anchors.
    """
    nothing = F.lit(None).cast("array<struct<id: long, score: long>>")
    asked = materialize(vectors.asked(rows, anchors, "label"), "anchors")
    own = vectors.first_copies(rows, max(positives, negatives), "label").withColumn("positives", nothing)
    own = materialize(own, "negative-rows")
    sizes = own.count(), asked.count()
    extra = ("label", "positives")

    def found(asked: DataFrame, k: int, with_negatives: bool) -> DataFrame:
        cells = vectors.deal(own, asked, *sizes, segment, block, extra).groupBy("seg", "blk", "dim")
        key = ["anchor_id", "turn", "number"]
        order = W.partitionBy(*key).orderBy(F.col("score").desc(), "found_id")
        out = cells.applyInArrow(_cells(k, scale, with_negatives), SCHEMA)
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = found(asked.withColumn("positives", nothing), positives, False)
    best = best.groupBy(F.col("anchor_id").alias("id"), "turn").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("found_id").alias("id"), "score"))).alias("best")  # at most positives
    )
    best = best.select("id", F.col("turn").cast("int").alias("turn"), F.transform("best", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    again = materialize(asked.join(best, ["id", "turn"]), "anchors-positives")
    out = found(again, negatives, True)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(prepared(table, "vec_id", "embedding", label), F.col("id") % EVERY == 0)


SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, c.place,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.place <> c.place AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, place) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id, n.place) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
