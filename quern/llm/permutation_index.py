"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors of each length. A vector is represented by its nearest pivots in order, the
first POSTED of them, nearness being the angle. Each is posted in the inverted files of these pivots with its place
there, so a file holds only the rows that have the pivot near. The index is a table of segments: a row has a segment's
vectors and its files, one after the other by pivot. A query reads the files of its own nearest pivots and no others.
With places counted from 0, and POSTED for a pivot that is not among a row's, the footrule distance of two such orders
is a constant less twice the sum, over the pivots that both have, of POSTED less the larger of the two places; so the
files' entries add up to it, and rows that are in none of them are the farthest. The RERANK share of each segment that
comes nearest, at least LEAST rows, is ranked by the exact measure.

The measure is the inner product. Rows are dealt to segments by their norm, in bands a fifth wide, since the angle
decides only among vectors of like norm; all bands are searched.

Recall of the 20 nearest against brute force, measured on the test tables, is in README.md and tests/llm.

Defined results: null, empty, zero, partly null or non-finite vectors, and null ids, take no part; rows of one id are
rows of their own, and equal rows ask and are found each; vectors of other lengths never meet; of more than LENGTHS
lengths the rarest have no pivots and are searched in full; ties go to smaller ids; a product beyond a double's range
is infinite, one that is no number comes last; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import vectors
from quern.session import materialize

K, EVERY = 20, 20
RERANK, LEAST = 0.08, 128
#: Vector lengths that have pivots.
LENGTHS = 64
#: Rows of a segment at most, and bytes of its vectors and files, about; queries of a block.
SEGMENT, BYTES, BLOCK = 16_384, 32_000_000, 8_192
#: Bands of norms, each a fifth wide; the last holds all shorter vectors.
BANDS, STEP = 16, 0.8
SCHEMA = "query_id long, turn long, times long, vec_id long, score double"


def pivots_of(dim: int) -> int:
    """How many pivots vectors of this length have: angles spread less in more dimensions, so more tell them apart."""
    return 1_024 if dim <= 128 else 2_048 if dim <= 384 else 4_096


def posted_of(dim: int, pivots: int) -> int:
    return max(1, min(pivots, 96 if dim <= 128 else pivots // 4))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def orders(x: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """Each vector's count nearest pivots, nearest first. pivots: unit vectors."""
    out = np.empty((len(x), count), np.int16)
    for low in range(0, len(x), 2_048):
        near = -(unit(x[low : low + 2_048]) @ pivots.T)
        first = np.argpartition(near, count - 1, axis=1)[:, :count] if count < len(pivots) else np.broadcast_to(np.arange(len(pivots)), near.shape)
        own = np.take_along_axis(near, first, axis=1)
        out[low : low + 2_048] = np.take_along_axis(first, np.lexsort((first, own), axis=1), axis=1)
    return out


def fit(rows: DataFrame, lengths: int = LENGTHS) -> dict[int, np.ndarray]:
    """Unit pivots for each of the most frequent vector lengths, those with the smallest hash.

    The pivots are all that is sampled; at most pivots_of() of each length come to the driver.
    """
    size = F.size("v").alias("dim")
    found = rows.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(lengths).collect()
    dims = [r.dim for r in found]
    if not dims:
        return {}
    most = F.element_at(F.create_map(*[F.lit(x) for d in dims for x in (d, pivots_of(d))]), F.col("dim"))
    first = W.partitionBy("dim").orderBy(F.xxhash64("v"), "v")
    own = rows.withColumn("dim", size).where(F.col("dim").isin(dims)).withColumn("r", F.row_number().over(first))
    taken = own.where(F.col("r") <= max(map(pivots_of, dims))).where(F.col("r") <= most).select("dim", "v").toArrow()
    at = taken.column("dim").to_numpy()
    out = {}
    for dim in dims:
        own = vectors.matrix(taken.take(pa.array(np.flatnonzero(at == dim))).column("v"), np.float64)
        out[dim] = unit(np.unique(own, axis=0))
    return out


class Files:
    """A segment's rows by id, and its inverted files."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray, rows: np.ndarray, places: np.ndarray, posted: int):
        self.ids, self.x, self.starts, self.rows, self.places, self.posted = ids, x, starts, rows, places, posted

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray | None) -> Files:
        if pivots is None:
            return cls(ids, x, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16), 0)
        posted = posted_of(x.shape[1], len(pivots))
        own = orders(x, pivots, posted).ravel()
        by = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[by], np.arange(len(pivots) + 1))
        return cls(ids, x, starts, (by // posted).astype(np.int32), (by % posted).astype(np.int16), posted)

    def nearest(self, order: np.ndarray, take: int) -> np.ndarray:
        """Places of the take rows that come nearest by footrule to a query with this order of pivots."""
        parts = [slice(self.starts[p], self.starts[p + 1]) for p in order]
        rows = np.concatenate([self.rows[s] for s in parts])
        worse = np.concatenate([np.maximum(self.places[s], i) for i, s in enumerate(parts)])
        shared = np.bincount(rows, self.posted - worse, len(self.x))
        return np.argpartition(-shared, take - 1)[:take]

    def search(self, asked: np.ndarray, asked_ids: np.ndarray, pivots: np.ndarray | None, k: int, share: float, least: int):
        """Yields (query's place, rows' places, scores) of the k best found."""
        n = len(self.x)
        take = min(n, max(least, math.ceil(share * n))) if self.posted else n
        own_orders = orders(asked, pivots, self.posted) if take < n else None
        for i in range(len(asked)):
            at = self.nearest(own_orders[i], take) if take < n else np.arange(n)
            own = vectors.own_row(self.ids, self.x, int(asked_ids[i]), asked[i])
            at = at[at != own]
            x = self.x[at]
            score = x @ asked[i]
            score[np.isnan(score)] = -np.inf
            top = vectors.best(score, self.ids[at], k)
            yield i, at[top], np.einsum("ij,j->i", x[top], asked[i]) if np.isfinite(score[top]).all() else score[top]


INDEX = "seg int, dim int, posted int, ids binary, x binary, starts binary, rows binary, places binary"
_KINDS = {"ids": np.int64, "x": np.float64, "starts": np.int64, "rows": np.int32, "places": np.int16}


def index_table(rows: DataFrame, pivots: dict[int, np.ndarray], segment: int = SEGMENT) -> DataFrame:
    """The index: a row a segment, see INDEX. rows: id, v."""
    spark = rows.sparkSession
    size = F.size("v")
    most = F.array_max(F.transform("v", F.abs))
    # relative to the largest component, so that no square overflows or vanishes
    norm = lambda m: F.log(m) + 0.5 * F.log(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / m) * (x / m)))
    norm = F.get(F.transform(F.array(most), norm), F.lit(0))  # so that most is found once a row
    own = rows.select("id", "v", size.alias("dim"), norm.alias("norm"))
    longest = own.groupBy("dim").agg(F.max("norm").alias("longest"))
    band = F.least(F.lit(BANDS - 1), F.floor((F.col("longest") - F.col("norm")) / -math.log(STEP))).cast("int")
    own = own.join(longest.withColumnRenamed("dim", "of"), F.col("dim") == F.col("of")).select("id", "v", "dim", band.alias("band"))
    room = lambda d: max(1, min(segment, BYTES // (8 * d + 6 * posted_of(d, pivots_of(d)))))
    counts = own.groupBy("dim", "band").count().collect()  # BANDS rows a length of vector
    if not counts:
        return spark.createDataFrame([], INDEX)
    starts, facts = 0, []
    for r in sorted(counts):
        segs = -(-r["count"] // room(r.dim))
        facts.append((r.dim, r.band, starts, segs))
        starts += segs
    facts = F.broadcast(spark.createDataFrame(facts, "dim int, band int, first int, segs int"))
    dealt = own.join(facts, ["dim", "band"]).select((F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("segs"))).cast("int").alias("seg"), "dim", "id", "v")
    shared = spark.sparkContext.broadcast(pivots)  # at most LENGTHS times pivots_of() vectors

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        dim = t.column("dim")[0].as_py()
        f = Files.build(t.column("id").to_numpy(), vectors.matrix(t.column("v"), np.float64), shared.value.get(dim))
        held = [np.ascontiguousarray(getattr(f, c), kind).tobytes() for c, kind in _KINDS.items()]
        cols = [pa.array([v], pa.int32()) for v in (t.column("seg")[0].as_py(), dim, f.posted)] + [pa.array([h], pa.binary()) for h in held]
        return pa.table(cols, ["seg", "dim", "posted", *_KINDS])

    return dealt.groupBy("seg", "dim").applyInArrow(build, INDEX)


def _files(t: pa.Table, i: int) -> Files:
    dim = t.column("dim")[i].as_py()
    own = {c: np.frombuffer(t.column(c)[i].as_buffer(), kind) for c, kind in _KINDS.items()}
    return Files(own["ids"], own["x"].reshape(-1, dim), own["starts"], own["rows"], own["places"], t.column("posted")[i].as_py())


def search(
    index: DataFrame, queries: DataFrame, pivots: dict[int, np.ndarray], n_queries: int, k: int = K, share: float = RERANK,
    least: int = LEAST, block: int = BLOCK,
) -> DataFrame:
    """index: index_table(), written; queries: vectors.asked(). query_id, rank, vec_id, score of the k best found, own row excepted.

    A task takes a segment's row of the index and a block of queries.
    """
    spark = index.sparkSession
    segs = index.select(F.col("seg").alias("at"), F.col("dim").alias("of"))
    n_segs, cores = segs.count(), spark.sparkContext.defaultParallelism
    blks = max(1, math.ceil(n_queries / block), min(math.ceil(cores / max(1, n_segs)), math.ceil(n_queries / 64)))
    asked = queries.select("id", F.col("turn").cast("long").alias("turn"), "times", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "turn"), F.lit(blks)).cast("int").alias("blk"))
    asked = asked.join(segs, F.col("dim") == F.col("of")).drop("of")  # a query to each segment of its length
    shared = spark.sparkContext.broadcast(pivots)

    def cell(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(held) and len(asked):
            y = vectors.matrix(asked.column("v"), np.float64)
            facts = [asked.column(c).to_numpy() for c in ("id", "turn", "times")]
            f = _files(held, 0)
            for i, at, score in f.search(y, facts[0], shared.value.get(y.shape[1]), k, share, least):
                out.append((*(np.full(len(at), c[i]) for c in facts), f.ids[at], score))
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
        cols = [np.concatenate([x[j] for x in out]) if out else np.zeros(0, t) for j, t in enumerate(kinds)]
        return pa.table(cols, ["query_id", "turn", "times", "vec_id", "score"])

    cells = index.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blks - 1)))).groupBy("seg", "blk")
    return vectors.ranked(cells.cogroup(asked.groupBy("at", "blk")).applyInArrow(cell, SCHEMA), k)


def prepared(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    rows = vectors.clean(table, id_col, vec_col)
    return rows.where(F.exists("v", lambda x: x != 0))


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "ann-rows")
    pivots = fit(rows)
    index = materialize(index_table(vectors.first_copies(rows, K), pivots), "ann-index")
    queries = materialize(vectors.asked(rows, F.col("id") % EVERY == 0), "ann-queries")
    return search(index, queries, pivots, queries.count())
