"""Exact top-k search by columnar branch-and-bound.

Vectors become integers, floor(scale * x). A segment of rows is laid out by dimension; a block of queries adds
up inner products one dimension block after the other, and after each block a row stays only if what it has
plus the most it can still get (the product of the norms of what is left) reaches the k-th best of what rows
have at least. Survivors are compacted, and the last ones' sums are complete, so the result is exact.

Each cell of (segment, query block) returns k rows a query; the cells' best are ranked in a second step.

Segments whose sums stay under 2^52 are added in doubles, under 2^62 in longs, both exact. Rows and queries of
larger components are searched apart: doubles with a bound on their error choose, Python's integers decide.

Defined results: null, empty, partly null or non-finite vectors, and null ids, take no part; rows of one id are rows
of their own, and equal rows ask and are found each; vectors of different lengths never meet; ties go to smaller
ids; an empty table gives no rows; further columns are ignored. A score that no long holds is given as the nearest
long, and ranked by its true value.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import vectors
from quern.session import materialize

SCALE, K, EVERY = 64, 20, 20
SEGMENT, BLOCK = 16_384, 8_192
DIMS, BATCH = 16, 64
LONG = 2**63 - 1
#: beyond orders scores that no long holds; it is empty for all others.
SCHEMA = "query_id long, turn long, times long, vec_id long, score long, beyond string"


def bounded_top(rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int):
    """Yields (query's place, rows' places, scores) of each query's k best rows other than itself. Sums fit 62 bits."""
    n, d = rows.shape
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(asked).max(initial=0)) * d
    kind = np.float64 if most < 2.0**52 else np.int64  # both exact
    upright = np.ascontiguousarray(rows.T.astype(kind))
    starts = list(range(0, d, DIMS)) + [d]
    # norms of what is left from each block's start on
    squares = np.add.reduceat(rows.astype(np.float64) ** 2, starts[:-1], axis=1)
    left = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
    for low in range(0, len(asked), BATCH):
        q = asked[low : low + BATCH]
        q_kind = q.astype(kind)
        q_squares = np.add.reduceat(q.astype(np.float64) ** 2, starts[:-1], axis=1)
        q_left = np.sqrt(np.cumsum(q_squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
        own = [vectors.own_row(ids, rows, int(i), v) for i, v in zip(asked_ids[low : low + BATCH], q)]
        have = np.zeros((len(q), n), kind)
        live: list[np.ndarray] | None = None  # each query's survivors, once compacted
        kept: list[np.ndarray] = []
        for b in range(len(starts) - 1):
            dims = slice(starts[b], starts[b + 1])
            if live is None:
                have += q_kind[:, dims] @ upright[dims]
            else:
                kept = [h + q_kind[i, dims] @ upright[dims, :][:, at] for i, (h, at) in enumerate(zip(kept, live))]
            if b + 2 == len(starts):
                break
            now, sums = [], []
            for i in range(len(q)):
                at = live[i] if live is not None else np.arange(n)
                h = kept[i] if live is not None else have[i]
                slack = left[at, b + 1] * q_left[i, b + 1] + 1e-6 + most * 2.0**-50
                least = h - slack
                j = np.searchsorted(at, own[i])
                if own[i] >= 0 and j < len(at) and at[j] == own[i]:
                    least[j] = -np.inf
                if len(at) <= k + 1:
                    now.append(at), sums.append(h)
                    continue
                edge = np.partition(least, len(at) - k)[len(at) - k]
                alive = h + slack >= edge
                now.append(at[alive]), sums.append(h[alive])
            if live is not None or sum(map(len, now)) < 0.4 * n * len(q):
                live, kept = now, sums
        for i in range(len(q)):
            at = live[i] if live is not None else np.arange(n)
            h = kept[i] if live is not None else have[i]
            other = at != own[i]
            at, h = at[other], h[other].astype(np.int64)
            top = vectors.best(h, ids[at], k)
            yield low + i, at[top], h[top]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers; from 2^53 on doubles are whole, so nothing overflows."""
    whole = lambda c: int(c) * scale if abs(c) >= 2.0**53 else math.floor(c * scale)
    return np.array([[whole(c) for c in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def wide_top(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int, scale: int):
    """As bounded_top, from original vectors of any finite components; scores are Python's integers."""
    size = max(float(np.abs(x).max(initial=0)), 2.0**-40)
    near = x / size  # no product overflows
    norm = np.sqrt((near * near).sum(1)) + scale**-1 / size * math.sqrt(x.shape[1])
    for i, q in enumerate(asked):
        q_size = max(float(np.abs(q).max(initial=0)), 2.0**-40)
        q_near = q / q_size
        q_norm = math.sqrt(float(q_near @ q_near)) + scale**-1 / q_size * math.sqrt(len(q))
        # rounding in the sum, and floors, which move a component by less than 1 / scale
        slack = norm * q_norm * (4 * len(q) * 2.0**-52) + math.sqrt(len(q)) / scale * (q_norm / size + norm / q_size)
        sums, own = near @ q_near, vectors.own_row(ids, x, int(asked_ids[i]), q)
        least = sums - slack
        if own >= 0:
            least[own] = -np.inf
        edge = np.partition(least, max(0, len(x) - k))[max(0, len(x) - k)] if len(x) else 0.0
        at = np.flatnonzero(sums + slack >= edge)
        at = at[at != own]
        exact = integers(x[at], scale) @ integers(q[None], scale)[0] if len(at) else np.zeros(0, object)
        top = sorted(range(len(at)), key=lambda j: (-exact[j], ids[at[j]]))[:k]
        yield i, at[top], [int(exact[j]) for j in top]


def beyond(score: int) -> str:
    """Empty within a long's ends; else text whose order is the scores'."""
    if -LONG - 1 < score < LONG:
        return "" if score >= 0 else "~"
    digits = f"{abs(score):d}"
    text = f"{len(digits):05d}{digits}"
    return text if score > 0 else text.translate(str.maketrans("0123456789", "9876543210")) + "~"


def _cell(k: int, scale: int):
    def run(cell: pa.Table) -> pa.Table:
        rows, asked = vectors.split(cell)
        parts: list[list[np.ndarray]] = []
        if len(rows) and len(asked):
            x, y = (vectors.matrix(t.column("v"), np.float64) for t in (rows, asked))
            ids, asked_ids, turn, times = rows.column("id").to_numpy(), *(asked.column(c).to_numpy() for c in ("id", "turn", "times"))
            # sums of components under this fit 62 bits
            least = math.sqrt(2.0**62 / x.shape[1]) / scale - 1
            large, q_large = np.abs(x).max(1) >= least, np.abs(y).max(1) >= least
            for r, q in ((~large, ~q_large), (large, ~q_large), (~large, q_large), (large, q_large)):
                r, q = np.flatnonzero(r), np.flatnonzero(q)
                if not len(r) or not len(q):
                    continue
                if large[r[0]] or q_large[q[0]]:
                    found = wide_top(x[r], ids[r], y[q], asked_ids[q], k, scale)
                else:
                    whole = [np.floor(v * scale).astype(np.int64) for v in (x[r], y[q])]
                    found = bounded_top(whole[0], ids[r], whole[1], asked_ids[q], k)
                for i, at, score in found:
                    score = [int(s) for s in score]
                    held = np.array([max(-LONG - 1, min(LONG, s)) for s in score], np.int64)
                    same = lambda v: np.full(len(at), v[q[i]])  # noqa: B023, E731
                    parts.append([same(asked_ids), same(turn), same(times), ids[r[at]], held, np.array([beyond(s) for s in score], object)])
        kinds = [pa.int64()] * 5 + [pa.string()]
        cols = [pa.array(np.concatenate([p[j] for p in parts]) if parts else [], kind) for j, kind in enumerate(kinds)]
        return pa.table(cols, ["query_id", "turn", "times", "vec_id", "score", "beyond"])

    return run


def exact_search(rows: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """rows: id long, v array<double>; queries: vectors.asked(). query_id, rank, vec_id, score of each query's k best other rows."""
    rows = materialize(vectors.first_copies(rows, k), "exact-rows")
    queries = materialize(queries, "exact-queries")
    cells = vectors.deal(rows, queries, rows.count(), queries.count(), segment, block)
    found = cells.groupBy("seg", "blk", "dim").applyInArrow(_cell(k, scale), SCHEMA)
    return vectors.ranked(found, k, F.col("beyond").desc())


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return exact_search(rows, vectors.asked(rows, F.col("id") % EVERY == 0))


SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.place <> c.place AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
