"""Whitening by a compensated covariance.

Two passes fit it. The first adds up the columns, in double-double, so that sums of whole numbers are exact. The
second centres each row by the double-double mean before it multiplies, and adds up the outer products in
double-double by error-free transformations (compensated.py). A task keeps one matrix of high and one of low parts;
tasks' matrices are merged by blocks of their rows, MERGE at a time, high and low parts together, so no task gets
more than a few of them. The driver gets the merged matrix, whose size is the dimension's square, and solves it: it is
made tridiagonal and solved by divide and conquer (LAPACK's syevd, which numpy's eigh calls), and one step of
refinement in extended precision takes out what rounding the matrix to doubles cost.

whiten() then projects each centred row on the leading components and divides by their deviations.

Defined results: null, empty, partly null or non-finite vectors take no part; null ids and repeated rows are rows like
others; vectors of each length are fitted apart; components without variance (as with a single row) are given with
null coordinates; an empty table gives no rows; further columns are ignored, whatever their names. For the query, an
entry's whole number is held within 2^52 either way, and a deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import compensated
from quern.llm.memory import bound_batches
from quern.session import discard, materialize

COMPONENTS = 8
SCALE, SHIFT = 1_024, 100_000
#: Tasks' matrices merged by one task, and rows of a matrix in a block.
MERGE, BLOCK = 64, 64
#: An eigenvalue under so many units of the largest one's last place is no variance.
NOISE = 64
LONG = 2**63 - 1


def matrices(column: pa.Array, change: Callable = lambda x: x) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix (doubles) of the rows that take part, one pair for each length of vector."""
    if not len(column):
        return
    sizes = np.where(np.asarray(column.is_null()), 0, np.diff(column.offsets.to_numpy()))
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become nan
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], change(x[good])


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) + SHIFT, as doubles that are whole."""
    return np.clip(np.floor(x * SCALE) + SHIFT, -(2.0**52), 2.0**52)


@dataclass(frozen=True)
class Moments:
    """Rows, and the columns' sums and means as double-doubles."""

    n: int
    sums: tuple[np.ndarray, np.ndarray]
    mean: tuple[np.ndarray, np.ndarray]

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = compensated.two_sum(x, -self.mean[0])
        return compensated.fast_two_sum(high, low - self.mean[1])


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    covariance: tuple[np.ndarray, np.ndarray]
    #: Falling eigenvalues, and unit eigenvectors as columns.
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    #: How many eigenvalues are more than rounding.
    rank: int

    def coordinates(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened coordinates on the first k components; nan where there is no variance."""
        k = min(k, len(self.values))
        scale = np.where(np.arange(k) < self.rank, np.sqrt(np.maximum(self.values[:k], 0)), np.nan)
        return (self.moments.centred(x)[0] @ self.vectors[:, :k]) / scale


NAMES = ["dim", "block", "n", "high", "low"]
SCHEMA = "dim int, block int, n long, high array<double>, low array<double>"


def _part(dim: int, block: int, n: int, high: np.ndarray, low: np.ndarray) -> list[pa.Array]:
    flat = [pa.array([m.ravel().tolist()], pa.list_(pa.float64())) for m in (high, low)]
    return [pa.array([dim], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), *flat]


def _merge(t: pa.Table) -> pa.Table:
    """Rows of one dim and block in one: n added, and high and low parts added as double-doubles."""
    high, low = np.zeros(1), np.zeros(1)
    for parts in sorted(zip(*(t.column(c).to_pylist() for c in ("high", "low")))):  # an order that reruns keep
        high, low = compensated.add(high, low, *map(np.array, parts))
    own = _part(t.column("dim")[0].as_py(), t.column("block")[0].as_py(), sum(t.column("n").to_pylist()), high, low)
    return pa.Table.from_arrays(own, NAMES)


def _merged(tasks: DataFrame) -> list:
    """A row each dim and block of the tasks' rows, merged MERGE at a time until one is left."""
    parts = materialize(tasks, "whitening-parts")
    most = parts.groupBy("dim", "block").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = -(-most // MERGE)
        salt = F.pmod(F.xxhash64("high", "low"), F.lit(groups)).alias("salt")
        before, parts = parts, materialize(parts.groupBy("dim", "block", salt).applyInArrow(_merge, SCHEMA), "whitening-parts")
        discard(before)
        most = groups if groups > 1 else 1
    return sorted(parts.collect(), key=lambda r: (r.dim, r.block))


def _moments(rows: DataFrame, change: Callable) -> dict[int, Moments]:
    """By length of vector. Each task gives one row a length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for b in batches:
            for _, x in matrices(b.column(0), change):
                held = own.setdefault(x.shape[1], [compensated.Sums(x.shape[1]), 0])
                held[0].add(x)
                held[1] += len(x)
        for dim, (s, n) in own.items():
            yield pa.RecordBatch.from_arrays(_part(dim, 0, n, s.high, s.low), NAMES)

    out = {}
    for r in _merged(rows.mapInArrow(work, SCHEMA)):
        sums = np.array(r.high), np.array(r.low)
        out[r.dim] = Moments(r.n, sums, compensated.quotient(*sums, r.n))
    return out


def _covariances(rows: DataFrame, change: Callable, moments: dict[int, Moments]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector, divisor n, as double-double."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, compensated.Products] = {}
        for b in batches:
            for _, x in matrices(b.column(0), change):
                own.setdefault(x.shape[1], compensated.Products(x.shape[1])).add(*moments[x.shape[1]].centred(x))
        for dim, p in own.items():
            for i, first in enumerate(range(0, dim, BLOCK)):
                rows = slice(first, first + BLOCK)
                yield pa.RecordBatch.from_arrays(_part(dim, i, 0, p.high[rows], p.low[rows]), NAMES)

    parts: dict[int, list] = {}
    for r in _merged(rows.mapInArrow(work, SCHEMA)):
        parts.setdefault(r.dim, []).append((np.array(r.high), np.array(r.low)))
    whole = {d: [np.concatenate([p[i] for p in own]).reshape(d, d) for i in (0, 1)] for d, own in parts.items()}
    return {d: compensated.quotient(*m, moments[d].n) for d, m in whole.items()}


def solve(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Falling eigenvalues, unit eigenvectors as columns, and the rank.

    Divide and conquer on the tridiagonal form, then one step of refinement: with X the found vectors and R = I - X'X,
    the entries (X'AX + value_j R) / (value_j - value_i) rotate X's columns onto the true ones.
    """
    values, found = np.linalg.eigh((high + high.T) / 2)
    values, found = values[::-1], found[:, ::-1]
    rank = int((values > NOISE * len(values) * np.finfo(float).eps * max(values[0], 0)).sum())
    wide = np.longdouble
    a, x = high.astype(wide) + low.astype(wide), found.astype(wide)
    a = (a + a.T) / 2
    rest, form = np.eye(len(a), dtype=wide) - x.T @ x, x.T @ a @ x
    exact = np.diag(form) / (1 - np.diag(rest))
    gap = exact[None, :] - exact[:, None]
    near = np.abs(gap) <= 1e-12 * np.abs(exact).max()  # equal values: any basis of theirs will do
    turn = np.where(near, rest / 2, (form + exact[None, :] * rest) / np.where(near, 1, gap))
    x = x + x @ turn
    x /= np.sqrt((x * x).sum(axis=0))
    return exact.astype(float), x.astype(float), rank


def fit(rows: DataFrame, column: str, change: Callable = lambda x: x) -> dict[int, Whitening]:
    """A whitening for each length of vector. change: applied to each matrix of rows before anything else."""
    rows = rows.select(F.col(f"`{column}`"))
    bound_batches(rows.sparkSession)
    moments = _moments(rows, change)
    out = {}
    for dim, (high, low) in (_covariances(rows, change, moments) if moments else {}).items():
        values, found, rank = solve(high, low)
        trace = compensated.Sums(1)
        trace.add(np.concatenate([np.diag(high), np.diag(low)])[:, None])
        total = float(trace.high[0])
        out[dim] = Whitening(moments[dim], (high, low), values, found, values / total if total > 0 else np.zeros(dim), rank)
    return out


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of rows of whole numbers, exactly; None beyond a long."""
    sums = [int(h) + int(lo) for h, lo in zip(*m.sums)]
    near = (m.centred(x)[0] ** 2).sum(axis=1) * float(m.n) ** 2
    out: list[int | None] = [None] * len(x)
    small = near < 0.9 * LONG
    if m.n * (np.abs(x).max(initial=0) + 1) < 2.0**62 and max(map(abs, sums)) < 2**62:
        d = x[small].astype(np.int64) * m.n - np.array(sums)
        for i, v in zip(np.flatnonzero(small), (d * d).sum(axis=1).tolist()):
            out[i] = v
        small = ~small
    else:
        small = np.ones(len(x), bool)
    for i in np.flatnonzero(small & (near < 1.1 * LONG)):
        v = sum((m.n * int(c) - s) ** 2 for c, s in zip(x[i], sums))
        out[i] = v if v <= LONG else None
    return out


def whiten(
    rows: DataFrame, id_col: str, vec_col: str, fits: dict[int, Whitening], k: int = COMPONENTS, change: Callable = lambda x: x, exact: bool = False
) -> DataFrame:
    """id, dim, w (the first k whitened coordinates, null without variance) of the rows that take part.

    exact: also deviation, for rows that change makes whole numbers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in matrices(b.column(1), change):
                own = fits[x.shape[1]]
                w = own.coordinates(x, k)
                flat = pa.array(w.ravel(), from_pandas=True)  # nan is null
                cols = [b.column(0).take(pa.array(at)), pa.array(np.full(len(x), x.shape[1], np.int32))]
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), flat))
                if exact:
                    cols.append(pa.array(deviations(x, own.moments), pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "dim", "w", *(["deviation"] if exact else [])])

    schema = "id long, dim int, w array<double>" + ", deviation long" * exact
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    bound_batches(rows.sparkSession)
    return own.mapInArrow(work, schema)


def identity_errors(whitened: DataFrame, fits: dict[int, Whitening], k: int) -> dict[int, float]:
    """By length, the largest absolute entry of the coordinates' covariance less the identity, where there is variance."""
    out = {}
    for dim, own in fits.items():
        m = min(k, dim, own.rank)
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        if pairs:
            at = lambda i: F.get("w", F.lit(i))
            r = whitened.where(F.col("dim") == dim).agg(*[F.covar_pop(at(i), at(j)) for i, j in pairs]).first()
            out[dim] = max(abs(c - (i == j)) for c, (i, j) in zip(r, pairs))
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    fits = fit(rows, "embedding", whole)
    whitened = materialize(whiten(rows, "vec_id", "embedding", fits, COMPONENTS, whole, exact=True), "whitened")
    errors = identity_errors(whitened, fits, COMPONENTS)
    facts = [
        (dim, int(f.moments.n), errors.get(dim), [float(e) for e in f.explained[:COMPONENTS]]) for dim, f in fits.items()
    ]
    facts = spark.createDataFrame(facts, "dim int, n long, identity_error double, shares array<double>")
    out = whitened.join(F.broadcast(facts), "dim")  # a row a length of vector
    out = out.select("*", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("shares", "at").alias("explained"), "identity_error",
    )
