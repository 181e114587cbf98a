"""A quality classifier on random-indexing word vectors.

Every token owns a fixed sparse index vector drawn from its hash: NONZERO of DIM places hold +1 or -1. A token's
word vector is the sum of the index vectors found within WINDOW tokens of it, itself included, over all documents.
Tokens share BUCKETS hashed rows, so the table's size doesn't grow with the corpus. A document is pooled: mean and
spread of its tokens' unit word vectors, rarer tokens weighing more, with the log of its length. A two-layer network
in numpy, fitted to a bounded sample of labelled documents, gives a logit, and a temperature fitted on a part of the
sample that the network didn't see turns it into a probability.

The sample: at most PER_CLASS documents of each label, by the smallest hash of the id. All else covers every text.

Defined results: null and empty texts have the all-zero feature vector and get the score that the network gives it;
without labels of both kinds all scores are 0.5; repeated rows score alike; where labels repeat an id the larger
label counts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.toxicity import fold
from quern.session import materialize

BUCKETS, DIM, NONZERO, WINDOW = 16_384, 32, 4, 2
COMMON = 1e-3
#: Tokens whose pairs are made at a time.
CHUNK = 500_000
PER_CLASS, HIDDEN, ROUNDS, RATE, DECAY = 4_000, 24, 400, 0.02, 1e-3
THRESHOLD, FOLDS, HELD = 0.7, 4, 2
_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")


class _Buckets(dict):
    """Token to bucket, remembered within a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = b = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


_buckets = _Buckets()


def token_buckets(text: str) -> np.ndarray:
    tokens = _TOKEN.findall(text)
    return np.fromiter(map(_buckets.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_sums(docs: DataFrame) -> DataFrame:
    """bucket, n, c0 ... of the whole corpus. Each task adds up its own dense table, and Spark adds up the tasks'."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        dense = np.zeros((BUCKETS, DIM))
        for row in range(NONZERO):
            np.add.at(dense, (np.arange(BUCKETS), places[:, row]), signs[:, row])
        count, sums = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIM))
        pairs: list[np.ndarray] = []
        held = 0

        def add() -> None:
            nonlocal held
            if pairs:
                both, n = np.unique(np.concatenate(pairs), return_counts=True)
                left, right = both // BUCKETS, both % BUCKETS
                for low in range(0, len(both), 65_536):
                    s = slice(low, low + 65_536)
                    starts = np.flatnonzero(np.r_[True, left[s][1:] != left[s][:-1]])
                    sums[left[s][starts]] += np.add.reduceat(dense[right[s]] * n[s, None], starts, axis=0)
            pairs.clear()
            held = 0

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                whole = token_buckets(text)
                count += np.bincount(whole, minlength=BUCKETS)
                for low in range(0, len(whole), CHUNK):  # a long text in parts that overlap by a window
                    t = whole[low : low + CHUNK + WINDOW]
                    for gap in range(1, WINDOW + 1):
                        a, b_ = t[:CHUNK][: max(0, len(t) - gap)], t[gap : CHUNK + gap]
                        pairs += [a * BUCKETS + b_, b_ * BUCKETS + a]
                    held += 2 * WINDOW * len(t)
                    if held > 4_000_000:
                        add()
        add()
        sums += count[:, None] * dense
        used = np.flatnonzero(count)
        cols = [pa.array(used), pa.array(count[used]), *[pa.array(sums[used, j]) for j in range(DIM)]]
        yield pa.RecordBatch.from_arrays(cols, ["bucket", "n", *[f"c{j}" for j in range(DIM)]])

    names = [f"c{j}" for j in range(DIM)]
    own = docs.select("text").mapInArrow(work, "bucket long, n long, " + ", ".join(f"{c} double" for c in names))
    return own.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors and pooling weights of all buckets; at most BUCKETS rows come to the driver."""
    table, count = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for r in context_sums(docs).collect():
        table[r.bucket], count[r.bucket] = r[2:], r.n
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    share = count / max(1.0, count.sum())
    return (table / np.maximum(norm, 1e-12)).astype(np.float32), (COMMON / (COMMON + share)).astype(np.float32)


def pooled(text: str | None, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros(2 * DIM + 1, np.float32)
    if text and len(t := token_buckets(text)):
        used, n = np.unique(t, return_counts=True)
        w = weight[used] * n
        w = w / w.sum()
        rows = table[used]
        mean = w @ rows
        out[:DIM] = mean
        out[DIM : 2 * DIM] = np.sqrt(np.maximum(0, w @ rows**2 - mean**2))
        out[-1] = np.log1p(len(t)) / 10
    return out


def features(docs: DataFrame, table: np.ndarray, weight: np.ndarray) -> DataFrame:
    """doc_id, x of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((table, weight))  # BUCKETS x DIM floats

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        for b in batches:
            if b.num_rows:
                x = np.stack([pooled(t, own, w) for t in b.column(1).to_pylist()])
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, x array<float>")


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, prior: float | None = None) -> Network | None:
    """Adam on the cross-entropy of four fifths of the rows, the temperature on the last fifth.

    prior: the share of label 1 where the rows were drawn from, to which both are weighted.
    """
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return None
    prior = y.mean() if prior is None else prior
    weigh = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    late, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for r in range(1, ROUNDS + 1):
        h = np.tanh(z[own] @ p[0] + p[1])
        s = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40)))
        d = (s - y[own]) * weigh[own] / weigh[own].sum()
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [z[own].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-8)
    net = Network(mean, scale, (p[0], p[1], p[2], float(p[3][0])), 1.0)
    logit = net.logits(x[late])

    def loss(t: float) -> float:
        return float((weigh[late] * np.logaddexp(0, np.where(y[late] == 1, -logit, logit) / t)).sum())

    best = min(np.geomspace(0.25, 8, 61), key=loss)
    return Network(net.mean, net.scale, net.layers, float(best))


def train(rows: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> Network | None:
    """rows: doc_id, x. Learns from the labels outside the held fold."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    own = own.where(F.col("_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("_id").agg(F.max("label").alias("label"))
    own = own.where(fold(F.col("_id"), folds) != held)
    share = own.agg(F.avg("label")).first()[0]
    parts = [own.where(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(PER_CLASS) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * PER_CLASS rows of two numbers
    found = rows.join(chosen, F.col("doc_id") == F.col("_id")).select("_id", "label", "x").collect()
    found = sorted({(r._id, r.label, tuple(r.x)) for r in found})
    if not found:
        return None
    return fit(np.array([r[2] for r in found], dtype=np.float64), np.array([r[1] for r in found]), share)


def scored(rows: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score from doc_id, x."""
    if net is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.scores(x.astype(np.float64)))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(work, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = materialize(features(docs, *word_vectors(docs)), "quality")
    out = scored(rows, train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
