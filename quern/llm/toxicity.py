"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only documents have labels. A sentence's chance p of being toxic is a
logistic function of its words and of their first letters, which inflected forms share; a document's score is the noisy-or 1 - product(1 - p). The word weights are fitted
to document labels through that noisy-or, so the sentences that explain a label earn it, and afterwards
offending() names the sentences whose own p is high.

Chances add up along a text, so what clean sentences get decides how long a clean text may be. Only words and stems
at least ODDS times as frequent among toxic as among clean documents are weighted, so ordinary words have none, and
the fitted log-odds are multiplied by SHARP, which moves no sentence across p = 0.5: a sentence without a weighted
word has p under 1.4e-6, and 490,000 of them score under 0.5.

Fitting takes a bounded sample of labelled documents, long ones whole: at most PER_CLASS of each label, by the
smallest hash of the id, with PER_CLASS * TRAIN_CHARS characters a label; a text that no longer fits is passed
over. Scoring reads every whole text.

Defined results: null and empty texts have no sentence and score 0; a null or unlabelled id is scored like any
other; without labels of both kinds no word has a weight and all scores are near 0; repeated rows score alike;
where labels repeat an id the larger label counts; an empty table gives no rows; further columns are kept, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.columns import fresh, named
from quern.llm.memory import bound_batches, hand_back, tidy
from quern.session import materialize

PER_CLASS, TRAIN_CHARS = 2_000, 30_000
#: A word is known by itself and by its first so many letters.
STEMS = (4, 5, 6, 8)
#: A word or stem is learned if it is in so many of the sample's documents.
LEAST_DOCS = 3
ODDS, SHARP = 3, 1.5
ROUNDS, RATE, SPARSE, BIAS = 200, 0.15, 2e-3, -9.0
THRESHOLD, FOLDS, HELD = 0.5, 5, 0
_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def parts_of(word: str) -> list[str]:
    """The word, and its stems marked with a hyphen, which no word holds."""
    return [word, *[word[:k] + "-" for k in STEMS if len(word) > k]]


def sentences(text: str) -> tuple[list[list[str]], list[tuple[int, int]]]:
    """Words and character range of every sentence that has a word."""
    words, spans, own, first, last = [], [], [], 0, 0
    for m in _TOKEN.finditer(text):
        if m[0] in _STOPS:
            if own:
                words.append(own), spans.append((first, m.end()))
            own = []
        else:
            first = m.start() if not own else first
            own.append(m[0].lower())
            last = m.end()
    if own:
        words.append(own), spans.append((first, last))
    return words, spans


def features(text: str) -> set[str]:
    """The text's words and stems."""
    return {x for w in set(_TOKEN.findall(text.lower())) - _STOPS for x in parts_of(w)}


class _Known(dict):
    """Word to the numbers of its parts that can have a weight; None for what ends a sentence."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab
        self.update(dict.fromkeys(_STOPS))

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 400_000:
            self.clear()
            self.update(dict.fromkeys(_STOPS))
        self[word] = own = [self.vocab[x] for x in parts_of(word) if x in self.vocab]
        return own


def bag(text: str, known: _Known) -> tuple[int, list[int], list[int]]:
    """How many sentences have no such part; of the others how many parts each has, and all their parts."""
    plain, sizes, parts, held, any_word = 0, [], [], 0, False
    for own in [*map(known.__getitem__, _TOKEN.findall(text.lower())), None]:
        if own is not None:
            any_word = True
            if own:
                parts += own
                held += len(own)
        elif any_word:
            if held:
                sizes.append(held)
            else:
                plain += 1
            held, any_word = 0, False
    return plain, sizes, parts


def chosen(seen: tuple[dict[str, int], dict[str, int]], clean: int, toxic: int) -> dict[str, int]:
    """Numbers of the parts that can have a weight. seen: by label, in how many texts a part is."""
    clean, toxic = max(1, clean), max(1, toxic)
    own = sorted(x for x, n in seen[1].items() if n + seen[0].get(x, 0) >= LEAST_DOCS and n * clean >= ODDS * seen[0].get(x, 0) * toxic)
    return {x: i for i, x in enumerate(own)}


def fit_bags(bags: list[tuple[int, list[int], list[int]]], labels: list[int], vocab: dict[str, int]) -> Model:
    """Noisy-or maximum likelihood with an l1 penalty, by Adam with a proximal step, from zero weights.

    Sentences without a part are alike, so a text has only their number.
    """
    y = np.asarray(labels)
    if not vocab or len(set(labels)) < 2:
        return Model({}, SHARP * BIAS)
    plain = np.array([b[0] for b in bags], np.float64)
    doc_of = np.repeat(np.arange(len(y)), [len(b[1]) for b in bags])
    sent_of = np.repeat(np.arange(len(doc_of)), np.concatenate([np.asarray(b[1], np.int64) for b in bags]))
    word_of = np.concatenate([np.asarray(b[2], np.int64) for b in bags])
    theta, bias, n_sent = np.zeros(len(vocab)), BIAS, len(doc_of)
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    share = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum())) / 2  # the classes weigh alike
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for r in range(1, ROUNDS + 1):
        z = np.bincount(sent_of, theta[word_of], n_sent) + bias
        # -log of the chance that no sentence is toxic
        mass = np.bincount(doc_of, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, bias)
        pull = np.where(y == 1, -1 / np.expm1(np.clip(mass, 1e-9, 50)), 1.0) * share
        g_z = np.clip(pull[doc_of] * chance(z), -1, 1)
        g_plain = (np.clip(pull * chance(bias), -1, 1) * plain).sum()
        grad = np.append(np.bincount(word_of, g_z[sent_of], len(vocab)), g_z.sum() + g_plain)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        theta = theta - step[:-1]
        theta = np.sign(theta) * np.maximum(0, np.abs(theta) - RATE * SPARSE / (np.sqrt(v[:-1] / (1 - 0.99**r)) + 1e-3))
        bias = min(BIAS, bias - step[-1])
    return Model({w: SHARP * float(theta[i]) for w, i in vocab.items() if abs(theta[i]) > 1e-3}, SHARP * float(bias))


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from texts on one machine; train() does the same with the texts where they are."""
    seen = (Counter(), Counter())
    for t, label in zip(texts, labels):
        seen[label].update(features(t))
    vocab = chosen(seen, labels.count(0), labels.count(1))
    known = _Known(vocab)
    return fit_bags([bag(t, known) for t in texts], labels, vocab)


class _Weights(dict):
    """A word's weight with its stems', remembered within a bound; nan for what ends a sentence."""

    def __init__(self, weights: dict[str, float]):
        self.fixed = weights
        self.update(dict.fromkeys(_STOPS, float("nan")))

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
            self.update(dict.fromkeys(_STOPS, float("nan")))
        get = self.fixed.get
        self[word] = total = sum(get(x, 0.0) for x in parts_of(word))
        return total


def sentence_masses(text: str, weights: _Weights, bias: float) -> np.ndarray:
    """log(1 + e^z) of every sentence that has a word."""
    tokens = _TOKEN.findall(text.lower())
    if not tokens:
        return np.zeros(0)
    value = np.fromiter(map(weights.__getitem__, tokens), np.float64, len(tokens))
    ends = np.isnan(value)
    place = np.cumsum(ends)[~ends]
    if not len(place):
        return np.zeros(0)
    total = np.bincount(place, value[~ends])
    return np.logaddexp(0, total[np.bincount(place) > 0] + bias)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with one more column at the end, the noisy-or of its sentences, under a name that docs doesn't have (see fresh)."""
    fixed, bias = model.weights, model.bias
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _Weights(fixed)
        for texts in parts:
            yield pd.Series([-np.expm1(-sentence_masses(t, weights, bias).sum()) if t else 0.0 for t in texts], dtype="float64")
        weights.clear()
        hand_back()

    return docs.select(*[named(c) for c in docs.columns], score(F.col("text")).alias(fresh(column, docs.columns)))


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence, first, last, score, text of every sentence whose own chance is at least least."""
    fixed, bias = model.weights, model.bias

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, weights = [], _Weights(fixed)
            for i, text in enumerate(b.column(1).to_pylist()):
                words, spans = sentences(text or "")
                for j, (own, (first, last)) in enumerate(zip(words, spans)):
                    p = 1 / (1 + np.exp(-(bias + sum(weights[w] for w in own))))
                    if p >= least:
                        rows.append((i, j, first, last, float(p), text[first:last]))
            at, *cols = zip(*rows) if rows else [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            arrays = [b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sentence", "first", "last", "score", "text"])

    schema = "doc_id long, sentence int, first long, last long, score double, text string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, chars: int) -> DataFrame:
    """text, label of the bounded training sample: at most per_class ids and per_class * chars characters a label."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("_id").agg(F.max("label").alias("label"))
    rows = rows.where(allowed)
    one = [rows.where(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(one[0].unionByName(one[1]))  # at most 2 * per_class rows of two numbers
    own = docs.select(F.col("doc_id").alias("_did"), "text").where(F.col("text").isNotNull())
    own = own.join(chosen, F.col("_did") == F.col("_id"))
    sizes = own.groupBy("_id", "label", F.xxhash64("_id").alias("at")).agg(F.sum(F.length("text")).alias("n")).collect()
    left, kept = [per_class * chars] * 2, []
    for r in sorted(sizes, key=lambda r: (r["at"], r["_id"])):
        if r.n <= left[r.label]:
            left[r.label] -= r.n
            kept.append(r["_id"])
    if len(kept) < len(sizes):
        own = own.where(F.col("_id").isin(kept))
    return own.select("_did", "text", "label")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, clean, toxic: in how many of the task's texts of each label a part is."""
    seen = (Counter(), Counter())
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            seen[label].update(features(text))
    own = sorted(seen[0].keys() | seen[1].keys())
    for low in range(0, len(own), 50_000):
        part = own[low : low + 50_000]
        counts = [pa.array([s.get(x, 0) for x in part], pa.int64()) for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], ["part", "clean", "toxic"])


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> Model:
    """A model from the labels outside the held fold; none of id, source, language or label enters a score.

    Executors read the sample's texts; the driver gets the parts that can have a weight, and of each text a count
    and the numbers of those parts.
    """
    bound_batches(docs.sparkSession)
    rows = sample(docs, labels, "toxic", fold(F.col("_id"), folds) != held, PER_CLASS, TRAIN_CHARS)
    rows = materialize(rows.dropDuplicates(["_did", "text"]), "toxic-sample")
    size = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(size) < 2:
        return Model({}, SHARP * BIAS)
    parts = rows.select("text", "label").mapInArrow(tidy(_seen), "part string, clean long, toxic long")
    parts = parts.groupBy("part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    parts = parts.where((F.col("clean") + F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * size[0] >= F.col("clean") * (ODDS * size[1])))
    found = parts.where("toxic > 0").toArrow()
    vocab = {x: i for i, x in enumerate(sorted(found.column("part").to_pylist()))}
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for b in batches:
            own = [bag(t, known) for t in b.column("text").to_pylist()]
            ints = pa.list_(pa.int32())
            cols = [b.column("_did"), b.column("label"), pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], ints), pa.array([x[2] for x in own], ints)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "label", "plain", "sizes", "parts"])

    kept = rows.select(F.col("_did").cast("long").alias("_did"), "label", "text")
    bags = kept.mapInArrow(tidy(work), "id long, label int, plain long, sizes array<int>, parts array<int>").toArrow()
    bags = bags.take(pa.array(np.lexsort((bags.column("plain").to_numpy(), bags.column("id").to_numpy()))))
    lists = [c.to_numpy(zero_copy_only=False) if len(bags) else [] for c in (bags.column("sizes").combine_chunks(), bags.column("parts").combine_chunks())]
    return fit_bags(list(zip(bags.column("plain").to_pylist(), *lists)), bags.column("label").to_pylist(), vocab)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
