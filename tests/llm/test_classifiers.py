from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, query, column, mod, rest):
    r = query(spark, SF).toPandas()
    assert len(r) == 10_000 and r.score.between(0, 1).all()
    assert (r.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in r.doc_id]).all()
    m = r.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    return m.predicted.to_numpy(), m[column].to_numpy()


def test_toxicity_held_out(spark):
    got, want = held_out(spark, toxicity.op2_toxicity, "toxic", 5, 0)
    assert (got == want).mean() > 0.96 and got[want == 1].mean() > 0.85 and got[want == 0].mean() < 0.02


def test_quality_held_out(spark):
    got, want = held_out(spark, quality.op8_quality, "quality", 4, 2)
    assert (got == want).mean() > 0.96 and got[want == 1].mean() > 0.96


def test_noisy_or_and_offending_sentences(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)]
    text = lambda bad: " ".join(" ".join(rng.choice(words, 6)) + (" grub" if bad and i == 2 else "") + "." for i in range(5))
    y = [i % 2 for i in range(300)]
    model = toxicity.fit([text(b) for b in y], y)
    frame = spark.createDataFrame([(1, text(1), 5), (2, text(0), 5), (3, "", 5), (4, None, 5), (5, "...\n!!", 5), (None, text(1), 5)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in toxicity.scored(frame, model).collect()}
    assert got[1]._score > 0.5 and got[None]._score > 0.5 and got[2]._score < 0.5 and got[3]._score == got[4]._score == got[5]._score == 0
    p = [1 / (1 + np.exp(-(model.bias + sum(toxicity._Weights(model.weights)[w] for w in s)))) for s in toxicity.sentences(got[1].text)[0]]
    assert got[1]._score == pytest.approx(1 - np.prod(1 - np.array(p)), abs=1e-9)
    marked = toxicity.offending(frame, model).collect()
    assert {(r.doc_id, r.sentence) for r in marked} == {(1, 2), (None, 2)}
    assert all("grub" in r.text and frame.where(F.col("doc_id").eqNullSafe(F.lit(r.doc_id))).first().text[r.first : r.last] == r.text for r in marked)


@pytest.mark.parametrize("case", ["no labels", "one label", "no documents"])
def test_odd_tables(spark, tmp_path, case):
    docs = [(i, None if i == 3 else "" if i == 4 else f"text number {i} !!", None, 1.0) for i in range(30)] + [(None, "x", "s", 1.0)]
    labels = {"no labels": [], "one label": [(i, 1, 1) for i in range(30)], "no documents": [(i, i % 2, i % 2) for i in range(30)]}[case]
    spark.createDataFrame(docs if case != "no documents" else [], "doc_id long, text string, source string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (toxicity.op2_toxicity, quality.op8_quality):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == (0 if case == "no documents" else 31)
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)


def test_network_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    chance = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(3000) < chance).astype(int)
    s = quality.fit(x[:2000], y[:2000]).scores(x[2000:])
    assert np.abs(s - chance[2000:]).mean() < 0.12


def test_clean_texts_of_10_000_sentences_are_not_toxic():
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    own = docs[~held]
    model = toxicity.fit(own.text.tolist(), own.toxic.tolist())
    weights = toxicity._Weights(model.weights)
    score = lambda t: -np.expm1(-toxicity.sentence_masses(t, weights, model.bias).sum())
    masses = lambda t: toxicity.sentence_masses(t, weights, model.bias)
    clean = [t for t in docs[held & (docs.toxic == 0)].text if masses(t).max(initial=0) < 0.1]  # without a suspect sentence
    joined = "\n".join(clean)
    assert len(toxicity.sentences(joined)[0]) > 10_000 and score(joined) < 0.1
    neutral = "Qzx qzy.\n" * 10_000
    assert score(neutral) < 0.05 and score(neutral * 40) < 0.5
    toxic = docs[held & (docs.toxic == 1)].text
    caught = next(t for t in toxic if score(t) >= 0.5)
    assert score(neutral + caught + "\n" + neutral) >= 0.5 and score(joined + "\n" + caught) >= 0.5


def test_long_labelled_documents_are_learned_from(spark):
    docs = spark.createDataFrame([(1, "a b. " * 20), (2, "c d"), (3, None), (4, "e " * 60), (5, "f"), (None, "g")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (None, 1)], "doc_id long, toxic int")
    ids = lambda chars: {r["_did"] for r in toxicity.sample(docs, labels, "toxic", F.lit(True), 10, chars).collect()}
    assert ids(30) == {1, 2, 4, 5}  # texts longer than 30, which a label's 300 characters hold
    assert ids(1) == {2, 5}  # a label's 10 characters pass the long texts over


def test_training_where_the_texts_are_is_training_on_one_machine(spark):
    """train() over several partitions gives fit()'s model."""
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        docs.append((i, ". ".join(" ".join(rng.choice(words, 5)) + (" grubling" if bad and k == 1 else "") for k in range(4))))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    own = [(t, y) for (i, t), (_, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5 != 0]
    want = toxicity.fit([t for t, _ in own], [y for _, y in own])
    assert set(model.weights) == set(want.weights) and model.weights["grubling"] > 1
    assert all(abs(model.weights[w] - want.weights[w]) < 1e-9 for w in want.weights) and abs(model.bias - want.bias) < 1e-9


def test_word_vectors_and_pooling_written_out(spark):
    """Each token's context one pair after the other, then means and spreads one word after the other."""
    import re

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "!!", "42", "é"], rng.integers(0, 40))) for _ in range(30)] + [None, "", "one"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    places, signs = quality.index_vectors()
    bucket = lambda w: zlib.crc32(w.encode()) % quality.BUCKETS

    def index(w):
        v = np.zeros(quality.DIM)
        for p, s in zip(places[bucket(w)], signs[bucket(w)]):
            v[p] += s
        return v

    sums, count = {}, {}
    for t in texts:
        tokens = re.findall(r"\w+|[^\w\s]+|\n", t or "")
        for i, w in enumerate(tokens):
            count[w] = count.get(w, 0) + 1
            for j in range(max(0, i - quality.WINDOW), min(len(tokens), i + quality.WINDOW + 1)):
                sums[w] = sums.get(w, np.zeros(quality.DIM)) + index(tokens[j])
    table, weight = quality.word_vectors(frame)
    total = sum(count.values())
    for w, v in sums.items():
        assert np.allclose(table[bucket(w)], v / np.linalg.norm(v), atol=1e-6)
        assert weight[bucket(w)] == pytest.approx(quality.COMMON / (quality.COMMON + count[w] / total), rel=1e-5)
    for r in quality.features(frame, table, weight).collect():
        tokens = re.findall(r"\w+|[^\w\s]+|\n", texts[r.doc_id] or "")
        want = np.zeros(2 * quality.DIM + 1)
        if tokens:
            share = np.array([float(weight[bucket(w)]) for w in tokens])
            unit = np.array([table[bucket(w)] for w in tokens], float)
            mean = (share[:, None] * unit).sum(0) / share.sum()
            want[: quality.DIM] = mean
            want[quality.DIM : -1] = np.sqrt(np.maximum(0, (share[:, None] * unit**2).sum(0) / share.sum() - mean**2))
            want[-1] = np.log1p(len(tokens)) / 10
        assert np.allclose(r.x, want, atol=2e-4)
