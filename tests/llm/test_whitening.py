from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import compensated, whitening


def test_products_are_exact_to_a_hundred_bits():
    """Against fractions, where plain doubles lose everything."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) * 10.0 ** rng.integers(-3, 4, (40, 1))
    x[20:] = -x[:20] * (1 + 2.0**-40)
    low = x * 2.0**-60
    p = compensated.Products(5)
    p.add(x[:17], low[:17])
    p.add(x[17:], low[17:])
    whole = [[Fraction(h) + Fraction(lo) for h, lo in zip(*r)] for r in zip(x.tolist(), low.tolist())]
    top = Fraction(float(np.abs(x).max())) ** 2
    for i in range(5):
        for j in range(5):
            got = Fraction(p.high[i, j]) + Fraction(p.low[i, j])
            assert abs(got - sum(r[i] * r[j] for r in whole)) < top * 40 / 2**95


def test_sums_of_whole_numbers_are_exact():
    x = np.array([[2.0**52, 1.0], [2.0**52 - 1, 3.0], [-(2.0**52), 5.0], [7.0, 2.0**40]] * 700)
    s = compensated.Sums(2)
    s.add(x[:1_300])
    s.add(x[1_300:])
    assert [int(h) + int(lo) for h, lo in zip(s.high, s.low)] == [sum(int(v) for v in c) for c in x.T]
    h, lo = compensated.quotient(s.high, s.low, 2_799)
    for a, b, c in zip(h, lo, x.T):
        assert abs(Fraction(a) + Fraction(b) - Fraction(sum(int(v) for v in c), 2_799)) < Fraction(2) ** 50 / 2**100


def brute(rows, k=8):
    """vec_id, deviation, whitened, explained by whole numbers, and eigenvectors of the exact covariance in doubles."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    c = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    w = np.array([[y / n for y in r] for r in c]) @ u[:, :k] / np.sqrt(e[:k])
    return [(i, sum(y * y for y in r), z, e[:k] / np.trace(v)) for (i, _), r, z in zip(rows, c, w)]


@pytest.mark.parametrize("dim,parts", [(12, 1), (70, 5)])
def test_query_matches_brute_force(spark, tmp_path, dim, parts):
    rng = np.random.default_rng(dim)
    x = (rng.normal(size=(240, dim)) * np.linspace(0.2, 2, dim) + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[3].tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in whitening.op11_whitening(spark, str(tmp_path)).collect():
        assert r.n == 242 and r.identity_error < 1e-9
        got.setdefault(r.vec_id, []).append(r)
    signs = None
    for i, deviation, w, share in brute(rows):
        own = sorted(got[i], key=lambda r: r.component)
        assert len(own) == (16 if i == 7 else 8) and {r.component for r in own} == set(range(1, 9))
        assert {r.deviation for r in own} == {deviation}
        own = own[:: len(own) // 8]
        z = np.array([r.whitened for r in own])
        signs = np.sign(z * w) if signs is None else signs
        assert np.allclose(z, w * signs, rtol=1e-9, atol=1e-9)
        assert np.allclose([r.explained for r in own], share, rtol=1e-12)


ODD = [
    (1, [1.0, 2.0], 1.0), (2, None, 2.0), (3, [float("nan"), 1.0], 3.0), (4, [float("inf"), 0.0], 4.0), (5, [None, 1.0], 5.0), (6, [], 6.0),
    (7, [2.0, 2.0], 7.0), (8, [2.0, 5.0], 8.0), (9, [4.0, 2.0, 1.0], 9.0), (None, [0.0, 1.0], 0.0), (1, [1.0, 2.0], 1.0),
]


def test_odd_rows_and_clashing_names(spark, tmp_path):
    frame = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, w double")
    frame = frame.withColumns({c: F.lit("x") for c in ("id", "v", "dim", "deviation", "n", "high", "low", "block", "shares", "at", "whitened", "component")})
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = whitening.op11_whitening(spark, str(tmp_path)).collect()
    two = [r for r in rows if r.n == 5]
    assert sorted((r.vec_id or 0, r.component) for r in two) == sorted((i, c) for i in (1, 1, 7, 8, 0) for c in (1, 2))
    assert all(r.identity_error < 1e-12 for r in two)
    alone = [r for r in rows if r.n == 1]  # a length of its own, without variance
    assert [(r.vec_id, r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alone, key=lambda r: r.component)] == [(9, c, 0, None, 0.0, None) for c in (1, 2, 3)]
    assert len(rows) == 13


def test_equal_rows_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "a/embeddings.parquet"))
    rows = whitening.op11_whitening(spark, str(tmp_path / "a")).collect()
    assert len(rows) == 10 and all(r.whitened is None and r.deviation == 0 for r in rows)
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "b/embeddings.parquet"))
    assert whitening.op11_whitening(spark, str(tmp_path / "b")).count() == 0


def test_deviation_beyond_a_long_is_null(spark, tmp_path):
    rows = [(i, [float(i), 1e8 * i]) for i in range(6)] + [(9, [3e38, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.deviation for r in whitening.op11_whitening(spark, str(tmp_path)).collect()} == {None}
    m = whitening.Moments(3, (np.array([9.0]), np.array([0.0])), (np.array([3.0]), np.array([0.0])))
    assert whitening.deviations(np.array([[3.0], [2.0], [1e9 + 3], [2e9]]), m) == [0, 9, 9 * 10**18, None]


def test_merging_many_tasks(spark, monkeypatch):
    """More tasks than one merge takes: the same sums, by levels."""
    monkeypatch.setattr(whitening, "MERGE", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 3)) + 1e6
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(9)
    own = whitening.fit(rows, "v")[3]
    assert own.moments.n == 90
    whole = [[Fraction(c) for c in r] for r in x.tolist()]
    mean = [sum(c) / 90 for c in zip(*whole)]
    exact = [[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in whole) / 90) for j in range(3)] for i in range(3)]
    assert np.allclose(own.covariance[0], exact, rtol=1e-15, atol=0)
