"""Exact search in cells: how much it measures, how large its cells are, and blocks that single precision can't tell apart."""

from __future__ import annotations

import numpy as np
import pytest

from quern.functions.distances import Metric, as_metric
from quern.operators import exact

METRICS = ["euclidean", "cosine", "manhattan"]


def nearest(metric, x, ids, asked, others, k):
    out = {}
    for a in asked:
        dist = metric.rows(x[others], x[a])
        own = sorted((d, i) for d, i, o in zip(dist.tolist(), ids[others].tolist(), others) if o != a)[:k]
        if own:
            out[int(ids[a])] = own
    return out


def found(metric, x, ids, a, b, k, same=False):
    parts = list(exact._both_ways(metric, x[a], ids[a], x[b], ids[b], k, same))
    out = {}
    for p, q, d in zip(*(np.concatenate(c).tolist() for c in zip(*parts))):
        out.setdefault(p, set()).add((d, q))
    return {p: sorted(own)[:k] for p, own in out.items()}


@pytest.mark.parametrize("name", METRICS)
def test_most_pairs_are_not_measured(name):
    """Each pair's exact distance was taken for the Manhattan distance before, which made its search too slow."""
    metric, seen = as_metric(name), []
    counted = Metric(name, metric.column, lambda x, y: seen.append(len(x)) or metric.rows(x, y))
    x = np.random.default_rng(3).normal(size=(4_000, 32))
    a, b = np.arange(2_000), np.arange(2_000, 4_000)
    assert len(found(counted, x, np.arange(4_000), a, b, 5)) == 4_000
    assert sum(seen) < 2_000 * 2_000 // 20


@pytest.mark.parametrize("name", METRICS)
@pytest.mark.parametrize("dim", [1, 3, 40])
def test_both_ways_give_the_nearest(monkeypatch, name, dim):
    """Stripes of a few rows; copies, a zero vector, points far off, huge and tiny ones, and a shift that single precision loses."""
    monkeypatch.setattr(exact, "STRIPE_BYTES", 100_000)
    rng, metric = np.random.default_rng(dim), as_metric(name)
    x = rng.normal(size=(900, dim))
    x[rng.integers(0, 900, 200)] = x[0]
    x[5], x[6] = 0, 1e150
    x[7] *= 1e-240
    x[8] *= 1e6
    a, b, ids = np.arange(400), np.arange(400, 900), rng.permutation(900) * 3
    for points in (x, x + 1e5, np.round(rng.normal(size=(900, dim)), 1), np.exp(4 * rng.normal(size=(900, dim)))):
        assert found(metric, points, ids, a, b, 6) == nearest(metric, points, ids, a, b, 6) | nearest(metric, points, ids, b, a, 6)
        assert found(metric, points, ids, a, a, 6, same=True) == nearest(metric, points, ids, a, a, 6)


def test_cells_do_not_grow_with_the_points():
    """A cell of 100,000 points of 64 components had blocks of 25,000 before, of 10,000 points 2,500: pairs grew a hundredfold."""
    assert exact.block_count(10_000, 64) == 4
    side = 100_000 / exact.block_count(100_000, 64)
    assert side <= exact.SIDE and side**2 <= 25 * 2_500**2
    assert 600_000 / exact.block_count(600_000, 64) <= exact.SIDE
