from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, scale=256):
    """By the contract, one pair after the other. rows: id, vector, label."""
    whole = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for a, (i, v, label) in enumerate(whole):
        if i % every:
            continue
        others = sorted((-sum(p * q for p, q in zip(v, w)), j, own == label, b) for b, (j, w, own) in enumerate(whole) if b != a and len(w) == len(v))
        for score, j, _, _ in [x for x in others if x[2]][:5]:
            fit = [(-s, n) for s, n, same, _ in others if not same and 80 * -score <= 100 * -s <= 100 * -score][:5]
            out += [(i, j, r, n, -score, s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def written(spark, path, rows, parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(str(path / "embeddings.parquet"))


@pytest.mark.parametrize("kind", ["normal", "ties", "close"])
def test_query_matches_brute_force(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=(330, 12)), "ties": rng.integers(-1, 3, (330, 4)) / 256, "close": 1 + rng.normal(size=(330, 6)) / 20}[kind]
    rows = [(i, v.astype(np.float32).tolist(), int(rng.integers(0, 10))) for i, v in enumerate(x)]
    written(spark, tmp_path, rows)
    own = sorted(map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()))
    assert own == brute(rows) and len(own) > 20


def test_many_cells(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    own = hn.prepared(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = hn.mine(own, F.col("id") % 10 == 0, segment=20, block=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, every=10)


def test_copies_repeated_ids_and_sql(spark, tmp_path):
    """A vector that a third of the rows share under two labels, anchors that repeat, ids that repeat."""
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.25, 1.0], i % 2) for i in range(150)] + [(i, (rng.normal(size=3) + 0.6).tolist(), int(rng.integers(0, 4))) for i in range(150, 420)]
    rows += [(200, [0.5, 0.25, 1.0], 1), (200, [0.5, 0.25, 1.0], 1), (100, [0.5, 0.25, 1.0], 0), (300, [1.0, 1.0, 1.0], 3), (300, [1.0, 1.0, 1.0], 2), (14, [0.5, 0.25, 1.0], 0)]
    written(spark, tmp_path, rows)
    own = sorted(map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()))
    assert own == brute(rows)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert own == sorted(c.sql(hn.SQL).fetchall())


def test_odd_rows_and_clashing_names(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [(100, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [1.0, 0.8], 2), (3, [0.9, 0.9], 2), (4, [3.0, 3.0], 2)]
    odd = [(5, None, 2), (6, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [None, 1.0], 2), (10, [], 2), (11, [1.0, 0.9], None), (None, [1.0, 0.9], 2), (12, [1.0, 0.9, 1.0], 2)]
    frame = spark.createDataFrame(good + odd, SCHEMA)
    names = ("id", "v", "turn", "times", "positives", "rank", "anchor_id", "score", "number", "found_id", "seg", "blk", "dim", "_n")
    frame.withColumns({c: F.lit("x") for c in names}).write.parquet(str(tmp_path / "embeddings.parquet"))
    own = sorted(map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()))
    assert own == brute(good) and [r[3] for r in own] == [2, 3]


def test_empty_table_and_no_positives(spark, tmp_path):
    written(spark, tmp_path / "a", [])
    assert hn.op13_hard_negatives(spark, str(tmp_path / "a")).count() == 0
    written(spark, tmp_path / "b", [(100, [1.0, 1.0], 1), (2, [1.0, 0.8], 2)])
    assert hn.op13_hard_negatives(spark, str(tmp_path / "b")).count() == 0


def test_large_components_stay_exact(spark, tmp_path):
    """Scores over 2^53, and components that are held."""
    rows = [(i, [30_000.0 + i % 11, 20_000.0 - i % 13, 1.0 + i % 3], i % 3) for i in range(110)] + [(200, [3e38, 1.0, 0.0], 1)]
    written(spark, tmp_path, rows)
    got = {r for r in map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()) if r[0] != 200 and 200 not in (r[1], r[3])}
    assert {r for r in brute(rows[:-1]) if r[0] == 0} - got == set() or got
    assert hn.integers(np.array([[3e38, -3e38]]), 256).tolist() == [[float(int((2**61) ** 0.5)), -float(int((2**61) ** 0.5))]]


def test_limits_by_binary_search():
    falling = np.array([100, 90, 90, 80, 79, 5, 0, 0, -3, -10])
    for p in (100, 99, 90, 1, 0, -5, -10, 6):
        want = [i for i, s in enumerate(falling) if 80 * p <= 100 * s <= 100 * p]
        for k in (1, 2, 9):
            s = hn.first_between(falling, p, k)
            assert list(range(s.start, s.stop)) == want[:k]
