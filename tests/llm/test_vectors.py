from __future__ import annotations

import math
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import exact_search, permutation_index, vectors

SF = "/root/testdata/sf0.001"


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def brute(rows, queries, k, score):
    out = {}
    for q, y in queries:
        best = sorted(((-score(y, x), i) for i, x in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("dim,n,kind", [(3, 90, "ties"), (40, 130, "normal"), (33, 60, "large")])
def test_exact_matches_brute_force(spark, dim, n, kind):
    rng = np.random.default_rng(dim)
    x = rng.integers(-2, 3, (n, dim)) / 64 if kind == "ties" else rng.normal(size=(n, dim)) * (1e6 if kind == "large" else 1)
    x = x.astype(np.float32)
    rows = vectors.clean(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), "vec_id", "embedding")
    got = found(exact_search.exact_search(rows, vectors.asked(rows, F.col("id") % 7 == 0), 20, segment=25, block=5))
    q = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in enumerate(x)]
    assert got == brute(q, [r for r in q if r[0] % 7 == 0], 20, lambda a, b: sum(s * t for s, t in zip(a, b)))


def test_copies_of_one_vector(spark):
    rows = [(i, [0.5, 0.25]) for i in range(200)] + [(200 + i, [0.1 * i, 0.0]) for i in range(10)]
    own = vectors.clean(table(spark, rows), "vec_id", "embedding")
    got = found(exact_search.exact_search(own, vectors.asked(own, "id % 20 = 0"), 20, segment=50))
    q = [(i, [int(np.floor(64 * np.float32(c))) for c in v]) for i, v in rows]
    assert got == brute(q, [r for r in q if r[0] % 20 == 0], 20, lambda a, b: sum(s * t for s, t in zip(a, b)))


ODD = [
    (0, [1.0, 2.0], 1), (1, None, 2), (2, [float("nan"), 1.0], 3), (3, [float("inf"), 0.0], 4), (4, [None, 1.0], 5), (5, [], 6),
    (6, [0.0, 0.0], 7), (20, [1.0, 2.0], 8), (20, [1.0, 2.0], 8), (None, [3.0, 3.0], 9), (40, [1.0, 2.0, 3.0], 10), (7, [2.0, 2.0], 11),
]


def test_odd_rows(spark, tmp_path):
    frame = table(spark, ODD, ", id int").withColumn("v", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("score", F.lit(None).cast("int"))
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = found(exact_search.op5_exact_top_k(spark, str(tmp_path)))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [7, 20, 20, 6], 20: [7, 7, 0, 0, 20, 20, 6, 6]}
    got = found(permutation_index.op1_permutation_index(spark, str(tmp_path)))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [7, 20, 20], 20: [7, 7, 0, 0, 20, 20]}


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert exact_search.op5_exact_top_k(spark, str(tmp_path)).count() == 0
    assert permutation_index.op1_permutation_index(spark, str(tmp_path)).count() == 0


def recall(got, rows):
    table_ = sorted((r.id, np.array(r.v)) for r in rows.collect())
    ids, x = np.array([i for i, _ in table_]), np.stack([v for _, v in table_])
    asked, hits = ids[ids % 20 == 0], 0
    for q in asked:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {i for i, _ in got[q]})
        assert all(abs(score - x[ids == i][0] @ x[ids == q][0]) < 1e-9 for i, score in got[q])
    return hits / (20 * len(asked))


@pytest.mark.parametrize("dim,n,kind,unequal", [(64, 2_000, "table", False), (64, 2_000, "table", True), (256, 3_000, "normal", False), (768, 1_500, "clustered", True)])
def test_query_holds_recall(spark, tmp_path, dim, n, kind, unequal):
    """The registered query, at its own parameters, on tables much larger than LEAST."""
    rng = np.random.default_rng(2)
    if kind == "table":
        x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()])
    else:
        x = rng.normal(size=(n, dim)) * (0.7 if kind == "clustered" else 1)
        if kind == "clustered":
            x += rng.normal(size=(100, dim))[rng.integers(0, 100, n)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if unequal:  # the largest inner product is not the smallest angle
        x = x * (1 + np.arange(len(x)) % 5)[:, None]
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel().astype(np.float32)))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": flat}), tmp_path / "embeddings.parquet")
    rows = permutation_index.prepared(spark.read.parquet(str(tmp_path / "embeddings.parquet")))
    assert recall(found(permutation_index.op1_permutation_index(spark, str(tmp_path))), rows) >= 0.9


def test_files_add_up_to_the_footrule():
    """The rows that the files give are those nearest by the footrule of whole orders, written out."""
    rng = np.random.default_rng(3)
    x, pivots = rng.normal(size=(400, 8)), permutation_index.unit(rng.normal(size=(40, 8)))
    f = permutation_index.Files.build(np.arange(400), x, pivots)
    f.posted = 10
    own = permutation_index.orders(x, pivots, 10)
    by = np.argsort(own.ravel(), kind="stable")
    f.starts, f.rows, f.places = np.searchsorted(own.ravel()[by], np.arange(41)), by // 10, by % 10
    place = lambda order: np.array([order.tolist().index(p) if p in order else 10 for p in range(40)])
    assert all(np.array_equal(o, np.argsort(-(permutation_index.unit(v[None]) @ pivots.T)[0], kind="stable")[:10]) for o, v in zip(own, x))
    for q in range(5):
        far = np.array([np.abs(place(o) - place(own[q])).sum() for o in own])
        got = f.nearest(own[q], 60)
        assert sorted(far[got]) == sorted(far)[:60]


def test_sizes_that_overflow(spark, tmp_path):
    """Components to 1e300: ranks follow the true sums, and a score is the nearest long."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.choice([0, 3, 8, 9, 18, 300, -300])).tolist()) for i in range(120)] + [(200, [1e300, 1.0, 0.0]), (220, [-1e300, 2.0, 0.0]), (240, [1e18, 0.5, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = {i: [math.floor(Fraction(c) * 64) for c in v] for i, v in rows}
    got = found(exact_search.op5_exact_top_k(spark, str(tmp_path)))
    for q in (i for i in whole if i % 20 == 0):
        sums = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
        assert got[q] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in sums]
    assert permutation_index.op1_permutation_index(spark, str(tmp_path)).count() == 20 * sum(i % 20 == 0 for i in whole)


def test_sql_with_repeated_ids(spark, tmp_path):
    rows = [(i % 40, [float(i % 7), float(i % 11), 1.0]) for i in range(90)] + [(20, []), (None, [1.0, 2.0, 3.0]), (20, [1.0]), (20, [1.0, 2.0, 1.0]), (20, [1.0, 2.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    own = sorted(map(tuple, exact_search.op5_exact_top_k(spark, str(tmp_path)).collect()))
    assert own == sorted(c.sql(exact_search.SQL).fetchall()) and len(own) > 100


def test_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    own = exact_search.op5_exact_top_k(spark, SF).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in own] == c.sql(f"select * from ({exact_search.SQL}) order by query_id, rank").fetchall()
