"""Queries against their SQL, on a small table of the same shape as embeddings."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from quern.plans import catalog, descent, oracle


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    x = np.random.default_rng(5).normal(size=(120, 16)).astype(np.float32)
    vec = pa.ListArray.from_arrays(pa.array(np.arange(121, dtype=np.int32) * 16), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(120)), "embedding": vec, "label": pa.array(np.arange(120) % 3)}), d / "embeddings.parquet")
    return str(d)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(round(float(x), 5) if isinstance(x, float) else x for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize(
    "name",
    ["knn_exact_l2", "knn_exact_cosine", "pair_distance_l1", "hubness_skew", "hub_damped_weights", "net_scores", "descent_naive_r2",
     "pair_distance_custom", "new_neighbors", "old_neighbors", "source_frequency", "topk_sources", "source_sketch", "json_result", "descent_naive_converged",
     "descent_optimized_converged", "descent_adaptive_converged", "descent_adaptive_r3", "descent_benchmark_adaptive_r3", "recall_descent_vs_exact", "gen_clustered"],
)
def test_query_matches_sql(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    own, other = catalog.QUERIES[name](spark, folder).toPandas(), c.sql(catalog.SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)


def test_every_query_is_listed():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(catalog.QUERIES) <= set(sql)


@pytest.mark.parametrize("name", ["descent_adaptive_converged", "descent_naive_converged", "descent_optimized_converged"])
def test_whole_descent_matches_sql_of_as_many_rounds(spark, monkeypatch, name):
    """The registered SQL spells out fewer rounds than the descent takes on this table; the descent may not end with it."""
    logs, own = [], descent.descend
    monkeypatch.setattr(descent, "descend", lambda *a, **kw: logs.append(own(*a, **kw)) or logs[-1])
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.1").toPandas()
    assert len(logs[0].log) > oracle.ROUNDS
    monkeypatch.setattr(oracle, "ROUNDS", descent.Settings().max_iterations)
    c = duckdb.connect()
    c.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.1/embeddings.parquet')")
    other = c.sql(oracle.build()[name]).df()
    assert sorted(got.columns) == sorted(other.columns)
    assert rows(got) == rows(other)
