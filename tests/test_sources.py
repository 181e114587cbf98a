from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.sources import (
    generate_clustered, generate_gaussian, generate_high_hubness, generate_uniform, load_points, load_sift, read_fvecs, read_npy, read_result, write_result,
)


def matrix(pts):
    return np.array([r.vec for r in pts.orderBy("id").collect()])


def test_generators(spark):
    u = matrix(generate_uniform(spark, 100, 50))
    assert u.shape == (100, 50) and u.min() >= 0 and u.max() < 1
    assert (u == matrix(generate_uniform(spark, 100, 50))).all()
    assert (u != matrix(generate_uniform(spark, 100, 50, seed=1))).any()
    g = matrix(generate_gaussian(spark, 10_000, 10, 5.0, 2.0))
    assert abs(g.mean() - 5) < 0.1 and abs(g.std() - 2) < 0.1
    assert matrix(generate_high_hubness(spark, 3)).shape == (3, 100)
    c = generate_clustered(spark, 300, 2, 3, std=0.01)
    centre = c.select("cluster", F.col("vec")[0].alias("x")).groupBy("cluster").agg(F.max("x") - F.min("x"), F.count(F.lit(1)))
    assert all(r[1] < 0.1 and r[2] == 100 for r in centre.collect())
    assert generate_clustered(spark, 10, 2, 3).select("cluster").distinct().count() == 4


def test_fvecs(spark, tmp_path):
    x = np.arange(24, dtype="<f4").reshape(6, 4)
    raw = b"".join(np.int32(4).astype("<i4").tobytes() + r.tobytes() for r in x)
    (tmp_path / "a.fvecs").write_bytes(raw + b"\x04\x00\x00\x00cut")
    got = read_fvecs(spark, str(tmp_path / "a.fvecs"))
    assert (matrix(got) == x).all() and [r.id for r in got.orderBy("id").collect()] == list(range(6))
    assert read_fvecs(spark, str(tmp_path / "a.fvecs"), 2).count() == 2
    (tmp_path / "b.fvecs").write_bytes(raw)
    assert read_fvecs(spark, str(tmp_path)).select("id").distinct().count() == 12
    with pytest.raises(FileNotFoundError):
        read_fvecs(spark, str(tmp_path / "none.fvecs"))
    got.write.parquet(str(tmp_path / "cache"))
    assert load_points(spark, str(tmp_path / "none.fvecs"), str(tmp_path / "cache"), 3).count() == 3
    with pytest.raises(FileNotFoundError):
        load_points(spark, str(tmp_path / "none.fvecs"), str(tmp_path / "nothing"))


def test_ranges_of_records(spark, tmp_path):
    """Many tasks a file, limits and ids that choose the records read; fvecs, npy and Parquet give equal points."""
    x = np.random.default_rng(1).normal(size=(1_000, 3)).astype("<f4")
    for i, part in enumerate((x[:700], x[700:])):
        raw = np.concatenate([np.full((len(part), 1), 3, "<i4").view("<f4"), part], axis=1)
        (tmp_path / f"{i}.fvecs").write_bytes(raw.tobytes())
    np.save(tmp_path / "x.npy", x.astype(np.float64))
    own = read_fvecs(spark, str(tmp_path / "0.fvecs"), rows=100)
    assert own.rdd.getNumPartitions() == 7 and (matrix(own) == x[:700]).all()
    (tmp_path / "all").mkdir()
    for i in (0, 1):
        (tmp_path / f"{i}.fvecs").rename(tmp_path / "all" / f"{i}.fvecs")
    both = load_sift(spark, f"file://{tmp_path}/all", rows=300)
    assert both.rdd.getNumPartitions() == 4 and (matrix(both) == x).all()
    assert read_fvecs(spark, str(tmp_path / "all"), n=750, rows=300).rdd.getNumPartitions() == 4
    npy = read_npy(spark, str(tmp_path / "x.npy"), rows=250)
    assert npy.rdd.getNumPartitions() == 4 and (matrix(npy) == x).all() and (matrix(load_points(spark, "/none", str(tmp_path / "x.npy"), 9)) == x[:9]).all()
    npy.write.parquet(str(tmp_path / "p"))
    assert (matrix(load_points(spark, "/none", str(tmp_path / "p"))) == x).all()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = read_npy(spark, str(tmp_path / "x.npy"), rows=250).where("id >= 240 and id < 260")
        assert few.rdd.getNumPartitions() == 1 and (matrix(few) == x[240:260]).all()
        assert read_npy(spark, str(tmp_path / "x.npy")).where("id = 5 and vec[0] is not null").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_odd_files(spark, tmp_path):
    (tmp_path / "e.fvecs").write_bytes(b"")
    assert read_fvecs(spark, str(tmp_path / "e.fvecs")).count() == 0
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    whole = (np.save(tmp_path / "i.npy", np.arange(8, dtype="<i4").reshape(4, 2)), (tmp_path / "i.npy").read_bytes())[1]
    (tmp_path / "cut.npy").write_bytes(whole[:-3])
    assert matrix(read_npy(spark, str(tmp_path / "cut.npy"))).tolist() == [[0, 1], [2, 3], [4, 5]]
    for bad in ("f.npy", "e.fvecs"):
        with pytest.raises(Exception, match="npy file|C order"):
            read_npy(spark, str(tmp_path / bad)).count()


def test_results(spark, tmp_path):
    run = {
        "recall": 0.5, "dist_comps": 7, "iterations": 1, "iter_log": [{"iter": 1, "updates": 2, "dist": 7, "time": 0.1}],
        "time": 1.5, "mode": "random", "rate": 0.5, "rho": 0.8,
    }
    path = write_result(spark, run, str(tmp_path))
    assert path.endswith("result_random_50")
    r = read_result(spark, path).first()
    assert r.recall == 0.5 and r.iter_log[0].updates == 2 and r.mode == "random"


def test_cli(spark):
    rows = cli.main(["--data", "clustered", "--n", "60", "--dim", "4", "--k", "4", "--algorithm", "adaptive", "--distance", "cosine", "--quiet", "--sample-rate", "0.9"], spark)
    assert rows[0][0] == "adaptive" and rows[0][1] > 0.6
