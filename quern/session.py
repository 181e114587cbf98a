"""Session and scratch-folder helpers shared by every subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def local_session(app: str = "quern", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent a folder of this machine takes its place in local mode; a cluster must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "quern-scratch"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, tag: str, path: str | None = None, **counts) -> DataFrame:
    """Write df as Parquet to the shared scratch folder (or to path) and read it back.

    This cuts lineage and survives lost executors, because the files are shared and not kept by an executor. counts:
    aggregates by name, taken while the rows are written and found in the result's .counts.
    """
    spark = df.sparkSession
    path = path or f"{scratch_dir(spark)}/quern/{tag}-{uuid.uuid4().hex}"
    seen = Observation() if counts else None
    own = df.observe(seen, *[c.alias(name) for name, c in counts.items()]) if counts else df
    own.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    out.counts = seen.get if counts else {}
    return out


def _file_system(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path = _file_system(spark, path)
    return fs.exists(path)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in the folder; none where it is absent."""
    fs, path = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written under another name and renamed."""
    fs, part = _file_system(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, _file_system(spark, path)[1])


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def _delete(spark: SparkSession, path: str) -> None:
    fs, path = _file_system(spark, path)
    fs.delete(path, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete what materialize() wrote for these very frames; for tables that nothing reads any more, as in loops."""
    for df in frames:
        if df is not None and (path := getattr(df, "scratch_path", None)):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer used, before the next large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything that materialize() wrote; call it when no frame that reads it is needed any more."""
    _delete(spark, f"{scratch_dir(spark)}/quern")
