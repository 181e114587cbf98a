"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents; the last returns the pieces with their sequences. Nulls, empty texts, repeated rows and empty
tables get the results that the stages' operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, mixing, packing, parity_join, toxicity
from quern.llm.columns import packed, unpacked
from quern.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is under the threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = toxicity.scored(packed(docs, F.col("text").alias("text")), model)
    return unpacked(rows.where(F.col("score") < toxicity.THRESHOLD), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of repeated three-line windows."""
    return line_dedup.dedup_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest id; rows without an id come after all others.

    Rows are known by a 64-bit hash of id and text, so the texts of a repeated id, or of none, are judged each on its
    own. Repeated rows are copies of each other, so one stays.
    """
    known = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text").isNull(), "text")
    own = packed(docs, known.alias("key"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    near = parity_join.near_duplicates(own.select(F.col("key").alias("doc_id"), "text"))
    near = near.select(F.col("doc_id").alias("key"), "component_id")
    ids = own.select("key", "id").distinct()
    order = F.struct(F.col("id").isNull(), "id", "key")
    first = near.join(ids, "key").groupBy("component_id").agg(F.min(order)["key"].alias("key"))
    kept = own.join(first, "key", "left_semi")
    if not near.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return unpacked(kept, docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that each source's words come near its target."""
    return mixing.mix_sources(docs, emit=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_to_targets),
    ("best-fit packing", pack_sequences),
]

#: The first stage is a learned model, which SQL can't express; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
