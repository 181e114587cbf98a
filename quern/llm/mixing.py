"""Mixing sources to target weights.

Each source's words are summed, a source's target follows from its weight and its cap, and every document is
emitted floor(rate) times plus once more when a hash of its id, its text and its number among equal rows falls under
the rate's fraction. The shares come
from one water level: with a = cap / weight ascending, the level is the largest of (total - caps before) /
(weights from here on), because that quotient rises while sources are capped and falls afterwards. So the
repeated resharing of what capped sources leave over is one ordered pass over the sources.

Defined results: null text has size 0; null source is a source of its own, last in order; a source without
words has target 0; a null id draws as the text "null"; repeated rows are numbered and draw each on its own, so
sources of equal ids or equal rows come near their targets too; an empty table gives no rows; further
columns, of any name and type, are kept by emit and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.columns import ROW, fresh, named, packed
from quern.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: A table of sources is broadcast up to so many rows and bytes of names; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds target double. One row a source passes through the ordered windows."""
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", turn.cast("long")).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (total - before).cast("double") / onward)
    s = s.withColumn("level", F.max("level").over(W.partitionBy()))
    return s.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def draw(doc_id: Column, mark: Column, number: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) fixed by the id, the md5 of the text, the row's number among equal rows, and the seed."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    h = F.md5(F.concat_ws("|", F.lit(f"mix|{seed}"), word(doc_id), word(mark), word(number)))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def _fingerprint(rows: DataFrame) -> Column:
    """128 bits of a whole row, by two hashes; columns that hold maps, which no hash takes, go in as JSON."""
    parts = [F.to_json(named(f.name)) if "map<" in f.dataType.simpleString() else named(f.name) for f in rows.schema]
    parts = [F.struct(p.isNull(), p) for p in parts]  # a null is not skipped
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts[::-1]).alias("b"))


def numbered(rows: DataFrame) -> DataFrame:
    """row (the columns as a struct) and number: 0, 1, ... among equal rows.

    Only rows whose fingerprint repeats are grouped by it, and summed before they are shuffled, so a row that a third
    of the table repeats costs one count from each task.
    """
    keyed = packed(rows, _fingerprint(rows).alias("key"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    often = materialize(often, "mix-often")
    none = F.lit(0).cast("long").alias("number")
    if not (n := often.count()):
        return keyed.select(ROW, none)
    often = F.broadcast(often) if n <= BROADCAST_ROWS else often
    once = keyed.join(often, "key", "left_anti").select(ROW, none)
    many = keyed.join(often, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first(ROW).alias(ROW))
    return once.unionByName(many.select(ROW, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("number")))


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, emit: bool = False, copy: str | None = None
) -> DataFrame:
    """Per document doc_id, size, source_size, target, taken; with emit the documents themselves, repeated.

    copy: with emit, the name of one more column at the end that tells the copies of a document apart, from 1; it gets
    underscores before it where docs has it. The size of every document is computed once and kept as a narrow table;
    only that table is aggregated, and the per-source result is broadcast when it is measured to be small.
    """
    shape = (F.col("doc_id").alias("id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), F.md5("text").alias("mark"))
    if emit:
        narrow = docs.select(*shape[1:3])
        rows = numbered(docs)
        field = lambda c: F.col(ROW)[c]
        rows = rows.select(
            ROW, "number", field("doc_id").alias("id"), field("source").alias("source"), word_count(field("text")).alias("size"), F.md5(field("text")).alias("mark")
        )
    else:
        narrow = materialize(docs.select(*shape), "mix")
        rows = numbered(narrow).select("number", f"{ROW}.*")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, most).withColumnRenamed("source", "of"), "mix-targets")
    n, width = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("of")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and width <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    drawn = draw(F.col("id"), F.col("mark"), F.col("number"), seed)
    copies = F.least(F.lit(most), whole + F.when(drawn < rate - whole, 1).otherwise(0)).cast("int")
    if emit:
        rows = rows.select(ROW, copies.alias("copies")).where(F.col("copies") > 0)
        rows = rows.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn"))
        return rows.select(f"{ROW}.*", *([F.col("turn").alias(fresh(copy, docs.columns))] if copy else []))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(text) AS mark, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS number
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s
), l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (
      ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (
      ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE), (SELECT max(level) FROM l) * weight) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    (CAST(CAST('0x' || substr(md5('mix|17|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || coalesce(d.mark, 'null') || '|' || d.number), 1, 8) AS BIGINT) AS DOUBLE)
      + 0.5) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(3, floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
