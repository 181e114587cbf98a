"""Line dedup over overlapping three-line windows, in DataFrame functions alone.

Every three consecutive lines of a text are hashed to 128 bits. A window whose hash occurs more than once in
the corpus is repeated; its occurrence with the smallest (doc_id, text hash, position) stays and every later one
is removed. The positions that later occurrences cover are merged per document, and the lines left are joined.

Counting pre-aggregates on the mapping side, so a window that a third of all documents share reaches one task
as one row from each mapper; the look-up of first occurrences is a sort-merge join that Spark splits when skewed.

Defined results: null text stays null and has no lines; fewer than three lines are never touched; a row with
the same id and text as another is the same document and gets the same result, so it does not count as a
repetition; null ids are documents before all others; an empty table gives no rows; further
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.columns import ROW, packed, unpacked

SPAN = 3


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(docs: DataFrame) -> DataFrame:
    """_id, _fp, pos, h1, h2 of every window."""

    def hashed(lines: Column) -> Column:
        window = lambda i: F.struct(
            F.xxhash64(*[F.get(lines, i + j) for j in range(SPAN)]).alias("h1"),
            F.xxhash64(F.lit("second"), *[F.get(lines, i + j) for j in reversed(range(SPAN))]).alias("h2"),
        )
        return F.when(F.size(lines) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(lines) - SPAN), window))

    own = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_fp"), _let(F.split("text", "\n", -1), hashed).alias("_h"))
    own = own.select("_id", "_fp", F.posexplode("_h").alias("pos", "h"))  # the text stays behind
    return own.select("_id", "_fp", "pos", "h.h1", "h.h2")


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs with text rewritten; n_chars, where present, follows the new text. counts: doc_id, n_lines, n_removed, text."""
    found = _windows(docs)
    where = F.struct("_id", "_fp", "pos")
    first = (
        found.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("first"))
        .where(F.col("n") > 1)
        .select("h1", "h2", "first")
    )
    later = found.join(first, ["h1", "h2"]).where(where > F.col("first"))
    covered = later.groupBy("_id", "_fp").agg(F.collect_set("pos").alias("_at"))
    covered = covered.select(F.col("_id").alias("_cid"), F.col("_fp").alias("_cfp"), "_at")
    own = docs.select("doc_id", "text") if counts else docs
    out = packed(own, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_fp"), F.col("text").alias("_text"))
    out = out.join(covered, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_fp") == F.col("_cfp")), "left")

    def rest(s: Column) -> Column:
        """In one pass over the lines: their number, how many go, and the others joined."""
        gone = F.array_distinct(F.flatten(F.transform(s["at"], lambda p: F.array(*[p + j for j in range(SPAN)]))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), gone)
        joined = F.array_join(F.transform(kept, lambda i: F.get(s["lines"], i)), "\n")
        return F.struct(F.size(s["lines"]).cast("long").alias("n"), F.size(gone).cast("long").alias("gone"), joined.alias("text"))

    cut = F.when(F.col("_at").isNotNull(), _let(F.struct(F.split("_text", "\n", -1).alias("lines"), F.col("_at").alias("at")), rest))
    out = out.withColumn("_cut", cut)
    text = F.when(F.col("_at").isNull(), F.col("_text")).otherwise(F.col("_cut.text"))
    if counts:
        whole = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + F.lit(1)
        n_lines = F.coalesce(F.col("_cut.n"), whole.cast("long"), F.lit(0).cast("long")).alias("n_lines")
        n_removed = F.coalesce(F.col("_cut.gone"), F.lit(0).cast("long")).alias("n_removed")
        return out.select(F.col("_id").alias("doc_id"), n_lines, n_removed, text.alias("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_at").isNull(), F.col(ROW)["n_chars"]).otherwise(F.length("_cut.text")).cast("long")
    return unpacked(out, docs.columns, **changed)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


SQL = r"""
WITH l AS (
  SELECT row_number() OVER () AS k, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)
), s AS (
  SELECT k, doc_id, string_split(text, chr(10)) AS ls FROM l
), n AS (
  SELECT k, doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM s
), w AS (
  SELECT k, doc_id, pos, line || chr(10) || lead(line) OVER p || chr(10) || lead(line, 2) OVER p AS win
  FROM n WINDOW p AS (PARTITION BY k ORDER BY pos)
), o AS (
  SELECT k, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, pos) AS rn FROM w WHERE win IS NOT NULL
), g AS (
  SELECT DISTINCT k, pos + j AS pos FROM o, range(3) t(j) WHERE rn > 1
), c AS (
  SELECT k, count(*) AS n_removed FROM g GROUP BY k
), r AS (
  SELECT k, string_agg(line, chr(10) ORDER BY pos) AS kept FROM n WHERE k IN (SELECT k FROM c) AND NOT EXISTS
    (SELECT 1 FROM g WHERE g.k = n.k AND g.pos = n.pos) GROUP BY k
), z AS (
  SELECT k, count(*) AS n_lines FROM n GROUP BY k
)
SELECT d.doc_id, CAST(coalesce(z.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
  md5(CASE WHEN c.k IS NULL THEN d.text ELSE coalesce(r.kept, '') END) AS kept_md5
FROM documents d LEFT JOIN l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.text = l.text
LEFT JOIN z ON z.k = l.k LEFT JOIN c ON c.k = l.k LEFT JOIN r ON r.k = l.k
"""
