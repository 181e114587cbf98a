"""Removal of long repeated byte strings, by suffix sorting of content-dealt shards.

Two equal strings of SPAN bytes must meet in one shard, wherever they start. So every start is dealt by the least
hash among the GRAM-byte grams of its string, which equal strings share. Consecutive starts with the same least
hash form a segment. Segments are counted by their content first: a hash with one segment in the whole corpus
holds no repetition, a segment that occurs often is sorted once with a mark, and copies of documents, however many,
come down to one. The segments of the other hashes are dealt to shards, where induced sorting (see induced_sort.py)
finds the strings that start at two places. A hash with more than a shard of segments, as a common phrase gives, is
split instead: its strings are dealt one by one by a 128-bit hash of their own, and counted. So no task gets more
than a few shards' bytes, and a shard is sorted in memory; queues spill only beyond MEMORY tuples. Only spans go
back to the documents.

Matches never cross documents, and positions are judged on the input.

Defined results: null text is empty; a text shorter than SPAN loses nothing; a row with the same id and text as
another counts as a document of its own, so both lose what they share; null ids are documents like others; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.induced_sort import repeated_starts
from quern.session import materialize

SPAN, GRAM = 400, 64
#: Bytes of segments in a shard, about, and tuples that its sort holds in memory.
SHARD, MEMORY = 3_000_000, 8_000_000
#: Hashes of more than a shard are broadcast up to so many (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _A
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from every place; gram is a power of two, 8 at least."""
    h = data.astype(np.uint64)
    for width in (1, 2, 4):
        h = h[:-width] | h[width:] << np.uint64(8 * width)
    h = _mixed(h)
    width = 8
    while width < gram:
        h = _mixed(h[:-width] * _A + h[width:])
        width *= 2
    return h


def segments(data: bytes, span: int = SPAN, gram: int = GRAM):
    """Start, number of starts, least hash, and whether that gram occurs twice, of every segment of the text."""
    n = len(data)
    if n < span:
        return ()
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    wide = span - gram + 1
    padded = np.full(-(-len(key) // wide) * wide, ~np.uint64(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - span + 1
    at = np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count]) & low
    least = h[at.astype(np.int64)]
    fresh = np.r_[True, least[1:] != least[:-1]]
    starts = np.flatnonzero(fresh)
    moved = np.r_[False, at[1:] != at[:-1]] & ~fresh
    twice = np.add.reduceat(moved, starts) > 0
    return starts, np.diff(np.r_[starts, count]), least[starts].view(np.int64), twice


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))


def segment_table(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """doc_id, fp, start, n, least, seg (a 128-bit hash of the content), twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, n, least, twice, seg = [], [], [], [], [], []
            for i, data in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                if len(data) >= span:
                    own = segments(data, span, gram)
                    row.append(np.full(len(own[0]), i))
                    start.append(own[0]), n.append(own[1]), least.append(own[2]), twice.append(own[3])
                    seg += [xxhash.xxh3_128_digest(data[a:z]) for a, z in zip(own[0].tolist(), (own[0] + own[1] + span - 1).tolist())]
            if row:
                at = pa.array(np.concatenate(row))
                cols = [b.column(0).take(at), b.column(1).take(at)]
                cols += [pa.array(np.concatenate(c)) for c in (start, n, least)] + [pa.array(seg, pa.binary()), pa.array(np.concatenate(twice))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "start", "n", "least", "seg", "twice"])

    schema = "doc_id long, fp long, start long, n long, least long, seg binary, twice boolean"
    return docs.mapInArrow(work, schema)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Texts and segments of a task's rows, of rows with one id and text the first. Such rows come to one task, or a few."""
    seen = set()
    for b in batches:
        keys = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
        at = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                at.append(i)
        kept = b.take(pa.array(at, pa.int64()))
        yield kept.column(0).to_pylist(), kept.column(1).to_pylist()


def _cut(span: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, owns in _once(batches):
            rows = []
            for text, own in zip(texts, owns):
                data = text.encode()
                rows += [(x["least"], x["seg"], x["often"], data[x["start"] : x["start"] + x["n"] + span - 1]) for x in own]
            for low in range(0, len(rows), 2_000):
                cols = zip(*rows[low : low + 2_000])
                kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["least", "seg", "often", "data"])

    return work


def _strings(span: int):
    """Every string of the segments, by its hash: key, least, seg, place, weight (2 where the segment itself repeats)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, owns in _once(batches):
            for text, own in zip(texts, owns):
                data = text.encode()
                for x in own:
                    for low in range(0, x["n"], 20_000):
                        places = range(low, min(x["n"], low + 20_000))
                        keys = [xxhash.xxh3_128_digest(data[a : a + span]) for a in range(x["start"] + low, x["start"] + places.stop)]
                        n = len(keys)
                        cols = [pa.array(keys, pa.binary()), pa.array([x["least"]] * n, pa.int64()), pa.array([x["seg"]] * n, pa.binary())]
                        cols += [pa.array(places, pa.int64()), pa.array([1 + x["often"]] * n, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, ["key", "least", "seg", "place", "weight"])

    return work


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """least, seg, edges of the runs of places."""
    for b in batches:
        out = []
        for places in b.column(2).to_pylist():
            p = np.sort(np.array(places))
            new = np.flatnonzero(np.r_[True, np.diff(p) > 1])
            out.append(np.stack([p[new], p[np.r_[new[1:], len(p)] - 1] + 1], axis=1).ravel().tolist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["least", "seg", "edges"])


def _sorted_shard(span: int, memory: int):
    """One shard: its segments, each ended by a separator, sorted as one text; gives the repeated starts of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, seg, often, sizes, text = [], [], [], [], [np.zeros(0, np.int16)]
        for b in batches:
            least += b.column(0).to_pylist()
            seg += b.column(1).to_pylist()
            often += b.column(2).to_pylist()
            for data in b.column(3).to_pylist():
                sizes.append(len(data))
                own = np.ones(len(data) + 1, np.int16)
                own[:-1] = np.frombuffer(data, np.uint8)
                own[:-1] += 2
                text.append(own)
        if not seg:
            return
        marks = repeated_starts(np.concatenate([*text, np.zeros(1, np.int16)]), span, memory)
        rows, at = [], 0
        for i, size in enumerate(sizes):
            own = marks[at : at + size - span + 1]
            at += size + 1
            if often[i]:
                own = np.ones_like(own)
            edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            if len(edge):
                rows.append((least[i], seg[i], edge.tolist()))
        if rows:
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["least", "seg", "edges"])

    return work


def _wanted(docs: DataFrame, same: DataFrame) -> DataFrame:
    """text, own, doc_id, fp: the documents that the segments are read from, each with its segments."""
    wanted = same.groupBy(F.col("at.doc_id").alias("_d"), F.col("at.fp").alias("_f")).agg(
        F.collect_list(F.struct(F.col("at.start").alias("start"), "n", "least", "seg", (F.col("copies") > 1).alias("often"))).alias("own")
    )
    rows = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")))
    return rows.select("text", "own", "doc_id", "fp")


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard: int = SHARD, memory: int = MEMORY) -> DataFrame:
    """doc_id, fp, spans of the documents of _texts(): pieces of [start of the first, start after the last) string."""
    found = materialize(segment_table(docs, span, gram), "segments")
    same = found.groupBy("least", "seg").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "fp", "start")).alias("at"),
        F.min("n").alias("n"), F.max("twice").alias("twice"),
    )
    # counted before the shuffle and joined, so a hash with very many contents is not gathered
    kinds = same.groupBy("least").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    same = same.join(kinds, "least", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    same = materialize(same.where((F.col("kinds") > 1) | (F.col("copies") > 1) | F.col("twice")), "segments-shared")
    alone = (F.col("kinds") == 1) & ~F.col("twice")  # its only repetitions are its copies
    whole = same.where(alone).select("least", "seg", F.array(F.lit(0).cast("long"), F.col("n")).alias("edges"))
    mixed = same.where(~alone)
    size = mixed.groupBy("least").agg(F.sum(F.col("n") + span).alias("size"))
    hot = materialize(size.where(F.col("size") > shard).select("least"), "segments-hot")  # fewer rows than shards
    parts = [whole]
    if n_hot := hot.count():
        hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        strings = _wanted(docs, mixed.join(hot, "least", "left_semi"))
        strings = strings.mapInArrow(_strings(span), "key binary, least long, seg binary, place long, weight long")
        strings = materialize(strings, "strings")
        again = strings.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key")
        places = strings.join(again, "key", "left_semi").groupBy("least", "seg").agg(F.collect_list("place").alias("places"))
        parts.append(places.mapInArrow(_edges, "least long, seg binary, edges array<long>"))
        mixed = mixed.join(hot, "least", "left_anti")
    total = mixed.agg(F.coalesce(F.sum(F.col("n") + span), F.lit(0))).first()[0]
    cut = _wanted(docs, mixed).mapInArrow(_cut(span), "least long, seg binary, often boolean, data binary")
    shards = cut.repartition(max(1, -(-total // shard)), "least")
    spans = shards.mapInArrow(_sorted_shard(span, memory), "least long, seg binary, edges array<long>")
    for part in parts:
        spans = spans.unionByName(part)
    hits = found.join(spans, ["least", "seg"])
    moved = F.transform("edges", lambda e: e + F.col("start"))
    # rows of one id and text have the same runs, and a set holds each once, before the shuffle already
    return hits.groupBy("doc_id", "fp").agg(F.collect_set(moved).alias("spans"))


def merged(edges: list[list[int]], span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings whose starts the edges bound."""
    out: list[list[int]] = []
    for first, after in sorted((e[i], e[i + 1]) for e in edges for i in range(0, len(e), 2)):
        last = after - 1 + span
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, z) for a, z in out]


def removed(docs: DataFrame, span: int = SPAN, keep_text: bool = False, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with keep_text also removed_spans and kept, bytes."""
    own = _texts(docs)
    spans = repeated_spans(own, span, **sizes).withColumnsRenamed({"doc_id": "_d", "fp": "_f"})
    rows = own.join(spans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, runs, sha, where, kept = [], [], [], [], [], []
            for text, edges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = text.encode()
                cuts = merged(edges, span) if edges else []
                rest = b"".join(data[a:z] for a, z in zip([0, *(z for _, z in cuts)], [*(a for a, _ in cuts), len(data)]))
                size.append(len(data)), gone.append(len(data) - len(rest)), runs.append(len(cuts))
                sha.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    where.append([{"first": a, "last": z} for a, z in cuts]), kept.append(rest)
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                cols += [pa.array(where, kind), pa.array(kept, pa.binary())]
                names += ["removed_spans", "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", removed_spans array<struct<first: long, last: long>>, kept binary" * keep_text
    return rows.select("doc_id", "text", "spans").mapInArrow(work, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every string of every text, counted by a 64-bit hash of its bytes in hex.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS MATERIALIZED (
  SELECT k, i, hash(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS s FROM (SELECT k, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)
), r AS (
  SELECT k, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
), e AS (
  SELECT k, i, CASE WHEN i <= lag(i) OVER p + 400 THEN 0 ELSE 1 END AS new FROM r WINDOW p AS (PARTITION BY k ORDER BY i)
), g AS (
  SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS run FROM e
), c AS (
  SELECT k, run, min(i) AS first, max(i) + 400 AS last FROM g GROUP BY k, run
), o AS (
  SELECT k, run, first, last, coalesce(lag(last) OVER (PARTITION BY k ORDER BY run), 0) AS before FROM c
), t AS (
  SELECT k, count(*) AS n_spans, sum(last - first) AS n_removed, max(last) AS after FROM c GROUP BY k
), p AS (
  SELECT o.k, string_agg(substr(d.h, CAST(2 * o.before + 1 AS BIGINT), CAST(2 * (o.first - o.before) AS BIGINT)), '' ORDER BY o.run) AS kept
  FROM o JOIN d ON d.k = o.k GROUP BY o.k
)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(t.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN t.k IS NULL THEN d.h ELSE p.kept || substr(d.h, CAST(2 * t.after + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN t ON t.k = d.k LEFT JOIN p ON p.k = d.k
"""
