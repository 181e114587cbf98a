"""Packing documents into sequences of a fixed token length by minimum bin slack.

Lengths lie between 1 and the sequence length, so the whole corpus is one histogram of at most that many
counts, whatever its size. Each bin starts from the longest length left; a subset-sum program over bitsets (one
bit for each total that the lengths left can reach) finds the fullest feasible combination, which is removed as
often as the counts allow. The plan is a list of patterns; its size depends on the sequence length alone.

Pieces are numbered within their length in salted parts, so a length that a third of all pieces share, also with one
id and text, is numbered by many tasks, and each number finds its sequence and offset in the plan by binary search.

Texts are tokenized in chunks, cut only before a space that a non-space follows. The tokenizer's own split always
cuts there, so a chunk's ids never depend on its neighbours and are remembered, within a bound. A new chunk of
Latin characters is cut on into the tokenizer's own parts, which go to its model one by one; other new chunks go
through the whole tokenizer. Texts that hold a special token or an odd blank are tokenized whole.

Defined results: null text is empty text, one piece holding the end id; repeated rows are documents of their own
and are packed each; a null id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.memory import bound_batches, hand_back, tidy
from quern.session import materialize

SIZE, END = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Chunks remembered by a worker; it starts afresh beyond that.
CACHE = 1_500_000
#: Seconds after which a worker without a packing task gives its remembered chunks up.
IDLE = 5.0
#: Pieces that one numbering task holds of a length, about.
PART = 500_000
#: Rows of the table of salted counts up to which it is broadcast.
BROADCAST_ROWS = 200_000

_ODD = re.compile("[\x1c-\x1f\x85᠎]")
_LOOSE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")
#: Below this code point letters and digits are the same in every version of Unicode.
_LATIN = 0x250
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Chunks of such characters, without odd blanks, that neither begin nor end in a blank.
_PLAIN = re.compile(r"[!-~¡-ɏ](?:[\t\n!-~¡-ɏ]*[!-~¡-ɏ])?")
#: The byte-level pre-tokenizer's pattern, for these characters.
_PART = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.limit = Tokenizer.from_file(path), cache
        table = pre_tokenizers.ByteLevel.alphabet()  # one character a byte, so a token's length is its bytes
        added = self.model.get_added_tokens_decoder()
        self.special = sorted(t.content for t in added.values())
        vocab = {x: i for x, i in self.model.get_vocab(with_added_tokens=False).items() if i not in added}
        self.bytes_of = np.zeros(self.model.get_vocab_size(with_added_tokens=True) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(x) if set(x) <= set(table) else 0 for x in vocab]
        self.known: dict[str, bytes] = {}  # a chunk without its leading space
        self.plain: dict[str, bytes] = {}  # a text's first chunk, a chunk as it stands, or a later part of one
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelt = {i: spell(chr(i))[0][0] for i in range(_LATIN)}
        self.parts = self._whole_parts()

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]

    def _whole_parts(self) -> bool:
        """Whether the tokenizer is its model on the parts that _PART finds, which a probe of many kinds tells."""
        probe = " it's ok,we'll 12²x ª½\n\tÀß÷ɏ... 'Tis don't\n\nend_of 3rd¡¿ naïve  "
        tokens = [t for p in _PART.findall(probe) for t in self.model.model.tokenize(p.translate(self.spelt))]
        return [t.id for t in tokens] == self.model.encode(probe, add_special_tokens=False).ids

    def _part(self, part: str) -> bytes:
        tokens = self.model.model.tokenize(part.translate(self.spelt))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words that follow a space.

        Latin words are learned part by part. Others that neither begin nor end in a blank are encoded as one text
        and told apart by their length in bytes.
        """
        if self.parts:
            known, plain, other = self.known, self.plain, []
            for w in words:
                if not _PLAIN.fullmatch(w):
                    other.append(w)
                    continue
                head, *tail = _PART.findall(" " + w)
                ids = tail and known.get(head[1:]) or self._part(head)
                if tail:
                    for t in tail:
                        if t not in plain:
                            plain[t] = self._part(t)
                    ids = b"".join([ids, *map(plain.__getitem__, tail)])
                known[w] = ids
            words = other
        own = [w for w in words if w and w.strip() == w]
        rest = [w for w in words if not w or w.strip() != w]
        for low in range(0, len(own), 65_536):
            self._learn_joined(own[low : low + 65_536])
        self.known.update(zip(rest, self._ids([" " + w for w in rest])))

    def _learn_joined(self, own: list[str]) -> None:
        groups = [own[i : i + 2_048] for i in range(0, len(own), 2_048)]
        texts = [" " + " ".join(g) for g in groups]
        for g, text, e in zip(groups, texts, self.model.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum(np.fromiter(map(len, map(str.encode, g)), np.int64, len(g)) + 1)
            at = np.searchsorted(ends, wanted)
            if ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                raw, cut = ids.tobytes(), (4 * (at + 1)).tolist()
                self.known.update(zip(g, [raw[a:z] for a, z in zip([0, *cut], cut)]))
            else:
                self.known.update(zip(g, self._ids([" " + w for w in g])))

    def __call__(self, texts: list[str]) -> list[bytes]:
        tight, loose, odd = {}, {}, []
        for i, t in enumerate(texts):
            if _ODD.search(t) or any(x in t for x in self.special):
                odd.append(i)
            elif _LOOSE.search(t):
                loose[i] = _CUT.split(t)
            else:
                tight[i] = t.split(" ")
        if len(self.known) + len(self.plain) > self.limit:
            self.known.clear(), self.plain.clear()
        new = set().union(*(p[1:] for p in tight.values())).difference(self.known)
        self._learn(list(new))
        new = list({p[0] for p in tight.values()}.union(*loose.values()).difference(self.plain))
        self.plain.update(zip(new, self._ids(new)))
        out = [b""] * len(texts)
        for i, p in tight.items():
            head = p[0]
            out[i] = self.plain[head] + b"".join(map(self.known.__getitem__, p[1:]))
        for i, p in loose.items():
            out[i] = b"".join(map(self.plain.__getitem__, p))
        for i, ids in zip(odd, self._ids([texts[i] for i in odd])):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}
_idle: list[threading.Timer] = []


def encoder(path: str) -> Encoder:
    while _idle:
        _idle.pop().cancel()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _forget() -> None:
    _encoders.clear()  # a task that runs holds its own
    hand_back()


def done() -> None:
    """Spark keeps workers for other stages; what this one remembers leaves them unless a task follows soon."""
    _idle.append(threading.Timer(IDLE, _forget))
    _idle[-1].daemon = True
    _idle[-1].start()


def cuts(n: int, size: int) -> np.ndarray:
    """Starts of the pieces of n ids: only the first may be shorter than size."""
    if n <= size:
        return np.zeros(1, np.int64)
    head = n % size
    return np.concatenate([[0], np.arange(head, n, size)]) if head else np.arange(0, n, size)


def tokenized(docs: DataFrame, path: str, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece, and row, a number of its document's own."""
    ending = np.array([end], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    part = batch.slice(low, 256)
                    ids = encode([x or "" for x in part.column(1).to_pylist()])
                    at, piece, start, length, crc, held = [], [], [], [], [], []
                    for i, b in enumerate(ids):
                        b += ending
                        starts = cuts(len(b) // 4, size).tolist()
                        for j, (s, e) in enumerate(zip(starts, [*starts[1:], len(b) // 4])):
                            own = b[4 * s : 4 * e]
                            at.append(i), piece.append(j), start.append(s), length.append(e - s), crc.append(zlib.crc32(own))
                            if keep_ids:
                                held.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                    cols = [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                    cols.append(part.column(2).take(pa.array(at, pa.int64())))
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
                    if keep_ids:
                        cols.append(pa.array(held, pa.list_(pa.int32()))), names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            done()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * keep_ids
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id())
    return own.mapInArrow(tidy(work), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the total is the largest that is at most room; longer ones first."""
    reach, mask, stages = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        most, take = min(counts[length], room // length), 1
        while most > 0:
            take = min(take, most)
            stages.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            most -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(stages):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often}) patterns that use up the counts."""
    counts, patterns = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        pattern = fullest({k: v for k, v in rest.items() if v and k <= size - longest}, size - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        patterns.append((times, pattern))
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return patterns


def slots(patterns) -> np.ndarray:
    """Columns length, first number, how often in a pattern, first sequence, offset; by length and first number."""
    rows, used, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def numbered(pieces: DataFrame, parts: int) -> DataFrame:
    """Adds number: 0, 1, ... within each length. Lengths are dealt to salted parts whose counts give their starts."""
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)).cast("int"))
    held = materialize(salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "pack-parts")
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")
    starts = held.select("length", "_part", before.alias("_first"))
    if held.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    order = W.partitionBy("length", "_part").orderBy("row", "piece")
    ranked = salted.withColumn("_r", F.row_number().over(order) - 1).join(starts, ["length", "_part"])
    return ranked.withColumn("number", F.col("_first") + F.col("_r")).drop("_part", "_r", "_first")


def pack(
    docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, keep_ids: bool = False
) -> DataFrame:
    """Every piece with its sequence_id and offset; with keep_ids its ids too, which sequences() joins up.

    row is a number that the pieces of one document share, and no other's, so copies of a document can be told apart.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = materialize(tokenized(docs, path or public_tokenizers.path(TOKENIZER), size, end, keep_ids), "pack")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    table = spark.sparkContext.broadcast(slots(plan(counts, size)))
    ranked = numbered(pieces, max(16, -(-max(counts.values(), default=0) // PART)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *(["ids"] if keep_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, often, sequence, offset = table.value.T
        key = (length << 50) + first
        for b in batches:
            own, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(key, (own << 50) + number, side="right") - 1
            turn = number - first[at]
            cols = [b.column(c) for c in columns]
            cols += [pa.array(sequence[at] + turn // often[at]), pa.array(offset[at] + turn % often[at] * own)]
            yield pa.RecordBatch.from_arrays(cols, [*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * keep_ids
    return ranked.select(*columns, "number").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: at most size tokens a group, in order of offset."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
