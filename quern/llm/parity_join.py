"""Near duplicates by a parity-sketch join on word shingles.

A document's shingles are hashed to 64 bits and dealt to the blocks of a sketch by their hash; a block is the XOR
of its shingles' codes. So a shingle that only one of two documents has changes one block, and the number of
blocks that differ is at most the symmetric difference. A Jaccard similarity of s bounds that difference by
(a + b)(1 - s)/(1 + s) for sizes a and b; call the bound d. A sketch has enough blocks that more than d non-empty
ones are there; one of them must then be equal in both (the pigeonhole). All documents put blocks in one order, and
post the first d + 1 of theirs: of the blocks that two linked documents share, the first is among these in both,
since at most d others come before it. The order puts blocks of frequent shingles last, so a passage that a third
of all documents share is posted only by those that hold little else. Where a document has too few non-empty blocks
it posts them all, and a sketch of twice as many, and so on; its partner does too, or has enough itself. Sketches
are made per band of sizes, [2^k, 2^(k+1)), and once more across each border.

Equal blocks meet in buckets, and each bucket's members are filed under its least one, its head, so that buckets
that share a head are one. Members are compared by bit sketches (each shingle flips one bit, so their Hamming
distance also is at most the difference) in three steps. First chunk by chunk, with the head in each: a member that
an earlier one may link with is left to it. Every such pair is verified on the sets of 64-bit hashes, so near copies,
however many, are linked by about as many pairs as there are copies. Then, under heads that still hold several
components, the members outside the largest are held against all others in cells of bounded size, and those that
may link with another component are noted, one row a member. At last these are compared by their sets, and a cell
gives the links that join its components, fewer than it has members. No step emits all pairs of a group.

Documents with equal sets are one class throughout, so exact copies, however many, cost one member.

The order's frequencies are counted over every text: a task notes shingles that NOTED of the classes it holds at a
time share, Spark adds the counts up, and the HOT most frequent are known to all. Any order gives the same links.

Defined results: null, empty and blank texts have 0 shingles and a component of their own; a null id has no
component and links with nothing; repeated rows are copies; where an id has several texts each row counts, and
they share what they link with; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.memory import bound_batches, tidy
from quern.session import discard, materialize, release

WORDS = 5
#: Linked when OF * intersection >= AT_LEAST * union.
AT_LEAST, OF = 75, 100
#: Blocks of a sketch for each shingle of the band's largest set: 1 - e^(-1/x) of x blocks are filled, and a third must be.
BLOCKS = 0.37
#: Posted blocks in a bucket table's part, and in a task's memory before they leave it.
PART, FLUSH = 400_000, 2_000_000
#: Shingles that so many classes of a flush share are counted, and so many of the most frequent order the blocks.
NOTED, HOT = 8, 200_000
#: Rows of one chunk of a comparison cell, by bit sketches and by sets, and of a group to verify, about.
CELL, EXACT, MEMBERS = 512, 512, 256
#: Classes to look up, or large heads, that are broadcast (32 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 300_000
#: Bytes of a word beyond which it is hashed by xxhash.
LONG_WORD = 256
_A, _B, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x5851F42D4C957F2D)
_U32 = np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> _U32)


_SEED = np.random.default_rng(23)
#: A random odd code for every byte; capital A-Z share the small letters'.
_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Powers:
    """Powers of _P and of its inverse modulo 2^64, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            grow = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)])
            self.up, self.down = grow(_P), grow(np.uint64(pow(int(_P), -1, 2**64)))
        return self.up, self.down


_powers = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, that is runs of other than ASCII blanks, lower-cased in A-Z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = np.r_[True, _BLANK[raw], True]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, after = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[raw] * up[: len(raw)], out=sums[1:])
    out = _mixed((sums[after] - sums[first]) * down[first])
    for i in np.flatnonzero(after - first > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : after[i]].tobytes().translate(_LOWER))
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the word shingles."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    if len(w) < words:  # the whole sequence, with its length
        h = np.array([len(w)], np.uint64) * _B
        for i in range(len(w)):
            h = h * _P + w[i : i + 1]
    else:
        h = w[: len(w) - words + 1].copy()
        for i in range(1, words):
            h = h * _P + w[i : len(w) - words + 1 + i]
    return np.unique(_mixed(h))


def class_of(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _most(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (OF - AT_LEAST) // (OF + AT_LEAST)


def frequency(own: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The level of every shingle: 0, or for those known as frequent the length of their count in bits."""
    known, level = hot
    if not len(known):
        return np.zeros(len(own), np.int8)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return np.where(known[at] == own, level[at], 0).astype(np.int8)


NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int8))


def posted_blocks(own: np.ndarray, hot: tuple[np.ndarray, np.ndarray] = NONE) -> np.ndarray:
    """64-bit names of the blocks under which a set is posted. hot: shingles, ascending, and their levels."""
    n = len(own)
    k = n.bit_length() - 1
    low, high = 1 << k, (1 << k + 1) - 1
    larger = n * OF // AT_LEAST  # the largest size that can link
    smaller = -(-n * AT_LEAST // OF)
    plans = [(3 * k, high, min(larger, high))]
    if larger > high:  # with the next band
        plans.append((3 * k + 1, high, larger))
    if smaller < low:  # with the band below: the border is that band's
        plans.append((3 * (k - 1) + 1, low - 1, low - 1))
    codes, levels, out = _mixed(own ^ _P), frequency(own, hot), []
    some = levels.any()
    for plan, most, partner in plans:
        blocks, level, apart = max(1, int(np.ceil(BLOCKS * most))), 0, _most(n, max(n, partner))
        while True:
            at = (own >> _U32) * np.uint64(blocks) >> _U32  # ascending, as the hashes are
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            block = np.bitwise_xor.reduceat(codes, starts)
            name = _mixed(block ^ _mixed(np.array([plan * 64 + level], np.uint64) * _B + at[starts] * _A))
            if len(starts) <= apart:
                out.append(name)
                blocks, level = 2 * blocks, level + 1
                continue
            if some:  # a block is as frequent as its rarest shingle, at most
                order = np.lexsort((name, np.minimum.reduceat(levels, starts)))
                out.append(name[order[: apart + 1]])
            else:
                out.append(np.partition(name, apart)[: apart + 1])
            break
    return np.concatenate(out)


def bit_sketch(own: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each of the least power of two of at least 3 bits a shingle."""
    bits = max(8, (3 * len(own) - 1).bit_length())
    at = (_mixed(own + _A) >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=1 << bits) & 1).tobytes()


def set_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, n, cls (128-bit hash of the set; null if empty), bits of every row; shingle, many counts."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = ["doc_id", "n", "cls", "bits", "shingle", "many"]

    def noted(held: list[np.ndarray]) -> pa.RecordBatch:
        u, many = np.unique(np.concatenate(held), return_counts=True)
        u, many = u[many >= NOTED].view(np.int64), many[many >= NOTED]
        none = [None] * len(u)
        return pa.RecordBatch.from_arrays([*[pa.array(none, k) for k in kinds[:4]], pa.array(u), pa.array(many.astype(np.int64))], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        for b in batches:
            for low in range(0, b.num_rows, 1_000):
                part, rows = b.slice(low, 1_000), []
                for text in part.column(1).to_pylist():
                    own = shingles(text)
                    rows.append((len(own), class_of(own) if len(own) else None, bit_sketch(own) if len(own) else None))
                    if len(own) and rows[-1][1] not in seen:
                        seen.add(rows[-1][1])
                        held.append(own)
                        total += len(own)
                    if total > FLUSH:
                        yield noted(held)
                        held, total = [], 0
                        seen.clear()
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:4])]
                none = pa.array([None] * part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, none, none], names)
        if held:
            yield noted(held)

    found = docs.mapInArrow(tidy(work), "doc_id long, n long, cls binary, bits binary, shingle long, many long")
    found = materialize(found, "sets-of-docs")
    return found.where("n is not null").select(*names[:4]), found.where("n is null").select(*names[4:])


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The HOT most frequent shingles, ascending, and their levels: 9 bytes each on the driver."""
    rows = counts.groupBy("shingle").agg(F.sum("many").alias("many")).orderBy(F.col("many").desc(), "shingle").limit(HOT).collect()
    known = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    level = np.array([r.many.bit_length() for r in rows], np.int8)
    order = np.argsort(known)
    return known[order], level[order]


def post(docs: DataFrame, parts: int, hot: tuple[np.ndarray, np.ndarray] = NONE) -> DataFrame:
    """part, names, tags: posted blocks, packed 5 bytes each, beside the first 5 bytes of their classes.

    A few packed rows a task instead of one row a block keep the shuffle to 10 bytes a block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def packed(names: list[np.ndarray], tags: list[np.ndarray]) -> pa.RecordBatch:
        name, tag = np.concatenate(names), np.concatenate(tags)
        part = ((name >> np.uint64(44)) * np.uint64(parts) >> np.uint64(20)).astype(np.int64)
        order = np.lexsort((tag, name))
        name, tag, part = name[order], tag[order], part[order]
        fresh = np.r_[True, (name[1:] != name[:-1]) | (tag[1:] != tag[:-1])]
        name, tag, part = name[fresh], tag[fresh], part[fresh]
        return pa.RecordBatch.from_arrays(_cut(part, name, tag), ["part", "names", "tags"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tags, held, known = [], [], 0, shared.value
        for b in batches:
            for text in b.column(1).to_pylist():
                own = shingles(text)
                if len(own) > 1:  # one shingle links with its copies only
                    names.append(posted_blocks(own, known))
                    tags.append(np.full(len(names[-1]), int.from_bytes(class_of(own)[:5], "little"), np.uint64))
                    held += len(names[-1])
                    if held > FLUSH:
                        yield packed(names, tags)
                        names, tags, held = [], [], 0
        if names:
            yield packed(names, tags)

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(tidy(work), "part int, names binary, tags binary")


def _five(x: np.ndarray) -> np.ndarray:
    """The first five bytes of each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _wide(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def _cut(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    """One row of packed numbers for each part; part ascends."""
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[starts[1:], len(part)]
    cut = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())
    return [pa.array(part[starts].astype(np.int32)), cut(_five(a)), cut(_five(b))]


def _buckets(cell: pa.Table, parts: int) -> pa.Table:
    """part, heads, tags: each bucket's least tag beside every tag of the bucket, in one part of the bucket table.

    Buckets of two near copies are in many parts of that table, so pairs are packed and dealt again by their head.
    """
    name, tag = _wide(cell.column("names")), _wide(cell.column("tags")).astype(np.int64)
    order = np.lexsort((tag, name))
    name, tag = name[order], tag[order]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (tag[1:] != tag[:-1])
    name, tag = name[fresh], tag[fresh]
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    starts = np.flatnonzero(first)
    size = np.diff(np.r_[starts, len(name)])
    head = np.repeat(tag[starts], size)
    many = np.repeat(size > 1, size)
    head, tag = head[many], tag[many]
    part = (_mixed(head.view(np.uint64)) >> _U32).astype(np.int64) * parts >> 32
    order = np.lexsort((tag, head, part))
    part, head, tag = part[order], head[order], tag[order]
    fresh = np.r_[True, (head[1:] != head[:-1]) | (tag[1:] != tag[:-1])][: len(head)]
    cols = _cut(part[fresh], head[fresh], tag[fresh]) if len(head) else [pa.array([], k) for k in (pa.int32(), pa.binary(), pa.binary())]
    return pa.table(cols, ["part", "heads", "tags"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head, tag, each once, of the packed pairs in one partition."""
    both = [np.zeros((2, 0), np.int64)]
    for b in batches:
        both.append(np.stack([_wide(b.column("heads")), _wide(b.column("tags"))]).astype(np.int64))
        if sum(x.shape[1] for x in both) > FLUSH:
            both = [np.unique(np.concatenate(both, axis=1), axis=1)]
    head, tag = np.unique(np.concatenate(both, axis=1), axis=1)
    for low in range(0, len(head), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(head[low : low + 50_000]), pa.array(tag[low : low + 50_000])], ["head", "tag"])


def bucket_heads(posted: DataFrame, parts: int) -> DataFrame:
    """head, tag of every class that shares a posted block with another."""
    wide = "part int, heads binary, tags binary"
    packed = posted.repartition(parts, "part").groupBy("part").applyInArrow(lambda cell: _buckets(cell, parts), wide)
    return packed.repartition(parts, "part").mapInArrow(tidy(_heads), "head long, tag long")


def lookup(docs: DataFrame, wanted: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """cls, data of the wanted classes (cls, first_id): the packed hashes, from one document each.

    With roles (cls, a, part, b) instead a, part, b, data: every role beside its class's data.
    """
    wanted = wanted.select(F.col("cls").alias("_c"), F.col("first_id").alias("_first"))
    if roles is not None:
        own = roles.groupBy(F.col("cls").alias("_c")).agg(F.collect_list(F.struct("a", "part", "b")).alias("_roles"))
        wanted = wanted.join(own, "_c")
    few = wanted.count() <= BROADCAST_ROWS and (roles is None or roles.count() <= BROADCAST_ROWS)
    wanted = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 100):
                part, rows = b.slice(low, 100), []
                own_roles = part.column(2).to_pylist() if roles_too else [None] * part.num_rows
                for text, cls, own_role in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), own_roles):
                    own = shingles(text)
                    if class_of(own) == cls:  # an id may have other texts
                        data = own.tobytes()
                        rows += [(r["a"], r["part"], r["b"], data) for r in own_role] if roles_too else [(cls, data)]
                    while len(rows) >= 200:
                        yield out(rows[:200])
                        rows = rows[200:]
                if rows:
                    yield out(rows)

    names, kinds = (["a", "part", "b", "data"], [pa.binary(), pa.int32(), pa.binary(), pa.binary()]) if roles is not None else (["cls", "data"], [pa.binary()] * 2)
    roles_too = roles is not None
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    near = docs.join(wanted, F.col("doc_id") == F.col("_first")).select("text", "_c", *(["_roles"] if roles_too else []))
    return near.mapInArrow(tidy(work), "a binary, part int, b binary, data binary" if roles_too else "cls binary, data binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of one key after the other, from a partition that is sorted by the keys."""
    own, last = [], None
    for b in batches:
        for row in b.to_pylist():
            key = tuple(row[k] for k in keys)
            if own and key != last:
                yield own
                own = []
            own.append(row)
            last = key
    if own:
        yield own


def _pairs_out(pairs: list[tuple], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(pairs), 10_000):
        cols = zip(*pairs[low : low + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of ascending hashes link."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return OF * shared >= AT_LEAST * (len(a) + len(b) - shared)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b) sorted by a and part, each group led by a's own set, those that link."""
    keep: list[tuple] = []
    last, head = None, None
    for batch in batches:
        for a, part, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "data"))):
            if b is None:
                last, head = (a, part), np.frombuffer(data, np.uint64)
            elif (a, part) == last and links(head, np.frombuffer(data, np.uint64)):
                keep.append((a, b))
        if len(keep) > 10_000:
            yield from _pairs_out(keep, ["a", "b"], [pa.binary()] * 2)
            keep = []
    yield from _pairs_out(keep, ["a", "b"], [pa.binary()] * 2)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by their sets. A group is one a with at most about MEMBERS of its b.

    Sets go straight from the texts to their groups, and are shuffled once.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    own = pairs.join(parts, "a").select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    heads = parts.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"))
    roles = materialize(own.unionByName(heads), "roles")
    wanted = roles.select("cls").distinct().join(classes.select("cls", "first_id"), "cls")
    dealt = lookup(docs, wanted, roles).repartition(_parts(docs.sparkSession), "a", "part")
    dealt = dealt.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = materialize(dealt.mapInArrow(tidy(_linked), "a binary, b binary"), "links")
    discard(roles)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, label (its component's smallest node) of every node of the edges (a, b).

    Each round points every node to its least neighbour, shortens the pointers to their ends, and contracts. A
    table that a round replaces is deleted.
    """
    edges = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"), F.lit(True).alias("moved"))
        up = materialize(up, "pointers")
        while True:
            further = up.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = up.select("a", "to").join(further, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            jumped = materialize(jumped, "pointers")
            discard(up)
            up = jumped
            if up.where("moved").isEmpty():
                break
        a, b = up.select("a", F.col("to").alias("new_a")), up.select(F.col("a").alias("b"), F.col("to").alias("new_b"))
        fewer = edges.join(a, "a").join(b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        fewer = materialize(fewer.where(F.col("a") != F.col("b")).distinct(), "edges")
        renamed = labels.join(a.withColumnRenamed("a", "label"), "label", "left")
        renamed = materialize(renamed.select("node", F.coalesce("new_a", "label").alias("label")), "labels")
        discard(edges, labels, up)
        edges, labels = fewer, renamed
    return labels


def _levels(bits: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Length of each sketch, and for each length the sketches that are as long or longer, folded to it, as 64-bit words.

    Folding adds up neighbouring bits modulo 2, which gives the sketch of half the length.
    """
    size = np.array([8 * len(b) for b in bits])
    out = {}
    for level in sorted(set(size.tolist())):
        words = np.zeros((len(bits), level // 64), np.uint64)
        for i in np.flatnonzero(size >= level):
            r = np.unpackbits(np.frombuffer(bits[i], np.uint8))
            while len(r) > level:
                r = r[0::2] ^ r[1::2]
            words[i] = np.packbits(r).view(np.uint64)
        out[level] = words
    return size, out


def _may_link(n: np.ndarray, size: np.ndarray, words: dict, i: int, other: np.ndarray) -> np.ndarray:
    """Those of the places other that sizes and sketches allow to link with place i; their slack beside them."""
    other = other[(OF * n[other] >= AT_LEAST * n[i]) & (OF * n[i] >= AT_LEAST * n[other])]
    if not len(other):
        return other
    apart = np.empty(len(other), np.int64)
    level = np.minimum(size[other], size[i])
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        own = words[int(k)]
        apart[at] = np.bitwise_count(own[other[at]] ^ own[i]).sum(axis=1, dtype=np.int64)
    return other[(n[other] + n[i]) * (OF - AT_LEAST) // (OF + AT_LEAST) >= apart]


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head, a, b: in each chunk, members in order of size take all later ones that may link and that none took yet."""
    out: list[tuple] = []
    for rows in _groups(batches, ["head", "chunk"]):
        n = np.array([r["n"] for r in rows])
        size, words = _levels([r["bits"] for r in rows])
        free = np.ones(len(rows), bool)
        for i in np.lexsort(([r["cls"] for r in rows], n)):
            if free[i]:
                free[i] = False
                took = _may_link(n, size, words, i, np.flatnonzero(free))
                free[took] = False
                out += [(rows[0]["head"], *sorted((rows[i]["cls"], rows[j]["cls"]))) for j in took]
        if len(out) > 10_000:
            yield from _pairs_out(out, ["head", "a", "b"], [pa.int64(), pa.binary(), pa.binary()])
            out = []
    yield from _pairs_out(out, ["head", "a", "b"], [pa.int64(), pa.binary(), pa.binary()])


def _across(rows: list[dict]):
    """n, sizes, words, and for each place of the left side the places of the right with another label."""
    n, side = np.array([r["n"] for r in rows]), np.array([r["side"] for r in rows])
    label = np.unique([r["label"] for r in rows], return_inverse=True)[1]
    size, words = _levels([r["bits"] for r in rows])
    minor = np.array([r["minor"] for r in rows])
    for i in np.flatnonzero((side <= 0) & minor):
        other = np.flatnonzero((side >= 0) & (label != label[i]))
        yield i, _may_link(n, size, words, i, other), label


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head, cls of the members of each cell that may link with one of another label: at most a row a member."""
    out: list[tuple] = []
    for rows in _groups(batches, ["head", "x", "y"]):
        own = np.zeros(len(rows), bool)
        for i, other, _ in _across(rows):
            if len(other):
                own[i] = own[other] = True
        out += sorted({(rows[0]["head"], rows[i]["cls"]) for i in np.flatnonzero(own)})
        if len(out) > 10_000:
            yield from _pairs_out(out, ["head", "cls"], [pa.int64(), pa.binary()])
            out = []
    yield from _pairs_out(out, ["head", "cls"], [pa.int64(), pa.binary()])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of links, by the sets, that join the labels of each cell: fewer than it has members."""
    out: list[tuple] = []
    for rows in _groups(batches, ["head", "x", "y"]):
        sets = [np.frombuffer(r["data"], np.uint64) for r in rows]
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:  # noqa: B023
                x = up[x]  # noqa: B023
            return x

        for i, other, label in _across(rows):
            for j in other:
                p, q = root(int(label[i])), root(int(label[j]))
                if p != q and links(sets[i], sets[j]):
                    up[p] = q
                    out.append(tuple(sorted((rows[i]["cls"], rows[j]["cls"]))))
        if len(out) > 10_000:
            yield from _pairs_out(out, ["a", "b"], [pa.binary()] * 2)
            out = []
    yield from _pairs_out(out, ["a", "b"], [pa.binary()] * 2)


def _spread(members: DataFrame, sizes: DataFrame, cell: int) -> DataFrame:
    """members with the left and right chunks of their head: 1 and 1 unless it is large. sizes: head, minors, total."""
    large = sizes.where(F.col("total") > cell).select(
        "head", F.greatest(F.lit(1), F.ceil(F.col("minors") / cell)).cast("int").alias("xs"), F.ceil(F.col("total") / cell).cast("int").alias("ys")
    )
    large = materialize(large, "large")  # a row for each cell full of members, at most
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    own = members.join(large, "head", "left")
    return own.withColumn("xs", F.coalesce("xs", F.lit(1))).withColumn("ys", F.coalesce("ys", F.lit(1)))


def _cells(members: DataFrame, cell: int, parts: int) -> DataFrame:
    """members: head, cls, label, and more. Deals each head's members to cells (x, y) of bounded size.

    The members outside a head's largest component are minor: they are the left side, and all are the right.
    Where one cell holds a head, its members are there once, for both sides.
    """
    held = members.groupBy("head", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = held.groupBy("head").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("total"))
    largest = largest.select("head", F.col("m.label").alias("_largest"), F.col("total"), (F.col("total") - F.col("m.n")).alias("minors"))
    largest = materialize(largest, "heads-open")
    own = members.join(largest.select("head", "_largest"), "head").withColumn("minor", F.col("label") != F.col("_largest")).drop("_largest")
    own = _spread(own, largest.select("head", "minors", "total"), cell)
    one = (F.col("xs") == 1) & (F.col("ys") == 1)
    at = F.xxhash64("cls", "head")
    left = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda j: F.struct(F.pmod(at, F.col("xs")).cast("int").alias("x"), j.alias("y"), F.lit(-1).alias("side")))
    right = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda i: F.struct(i.alias("x"), F.pmod(at, F.col("ys")).cast("int").alias("y"), F.lit(1).alias("side")))
    none = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"))
    places = F.when(one, F.array(none)).when(F.col("minor"), F.concat(left, right)).otherwise(right)
    own = own.withColumn("_at", F.explode(places)).select("*", "_at.x", "_at.y", "_at.side").drop("_at", "xs", "ys")
    return own.repartition(parts, "head", "x", "y").sortWithinPartitions("head", "x", "y")


def near_classes(docs: DataFrame, table: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (cls, tag, first_id, n, bits), and node, label of those that link with another."""
    spark = docs.sparkSession
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    posted = post(docs, parts := int(max(8, total // 3 // PART)), frequent(counts))
    heads = materialize(bucket_heads(posted, parts), "heads")
    release(spark)
    classes = table.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull()).groupBy("cls")
    classes = classes.agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.min("bits").alias("bits"))
    tag = F.conv(F.concat(*[F.substring(F.hex("cls"), 2 * i + 1, 2) for i in reversed(range(5))]), 16, 10).cast("long")
    classes = materialize(classes.withColumn("tag", tag), "classes")
    members = materialize(heads.join(classes.select("tag", "cls", "n", "bits"), "tag"), "members")
    discard(heads)
    sizes = members.groupBy("head").agg(F.count(F.lit(1)).alias("total")).withColumn("minors", F.lit(0))
    chunked = _spread(members, sizes, CELL).withColumn("_own", F.pmod(F.xxhash64("cls", "head"), F.col("ys")).cast("int"))
    all_ = F.sequence(F.lit(0), F.col("ys") - 1)  # the head's own class is in every chunk
    chunked = chunked.withColumn("chunk", F.explode(F.when(F.col("tag") == F.col("head"), all_).otherwise(F.array("_own"))))
    dealt = chunked.select("head", "chunk", "cls", "n", "bits").repartition(_parts(spark), "head", "chunk").sortWithinPartitions("head", "chunk")
    found = materialize(dealt.mapInArrow(tidy(_star), "head long, a binary, b binary"), "compared")
    links = verified(found.select("a", "b").distinct(), docs, classes)
    labels = components(links)
    release(spark)
    # heads that may hold another link: those with pairs, and those whose members were not all in one chunk
    again = found.select("head").union(sizes.where(F.col("total") > CELL).select("head")).distinct()
    named = members.join(again, "head", "left_semi").join(labels, F.col("cls") == F.col("node"), "left")
    named = named.select("head", "cls", "n", "bits", F.coalesce("label", "cls").alias("label"))
    named = materialize(named, "named")
    open_ = named.groupBy("head").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("head")
    left = _cells(named.join(open_, "head", "left_semi"), CELL, _parts(spark))
    noted = materialize(left.mapInArrow(tidy(_noted), "head long, cls binary").distinct(), "noted")
    if not noted.isEmpty():
        sets = lookup(docs, noted.select("cls").distinct().join(classes.select("cls", "first_id"), "cls"))
        sets = materialize(sets, "sets")
        last = _cells(named.join(noted, ["head", "cls"], "left_semi"), EXACT, _parts(spark))
        last = last.join(sets, "cls").repartition(_parts(spark), "head", "x", "y").sortWithinPartitions("head", "x", "y")
        more = materialize(last.mapInArrow(tidy(_exact), "a binary, b binary"), "links")
        if not more.isEmpty():
            discard(labels)
            labels = components(links.unionByName(more))
        discard(sets)
    discard(members, found, named, noted)
    return classes, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table, counts = set_table(own)
    classes, labels = near_classes(own, table, counts)
    known = classes.select("cls", "first_id").join(labels, F.col("cls") == F.col("node"), "left")
    known = materialize(known.select("cls", "first_id", F.coalesce("label", "cls").alias("label")), "known")
    least = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = known.join(least, "label").select("cls", "component_id")
    out = table.select("doc_id", "n", "cls").join(named, "cls", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS sh FROM t
), e AS (
  SELECT doc_id, unnest(sh) AS x FROM s
), n AS (
  SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)
), g AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.c FROM r JOIN g ON r.doc_id = g.a
)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id
"""
