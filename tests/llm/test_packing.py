from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
TEXTS = [
    "a  b", " x", "x ", "a \n b", "\n \n b c", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "a\xa0 b \xa0c", "\x1c a \x1cb", "it's we'll  don't",
    "", None, "a\t b \t c", "é  è\n\n\nx  ", "日本 語  　 x", "\x85 x", " ", "   ", "word " * 3000, "x" * 5000, "be.\nAnd so. And",
]


def reference(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    own = packing.Encoder(PATH, cache=3)
    for group in ([t or "" for t in TEXTS], ["a b c a", "a b"], ["d e f g h", "a b"]):
        assert [np.frombuffer(b, "<u4").tolist() for b in own(group)] == [reference(t) for t in group]


def test_new_words_part_by_part():
    rng, whole = random.Random(6), Tokenizer.from_file(PATH)
    own, slow = packing.Encoder(PATH), packing.Encoder(PATH, cache=50)
    assert own.parts
    letters = list("abcdestrvlm'.,!-09²ªß÷ɏ\t\n  ") + ["'s", "'ll", "中", "٣", "ɐ", "\xa0", "\xad", "😀"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(5_000)]
    texts.append("x " + "".join(rng.choices("ab1,.\n'", k=1_000_000)) + "z")
    for low in range(0, len(texts), 256):
        part = texts[low : low + 256]
        want = [e.ids for e in whole.encode_batch_fast(part, add_special_tokens=False)]
        for encode in (own, slow):
            assert [np.frombuffer(b, "<u4").tolist() for b in encode(part)] == want


@pytest.mark.parametrize("n", [1, 5, 8, 9, 16, 17, 40])
def test_cuts(n):
    starts = packing.cuts(n, 8).tolist()
    sizes = np.diff([*starts, n]).tolist()
    assert starts[0] == 0 and all(s == 8 for s in sizes[1:]) and 0 < sizes[0] <= 8


def test_fullest_is_fullest():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        reach = {0}
        for k, n in counts.items():
            reach = {t + k * i for t in reach for i in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == max(t for t in reach if t <= room)
        assert all(0 < n <= counts[k] for k, n in got.items())


def test_plan_uses_every_piece_and_few_bins():
    rng = np.random.default_rng(4)
    for n in (1, 50, 5000):
        lengths = np.minimum(1024, np.exp(rng.normal(5.5, 1, n)).astype(int) + 1)
        counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
        patterns = packing.plan(counts)
        used = defaultdict(int)
        for times, p in patterns:
            assert sum(k * m for k, m in p.items()) <= 1024
            for k, m in p.items():
                used[k] += k and m * times
        assert used == counts
        least = -(-int(lengths.sum()) // 1024)
        assert sum(t for t, _ in patterns) <= least + max(2, least // 50) or n == 50


def test_pack(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "x y z"), (17, "word " * 3000)] + [(100 + i, "hot text") for i in range(300)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, number int, length string")
    got = packing.pack(frame, size=64, keep_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        raw = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(raw) == r.ids_crc32 and len(r.ids) == r.length <= 64
    for i, t in rows:
        ids = [*reference(t), 2]
        copies = sum(1 for j, _ in rows if j == i)
        own = sorted(by[i], key=lambda r: (r.piece, r.sequence_id))[::copies]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert len(own) == 1 or all(r.length == 64 for r in own[1:])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2
    joined = packing.sequences(packing.pack(frame, size=64, keep_ids=True)).collect()
    assert len(joined) == len(bins) and all(len(r.ids) <= 64 for r in joined)
    assert packing.pack(frame.limit(0)).count() == 0


def test_special_tokens_anywhere():
    parts = ["see", "<|endoftext|>", " ", "  ", "here", "\n", "<|", "|>", "a<|endoftext|>b", "word"]
    rng = random.Random(8)
    texts = ["see <|endoftext|> here", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(300))]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    own, model = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in own(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_at_its_size(spark, tmp_path):
    """op4 at 1024 tokens: ids, cuts and places of long, tiny, null, repeated and special texts."""
    rows = [(1, "word " * 9_000), (2, None), (3, ""), (4, "a <|endoftext|> b"), (4, "a <|endoftext|> b"), (None, "x" * 3_000), *((10 + i, "hot text") for i in range(2_000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op4_packing(spark, str(tmp_path)).collect()
    model = Tokenizer.from_file(PATH)
    want, least = [], 0
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        starts = packing.cuts(len(ids), 1024).tolist()
        own = [ids[a:z].tobytes() for a, z in zip(starts, [*starts[1:], len(ids)])]
        want += [(i, p, a, len(b) // 4, zlib.crc32(b)) for p, (a, b) in enumerate(zip(starts, own))]
        least += len(ids)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]]).tolist()
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert len(bins) <= -(-least // 1024) + 1


def test_copies_are_told_apart(spark, tmp_path):
    """Equal rows have numbers of their own, so (row, piece) is one piece; their salts are many."""
    rows = [(7, "same words " * 700)] * 40 + [(None, None)] * 300
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op4_packing(spark, str(tmp_path)).collect()
    assert len({(r.row, r.piece) for r in got}) == len(got) and len({r.row for r in got}) == 340
    by = defaultdict(set)
    for r in got:
        by[r.row].add(r.doc_id)
    assert all(len(ids) == 1 for ids in by.values())
