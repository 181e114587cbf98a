from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from quern.llm import substring_dedup
from quern.llm.induced_sort import repeated_starts


def plain(rows, span):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - span + 1):
            if count[b[p : p + span]] > 1:
                gone[p : p + span] = True
        runs = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9)))
    part = lambda n: " ".join(word() for _ in range(n))
    passages = [part(n) for n in (10, 20, 40, 60)]
    rows = [(i, part(rng.randint(0, 30)) + rng.choice(passages) * rng.randint(0, 1) + part(rng.randint(0, 30)) + rng.choice(passages)[rng.randint(0, 9) :]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200, "ab" * 400), (201, "x" * 500), (202, "x" * 81), (203, ""), (204, None), (3, rows[3][1]), (None, passages[3])]
    return rows


@pytest.mark.parametrize("seed,memory", [(1, 10**7), (2, 40)])
def test_matches_brute_force(spark, seed, memory):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, spans string")
    got = substring_dedup.removed(frame, span=80, gram=16, shard=3_000, memory=memory, keep_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(rows, 80)
    text = dict(rows)
    for r in got:
        assert sum(s.last - s["first"] for s in r.removed_spans) == r.n_removed
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
        assert r.n_bytes == len((text[r.doc_id] or "").encode())
    assert substring_dedup.removed(frame.limit(0)).count() == 0


def test_query_on_the_test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, substring_dedup.op10_substring_dedup(spark, sf).collect()), key=repr) == plain(rows, 400)


def test_equal_strings_share_their_segment_hash():
    rng = random.Random(5)
    for _ in range(50):
        core = bytes(rng.choice(b"abcd") for _ in range(rng.randint(90, 200)))
        seen = []
        for _ in range(2):
            data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 150))) + core + bytes(rng.choice(b"abcd") for _ in range(60))
            first, n, least, _ = substring_dedup.segments(data, 80, 16)
            assert first[0] == 0 and n.sum() == len(data) - 79
            at = data.index(core)
            seen.append([least[np.searchsorted(first, at + i, side="right") - 1] for i in range(len(core) - 79)])
        assert seen[0] == seen[1]


@pytest.mark.parametrize("memory", [10**9, 3, 20])
def test_induced_sorting(memory):
    """Small memory makes queues spill and names recurse."""
    rng = np.random.default_rng(memory % 97)
    for trial in range(150):
        t = rng.integers(1, 2 + rng.integers(0, 5), rng.integers(1, 200))
        if trial % 3 == 0:
            t = np.concatenate([t, t[: len(t) // 2], t[len(t) // 3 :]])
        cap, t = int(rng.integers(1, 12)), np.r_[t, 0].astype(np.int16)
        count = Counter(t[i : i + cap].tobytes() for i in range(len(t) - cap + 1))
        want = [i + cap <= len(t) and count[t[i : i + cap].tobytes()] > 1 for i in range(len(t))]
        assert repeated_starts(t, cap, memory).tolist() == want


@pytest.mark.parametrize("shard,split", [(3_000, True), (10**9, False)])
def test_a_phrase_of_most_documents_is_split(spark, monkeypatch, shard, split):
    """Its least hash has more than a shard of distinct segments, so its strings are dealt one by one."""
    rng = random.Random(7)
    part = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, passage = part(60), part(200)
    rows = [(i, part(150) + phrase + part(150)) for i in range(80)] + [(100 + i, part(90) + passage + part(90)) for i in range(40)]
    rows += [(200, rows[0][1]), (201, rows[1][1]), (202, "ab" * 3_000), (203, rows[2][1][100:300]), (None, rows[90][1])]
    calls, own = [], substring_dedup._strings
    monkeypatch.setattr(substring_dedup, "_strings", lambda span: calls.append(span) or own(span))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.removed(frame, span=80, gram=16, shard=shard).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 80)
    assert bool(calls) == split


def test_two_thousand_rows_of_one_id_and_text(spark):
    """Equal rows cost what rows with ids of their own cost, and all lose the whole text."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(10_000))
    frame = spark.createDataFrame([(None, text)] * 2_000 + [(1, text[:300]), (2, text[:450])], "doc_id long, text string").repartition(4)
    substring_dedup.removed(frame.limit(2)).collect()
    began = time.time()
    got = substring_dedup.removed(frame).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert time.time() - began < 20
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 10_000, 10_000, 1, 2_000), (1, 300, 0, 0, 1), (2, 450, 450, 1, 1)], key=repr)
