from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quern.llm import line_dedup, mixing, packing, parity_join, toxicity

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows):
    """(id, size, component) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[root(i)] = min(a, least.get(root(i), a))
    return sorted(((a, len(x), None if a is None else least[root(i)]) for i, (a, x) in enumerate(sets)), key=repr)


def changed(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    rows, i = [], 0
    passage = [word() for _ in range(60)]
    for size in (3, 5, 6, 9, 20, 40, 80, 300):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for share in (0, 0, 0.01, 0.03, 0.05, 0.06):
                rows.append((i, " ".join(changed(rng, base, share))))
                i += 1
            rows.append((i, " ".join(base[: -max(1, size // 8)]).upper()))
            i += 1
        rows.append((i, " ".join(passage + [word() for _ in range(size)])))
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n int, cls string")
    got = parity_join.near_duplicates(frame).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t"), (4, "x"), (5, "X"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "A b C d e f"), (8, "É b c d e f"), (9, "é b c d e f")]
    rows += [(20 + i, " ".join(changed(rng, base, 0.01 * (i % 3)))) for i in range(90)]
    monkeypatch.setattr(parity_join, "CELL", 20)  # many cells and groups
    monkeypatch.setattr(parity_join, "EXACT", 9)
    monkeypatch.setattr(parity_join, "NOTED", 2)
    monkeypatch.setattr(parity_join, "MEMBERS", 7)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, parity_join.near_duplicates(frame).collect()), key=repr) == plain(rows)
    assert parity_join.near_duplicates(frame.limit(0)).count() == 0


def test_large_groups(spark, monkeypatch):
    """Near copies by the thousand, and a passage that a third of the rows share: all links, and few rows on the way."""
    rng, made = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2_500):  # one word of 60 changed: 51 of 61 shingles shared with the base
        own = list(base)
        own[rng.randrange(60)] = word()
        rows.append((i, " ".join(own)))
    rows += [(10_000 + i, " ".join(passage + [word() for _ in range(50)])) for i in range(1_500)]
    rows += [(20_000 + i, " ".join(word() for _ in range(50))) for i in range(500)]
    monkeypatch.setattr(parity_join, "CELL", 300)
    for name in ("verified", "components"):
        own = getattr(parity_join, name)
        monkeypatch.setattr(parity_join, name, lambda frame, *rest, own=own: made.append(frame.count()) or own(frame, *rest))
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 2_500 else i for i, _ in rows}
    assert max(made) < 20 * len(rows)


def test_long_words():
    a, b = "Ab" * 3_000, "ab" * 3_000
    assert parity_join.word_hashes(f"x {a} y").tolist() == parity_join.word_hashes(f"x {b} y").tolist()
    bits = [bin(i).count("1") % 2 for i in range(4_096)]  # a word and its complement, which a polynomial modulo 2^64 confuses
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    assert parity_join.word_hashes(one)[0] != parity_join.word_hashes(two)[0]


def test_pigeonhole_and_bounds():
    """Linked sets share a posted block, and sketches never exaggerate the difference."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        shared = rng.integers(0, 2**63, n, dtype=np.uint64)
        extra = [rng.integers(0, 2**63, int(rng.integers(0, 2 + n // 4)), dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.r_[shared, e]) for e in extra)
        both, apart = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        if 100 * both >= 75 * (both + apart) and apart:
            assert len(np.intersect1d(parity_join.posted_blocks(a), parity_join.posted_blocks(b)))
            known = np.unique(np.r_[shared[::2], extra[0][::3]])
            hot = (known, rng.integers(1, 9, len(known)).astype(np.int8))
            assert len(np.intersect1d(parity_join.posted_blocks(a, hot), parity_join.posted_blocks(b, hot)))
        size, words = parity_join._levels([parity_join.bit_sketch(a), parity_join.bit_sketch(b)])
        w = words[int(size.min())]
        assert np.bitwise_count(w[0] ^ w[1]).sum() <= apart


def test_words_are_those_of_the_pattern():
    for t in ("A\x0bb\x0cC  é\x1cx\x85y\xa0z\n", "", " ", "Ä A"):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
        assert parity_join.word_hashes(t).tolist() == [parity_join.word_hashes(w)[0] for w in words]


def test_components(spark):
    rng = random.Random(4)
    chain = [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(60)]
    pairs = chain + [(f"z{rng.randint(0, 80):04d}".encode(), f"z{rng.randint(0, 80):04d}".encode()) for _ in range(60)]
    got = {bytes(r.node): bytes(r.label) for r in parity_join.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(200):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert sorted(map(tuple, parity_join.op3_parity_join(spark, SF).collect())) == sorted(c.sql(parity_join.SQL).fetchall())


def test_pipeline_matches_its_stages_done_plainly(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    weights = toxicity._Weights(model.weights)
    docs = [r for r in raw.collect() if -np.expm1(-toxicity.sentence_masses(r.text, weights, model.bias).sum()) < 0.5]
    seen, texts = set(), {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        ls, gone = r.text.split("\n"), set()
        for p in range(len(ls) - 2):
            gone |= {p, p + 1, p + 2} if tuple(ls[p : p + 3]) in seen else set()
            seen.add(tuple(ls[p : p + 3]))
        texts[r.doc_id] = "\n".join(x for p, x in enumerate(ls) if p not in gone)
    kept = {i for i, _, c in plain(list(texts.items())) if i == c}
    stage = corpus_pipeline.STAGES
    assert [n for n, _ in stage] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    frame = raw
    for (name, f), want in zip(stage[:3], ({r.doc_id for r in docs}, set(texts), kept)):
        frame = f(spark, frame, SF)
        assert frame.columns == raw.columns and frame.dtypes == raw.dtypes
        rows = {r.doc_id: r.text for r in frame.collect()}
        assert set(rows) == want
        assert name == "toxicity" or all(rows[i] == texts[i] for i in rows)
        frame = spark.createDataFrame(frame.collect(), raw.schema)
    mixed = mixing.mix_sources(frame).collect()
    size = {r.doc_id: r["size"] for r in mixed}
    copies = {r.doc_id: r.taken // r["size"] for r in mixed if r["size"]}
    encode = packing.Encoder(packing.public_tokenizers.path(packing.TOKENIZER))
    want = sorted((i, p) for i, n in copies.items() for p in range(len(packing.cuts(len(encode([texts[i]])[0]) // 4 + 1, 1024))) for _ in range(n))
    got = sorted((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect() if size[r.doc_id])
    assert got == want


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(1, None, None, None, None, 1.0), (2, "", "en", "a", 0, 1.0), (None, "x y", "en", "a", 3, 1.0), (3, "a b c d e f", "en", "b", 11, 1.0), (3, "a b c d e f", "en", "b", 11, 1.0)]
    for i, own in enumerate((rows, [])):
        d = tmp_path / str(i)
        spark.createDataFrame(own, schema).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        assert (corpus_pipeline.run(spark, str(d)).count() > 0) == bool(own)
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_keeps_one_of_each_group_where_ids_repeat(spark):
    text = lambda k, end="": " ".join(f"{k}{i}" for i in range(60)) + end
    rows = [(3, text("a")), (7, text("a", " more")), (7, text("b")), (7, text("c")), (7, text("c", " more")), (9, text("d")), (9, text("e")), (9, text("e")), (None, text("a"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text.split()[0]) for r in corpus_pipeline.keep_one_of_each_group(spark, frame, SF).collect()]
    assert sorted(got, key=repr) == sorted([(3, "a0"), (7, "b0"), (7, "c0"), (9, "d0"), (9, "e0")], key=repr)


def test_pipeline_compares_rows_without_an_id(spark):
    """A row with an id comes before those without; of these one stays. Texts that are not alike all stay."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (5, text("a") + " more"), *[(None, text("b"))] * 3, (None, text("b") + " more"), (None, text("c")), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text and r.text.split()[0]) for r in corpus_pipeline.keep_one_of_each_group(spark, frame, SF).collect()]
    assert sorted(got, key=repr) == sorted([(5, "a0"), (None, "b0"), (None, "c0"), (None, None)], key=repr)
