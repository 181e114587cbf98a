from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import secrets

HEX40 = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
#: The contract's patterns, as they stand there.
PLAIN = (
    (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    (r"AKIA[A-Z0-9]+", 0, 16),
    (r"[0-9a-f]+", 0, 32),
)


def plain(text):
    """(first, kind, last) by scanning with the contract's patterns and dropping matches that fail."""
    out = []
    for kind, (pattern, group, least) in enumerate(PLAIN):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(out)


CASES = [
    "", None, "nothing here", f'token = "{HEX40}"', f"TOKEN={HEX40.upper()}", "password: short", "token=secret: abcdefgh1", "token=secret=abcdefgh",
    "api_key  =  'abcdefgh'", "apikey:abcdefg", "ApI_KeY:\"abcdefgh", "password \n= abcdefgh", "paſſword=abcdefgh", "toKen=abcdefgh",
    "AKIAABCDEFGH1234", "AKIAABCDEFGH123", "xAKIAABCDEFGH1234y AKIAAKIAAKIAAKIA_", "AKIA" * 3, "AKIA" * 5, f"a{HEX40}g{HEX40}", "f" * 31, "f" * 32,
    f"é\U0001f600 {HEX40} é secret='{HEX40}'", "secretsecret=abcdefghi", "token==abcdefgh", "password=' abcdefgh", "İ token=abcdefgh", f"passwd={'a' * 5_000}",
]


@pytest.mark.parametrize("text", CASES)
def test_base_findings(text):
    found = secrets.base_spans(text, secrets.runs(text)) if text else []
    assert [s[:3] for s in found] == plain(text)


def test_base_findings_on_random_texts():
    rng = np.random.default_rng(1)
    parts = ["token", "secret", "pass", "word", "wd", "api", "_", "key", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH", "1234", "abcdef0123456789", "\n", "é", "Q", "-"]
    for _ in range(4_000):
        text = "".join(rng.choice(parts, rng.integers(1, 30)))
        assert [s[:3] for s in secrets.base_spans(text, secrets.runs(text))] == plain(text)


def corpus(n=400, seed=3):
    """Texts of words, mail addresses and dates, a third of which hold a secret."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abdeilnorstu"), rng.integers(2, 14)))
    out = []
    for i in range(n):
        words = [word() for _ in range(30)]
        words[5] = f"{word()}.{word()}@mail{i % 9}.example.com"
        words[9] = f"2024-0{i % 9 + 1}-1{i % 9}T10:2{i % 9}:00"
        if i % 3 == 0:
            key = "".join(rng.choice(list("0123456789abcdef"), 40))
            words[20] = f'token = "{key}"'
        out.append((i, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4)
    return secrets.train(secrets.findings(docs.select("text")))


def test_scores_held_out(spark, trained):
    """Findings of documents it never saw score high, in their place and bare; other candidates low."""
    good, clean = [], []
    for _, text in corpus(300, seed=9):
        places = secrets.runs(text)
        base = secrets.base_spans(text, places)
        good += [secrets.window(text, s[3], s[2]) for s in base if s[1] == 0]
        clean += [secrets.window(text, *p) for p in secrets.candidates(places, base)]
    assert len(good) == 100 and len(clean) > 300
    for windows in (good, [secrets.bare(w) for w in good]):
        assert (trained.scores(windows) >= trained.thresholds_of(windows)).mean() >= 0.85
    assert (trained.scores(clean) >= trained.thresholds_of(clean)).mean() <= 0.005
    assert trained.scores(good).min() > trained.scores(clean).mean()


def test_network_adds_what_no_pattern_names(spark, trained):
    """30 hex characters are too few for the pattern; clean rows stay clean."""
    docs = spark.createDataFrame([(1, f'mein token " = "{HEX40[:30]}" und'), (2, "plain words and user.name@mail3.example.com only"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.scan(docs, trained).collect()}
    assert [(s.kind, s.text) for s in rows[1].added] == [("network", HEX40[:30])] and not rows[1].base
    assert not rows[2].added and not rows[2].base and not rows[3].added and not rows[3].base


def test_pooling_matches_a_plain_convolution(trained):
    windows = [secrets.window("abc " + "x1y2z3" * k + " def", 4, 4 + 6 * k) for k in (2, 3, 50)]
    long = [secrets.window("q7" * 60_000, 0, 120_000)]
    for w, x in zip(windows + long, np.concatenate([trained.pooled(windows), trained.pooled(long)])):
        c = [min(ord(ch), 127) for ch in w]
        h = np.stack([trained.bias + sum(trained.table[k][c[i + k - 2]] for k in range(5)) for i in range(2, len(c) - 2)])
        a = np.maximum(h, 0)
        inner = a[secrets.BEFORE : len(a) - secrets.AFTER]
        around = np.concatenate([a[: secrets.BEFORE], a[-secrets.AFTER :]])
        assert np.allclose(x, np.concatenate([inner.max(0), inner.mean(0, dtype=float), around.max(0)]), rtol=5e-3, atol=1e-4)


def test_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(0)
    own = [0.3 * rng.normal(size=s) for s in ((5, 128, 16), (16,), (48, 12), (12,), (13,))]
    windows = [secrets.window(t, 3, len(t) - 2) for t in ("abc hello1234 x", "zz9 password=1q2w3e4r!!", "qwertyuiopasdfgh")]
    y, weigh = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])

    def loss(p):
        z = secrets.Network(*p)
        x = np.zeros(0)
        codes, (first, last, _, _) = secrets.codes_of(windows), secrets.regions(windows)
        a = np.maximum(np.stack([p[1] + sum(p[0][k][codes[i + k - 2]] for k in range(5)) for i in range(2, len(codes) - 2)]), 0)
        x = []
        for i in range(3):
            left, own_, right = (a[first[3 * i + j] - 2 : last[3 * i + j] - 2] for j in range(3))
            x.append(np.concatenate([own_.max(0), own_.mean(0), np.maximum(left.max(0), right.max(0))]))
        z = np.tanh(np.array(x) @ p[2] + p[3]) @ p[4][:-1] + p[4][-1]
        return float((weigh * np.logaddexp(0, np.where(y == 1, -z, z))).sum())

    grads = secrets._step(secrets.Network(*own), windows, y, weigh)
    for j, g in enumerate(grads):
        flat = np.argsort(-np.abs(g).ravel())[:4]
        for at in flat:
            step = [p.copy() for p in own]
            step[j].ravel()[at] += 1e-5
            back = [p.copy() for p in own]
            back[j].ravel()[at] -= 1e-5
            assert abs((loss(step) - loss(back)) / 2e-5 - g.ravel()[at]) < 1e-3 * max(1, abs(g.ravel()[at]))


def test_query(spark, tmp_path):
    rows = corpus() + [(9_000 + i, t) for i, t in enumerate(CASES)] + [(None, CASES[3]), (3, corpus()[3][1]), (9_500, "ab " * 400_000 + f"token='{HEX40}'")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.withColumns({c: F.lit("x") for c in ("label", "hash", "window", "n", "base", "added", "kind", "spans")})
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in secrets.op12_secrets(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == len(rows)
    names = ("assign", "access", "hex")
    want, shown = [], []
    for i, text in rows:
        found = plain(text)
        joined = ",".join(f"{names[k]}:{a}:{z}" for a, k, z in found)
        want.append((i, *(sum(s[1] == k for s in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
        shown.append((i, joined))
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    for i, *_, spans, added in got:
        base = [x for x in spans.split(",") if x and not x.startswith("network")]
        assert (i, ",".join(base)) in shown and len(base) + added == len([x for x in spans.split(",") if x])


def test_no_findings_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "just words"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "a/documents.parquet"))
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, secrets.op12_secrets(spark, str(tmp_path / "a")).collect())) == [(i, 0, 0, 0, empty, "", 0) for i in (1, 2, 3)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "b/documents.parquet"))
    assert secrets.op12_secrets(spark, str(tmp_path / "b")).count() == 0


def test_training_does_not_depend_on_partitions(spark, trained):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").coalesce(1)
    again = secrets.train(secrets.findings(docs.select("text")))
    assert np.array_equal(again.table, trained.table) and again.thresholds == trained.thresholds


def test_every_window_is_learned_from_or_kept(spark, monkeypatch):
    """At most 2,000 windows of a label, none over 1,000 characters, were before."""
    texts = [f"see item{i:07d}x and more" for i in range(2_600)] + [f"token={i:08x}" + "x" * 1_500 * (i % 9 == 0) for i in range(2_300)] + ["see item0000001x and more"] * 9
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    found, seen = secrets.findings(docs), []
    take = lambda frame: [(r.shard, w.window, w.label) for r in frame.collect() for w in r.windows]
    monkeypatch.setattr(secrets, "SHARD", 100_000)
    monkeypatch.setattr(secrets, "fit", lambda dealt, balance: seen.append((take(dealt), balance)))
    monkeypatch.setattr(secrets, "calibrated", lambda kept, net, share: seen.append((take(kept), share)))
    secrets.train(found)
    (learned, balance), (kept, share) = seen
    own = [(w, label) for _, w, label in learned + kept]
    want = {(secrets.window(t, a, len(t)), 1) for t in texts if (a := t.find("=") + 1)} | {(secrets.window(t, 4, 16), 0) for t in texts if t[0] == "s"}
    assert len(own) == len(want) == 4_900 and set(own) == want
    assert len({s for s, _, _ in learned}) > 3 and 0.1 < len(kept) / len(own) < 0.3
    ones = sum(label for _, _, label in learned)
    assert np.allclose(balance, (0.5 * len(learned) / (len(learned) - ones), 0.5 * len(learned) / ones)) and share == 2_300 / 4_909


def test_shards_do_not_depend_on_partitions(spark, monkeypatch):
    """Several shards' networks are averaged alike, whatever task has them, and tell secrets as one's does."""
    monkeypatch.setattr(secrets, "SHARD", 20_000)
    nets = [secrets.train(secrets.findings(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(n).select("text"))) for n in (1, 5)]
    assert np.array_equal(nets[0].table, nets[1].table) and nets[0].thresholds == nets[1].thresholds
    good, clean = [], []
    for _, text in corpus(300, seed=9):
        places = secrets.runs(text)
        base = secrets.base_spans(text, places)
        good += [secrets.window(text, s[3], s[2]) for s in base if s[1] == 0]
        clean += [secrets.window(text, *p) for p in secrets.candidates(places, base)]
    assert (nets[0].scores(good) >= nets[0].thresholds_of(good)).mean() >= 0.85
    assert (nets[0].scores(clean) >= nets[0].thresholds_of(clean)).mean() <= 0.005


def test_gradients_of_long_windows(monkeypatch):
    """Candidates over SPAN were not learned from before."""
    p = secrets._parts(secrets.begun()[: (len(secrets.begun()) - 1) // 3])
    windows = [secrets.window(t, 3, len(t) - 2) for t in ("abc " + "hello1234" * 30 + " x", "zz9 password=1q2w3e4r!!", "k" * 90)]
    y, weigh = np.array([1.0, 0.0, 1.0], np.float32), np.full(3, 0.3, np.float32)
    whole = secrets._step(secrets.Network(*p), windows, y, weigh)
    monkeypatch.setattr(secrets, "SPAN", 16)
    for a, b in zip(whole, secrets._step(secrets.Network(*p), windows, y, weigh)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-6)


def test_ranks(spark):
    x = np.random.default_rng(2).normal(0, 5, 500).astype(np.float32)
    x[:50] = x[50:100]
    keys = secrets.keys_of(x)
    assert [secrets.logit_of(k) for k in sorted(keys.tolist())] == sorted(x.tolist())
    own = spark.createDataFrame([(k,) for k in keys.tolist()], "key long")
    assert [secrets.ranked(own, r) for r in (0, 25, 250, 499)] == [sorted(keys.tolist())[r] for r in (0, 25, 250, 499)]


def test_long_findings_alone_are_learned_from(spark):
    """There was no network before where all findings were over 1,000 characters."""
    texts = [f"see item{i:07d}x and more" for i in range(300)] + [f"token={i:08x}" + "x9" * 800 for i in range(300)]
    net = secrets.train(secrets.findings(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert net is not None
