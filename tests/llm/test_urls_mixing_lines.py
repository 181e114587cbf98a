from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import line_dedup, mixing, url_filters

SF = "/root/testdata/sf0.001"


def sql_rows(sql, **tables):
    c = duckdb.connect()
    for name, path in tables.items():
        c.execute(f"create view {name} as select * from read_parquet('{path}')")
    return sorted(c.sql(sql).fetchall(), key=repr)


URLS = [
    None, "", "no scheme", "http://", "http://com/", "http://COM", "https://a.com/x?y#z", "http://example.com/en/1", "http://Example.COM/en",
    "http://www.example.com/en/1", "http://m.example.com/en/a/b", "http://xexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://b.net/de/",
    "http://a.com#/en/", "http://example.com?/en/", "x://y://example.com/en/", "http://example.com/EN/", "http://a..com/", "http://.com/", "http://com./",
]


def judged(url):
    at = url.find("://") if url is not None else -1
    rest = "" if at < 0 else url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string").withColumn("_keys", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(frame).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS + URLS)}
    assert url_filters.judge_urls(frame.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::30] + ["not in the universe"]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    c = url_filters.build_cascade(universe, 3000, listed)
    assert len(c.levels) > 1
    got = {r.key for r in universe.where(c.contains(F.col("key"))).collect()}
    assert got == set(keys[::30])
    assert url_filters.build_cascade(universe, 3000, []).levels == ()


def test_urls_sql(spark):
    own = sorted(map(tuple, url_filters.op9_url_filters(spark, SF).collect()), key=repr)
    assert own == sql_rows(url_filters.SQL, pages=f"{SF}/pages.parquet")


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["b", "a", "é", "Z", None, "c"] + ["hot"] * 6), i) for i in range(3000)]
    rows += [(None, None, "nulls", 1), (5, "  \t\n ", "blank", 1), (7, "x\x0by z", "tiny", 1), (7, "x\x0by z", "tiny", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").withColumn("target", F.lit(1))
    got = mixing.mix_sources(frame).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    by = {(r[0], size(r[1])): r[2] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        s = by[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12, abs=1e-9)
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.15 * want[s] + 60
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(frame.repartition(7)).collect()), key=repr)
    emitted = mixing.mix_sources(frame, emit=True)
    assert emitted.columns == frame.columns
    assert sum(size(r.text) for r in emitted.collect()) == sum(taken.values())
    assert mixing.mix_sources(frame.limit(0)).count() == 0
    assert mixing.mix_sources(frame.limit(0), emit=True).count() == 0


def test_mixing_sql(spark):
    own = sorted(map(tuple, mixing.op7_mixing(spark, SF).collect()), key=repr)
    assert own == sql_rows(mixing.SQL, documents=f"{SF}/documents.parquet")


def plain_lines(rows):
    seen, gone = {}, defaultdict(set)
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            if tuple(ls[p : p + 3]) in seen:
                gone[i, t] |= {p, p + 1, p + 2}
            seen.setdefault(tuple(ls[p : p + 3]), i)
    return {(i, t): "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t]) for i, t in rows if t is not None}


def test_lines(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, "l1\nl2\nl3\nl4\n"), (101, "x\nl2\nl3\nl4\n\ny"), (102, ""), (103, None), (104, "\n\n\n\n"), (100, "l1\nl2\nl3\nl4\n"), (None, "l2\nl3\nl4"), (105, "p\nq\nr\np\nq\nr")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pos int, n_chars long")
    got = line_dedup.dedup_lines(frame).collect()
    want = plain_lines(rows)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    for i, t in rows:
        assert (want[i, t] if t is not None else None) in by[i]
    assert by[100][0] == by[100][1] == "l1\n" and by[105] == ["p\nq\nr"] and by[None] == ["l2\nl3\nl4"]
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_lines_sql(spark):
    own = sorted(map(tuple, line_dedup.op6_line_dedup(spark, SF).collect()), key=repr)
    assert own == sql_rows(line_dedup.SQL, documents=f"{SF}/documents.parquet")


def test_native_plans(spark):
    """The operators asked for in DataFrame functions alone run no Python."""
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    for frame in (line_dedup.dedup_lines(docs), url_filters.judge_urls(pages)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)



def test_cascade_of_100_000_keys(spark):
    listed = [f"host{i}.com/" for i in range(100_000)]
    universe = spark.range(150_000).select(F.concat(F.lit("host"), F.col("id"), F.lit(".com/")).alias("key"))
    c = url_filters.build_cascade(universe, 150_000, listed)
    got = universe.where(c.contains(F.col("key"))).agg(F.count(F.lit(1)), F.max(F.regexp_extract("key", r"\d+", 0).cast("int"))).first()
    assert tuple(got) == (100_000, 99_999)


def test_equal_ids_and_equal_rows_come_near_their_targets(spark, tmp_path):
    rows = [(None, f"word{i} " * 10, "nulls") for i in range(400)] + [(5, "same text of six words here", "rows") for _ in range(900)]
    rows += [(5, f"other{i} " * 10, "ids") for i in range(400)] + [(i, "w " * 9, "small") for i in range(1_000, 1_400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = defaultdict(int), {}
    for r in mixing.mix_sources(frame).collect():
        key = (r.source_size, r.target)
        taken[key] += r.taken
        target[key] = r.target
    assert all(abs(taken[k] - target[k]) <= 0.1 * target[k] for k in target) and len(target) == 4
    assert sum(len(r.text.split()) for r in mixing.mix_sources(frame, emit=True).collect()) == sum(taken.values())
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, mixing.op7_mixing(spark, str(tmp_path)).collect()), key=repr) == sql_rows(mixing.SQL, documents=f"{tmp_path}/documents.parquet/*.parquet")


def test_a_text_of_30_000_lines(spark, tmp_path):
    body = [f"line {i} " + "x" * 30 for i in range(30_000)]
    rows = [(1, "\n".join(body)), (2, "\n".join(x for i in range(0, 30_000, 10) for x in [*body[i : i + 5], f"own {i}"])), (3, "\n".join(body[:2])), (3, "\n".join(body[:2]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    line_dedup.op6_line_dedup(spark, SF).collect()
    began = time.time()
    own = sorted(map(tuple, line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert time.time() - began < 8
    assert [r[1:3] for r in own] == [(30_000, 0), (18_000, 15_000), (2, 0), (2, 0)]
    assert own == sql_rows(line_dedup.SQL, documents=f"{tmp_path}/documents.parquet/*.parquet")
