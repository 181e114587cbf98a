"""Columns of the operators' own names in the caller's table, in either case, and columns of odd kinds."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import columns, line_dedup, mixing, toxicity

TEXTS = ["l1\nl2\nl3\nl4", "x\nl1\nl2\nl3", "plain words of one line", None, "", "l1\nl2\nl3\nl4"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def own_names():
    """Every name in quotes that the operators' code gives to a column, and those with other cases and characters."""
    found = set()
    for module in ("columns", "line_dedup", "mixing", "toxicity", "packing", "parity_join"):
        found |= set(re.findall(r'"(_?[a-z][a-z_0-9]*)"', (Path(columns.__file__).parent / f"{module}.py").read_text()))
    found -= {"doc_id", "text", "lang", "source", "n_chars"}
    upper = {n.upper() for n in found if n.startswith("_")} - {n for n in found}
    return sorted(found - {n.lower() for n in upper}) + sorted(upper) + ["a.b", "tick`ed", "two words"]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i if i != 5 else 0, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(TEXTS)]
    names = own_names()
    assert len(names) > 60
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = [F.lit(5_000 + i).alias(n) for i, n in enumerate(names)]
    return frame.select("*", *extra, F.create_map(F.lit("k"), F.col("doc_id")).alias("a_map")), names


def untouched(rows, names, of):
    assert rows and all(r.asDict()[n] == 5_000 + i for r in rows for i, n in enumerate(names)) and all(r.a_map == {"k": r.doc_id} for r in rows), of


def test_line_dedup(spark, crowded):
    frame, names = crowded
    out = line_dedup.dedup_lines(frame)
    assert out.dtypes == frame.dtypes
    rows = out.collect()
    untouched(rows, names, "lines")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in rows if r.doc_id in (0, 1, 2)) == [(0, "l1\nl2\nl3\nl4", 11)] * 2 + [(1, "x", 1), (2, TEXTS[2], 23)]


def test_toxicity(spark, crowded):
    frame, names = crowded
    out = toxicity.scored(frame, toxicity.Model({"plain": 50.0}, -9.0))
    assert out.columns[:-1] == frame.columns and out.columns[-1].strip("_") == "score" and out.columns[-1] not in frame.columns
    rows = out.collect()
    untouched(rows, names, "toxicity")
    assert all((r[-1] > 0.5) == (r.doc_id == 2) for r in rows)


def test_mixing(spark, crowded):
    frame, names = crowded
    out = mixing.mix_sources(frame, emit=True)
    assert out.dtypes == frame.dtypes
    rows = out.collect()
    untouched(rows, names, "mixing")
    assert {r.source for r in rows} == {"a", "b"}
    taken = sum(r.taken for r in mixing.mix_sources(frame).collect())
    assert sum(len((r.text or "").split()) for r in rows) == taken
    numbered = mixing.mix_sources(frame, emit=True, copy="copy")
    assert numbered.columns[:-1] == frame.columns and numbered.columns[-1] == columns.fresh("copy", frame.columns)
    assert sorted(r[:-1] and r.doc_id for r in numbered.collect()) == sorted(r.doc_id for r in rows)
    per = {}
    for r in numbered.where("doc_id > 0").collect():
        per.setdefault(r.doc_id, []).append(r[-1])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())


def test_pipeline_stages(spark, crowded, tmp_path):
    frame, names = crowded
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), frame.schema)
        assert docs.dtypes == frame.dtypes
        untouched(docs.collect(), names, name)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_fresh_names():
    assert columns.fresh("score", ["Score", "_score"]) == "__score" and columns.fresh("a", []) == "a"
