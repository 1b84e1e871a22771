"""The corpus pipeline stage by stage against brute force on its own input."""

import json
import re

import numpy as np
import pytest

from test_queries import brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=lambda r: r[0])
    raw = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert {r[0] for r in kept["language"]} == {i for i, t in raw if any(c.isalpha() for c in t or "")}
    first = [r[:2] for r in kept["language"]]
    comp = brute_components(first, 80)[1]
    assert [r[0] for r in kept["near_duplicates"]] == [i for (i, _), c in zip(first, comp) if i == c]
    bad = set().union(*(windows(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    short = {len(w) for w in bad}
    clean = [r[0] for r in kept["near_duplicates"] if not any(windows(r[1], n) & bad for n in short)]
    assert [r[0] for r in kept["benchmark"]] == clean
    size = lambda t: len((t or "").split())
    before = {r[0]: size(r[1]) for r in kept["benchmark"]}
    assert {r[0] for r in kept["mixing"]} <= set(before)
    assert sum(size(r[1]) for r in kept["mixing"]) == pytest.approx(1.5 * sum(before.values()), rel=0.02)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in kept["mixing"]]
    assert np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() == [r.start for r in got]
    json.dumps([r.asDict() for r in got[:2]])
