"""Whole jobs where an earlier round left rows or lines out."""

import pytest

from phasefold.llm import decontaminate, license_scan


def test_license_lines_without_cue(spark):
    """Lines without any word of the former cue list match their templates too."""
    lines = [
        ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
        ("CC-BY-SA-4.0", "CC-BY-SA 4.0"),
        ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ]
    rows = [(i, f"d{i}/f", t) for i, (_, t) in enumerate(lines)] + [(100 + i, f"e{i}/f", "plain prose of no licence") for i in range(50)]
    got = {r.id: r for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert [(got[i].own_license, got[i].via) for i in range(len(lines))] == [(name, "own") for name, _ in lines]


def test_license_prefilter_is_safe(spark):
    """Every line that brute force over all lines matches is scored; the filter's terms alone decide nothing else."""
    import math
    import random

    rng = random.Random(4)
    texts = []
    for _, t in license_scan.TEMPLATES * 12:
        w = license_scan.words_of(t)
        kept = [x for x in w if rng.random() < 0.75] + ["other"] * rng.randrange(2)
        rng.shuffle(kept)
        texts.append("-".join(kept))
    n, sets = len(texts), [set(license_scan.words_of(t)) for t in texts]
    idf = lambda x, known: math.log((1 + n) / (1 + (sum(x in s for s in sets) if known else 0))) + 1
    vocabulary = {w for _, t in license_scan.TEMPLATES for w in license_scan.words_of(t)}
    weights = lambda w: {x: w.count(x) * idf(x, x in vocabulary) for x in set(w)}
    tpl = [weights(license_scan.words_of(t)) for _, t in license_scan.TEMPLATES]
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    best = []
    for t in texts:
        w = weights(license_scan.words_of(t))
        best.append(max(sum(w[x] * v.get(x, 0) for x in w) / (norm(w) * norm(v) or 1) for v in tpl) if w else 0)
    got = license_scan.scan(spark.createDataFrame([(i, f"{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string"), texts=[]).collect()  # lines alone
    near = 1e-5
    for r in got:
        if abs(best[r.id] - license_scan.LEAST) > near:
            assert (r.own_license is not None) == (best[r.id] >= license_scan.LEAST), texts[r.id]


def test_benchmark_items_without_id(spark, tmp_path):
    """A passage of an item without an id is found and removed, as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    docs = spark.createDataFrame([(1, "a b secret passage c"), (2, "x secret passage z named one more y"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "Secret passage"), ("n", "named one more")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (2, [None], True), 2: (5, ["n", None], True), 3: (0, [], False)}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items, remove="documents").collect()] == [3]
    spans = decontaminate.decontaminate(docs, items, remove="spans").where("doc_id = 1").first()
    assert spans.text == "a b  c"
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    items.toPandas().to_parquet(tmp_path / "benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = [tuple(r) for r in decontaminate.op3_decontamination(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == sorted(db.sql(decontaminate.SQL).fetchall())
