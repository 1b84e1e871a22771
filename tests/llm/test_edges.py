"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from phasefold.llm import decontaminate, langid, license_scan, line_dedup, mixing, near_dedup, token_counts, token_output, topk, toxicity

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, score string, SCORE_ string, items int, n_tokens int, target int, m_size int, held_out int, id int, node int, th int, size int, kept int"
LONG = " ".join(f"word{i % 977} stupid" for i in range(60_000))
COPY = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, COPY, "en", "a"),
    (2, COPY, "en", "b"),
    (2, COPY, "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (None, "a line\nand another", "en", None),
    (None, None, None, None),
    (5, LONG, "xx", "a"),
    (6, "   \n\t \x0b\x0c\r ", "de", ""),
    (7, "Äußerung über große Straßen\nLicensed under CC BY 4.0", "de", "c"),
    (8, "<|endoftext|> it's 12 Σας İx é   'll", "en", "c"),
    (8, "another text under the same id", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", "t", 1, 2, 3, 4, 5, 6, 7, 8, 9, 0) for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_line_dedup(docs, empty):
    got = line_dedup.line_dedup(docs, min_docs=2).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_lines): r for r in got}
    assert by[1, 1].n_dropped == 1 and by[1, 1].kept == ""
    assert by[3, 1].n_dropped == 0 and by[4, 1].kept == ""
    assert by[6, 2].n_dropped == 0 and by[6, 2].kept == ROWS[8][1]
    assert line_dedup.line_dedup(empty).count() == 0


def test_topk(spark, docs):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.5, 0.5], 0), (3, [0.5, 0.5], 0), (4, None, 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0], 0), (9, [], 0), (10, [-1.0, 2.0], 0), (None, [1.0, 1.0], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = topk.top_k(v, v.where("vec_id IN (1, 3, 8, 4)"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id == 1] == [(1, 1, 2, 1024 * 1024), (1, 2, 3, 512 * 1024), (1, 3, 3, 512 * 1024)]
    assert {r.query_id for r in got} == {1, 3}
    assert topk.top_k(v.where("false"), v).count() == 0
    assert topk.top_k(v, v.where("false")).count() == 0


def test_topk_beyond_doubles(spark):
    v = spark.createDataFrame([(1, [2.0**17, 1.0]), (2, [2.0**16, 1.0]), (3, [-(2.0**16), 3.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(v, v.where("vec_id = 1"), k=5).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**53 + 2**20), (3, -(2**53) + 3 * 2**20)]


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([("x", "Two, three! FOUR"), ("y", COPY), ("y", COPY), ("z", None), ("w", "--"), (None, "another text")], "item_id string, text string")
    got = decontaminate.decontaminate(docs, items).collect()
    assert len(got) == len(ROWS)
    hits = {r.doc_id: (r.n_hit, list(r["items"])) for r in got if r.contaminated}
    assert hits == {1: (12, ["x", "y"]), 2: (12, ["x", "y"]), 8: (2, [None])}  # an item without an id is found too
    assert decontaminate.decontaminate(docs, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, items).count() == 0
    small = decontaminate.decontaminate(docs, items, block_words=1).where("contaminated").count()
    assert small == 4  # one item per block finds the same
    spans = decontaminate.decontaminate(docs, items.where("item_id = 'x'"), remove="spans").where("doc_id = 1").first()
    assert spans.text == "one  five six seven eight nine ten eleven twelve"
    assert decontaminate.decontaminate(docs, items, remove="documents").count() == len(ROWS) - 4


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = sorted((r[0] is not None, r[0] or 0, len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    got = token_counts.token_counts(docs, TOKENIZER).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == want
    out = token_output.token_output(docs, TOKENIZER).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens - 1) for r in out) == want
    assert [r.doc_id for r in out] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    ends = [r.start + r.n_tokens for r in out]
    assert [r.start for r in out] == [0, *ends[:-1]]
    assert token_counts.token_counts(empty, TOKENIZER).count() == 0
    assert token_output.token_output(empty, TOKENIZER).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert toxicity.score_toxicity(docs, labels.where("false")).count() == len(ROWS)
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_mixing(spark, docs, empty):
    m = mixing.Mixer(docs)
    got = m.draw().collect()
    assert len(got) == len(ROWS)
    assert all(r.taken <= 2 * r.size for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    mixed = m.mix()
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(words - sum(r.taken for r in got)) < 30
    assert mixing.Mixer(empty).draw().count() == 0 and mixing.Mixer(empty).mix().count() == 0


def test_near_dedup(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[1, 8].kept and by[1, 8].component_id == 1 and by[2, 8].component_id == 1 and not by[2, 8].kept
    assert by[3, 0].kept and by[4, 0].kept and by[6, 0].kept
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id == 8} == {8}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_license_scan(spark, docs, empty):
    files = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text", "score")
    got = license_scan.scan(files).collect()
    assert len(got) == len(ROWS)
    assert {r.id: (r.own_license, r.via) for r in got}[7] == ("CC-BY-4.0", "own")
    assert license_scan.scan(files.where("false")).count() == 0


def test_license_directories(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License"),
        (2, "p/src/a.py", "code here"),
        (3, "p/src/lib/LICENSE", "Licensed under the Apache License, Version 2.0"),
        (4, "p/src/lib/deep/x.py", None),
        (5, "p/src/lib/y.py", "All rights reserved\n" + "word " * 100),
        (6, "q/z.py", ""),
        (7, None, "text"),
        (8, "top.py", "text"),
    ]
    got = {r.id: r for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {i: (r.license, r.via, r.license_dir) for i, r in got.items()} == {
        1: ("MIT", "own", "p"),
        2: ("MIT", "inherited", "p"),
        3: ("Apache-2.0", "own", "p/src/lib"),
        4: ("Apache-2.0", "inherited", "p/src/lib"),
        5: ("Proprietary", "own", "p/src/lib"),
        6: (None, "none", None),
        7: (None, "none", None),
        8: (None, "none", None),
    }


def test_language(docs, empty):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    und = {r.text for r in got if r.lang_pred == "und"}
    assert und == {None, "", ROWS[8][1]}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got} <= {"en", "de", "xx", "und"}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
