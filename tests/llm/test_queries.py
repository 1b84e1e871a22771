"""The queries against their SQL in DuckDB, or against brute force where SQL has no word for them."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from phasefold.llm import base, decontaminate, langid, license_scan, line_dedup, mixing, near_dedup, token_counts, token_output, topk, toxicity

duckdb = pytest.importorskip("duckdb")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize(
    ("query", "sql"),
    [
        (line_dedup.op1_line_dedup, line_dedup.SQL),
        (topk.op2_topk_search, topk.SQL),
        (decontaminate.op3_decontamination, decontaminate.SQL),
        (license_scan.op9_license_scan, license_scan.SQL),
    ],
    ids=["op1", "op2", "op3", "op9"],
)
def test_against_sql(spark, sf, db, query, sql):
    got, want = query(spark, sf).toPandas(), db.sql(sql).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.fixture(scope="module")
def texts(db):
    return db.sql("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch([x[1] or "" for x in texts], add_special_tokens=False)]


def test_token_counts(spark, sf, texts, encoded):
    got = {r.doc_id: r for r in token_counts.op4_token_counts(spark, sf).collect()}
    for (i, text, *_), ids in zip(texts, encoded):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids), len((text or "").encode()), len(ids) > 2048)


def test_token_output(spark, sf, texts, encoded):
    got = token_output.op7_token_output(spark, sf).orderBy("start").collect()
    start = 0
    for r, (i, *_), ids in zip(got, texts, encoded, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids) + 1)
        assert r.ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
        start += len(ids) + 1


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = rng.integers(0, 2**32, dtype=np.uint32) if n else 0
    parts = token_output.pack_ids(ids)
    import pyarrow as pa

    got = token_output.unpack_ids([pa.py_buffer(p) for p in parts], n)
    assert (got == ids).all()
    if n > 300:
        assert (token_output.unpack_ids([pa.py_buffer(p) for p in parts], n, 2, 3) == ids[256:384]).all()


def brute_components(texts, percent):
    sets, rep, links = [], {}, []
    for _, x, *_ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    held = defaultdict(list)
    for i, s in enumerate(sets):
        if s and s in rep:
            links.append((rep[s], i))
        elif s:
            rep[s] = i
            both = Counter(j for g in s for j in held[g])
            links += [(j, i) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
            for g in s:
                held[g].append(i)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return sets, [texts[find(i)][0] for i in range(len(sets))]


def test_near_dedup(spark, sf, texts):
    sets, comp = brute_components(texts, 85)
    got = {r.doc_id: r for r in near_dedup.op8_near_dedup(spark, sf).collect()}
    for (i, *_), s, c in zip(texts, sets, comp):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), c, c == i)


def test_near_dedup_chains_and_groups(spark):
    """Chains of small edits, a large group of distinct copies, and a passage that many texts share."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choice(words, 60))
    out = [" ".join(rng.choice(words, 120)) + " " + passage for _ in range(150)]
    chain = list(rng.choice(words, 200))
    for _ in range(40):
        chain = chain.copy()
        chain[rng.integers(200)] = f"x{rng.integers(10**6)}"
        out.append(" ".join(chain))
    seed = list(rng.choice(words, 300))
    for _ in range(120):
        own = seed.copy()
        for k in rng.integers(0, 300, rng.integers(1, 8)):
            own[k] = f"y{rng.integers(10**6)}"
        out.append(" ".join(own))
    out += ["a b c", "a  B c", "a b", "", None]
    order = rng.permutation(len(out)).tolist()
    texts = [(i, out[k]) for i, k in enumerate(order)]
    for percent in (85, 80):
        _, comp = brute_components(texts, percent)
        got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(zip((i for i, _ in texts), comp))


def test_toxicity_held_out(spark, db):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op5_toxicity(spark, sf).toPandas()
    want = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").df()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got.merge(want, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert both[both.toxic == 1].score.mean() > both[both.toxic == 0].score.mean() + 0.4
    assert (got.predicted == (got.score >= 0.5)).all()


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    n, rates = 6000, [0.9, 0.8, 0.7, 0.85]
    y = rng.random(n) < 0.4
    votes = np.stack([np.where(rng.random(n) < 0.25, 0, np.where((rng.random(n) < a) == y, 1, -1)) for a in rates], 1)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # the last voter repeats the first
    combos, at = np.unique(votes, axis=0, return_inverse=True)
    m = toxicity.LabelModel(combos, np.bincount(at).astype(float), np.zeros((len(combos), 2)))
    assert np.abs(m.accuracy[:4] - rates).max() < 0.06
    i, j = 0, 4
    assert m.parent[j] == i or m.parent[i] == j  # the copy hangs on its original
    assert ((m.posterior(combos)[at] > 0.5) == y).mean() > 0.85


def test_mixing(spark, sf, texts):
    got = {r.doc_id: r for r in mixing.op6_mixing(spark, sf).collect()}
    again = {r.doc_id: r.taken for r in mixing.op6_mixing(spark, sf).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x, *_ in texts}
    sources = sorted({s for *_, s in texts})
    total = {s: sum(sizes[i] for i, _, _, o in texts if o == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, target, free = 1.5 * sum(total.values()), {}, set(sources)
    while free:
        w = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / w >= 2 * total[s]}
        for s in above or free:
            target[s] = 2.0 * total[s] if above else left * weight[s] / w
        if not above:
            break
        left -= sum(target[s] for s in above)
        free -= above
    for i, _, _, s in texts:
        r = got[i]
        assert r.size == sizes[i] and r.source_size == total[s] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[s])
    for s in sources:
        assert abs(sum(got[i].taken for i, _, _, o in texts if o == s) - target[s]) <= 1


def test_language(spark):
    got = langid.op10_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.97


def test_language_vectors_bind_and_bundle():
    """A text's vector is the sum over its trigrams of the product of rotated letter vectors."""
    import pyarrow as pa

    v, n = langid.bundles(base.strings(pa.array(["Ab, a!", "", None, "é"])), np.arange(4), 4)
    f = lambda c: langid.symbol_vector(ord(c) if c else 0).astype(float)
    tri = lambda a, b, c: np.roll(f(a), 2) * np.roll(f(b), 1) * f(c)
    want = tri("", "a", "b") + tri("a", "b", "") + tri("b", "", "a") + tri("", "a", "")
    assert np.allclose(v[0], want) and not v[1].any() and not v[2].any()
    assert np.allclose(v[3], tri("", "é", ""))
    assert n.tolist() == [3, 0, 0, 1]


def test_minimal_perfect_hash():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    prints, counts = rng.integers(0, 2**63, len(keys)).astype(np.uint64), rng.integers(2, 1000, len(keys))
    shard = line_dedup.Shard(pa.py_buffer(line_dedup.build_shard(keys, prints, counts)))
    assert (shard.find(keys, prints) == counts).all()
    assert not shard.find(keys, prints ^ np.uint64(1)).any()
    other = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert not shard.find(other, other).any()
    assert len(shard.prints) == len(keys)
