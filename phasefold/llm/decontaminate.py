"""Benchmark decontamination: find test passages in training documents.

A hash set of the benchmark's word windows scans the documents' words. Words of a
batch become numbers in the benchmark's vocabulary at once (0: not in it); a rolling
hash over windows without a 0 is looked up among the sorted hashes of the benchmark's
windows, and every hit is verified word by word. Spans or documents are then removed.

The hash set is sent to all tasks in blocks of at most `block_words` benchmark words,
each a file in the shared folder, so its size in memory is bounded however large the
benchmark is; a usual benchmark is one block, read once by each worker. With several, a
task gathers steps of documents and meets each block once with all of them.

Defined results: a null or empty text has no words and no hit; an item without words
has no window and is never found; an item shorter than a window is one window; equal
item_ids count once; an item without an id is found like others (n_hit, contaminated,
removal), all such items being one null at the end of items; equal rows are documents of
their own; an empty benchmark finds nothing.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: bytes to bytes: A-Z lower-cased, what is no word a space
TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
BASE = 0x9E3779B97F4A7C15
#: steps of documents that meet a block together, if there are several blocks
GATHERED = 12


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive codes."""
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for i in range(n):
            h *= np.uint64(BASE)
            h += codes[i : i + len(h)].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
        return h


class Grams:
    """The hash set of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int):
        texts = [[w.encode() for w in ws] for _, ws in items]
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for ws in texts for w in ws))}
        self.values = pa.array([w.decode("utf-8", "surrogateescape") for w in self.vocab], pa.string())
        self.items = [i for i, _ in items]
        windows: dict[int, dict[tuple, set[int]]] = {}
        for item, ws in enumerate(texts):
            codes = [self.vocab[w] for w in ws]
            n = min(window, len(codes))
            for i in range(len(codes) - n + 1 if n else 0):
                windows.setdefault(n, {}).setdefault(tuple(codes[i : i + n]), set()).add(item)
        self.sets = []
        for n, found in windows.items():
            rows = np.array(list(found), np.int64).reshape(-1, n)
            hashes = np.array([_rolling(r, n)[0] for r in rows], np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = list(found.values())
            self.sets.append((n, hashes[order], rows[order], [owners[i] for i in order.tolist()]))

    def scan(self, flat: pa.StringArray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[set[int]]]]:
        """(window length, positions in flat, items of each) of verified hits."""
        at = pc.index_in(flat, value_set=self.values)
        codes = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        first = base.starts_of(counts)
        known = codes > 0
        bad = base.starts_of(~known)
        end = np.repeat(first[1:], counts)  # of each word's document
        for n, hashes, rows, owners in self.sets:
            if len(codes) < n:
                continue
            pos = np.flatnonzero((bad[n:] == bad[:-n]) & (np.arange(len(codes) - n + 1) + n <= end[: len(codes) - n + 1]))
            if not len(pos):
                continue
            h = _rolling_at(codes, pos, n)
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            some = hi > lo
            pos, lo, hi = pos[some], lo[some], hi[some]
            where, who = [], []
            for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist()):
                for r in range(a, b):
                    if np.array_equal(codes[p : p + n], rows[r]):
                        where.append(p)
                        who.append(owners[r])
            if where:
                yield n, np.array(where, np.int64), who


def _rolling_at(codes: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(pos), np.uint64)
        for i in range(n):
            h *= np.uint64(BASE)
            h += codes[pos + i].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
        return h


def _grams(uri: str, window: int) -> Grams:
    key = ("grams", uri, window)
    base.release(key)  # one block at a time
    return base.held(key, lambda: Grams([(i, w) for i, w in base.get_json(uri)], window))


def write_blocks(benchmark: DataFrame, scratch: base.Scratch, block_words: int, item_col: str, text_col: str) -> list[str]:
    """The benchmark's items as files of at most block_words words (or one item) each."""
    blocks, now, size = [], [], 0

    def close() -> None:
        if now:
            blocks.append(scratch.path(f"grams/{len(blocks):05d}"))
            base.put_json(blocks[-1], now)
            now.clear()

    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        ws = [w.decode("utf-8", "surrogateescape") for w in words_of(r.t)]
        if ws:
            if size + len(ws) > block_words:
                close()
                size = 0
            now.append((r.i, ws))
            size += len(ws)
    close()
    return blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, remove: str = "nothing", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 2_000_000) -> DataFrame:
    """All columns of docs and n_words, n_hit, items (sorted item ids), contaminated.

    remove: "nothing", "documents" (those with a hit go) or "spans" (their hit words go,
    with what stands between two of them).
    """
    if remove not in ("nothing", "documents", "spans"):
        raise ValueError(f"remove: {remove}")
    blocks = write_blocks(benchmark, base.Scratch(docs.sparkSession, "bench"), block_words, item_col, item_text_col)
    docs = base.without(docs, "n_words", "n_hit", "items", "contaminated")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = base.steps(batches, text_col, keep=("grams", blocks[0], window) if blocks else None)
        while own := list(itertools.islice(steps, GATHERED if len(blocks) > 1 else 1)):
            found = []
            for b in own:
                flat, counts = base.split_words(base.translated(base.strings(base.col(b, text_col)), TO_WORDS))
                found.append((flat, counts, base.starts_of(counts), np.zeros(len(flat) + 1, np.int32), {}))
            for uri in blocks:
                g = _grams(uri, window)
                for flat, counts, first, hit, items in found:
                    for n, pos, who in g.scan(flat, counts):
                        np.add.at(hit, pos, 1)
                        np.add.at(hit, pos + n, -1)
                        for d, w in zip((np.searchsorted(first, pos, "right") - 1).tolist(), who):
                            items.setdefault(d, set()).update(g.items[i] for i in w)
            for b, (_, counts, first, hit, items) in zip(own, found):
                is_hit = np.cumsum(hit)[:-1] > 0
                n_hit = np.diff(base.starts_of(is_hit)[first])
                cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
                if remove == "spans" and items:
                    out = base.col(b, text_col).to_pylist()
                    for d in items:
                        out[d] = _without(out[d], is_hit[first[d] : first[d + 1]])
                    cols[text_col] = pa.array(out, cols[text_col].type)
                cols |= {"n_words": pa.array(counts), "n_hit": pa.array(n_hit), "items": pa.array([sorted(items.get(d, ()), key=lambda i: (i is None, i)) for d in range(len(counts))], pa.list_(pa.string())), "contaminated": pa.array(n_hit > 0)}
                done = pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
                yield done.filter(pc.invert(done.column(len(cols) - 1))) if remove == "documents" else done

    return docs.mapInArrow(scan, f"{base.schema_of(docs)}, n_words long, n_hit long, items array<string>, contaminated boolean")


def _without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and without what separates two of them that follow each other."""
    data, out, at, before = text.encode(), [], 0, False
    for m, h in zip(WORD.finditer(data.translate(TO_WORDS).replace(b" ", b"\x00")), hit.tolist()):
        if h:
            if not before:
                out.append(data[at : m.start()])
            at = m.end()
        before = h
    return b"".join([*out, data[at:]]).decode()


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, base.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL = """
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS p FROM documents
), d AS (
  SELECT r, doc_id, list_filter(p, lambda x: x <> '') AS w FROM low
), b AS (
  SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT DISTINCT n FROM g),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, n WHERE len(w) >= n)
), h AS (
  SELECT r, dw.n, i, item FROM dw JOIN g ON dw.n = g.n AND dw.gram = g.gram
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
