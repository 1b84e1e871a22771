"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's
vector binds the vectors of its symbols, permuted by position (rotated by 2, 1 and 0,
multiplied); a text's vector bundles (adds) those of its trigrams, a language's
prototype those of its training texts. A document gets the language whose prototype has
the largest cosine with its vector; the cosine, from 0 to 1, is its score.

Symbols are lower-cased letters; a run of anything else is one boundary symbol, as are
both ends of a text. Training adds up whole-number vectors per task, so a language that
holds a third of all rows is one vector per task; only prototypes (languages x
dimensions) come to the driver. Texts are handled in steps of bounded size.

Defined results: `und` with score 0 for a null text, a text without letters, or if
nothing was learned; equal cosines go to the first language by name; rows with a null
language or held out teach nothing; a null id is not held out; equal rows count each.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

DIMS, SEED = 1024, 20_011
STEP, CELLS, GRAMS = 1_500_000, 1 << 23, 4096


@functools.lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """By code point: the lower-cased letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


@functools.lru_cache(maxsize=20_000)
def symbol_vector(cp: int) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64([SEED, cp])).integers(0, 2, DIMS, np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A float32 row for each trigram (numbers of three letters, base len(letters))."""
    k = len(letters)
    v = np.stack([symbol_vector(int(c)) for c in letters])
    a, b, c = grams // (k * k), grams // k % k, grams % k
    return (np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]).astype(np.float32)


def trigrams(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram) of all windows, the letters that trigrams are numbered in, letters per document."""
    offsets, data = base.raw(texts)
    data = data[: offsets[-1]]
    cps = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = base.starts_of((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    first = heads[offsets]  # of each document, in characters
    sym = symbols()[cps]
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    n_letters = np.bincount(doc[sym > 0], minlength=len(n))
    # a boundary before and after each document, then one boundary for each run of them
    sym = np.insert(sym, np.concatenate([first[:-1], first[1:]]), 0)
    doc = np.insert(doc, np.concatenate([first[:-1], first[1:]]), np.concatenate([np.arange(len(n))] * 2))
    order = np.argsort(doc, kind="stable") if len(n) > 1 and (np.diff(doc) < 0).any() else None
    if order is not None:
        sym, doc = sym[order], doc[order]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep], doc[keep]
    letters, code = np.unique(sym, return_inverse=True)
    k = len(letters)
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters, n_letters
    gram = (code[:-2] * k + code[1:-1]) * k + code[2:]
    same = doc[2:] == doc[:-2]
    return doc[:-2][same], gram[same], letters, n_letters


def bundles(texts: pa.StringArray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """n_rows summed vectors, document d going to row rows[d], and letters per document."""
    doc, gram, letters, n_letters = trigrams(texts)
    out = np.zeros((n_rows, DIMS), np.float32 if n_rows == len(rows) else np.float64)
    if not len(gram):
        return out, n_letters
    if len(letters) ** 3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(gram, minlength=1))
        at = np.zeros(len(letters) ** 3, np.int64)
        at[used] = np.arange(len(used))
        at = at[gram]
    else:
        used, at = np.unique(gram, return_inverse=True)
    per = max(1, CELLS // len(used))
    row = rows[doc]
    for lo in range(0, n_rows, per):
        hi = min(n_rows, lo + per)
        own = slice(None) if per >= n_rows else (row >= lo) & (row < hi)
        counts = np.bincount((row[own] - lo) * len(used) + at[own], minlength=(hi - lo) * len(used)).reshape(hi - lo, len(used)).astype(np.float32)
        for g in range(0, len(used), GRAMS):
            out[lo:hi] += counts[:, g : g + GRAMS] @ gram_vectors(used[g : g + GRAMS], letters)
    return out, n_letters


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from rows (text, lang)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in base.steps(batches, limit=STEP):
            langs = base.col(b, "lang").to_pylist()
            names = sorted(set(langs))
            at = {x: i for i, x in enumerate(names)}
            v, _ = bundles(base.strings(base.col(b, "text")), np.array([at[x] for x in langs]), len(names))
            for x, row in zip(names, v):
                total[x] = total.get(x, 0) + np.rint(row).astype(np.int64)
        for x, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(row)], ["lang", "dim", "v"])

    sums = rows.mapInArrow(add, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).toPandas()
    names = sorted(set(sums["lang"]))
    out = np.zeros((len(names), DIMS))
    if not names:
        return names, out
    out[[names.index(x) for x in sums["lang"]], sums["dim"].to_numpy()] = sums["v"].to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return names, np.divide(out, norm, out=out, where=norm > 0)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = base.without(docs, "lang_pred", "score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.steps(batches, text_col, STEP):
            n = b.num_rows
            v, n_letters = bundles(base.strings(base.col(b, text_col)), np.arange(n), n)
            best, cos = np.zeros(n, np.int64), np.zeros(n)
            if names:
                norm = np.linalg.norm(v, axis=1)
                all_cos = (v @ prototypes.T.astype(np.float32)) / np.where(norm > 0, norm, 1)[:, None]
                best = all_cos.argmax(1)
                cos = np.clip(all_cos[np.arange(n), best], 0, 1).astype(np.float64)
            lang = [names[i] if k and names else "und" for i, k in zip(best.tolist(), n_letters.tolist())]
            cols = [*b.columns, pa.array(lang, pa.string()), pa.array(np.where(n_letters > 0, cos, 0.0) if names else np.zeros(n))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(score, f"{base.schema_of(docs)}, lang_pred string, score double")


def identify(docs: DataFrame, fold: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score; learned from rows that are not held out."""
    base.bounded(docs.sparkSession)
    out = base.in_fold(F.col(id_col), fold, held)
    known = docs.where(~out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(base.without(docs, "held_out").withColumn("held_out", out), *learn(known), text_col)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
