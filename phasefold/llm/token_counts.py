"""Token counts by byte-pair merging, with no identifiers emitted.

Each distinct piece of a worker's texts is merged once: its symbols form a linked
list, adjacent pairs lie in a heap by merge rank, and the lowest-rank pair that still
stands is popped and merged until none is left. A piece has as many tokens as symbols
minus merges. Where the vocabulary's tokens never reach across white space (pieces.py
checks that), counts of words are remembered, up to a bound, and added up by document;
otherwise the library's pre-tokenizer cuts whole texts into pieces. A vocabulary that is
more than merges (byte fallback, unknown tokens, dropout) is refused.

Defined results: null counts as an empty text (0 bytes, 0 tokens); equal rows are
counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, pieces


class Merger:
    """Token counts of words under the merges of a tokenizers BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if not pieces.plain(spec):
            raise ValueError(f"{path}: its tokens are more than merges")
        self.by_word = pieces.fits(spec)
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = set(model["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        library = Tokenizer.from_file(path)
        self.normal = library.normalizer.normalize_str if library.normalizer else str
        self.pre = library.pre_tokenizer.pre_tokenize_str if library.pre_tokenizer else lambda x: [(x, None)] * bool(x)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def merges(self, piece: str) -> int:
        """Tokens of one byte-level piece."""
        left = list(piece[:-1]) + [piece[-1] + self.end]
        left = [x for x in left if x in self.vocab]
        n = len(left)
        if n < 2:
            return n
        ranks, nxt, prev = self.ranks, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, left[i], left[i + 1]) for i in range(n - 1) if (r := ranks.get((left[i], left[i + 1]))) is not None]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if left[i] != a or j >= n or left[j] != b:
                continue  # one of the two was merged meanwhile
            left[i], left[j] = a + b, ""
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (r := ranks.get((left[i], left[k]))) is not None:
                    heapq.heappush(heap, (r, i, left[i], left[k]))
            p = prev[i]
            if p >= 0 and (r := ranks.get((left[p], left[i]))) is not None:
                heapq.heappush(heap, (r, p, left[p], left[i]))
            merged += 1
        return n - merged

    def piece(self, p: str) -> int:
        n = self.known.get(p)
        if n is None:
            if len(self.known) >= pieces.MOST:
                self.known.clear()
            n = self.known[p] = self.merges(p)
        return n

    def word(self, w: str) -> int:
        own = pieces.cut(w) if self.by_word else None
        if own is not None:
            return sum(map(self.piece, own))
        if self.special and (parts := self.special.split(w))[1:]:
            return len(parts) // 2 + sum(map(self.word, filter(None, parts[::2])))
        return sum(self.piece(p) for p, _ in self.pre(self.normal(w)))

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of distinct words."""
        if len(self.words) > pieces.MOST:
            self.words.clear()
        known = self.words
        out = list(map(known.get, words))
        for i, n in enumerate(out):
            if n is None:
                out[i] = known[words[i]] = self.word(words[i])
        return np.array(out, np.int64)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = base.held(("merger", tokenizer), lambda: Merger(tokenizer))
        for b in base.steps(batches, keep=("merger", tokenizer)):
            texts = base.strings(base.col(b, "text"))
            if m.by_word:
                flat, counts = base.split_words(texts)
                codes, words = base.coded(flat)
                total = base.starts_of(m.count(words)[codes] if len(flat) else np.zeros(0, np.int64))
                n = np.diff(total[base.starts_of(counts)])
            else:
                n = np.array([m.word(x) for x in texts.to_pylist()], np.int64)
            n_bytes = np.diff(base.raw(texts)[0]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([base.col(b, "id"), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(base.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
