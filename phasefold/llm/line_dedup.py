"""Line dedup: documents lose the lines that many documents share.

A sharded minimal perfect hash over distinct line hashes indexes compact
fingerprint and count arrays; documents probe these arrays, so no line and no
document is joined or shuffled.

1. Each task hashes its documents' distinct line keys to 128 bits and adds them up;
   one shuffle of (hash, fingerprint, count) with map-side sums gives the document
   counts. A line that a third of all rows hold is one row per map task.
2. Hashes seen in at least two documents (a line of a single one is never dropped)
   are split into shards of about `shard_keys`; each shard becomes a minimal perfect
   hash (levels of bit arrays with the rank of every word of bits), a fingerprint array
   and a count array, written as one file in the shared folder.
3. Documents probe the files shard by shard and are rebuilt. A worker maps each file
   once and keeps it for all its tasks (file systems that cannot map are read, and kept
   up to a bound). A key outside the index is told by its fingerprint of 64 bits.

Defined results: a null or empty text is one empty line, which has an empty key and
stays; keys are compared by 128-bit hashes; equal rows are documents of their own;
other columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

BLANK = b" \t\n\x0b\x0c\r"
GAMMA, LEVELS = 2.0, 40
#: bytes of shards that a worker keeps if they cannot be mapped, and of texts that probe together
KEPT, PROBED = 128 << 20, 16 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_key(line: bytes) -> bytes:
    """All of [\\x20\\x09-\\x0D] stripped at both ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def build_shard(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> bytes:
    """A minimal perfect hash of distinct uint64 keys with its two arrays, as bytes.

    Level by level, keys that alone hit a bit keep it and the others go on to the
    next level; a key's index is the number of set bits before its own.
    """
    levels, left, where = [], np.arange(len(keys)), np.zeros(len(keys), np.int64)
    done = 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(len(left) * GAMMA + 63) // 64 * 64)
        at = (mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        rank = np.cumsum(alone) - 1
        where[left[placed]] = done + rank[at[placed]]
        done += int(placed.sum())
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~placed]
    if len(left):
        raise ValueError("equal keys in a shard")
    fp, n = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
    fp[where], n[where] = prints, np.minimum(counts, 0xFFFFFFFF)
    head = np.array([len(keys), len(levels), *(len(x) * 8 for x in levels)], np.int64)
    words = np.concatenate([np.zeros(0, np.uint8), *levels]).view(np.uint64)
    ones = np.bitwise_count(words).astype(np.uint32)
    before = (np.cumsum(ones) - ones).astype(np.uint32)
    # levels are multiples of 8 bytes, so that every array of the file is aligned
    return b"".join(x.tobytes() for x in (head, words, fp, n, before))


class Shard:
    """Lookups in the bytes of build_shard(); the arrays stay mapped."""

    def __init__(self, buf: pa.Buffer):
        n, k = np.frombuffer(buf, np.int64, 2).tolist()
        sizes, at = np.frombuffer(buf, np.int64, k, 16), 16 + 8 * k
        n_words = int(sizes.sum()) // 64
        words = np.frombuffer(buf, np.uint64, n_words, at)
        self.prints = np.frombuffer(buf, np.uint64, n, at + 8 * n_words)
        self.counts = np.frombuffer(buf, np.uint32, n, at + 8 * (n_words + n))
        before = np.frombuffer(buf, np.uint32, n_words, at + 8 * (n_words + n) + 4 * n)
        ends = np.cumsum(sizes // 64).tolist()
        self.levels = [(s, words[e - s // 64 : e], before[e - s // 64 : e]) for s, e in zip(sizes.tolist(), ends)]

    def find(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Document counts of the keys, 0 for those outside the index."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            at = (mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            w, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (w >> bit) & np.uint64(1) == 1
            h, wh, bh, ah = left[hit], w[hit], bit[hit], at[hit]
            i = before[ah >> 6].astype(np.int64) + np.bitwise_count(wh & ((np.uint64(1) << bh) - np.uint64(1)))
            same = self.prints[i] == prints[h]
            out[h[same]] = self.counts[i[same]]
            left = left[~hit]
            if not len(left):
                break
        return out


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two uint64 of each key's 128-bit hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)


def _lines(texts: pa.StringArray) -> list[list[bytes]]:
    offsets, data = base.raw(texts)
    return [data[a:b].split(b"\n") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, f, n): both hash halves of every distinct line key, and its number of documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.steps(batches):
            keys = [k for lines in _lines(base.strings(base.col(b, "text"))) for k in {line_key(x) for x in lines} if k]
            if not keys:
                continue
            h, n = np.unique(_hashes(keys).view([("h", np.uint64), ("f", np.uint64)]).ravel(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h["h"].view(np.int64)), pa.array(h["f"].view(np.int64)), pa.array(n.astype(np.int64))], ["h", "f", "n"])

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(emit, "h long, f long, n long")
    return each.groupBy("h", "f").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, scratch: base.Scratch, shard_keys: int, floor: int = 2) -> tuple[str, int, frozenset[int]]:
    """Write the index of all hashes with at least `floor` documents; its place, number of shards and those that hold any."""
    stored = scratch.save(counts.where(F.col("n") >= floor), "counts")
    n_shards = max(1, -(-stored.count() // shard_keys))
    place = scratch.path("index")

    def write(key, group):
        g = {c: group.column(c).combine_chunks().to_numpy() for c in ("h", "f", "n")}
        h, f, n = g["h"].view(np.uint64), g["f"].view(np.uint64), g["n"]
        first = np.unique(h, return_index=True)[1]
        if len(first) < len(h):  # equal first halves, about one pair in 2**64: the larger count stays
            order = np.lexsort((-n, h))
            h, f, n = h[order], f[order], n[order]
            first = np.unique(h, return_index=True)[1]
        s = key[0].as_py()
        base.put_file(f"{place}/{s:06d}", [build_shard(h[first], f[first], n[first])])
        return pa.table({"s": pa.array([s], pa.int32())})

    shard = F.pmod(F.shiftrightunsigned("h", 20), F.lit(n_shards)).cast("int")
    written = stored.withColumn("s", shard).groupBy("s").applyInArrow(write, "s int").collect()  # a number per shard
    scratch.drop("counts")
    return place, n_shards, frozenset(r.s for r in written)


class Shards:
    """A worker's open shards of an index."""

    def __init__(self, place: str):
        self.place, self.open, self.read = place, {}, 0

    def get(self, s: int) -> Shard:
        if s not in self.open:
            buf, mapped = base.open_map(f"{self.place}/{s:06d}"), base.mapped(self.place)
            if not mapped and self.read + buf.size > KEPT:
                self.open, self.read = {}, 0
            self.open[s] = Shard(buf)
            self.read += 0 if mapped else buf.size
        return self.open[s]


def probe(shards: Shards, n_shards: int, found: frozenset[int], h: np.ndarray) -> np.ndarray:
    """Document counts of 128-bit hashes; a shard that was written and is gone is an error."""
    keys, prints = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
    shard = ((keys >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64)
    out, order = np.zeros(len(keys), np.int64), np.argsort(shard, kind="stable")
    ids, at = np.unique(shard[order], return_index=True)
    for s, part in zip(ids.tolist(), np.split(order, at[1:])):
        if s in found:
            out[part] = shards.get(s).find(keys[part], prints[part])
    return out


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = 1_000_000) -> DataFrame:
    """id_col, n_lines, n_dropped, kept (the remaining text), kept_sha256 per row of docs.

    Lines whose key has at least min_chars code points and is in at least min_docs
    documents lose all their occurrences.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    scratch = base.Scratch(docs.sparkSession, "lines")
    place, n_shards, found = build_index(line_counts(docs, text_col), scratch, shard_keys)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = base.held(("shards", place), lambda: Shards(place))
        for b in base.steps(batches, limit=PROBED, keep=("shards", place)):
            docs_lines = _lines(base.strings(base.col(b, "text")))
            keys = [line_key(x) for lines in docs_lines for x in lines]
            wanted = [i for i, k in enumerate(keys) if k and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars)]
            drop = np.zeros(len(keys), bool)
            if wanted:
                drop[wanted] = probe(shards, n_shards, found, _hashes([keys[i] for i in wanted])) >= min_docs
            drops, at, out = drop.tolist(), 0, ([], [], [], [])
            for lines in docs_lines:
                gone = drops[at : at + len(lines)]
                at += len(lines)
                kept = b"\n".join([x for x, d in zip(lines, gone) if not d])
                for o, v in zip(out, (len(lines), sum(gone), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([base.col(b, "id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["id", "n_lines", "n_dropped", "kept", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(rebuild, f"id {kind}, n_lines long, n_dropped long, kept string, kept_sha256 string")
        .withColumnRenamed("id", id_col)
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(base.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = """
WITH l AS (
  SELECT r, doc_id, i, line,
         translate(trim(line, E' \\t\\n\\x0B\\f\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), hot AS (
  SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.k = hot.k
GROUP BY r, doc_id
"""
