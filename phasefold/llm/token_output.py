"""Token-ID output: encoded documents in binary files of patched frame-of-reference blocks.

Documents are range-partitioned by id on their own columns, encoded once, and written in
files of a bounded number of ids, one or several per partition: ids in blocks of 128, each as offsets from the block's minimum,
packed at the width that a percentile of them needs; the others keep their low bits in
place, their high bits and positions in exception lists. An index holds every block's
byte position, so any document can be read without those before it.

If tokens of the vocabulary never reach across white space (pieces.py checks that), the
distinct words of a step are cut into pieces at once, the tokenizers library encodes each
distinct piece that the worker does not remember, and ids of whole texts are gathered
from these. With another vocabulary it encodes whole texts.

Defined results: null counts as an empty text, which has only the end id; equal ids are
ordered by a hash of their texts; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, pieces

BLOCK, PERCENT = 128, 97
MAGIC = b"PFRIDS01"
#: blocks packed or unpacked in one step
CHUNK = 4_096
#: ids after which a partition goes on with a new file
ROLL = 32_000_000


def _gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at first and are n long, in turn."""
    ends = np.cumsum(n)
    return flat[np.repeat(first - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)]


class Encoder:
    """Ids of words by the tokenizers library; those of pieces are remembered up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_word = pieces.fits(json.load(f))
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.n_flat = np.zeros(1 << 19, np.uint32), 0
        self.first, self.length = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _add(self, new: list[str]) -> None:
        """Pieces, and behind a space words for the library."""
        own, strange = [p for p in new if p[0] != " "], [p[1:] for p in new if p[0] == " "]
        new, ids, n = own + [" " + w for w in strange], [], []
        for p in pieces.byte_level(own):
            got = self.tokenize(p)
            n.append(len(got))
            ids += [t.id for t in got]
        for e in self.library.encode_batch_fast(strange, add_special_tokens=False) if strange else []:
            n.append(len(e.ids))
            ids += e.ids
        new_ids, n = np.array(ids, np.uint32), np.array(n, np.int64)
        k, m = len(self.at), self.n_flat
        while m + len(new_ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(n) > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        self.flat[m : m + len(new_ids)] = new_ids
        self.first[k : k + len(n)] = m + np.cumsum(n) - n
        self.length[k : k + len(n)] = n
        self.n_flat = m + len(new_ids)
        self.at.update(zip(new, range(k, k + len(n))))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's number of ids."""
        if not self.by_word:
            got = [e.ids for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        flat, counts = base.split_words(texts)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        d = flat.dictionary_encode()
        words = base.strings(d.dictionary)
        here, cuts, n_cuts = pieces.cut_many(words)
        # words that are not cut at once: as pieces, or behind a space for the library
        apart = [pieces.cut_text(w) or [" " + w] for w in words.filter(pa.array(~here)).to_pylist()]
        p = cuts.dictionary_encode()
        keys = p.dictionary.to_numpy(zero_copy_only=False).tolist() + [k for own in apart for k in own]
        if len(self.at) > pieces.MOST:
            self.clear()
        found = list(map(self.at.get, keys))
        if None in found:
            self._add(list(dict.fromkeys(k for k, i in zip(keys, found) if i is None)))
            found = list(map(self.at.get, keys))
        numbers = np.array(found, np.int64)
        numbers = np.concatenate([numbers[p.indices.to_numpy(zero_copy_only=False)], numbers[len(p.dictionary) :]])
        # ids of the distinct words, those cut at once before the others; then of all words
        ids = _gather(self.flat, self.first[numbers], self.length[numbers])
        starts = base.starts_of(self.length[numbers])[base.starts_of(np.concatenate([n_cuts, np.array([len(own) for own in apart], np.int64)]))]
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.flatnonzero(here), np.flatnonzero(~here)])] = np.arange(len(words))
        where = place[d.indices.to_numpy(zero_copy_only=False)]
        n = np.diff(starts)[where]
        return _gather(ids, starts[where], n), np.diff(base.starts_of(n)[base.starts_of(counts)])


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of 128 values below 2**w as rows of 4*w words: lane by lane, bits in order."""
    lanes = v.reshape(-1, 32, 4).astype(np.uint32)
    out = np.zeros((len(lanes), w, 4), np.uint32)
    for i in range(32):
        word, shift = divmod(i * w, 32)
        out[:, word] |= lanes[:, i] << np.uint32(shift)
        if shift + w > 32:
            out[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(lanes), 4 * w)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    rows = words.reshape(-1, w, 4)
    out = np.zeros((len(rows), 32, 4), np.uint32)
    mask = np.uint32((1 << w) - 1)
    for i in range(32):
        word, shift = divmod(i * w, 32)
        x = rows[:, word] >> np.uint32(shift)
        if shift + w > 32:
            x |= rows[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = x & mask
    return out.reshape(len(rows), BLOCK)


class Packer:
    """Packs ids as they come; holds packed blocks and less than a block of ids."""

    def __init__(self):
        self.n, self.rest = 0, np.zeros(0, np.uint32)
        self.low, self.width, self.over, self.place, self.high, self.words = [], [], [], [], [], []

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32, copy=False)])
        k = len(ids) // BLOCK
        self.rest = ids[k * BLOCK :].copy()
        for at in range(0, k, CHUNK):
            self._blocks(ids[at * BLOCK : min(at + CHUNK, k) * BLOCK].reshape(-1, BLOCK))

    def _blocks(self, full: np.ndarray) -> None:
        low = full.min(1)
        d = full - low[:, None]
        bits = np.ceil(np.log2(d.astype(np.float64) + 1)).astype(np.uint8)
        w = np.partition(bits, BLOCK * PERCENT // 100, axis=1)[:, BLOCK * PERCENT // 100]
        out = bits > w[:, None]
        r, c = np.nonzero(out)
        starts = base.starts_of(w.astype(np.int64) * (BLOCK // 32))
        words = np.zeros(int(starts[-1]), "<u4")
        for each in np.unique(w).tolist():
            if each:
                rows = np.flatnonzero(w == each)
                words[starts[rows][:, None] + np.arange(4 * each)] = _pack(d[rows] & np.uint32((1 << each) - 1), each)
        self.low.append(low)
        self.width.append(w)
        self.over.append(out.sum(1).astype(np.uint8))
        self.place.append(c.astype(np.uint8))
        self.high.append(d[r, c] >> w[r].astype(np.uint32))
        self.words.append(words)

    def parts(self) -> list[bytes]:
        """Minima, widths, block starts, numbers of exceptions, their places and high bits, packed words; the last block is filled up."""
        if len(self.rest):
            n = self.n
            self.add(np.full(BLOCK - len(self.rest), self.rest[-1], np.uint32))
            self.n = n
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        width, high = join(self.width, np.uint8), join(self.high, np.uint32)
        small = "<u2" if not len(high) or high.max() < 1 << 16 else "<u4"
        starts = base.starts_of(width.astype(np.int64) * (BLOCK // 8))
        return [join(self.low, "<u4").tobytes(), width.tobytes(), starts.astype("<i8").tobytes(), join(self.over, np.uint8).tobytes(), join(self.place, np.uint8).tobytes(), high.astype(small).tobytes(), b"".join(x.tobytes() for x in self.words)]


def pack_ids(ids: np.ndarray) -> list[bytes]:
    p = Packer()
    p.add(ids)
    return p.parts()


def unpack_ids(parts: list[pa.Buffer], n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first to last of a file's block section."""
    low, width, starts, over, place = (np.frombuffer(p, t) for p, t in zip(parts, ("<u4", np.uint8, "<i8", np.uint8, np.uint8)))
    high, words = np.frombuffer(parts[5], "<u4" if len(parts[5]) == 4 * len(place) else "<u2"), np.frombuffer(parts[6], "<u4")
    last = len(width) if last is None else min(last, len(width))
    out = np.zeros((last - first, BLOCK), np.uint32)
    for at in range(first, last, CHUNK):
        w = width[at : min(at + CHUNK, last)]
        for each in np.unique(w).tolist():
            if each:
                rows = at + np.flatnonzero(w == each)
                out[rows - first] = _unpack(words[(starts[rows] // 4)[:, None] + np.arange(4 * each)], each)
    ends = base.starts_of(over)
    a, b = int(ends[first]), int(ends[last])
    block = np.repeat(np.arange(first, last), over[first:last])
    out[block - first, place[a:b]] |= high[a:b].astype(np.uint32) << width[block].astype(np.uint32)
    out += low[first:last, None]
    return out.reshape(-1)[: n - first * BLOCK]


def file_parts(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, packed: Packer) -> list[bytes]:
    """A whole file: magic, length of the head, JSON head with the sections' lengths, sections."""
    sections = [doc_ids.astype("<i8").tobytes(), np.packbits(missing).tobytes(), counts.astype("<i8").tobytes(), *packed.parts()]
    head = json.dumps({"docs": len(doc_ids), "ids": packed.n, "block": BLOCK, "sections": [len(s) for s in sections]}).encode()
    head += b" " * (-len(head) % 8)
    padded = [s + b"\0" * (-len(s) % 8) for s in sections]
    return [MAGIC, len(head).to_bytes(8, "little"), head, *padded]


class TokenFile:
    """Reads a file of file_parts()."""

    def __init__(self, uri: str):
        buf = base.open_map(uri)
        if buf.slice(0, 8).to_pybytes() != MAGIC:
            raise ValueError(f"{uri} is no token file")
        at = 16 + int.from_bytes(buf.slice(8, 8).to_pybytes(), "little")
        self.head = json.loads(buf.slice(16, at - 16).to_pybytes())
        self.parts = []
        for n in self.head["sections"]:
            self.parts.append(buf.slice(at, n))
            at += n + -n % 8
        self.doc_ids = np.frombuffer(self.parts[0], "<i8")
        self.missing = np.unpackbits(np.frombuffer(self.parts[1], np.uint8), count=self.head["docs"]).astype(bool)
        self.starts = base.starts_of(np.frombuffer(self.parts[2], "<i8"))

    def ids(self, start: int, stop: int) -> np.ndarray:
        first = start // BLOCK
        return unpack_ids(self.parts[3:], self.head["ids"], first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", roll: int = ROLL, step: int = base.STEP_BYTES) -> list[tuple[str, int]]:
    """Write all documents in ascending id order; the files in order, each with its number of ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = base.held(("encoder", tokenizer), lambda: Encoder(tokenizer))
        part, attempt, turn = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        packer, doc_ids, n_ids = Packer(), [], []

        def close() -> pa.RecordBatch:
            uri, owners = f"{folder}/part-{part:06d}-{turn:04d}-{attempt}.ids", pa.concat_arrays(doc_ids)
            numbers = owners.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            base.put_file(uri, file_parts(numbers, owners.is_null().to_numpy(zero_copy_only=False), np.concatenate(n_ids), packer))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([turn], pa.int32()), pa.array([uri]), pa.array([packer.n], pa.int64())], ["part", "turn", "uri", "n"])

        for b in base.steps(batches, limit=step, keep=("encoder", tokenizer)):
            ids, counts = e.encode(base.strings(base.col(b, "text")))
            packer.add(np.insert(ids, np.cumsum(counts), end_id))
            doc_ids.append(base.col(b, "id"))
            n_ids.append(counts + 1)
            if packer.n >= roll:
                yield close()
                packer, doc_ids, n_ids, turn = Packer(), [], [], turn + 1
        if doc_ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"))
    files = ordered.mapInArrow(write, "part int, turn int, uri string, n long").collect()  # one row per file
    return [(r.uri, r.n) for r in sorted(files, key=lambda r: (r.part, r.turn))]


def read_tokens(spark, files: list[tuple[str, int]], id_col: str = "doc_id", step: int = 1_000_000) -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 of every document, from the files alone."""
    starts = base.starts_of(np.array([n for _, n in files], np.int64)).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.release()
        for b in batches:
            for uri, start in zip(base.col(b, "uri").to_pylist(), base.col(b, "start").to_pylist()):
                f, lo = TokenFile(uri), 0
                n_docs = len(f.doc_ids)
                while lo < n_docs:
                    hi = max(lo + 1, int(np.searchsorted(f.starts, f.starts[lo] + step, "right")) - 1)
                    ids = f.ids(int(f.starts[lo]), int(f.starts[hi])).astype("<u4", copy=False)
                    data, at = memoryview(ids).cast("B"), ((f.starts[lo : hi + 1] - f.starts[lo]) * 4).tolist()
                    crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:])]
                    n = np.diff(f.starts[lo : hi + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[lo:hi], pa.int64(), mask=f.missing[lo:hi]), pa.array(start + f.starts[lo:hi]), pa.array(n), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])
                    lo = hi

    jobs = spark.createDataFrame([(u, s) for (u, _), s in zip(files, starts)], "uri string, start long")
    jobs = jobs.repartition(max(1, len(files)), "uri")
    return jobs.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = base.Scratch(docs.sparkSession, "tokens").path("ids")
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, folder, end_id))


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(base.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
