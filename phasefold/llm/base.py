"""Shared plumbing: the shared scratch folder, Arrow word splitting, batching."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that one vectorised step handles at most (a longer text is a step of its own)
STEP_BYTES = 4_000_000


def bounded(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most 2,000 rows and 16 MB, as rows are whole texts."""
    for name, most in (("maxRecordsPerBatch", 2_000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(col, mod: int, value: int):
    """Whether crc32(id as text) mod `mod` is value; false for a null id."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % F.lit(mod) == value, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case: results take their place."""
    low = {n.lower() for n in names}
    return df.select(*("`" + c.replace("`", "``") + "`" for c in df.columns if c.lower() not in low))


def schema_of(df: DataFrame) -> str:
    return ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in df.schema)


class Scratch:
    """A folder of its own in the folder that all executors share.

    The cluster names it in spark.checkpoint.dir; a path without a scheme lies on the
    cluster's default file system. Only where it is unset and the master is local (tests)
    a local temporary folder stands in. Tables written here cut the lineage and outlive
    lost executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        bounded(spark)
        self.spark = spark
        self.uri = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}" if name else self.uri

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Delete the folder, once nothing reads its tables any more."""
        self.drop("")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder as a URI with a scheme."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return "file://" + tempfile.mkdtemp(prefix="phasefold-")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a URI as Hadoop names it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "dbfs":  # mounted on every executor
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def put_file(uri: str, parts: list[bytes]) -> None:
    """Write a file from an executor: under another name first, then moved, so readers see whole files only."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(tmp) as out:
        for p in parts:
            out.write(p)
    fs.move(tmp, path)


def open_map(uri: str) -> pa.Buffer:
    """A file's bytes; mapped, not loaded, on a local or mounted file system."""
    fs, path = file_system(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def mapped(uri: str) -> bool:
    return isinstance(file_system(uri)[0], pafs.LocalFileSystem)


def put_json(uri: str, value) -> None:
    put_file(uri, [json.dumps(value).encode()])


def get_json(uri: str):
    return json.loads(open_map(uri).to_pybytes())


def strings(col) -> pa.StringArray:
    """A text column as one StringArray with nulls as empty strings and offset 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.string()), "")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4) if n else np.zeros(1, np.int32)
    data = col.buffers()[2] if n and col.buffers()[2] is not None else pa.py_buffer(b"")
    lo, hi = int(offsets[0]), int(offsets[-1])
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets - lo)), data.slice(lo, hi - lo))


def raw(col: pa.StringArray) -> tuple[np.ndarray, bytes]:
    """Offsets and bytes of a column from strings()."""
    n = len(col)
    return np.frombuffer(col.buffers()[1], np.int32, n + 1), col.buffers()[2].to_pybytes()


def translated(col: pa.StringArray, to: bytes) -> pa.StringArray:
    """Map every byte through a 256-byte table that keeps bytes from 0x80 as they are."""
    offsets, data = raw(col)
    return pa.StringArray.from_buffers(len(col), pa.py_buffer(offsets), pa.py_buffer(data.translate(to)))


def split_words(col: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all rows in one array, and each row's number of words."""
    lists = pc.ascii_split_whitespace(col)
    flat = lists.flatten()
    counts = np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.sum(full).as_py() not in (None, len(flat)):
        keep = full.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(counts)), counts)[keep]
        counts = np.bincount(row, minlength=len(counts)).astype(np.int64)
        flat = flat.filter(full)
    return flat, counts


def coded(flat: pa.StringArray) -> tuple[np.ndarray, list[str]]:
    """Dictionary codes of the words, and the distinct words."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_numpy(zero_copy_only=False).tolist()


_held: dict = {}


def held(key, make):
    """A worker's object for a key, made once; workers outlive tasks and stages."""
    if key not in _held:
        release(key)
        _held[key] = make()
    return _held[key]


def release(keep=None) -> None:
    """Drop what the worker holds for other operators, and give the memory back."""
    gone = [k for k in _held if k != keep]
    for k in gone:
        del _held[k]
    if gone:
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES, keep=None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most `limit` bytes of text, or one row.

    keep: the key of what the worker may go on holding; all else is released first.
    """
    release(keep)
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, lo = np.cumsum(size), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
            yield b.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()
            lo = hi
    trim()


def col(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def starts_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out
