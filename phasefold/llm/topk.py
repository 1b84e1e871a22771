"""Exact top-k search by inner product: columnar branch and bound.

Candidates are laid out dimension by dimension. Scores of a block of queries with a
batch of candidates accumulate one block of dimensions at a time; after each block,
pairs whose score plus the largest possible rest (Cauchy-Schwarz on the remaining
mass of both vectors) falls short of the query's bound are compacted away. The bound
is first the query's k-th best score over a bounded pilot of candidates, and then rises
with the k best found in the task. It only prunes: all candidates are searched.

Queries lie in the shared folder and are read in blocks, so neither their number nor
the candidates' has to fit in memory. A task gathers its candidates up to a bound of
bytes (a whole partition, mostly), keeps the k best of each query over all of them and
sends these; a window with a partial top-k before its shuffle merges the tasks'.

Defined results: vectors that are null, or hold null or non-finite components, take
no part; vectors meet vectors of the same length only; a query skips every row with
its own id; equal scores go to the smaller id; fewer than k candidates give fewer
rows; query rows with the same id are answered each on its own, and repeated candidates
count each. Integer scores are exact as long as they are below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

DIMS = 8
QUERY_BLOCK = 256
EXACT = float(2**53)
#: bytes of candidates that a task searches at once, and candidates between two rises of the bounds
HELD, RISE = 64 << 20, 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): ids with floor(scale * x) as doubles, for vectors that take part."""
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    ok = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    wide = F.transform(F.col(vec_col), lambda x: x.cast("double") * F.lit(float(scale)))
    small = F.forall(wide, lambda x: F.abs(x) < F.lit(float(2**62)))
    v = F.when(small, whole).otherwise(wide)  # from 2**53 on a double is its own floor
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _by_length(ids: np.ndarray, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of dimensions x vectors) for each length."""
    n = np.diff(np.asarray(lists.offsets))
    flat, at = np.asarray(lists.values), np.asarray(lists.offsets)[:-1]
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield ids[rows], np.ascontiguousarray(flat[at[rows][:, None] + np.arange(d)].T) if d else np.zeros((0, len(rows)))


def search_block(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, as (query position, id, score) arrays.

    q and c are dimensions x vectors; pairs below bound[query] may be left out.
    """
    d = len(q)
    q_rest = np.sqrt(np.cumsum((q * q)[::-1], 0)[::-1]) if d else np.zeros((0, q.shape[1]))
    c_rest = np.sqrt(np.cumsum((c * c)[::-1], 0)[::-1]) if d else np.zeros((0, c.shape[1]))
    exact = not d or float(q_rest[0].max(initial=0)) * float(c_rest[0].max(initial=0)) < EXACT
    if not exact:  # beyond doubles: whole numbers of any size, no pruning
        qi, ci = (x.ravel() for x in np.indices((q.shape[1], c.shape[1])))
        qs, cs = [[int(x) for x in v] for v in q.T.tolist()], [[int(x) for x in v] for v in c.T.tolist()]
        s = np.array([sum(a * b for a, b in zip(qs[i], cs[j])) for i, j in zip(qi.tolist(), ci.tolist())], object)
        s = np.clip(s, -(2**63), 2**63 - 1).astype(np.int64) if len(s) else np.zeros(0, np.int64)
    else:
        first = min(DIMS, d)
        score = q[:first].T @ c[:first]
        rest = q_rest[first][:, None] * c_rest[first] if first < d else 0.0
        qi, ci = np.nonzero(score + rest * (1 + 1e-9) + 1e-6 >= bound[:, None])
        s = score[qi, ci]
        for lo in range(first, d, DIMS):
            for x in range(lo, min(lo + DIMS, d)):
                s = s + q[x, qi] * c[x, ci]
            if lo + DIMS < d:
                live = s + q_rest[lo + DIMS, qi] * c_rest[lo + DIMS, ci] * (1 + 1e-9) + 1e-6 >= bound[qi]
                qi, ci, s = qi[live], ci[live], s[live]
        live = s >= bound[qi]
        qi, ci, s = qi[live], ci[live], np.rint(s[live]).astype(np.int64)
    other = q_ids[qi] != c_ids[ci]
    qi, ids, s = qi[other], c_ids[ci[other]], s[other]
    order = np.lexsort((ids, -s.astype(object) if len(s) and s.min() == -(2**63) else -s, qi))
    qi, ids, s = qi[order], ids[order], s[order]
    first = np.searchsorted(qi, np.arange(len(q_ids) + 1))
    best = np.arange(len(qi)) - first[qi] < k
    return qi[best], ids[best], s[best]


def best_of(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """search_block() over candidates in turns, each with the bounds that those before it raised."""
    bound, best = bound.copy(), None
    for lo in range(0, len(c_ids), RISE):
        new = search_block(q_ids, q, bound, c_ids[lo : lo + RISE], np.ascontiguousarray(c[:, lo : lo + RISE]), k)
        if best is None:
            best = new
        elif len(new[0]):
            qi, ids, s = (np.concatenate(x) for x in zip(best, new))
            order = np.lexsort((ids, -s.astype(object) if s.min() == -(2**63) else -s, qi))
            qi, ids, s = qi[order], ids[order], s[order]
            first = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(q_ids)))[qi] < k
            best = qi[first], ids[first], s[first]
        n = np.bincount(best[0], minlength=len(q_ids))
        full = n >= k
        # the score in doubles may be rounded up: one less never prunes an equal one
        bound[full] = np.maximum(bound[full], np.nextafter(best[2][np.cumsum(n)[full] - 1].astype(np.float64), -np.inf))
    return best if best is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bounds(q_ids, q, pilot_ids, pilot, k) -> np.ndarray:
    """Each query's k-th best score over the pilot; -inf where it has fewer."""
    qi, _, s = search_block(q_ids, q, np.full(len(q_ids), -np.inf), pilot_ids, pilot, k)
    n, out = np.bincount(qi, minlength=len(q_ids)), np.full(len(q_ids), -np.inf)
    last = np.cumsum(n) - 1
    out[n >= k] = s[last[n >= k]]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", pilot: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the highest scores for each row of `queries`.

    pilot: rows that give the queries' starting bounds (a bound on memory, not on the search).
    """
    spark = vectors.sparkSession
    scratch = base.Scratch(spark, "topk")
    rows, asked = usable(vectors, id_col, vec_col, scale), usable(queries, id_col, vec_col, scale)
    head = rows.limit(pilot).toArrow()
    p_ids, p_vec = head.column("id").combine_chunks().to_numpy(), head.column("v").combine_chunks()
    at_hand = {len(m): (i, m) for i, m in _by_length(p_ids, p_vec)} if len(p_ids) else {}

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, m in _by_length(base.col(b, "id").to_numpy(), base.col(b, "v")):
                for lo in range(0, len(ids), QUERY_BLOCK):
                    i, x = ids[lo : lo + QUERY_BLOCK], np.ascontiguousarray(m[:, lo : lo + QUERY_BLOCK])
                    bound = _bounds(i, x, *at_hand[len(m)], k) if len(m) in at_hand else np.full(len(i), -np.inf)
                    flat = pa.array(np.ascontiguousarray(x.T).ravel(), pa.float64())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * len(m), pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(i), lists, pa.array(bound)], ["id", "v", "bound"])

    scratch.save(asked.mapInArrow(bounds, "id long, v array<double>, bound double"), "queries")
    place = scratch.path("queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = base.file_system(place)
        files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet"))

        def chunks() -> Iterator[tuple[np.ndarray, pa.ListArray]]:
            own, size = [], 0
            for b in batches:
                own.append(b)
                size += b.nbytes
                if size >= HELD:
                    yield own
                    own, size = [], 0
            if own:
                yield own

        for own in chunks():
            ids = np.concatenate([base.col(b, "id").to_numpy() for b in own])
            cands = list(_by_length(ids, pa.concat_arrays([base.col(b, "v") for b in own])))
            for n_file, file in enumerate(files):
                at = n_file << 40  # a number for each query row, the same in all tasks
                for qb in pq.ParquetFile(fs.open_input_file(file)).iter_batches(QUERY_BLOCK):
                    bound = base.col(qb, "bound").to_numpy()
                    n, rows = np.diff(np.asarray(base.col(qb, "v").offsets)), at + np.arange(qb.num_rows)
                    at += qb.num_rows
                    for q_ids, q in _by_length(base.col(qb, "id").to_numpy(), base.col(qb, "v")):
                        for c_ids, c in cands:
                            if len(c) == len(q):
                                qi, found, s = best_of(q_ids, q, bound[n == len(q)], c_ids, c, k)
                                yield pa.RecordBatch.from_arrays([pa.array(rows[n == len(q)][qi]), pa.array(q_ids[qi]), pa.array(found), pa.array(s)], ["q_row", "query_id", "vec_id", "score"])

    best = rows.mapInArrow(search, "q_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = base.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= 10
"""
