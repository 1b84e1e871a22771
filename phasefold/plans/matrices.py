"""Fan-outs over many columns: best dimensions, cross maps, cross-map and convergence matrices.

A wide table becomes one row per column (its values as an array). Pairs of columns are
joined to these rows by name, so a task gets two columns and never the whole table, and
the number of columns is bounded by no single row. Matrices join each source with blocks
of TARGETS targets, so its neighbours are searched once a block and not once a pair.
Spark broadcasts the column rows only where their size allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.indices import names, numbers
from ..operators.ccm import library_sizes
from ..sources.series import column_rows, time_column
from .grid import _array, _column, _types


#: targets that one task holds at once
TARGETS = 32


def value_columns(df: DataFrame, noTime: bool, time: str | None) -> list[str]:
    at = time_column(df, time, noTime, [])
    return [c for c in df.columns if c != at]


def pair_run(df: DataFrame, jobs: list[tuple], job_schema: str, kernel: Callable, schema: str, noTime: bool = False, time: str | None = None, valid: str | None = None) -> DataFrame:
    """kernel(x, y, job) for jobs (a, b, ...): x and y are columns a and b; gives a, b and the kernel's columns.

    valid: an SQL condition on the rows of df; job["valid"] is an array of booleans then, else None.
    """
    spark = df.sparkSession
    todo = spark.createDataFrame(jobs, job_schema)
    used, flag = value_columns(df, noTime, time), "is valid"
    at = time_column(df, time, noTime, [])
    rows = df if valid is None else df.withColumn(flag, F.coalesce(F.expr(valid), F.lit(False)).cast("double"))
    rows = column_rows(rows, used if valid is None else [*used, flag], at, noTime)
    x, y = rows.select(F.col("name").alias("a"), F.col("v").alias("x")), rows.select(F.col("name").alias("b"), F.col("v").alias("y"))
    both = todo.join(x, "a").join(y, "b")
    if valid is not None:
        both = both.withColumn("flag", F.lit(flag)).join(rows.select(F.col("name").alias("flag"), F.col("v").alias("valid")), "flag").drop("flag")
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *todo.columns)
    extra = [c for c in todo.columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema)
    out_names = [s.strip().split(" ")[0] for s in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _types(schema)
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                job = {c: at[c][r].as_py() for c in extra} | {"valid": _array(at["valid"][r]) > 0 if valid is not None else None}
                got = kernel(_array(at["x"][r]), _array(at["y"][r]), job)
                n = len(next(iter(got.values())))
                cols = [pa.array([job[c]] * n, b.schema.field(c).type) for c in extra]
                yield pa.RecordBatch.from_arrays([*cols, *(_column(got[c], types[c]) for c in out_names)], [*extra, *out_names])

    return both.mapInArrow(each, f"{kinds}, {schema}")


def block_run(df: DataFrame, dims: dict[str, int], kernel: Callable, schema: str, noTime: bool = False, time: str | None = None, valid: str | None = None) -> DataFrame:
    """kernel(x, [(target, y) ...], E, valid) for every column x with all others, by blocks: gives a and the kernel's columns.

    valid: an SQL condition on the rows of df, an array of booleans in the kernel.
    """
    spark, used = df.sparkSession, list(dims)
    n_blocks = -(-len(used) // TARGETS)
    jobs = spark.createDataFrame([(c, E, k) for c, E in dims.items() for k in range(n_blocks)], "a string, E int, block int")
    place = spark.createDataFrame([(c, i % n_blocks) for i, c in enumerate(used)], "name string, block int")
    flag = "is valid"
    at = time_column(df, time, noTime, [])
    rows = df if valid is None else df.withColumn(flag, F.coalesce(F.expr(valid), F.lit(False)).cast("double"))
    rows = column_rows(rows, used if valid is None else [*used, flag], at, noTime)
    ys = rows.join(place, "name").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("name", "v"))).alias("ys"))
    both = jobs.join(rows.select(F.col("name").alias("a"), F.col("v").alias("x")), "a").join(ys, "block")
    if valid is not None:
        both = both.withColumn("flag", F.lit(flag)).join(rows.select(F.col("name").alias("flag"), F.col("v").alias("valid")), "flag").drop("flag")
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "block")
    out_names = [s.strip().split(" ")[0] for s in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _types(schema)
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                a, ys = at["a"][r].as_py(), at["ys"][r].values
                targets = [(name, _array(v)) for name, v in zip(ys.field("name").to_pylist(), ys.field("v")) if name != a]
                got = kernel(_array(at["x"][r]), targets, at["E"][r].as_py(), _array(at["valid"][r]) > 0 if valid is not None else None)
                n = len(next(iter(got.values())))
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.string()), *(_column(got[c], types[c]) for c in out_names)], ["a", *out_names])

    return both.mapInArrow(each, f"a string, {schema}")


def _spans(lib, pred, n: int) -> dict:
    return {"lib": numbers(lib) or [1, n], "pred": numbers(pred) or [1, n]}


def _dimensions(E, columns: list[str]) -> dict[str, int]:
    """E of each column from one number or one per column."""
    each = [int(x) for x in E] if isinstance(E, (list, tuple, np.ndarray)) else [int(E)] * len(columns)
    if len(each) == 1:
        each *= len(columns)
    if len(each) != len(columns):
        raise ValueError(f"{len(each)} values of E for {len(columns)} columns")
    if min(each, default=1) < 1:
        raise ValueError("E must be at least 1")
    return dict(zip(columns, each))


def embed_dim_columns(df: DataFrame, target: str | None = None, maxE: int = 15, minE: int = 1, lib=None, pred=None, Tp: int = 1, tau: int = -1, exclusionRadius: int = 0, firstMax: bool = False, noTime: bool = False, time: str | None = None, validLib: str | None = None) -> DataFrame:
    """column, target, E, rho: each column's best dimension for the target (itself by default).

    The largest rho, rounded to 4 digits, or with firstMax the first that both neighbours
    stay below (the last, if none); never below minE. validLib: an SQL condition for rows
    that may be neighbours.
    """
    cols = value_columns(df, noTime, time)
    if target is not None and target not in cols:
        raise ValueError(f"no such column: {target}")

    def kernel(x, y, job) -> dict:
        spec = _spans(lib, pred, len(x)) | {"Tp": Tp, "tau": tau, "radius": exclusionRadius}
        return {"E": list(range(1, maxE + 1)), "rho": kernels.e_sweep([x], y, spec, maxE, job["valid"])}

    got = pair_run(df, [(c, target or c) for c in cols], "a string, b string", kernel, "E long, rho double", noTime, time, validLib)
    return best_dimension(got.withColumnsRenamed({"a": "column", "b": "target"}), firstMax, minE)


def best_dimension(rho: DataFrame, firstMax: bool = False, minE: int = 1) -> DataFrame:
    """column, target, E, rho from rho by (column, target, E), the least such E, at least minE."""
    w = Window.partitionBy("column", "target").orderBy("E")
    r = F.coalesce("rho", F.lit(-2.0))
    if firstMax:
        before, after = F.lag(r).over(w), F.lead(r).over(w)
        marked = rho.withColumn("hit", F.coalesce((r > before) & (r > after), F.lit(False)))
        best = marked.groupBy("column", "target").agg(F.coalesce(F.min(F.when(F.col("hit"), F.col("E"))), F.max("E")).alias("best"))
    else:
        best = rho.groupBy("column", "target").agg((-F.max(F.struct(F.round(r, 4).alias("r"), (-F.col("E")).alias("e")))["e"]).alias("best"))
    best = best.withColumn("best", F.greatest("best", F.lit(minE)))
    return rho.join(best, ["column", "target"]).where(F.col("E") == F.col("best")).select("column", "target", "E", "rho")


def cross_map_columns(df: DataFrame, target: str | None = None, E=0, Evec=None, Tp: int = 1, tau: int = -1, exclusionRadius: int = 0, lib=None, pred=None, noTime: bool = False, time: str | None = None, returnError: bool = False) -> DataFrame:
    """Simplex of every column to one target (each to itself by default): its rows, or with returnError its errors."""
    cols = value_columns(df, noTime, time)
    dims = _dimensions(Evec if Evec is not None else E, cols)
    jobs = [(c, target or c, dims[c]) for c in cols]
    return _cross_map(df, jobs, Tp, tau, exclusionRadius, lib, pred, noTime, time, returnError)


def _cross_map(df, jobs, Tp, tau, radius, lib, pred, noTime, time, errors_only: bool) -> DataFrame:
    def kernel(x, y, job) -> dict:
        p = kernels.problem([x], y, _spans(lib, pred, len(x)) | {"E": job["E"], "Tp": Tp, "tau": tau, "radius": radius})
        mu, var = kernels.simplex(p, p.pred)
        if errors_only:
            return {k: [v] for k, v in kernels.errors(kernels.at_rows(y, p.pred + Tp), mu).items()}
        r = p.pred + Tp
        return {"_i": r, "Observations": kernels.at_rows(y, r), "Predictions": mu, "Pred_Variance": var}

    schema = "rho double, MAE double, mean_abs_err double, CAE double, RMSE double" if errors_only else "_i long, Observations double, Predictions double, Pred_Variance double"
    got = pair_run(df, jobs, "a string, b string, E int", kernel, schema, noTime, time)
    return got.withColumnsRenamed({"a": "column", "b": "target"})


def cross_map_column_list(df: DataFrame, columns=(), target: str | None = None, E: int = 0, Tp: int = 1, tau: int = -1, exclusionRadius: int = 0, lib=None, pred=None, embedded: bool = False, noTime: bool = False, time: str | None = None) -> DataFrame:
    """Simplex of each entry of a list of columns, or of lists of columns, to the target: rows named by the entry."""
    from ..operators.projection import ROWS, request, shaped, simplex_kernel
    from .grid import run

    entries = [names(c) for c in columns]
    if not entries or not target:
        raise ValueError("columns and target are needed")
    used = list(dict.fromkeys(c for e in entries for c in e))
    req = request(df, used, target, lib, pred, E, Tp, 0, tau, exclusionRadius, embedded, None, noTime, time, whole_span=True)

    def kernel(s, spec: dict) -> dict:
        out = simplex_kernel(s, spec)
        return out | {"columns": [" ".join(spec["columns"])] * len(out["_i"])}

    grid = [req.spec | {"columns": e, "E": len(e) if embedded else E} for e in entries]
    got = run(req.packed, grid, kernel, ROWS + ", columns string")
    return shaped(req.packed, got, "columns")


def cross_map_matrix(df: DataFrame, E=0, Tp: int = 1, tau: int = -1, exclusionRadius: int = 0, lib=None, pred=None, threshold: float | None = None, returnValue: str = "dataframe", noTime: bool = False, time: str | None = None) -> DataFrame:
    """rho of every column to every other: column, target, rho ("dataframe"), or one row per column ("matrix").

    E may be one per (source) column. The diagonal is null; so is a rho not above the threshold.
    """
    if returnValue not in ("dataframe", "matrix"):
        raise ValueError(f"returnValue: {returnValue}")
    cols = value_columns(df, noTime, time)
    dims = _dimensions(E, cols)

    def kernel(x, targets, E, valid) -> dict:
        p, rhos = kernels.problem([x], x, _spans(lib, pred, len(x)) | {"E": E, "Tp": Tp, "tau": tau, "radius": exclusionRadius}), []
        rows, dist = kernels.neighbours(p)
        for _, y in targets:
            rhos.append(kernels.errors(kernels.at_rows(y, p.pred + Tp), kernels.weighted_mean(rows, dist, y, Tp)[0])["rho"])
        return {"b": [name for name, _ in targets], "rho": rhos}

    got = block_run(df, dims, kernel, "b string, rho double", noTime, time).select(F.col("a").alias("column"), F.col("b").alias("target"), "rho")
    one = df.sparkSession.createDataFrame([(c,) for c in cols], "a string")
    if threshold is not None:
        got = got.withColumn("rho", F.when(F.col("rho") > threshold, F.col("rho")))
    got = got.unionByName(one.select(F.col("a").alias("column"), F.col("a").alias("target"), F.lit(None).cast("double").alias("rho")))
    return got if returnValue == "dataframe" else matrix(got, cols, "rho")


def matrix(long: DataFrame, columns: list[str], value: str) -> DataFrame:
    """One row per column, one column per target."""
    return long.groupBy("column").pivot("target", columns).agg(F.max(value))


def converge(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(y0, b, a) of y0 + b (1 - exp(-a x)) by bounded Gauss-Newton with damping; 0 <= a."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) < 3:
        return (np.nan,) * 3

    def linear(a):
        A = np.column_stack([np.ones_like(x), 1 - np.exp(-a * x)])
        c = np.linalg.lstsq(A, y, rcond=None)[0]
        return c, ((A @ c - y) ** 2).sum()

    # two parameters are linear given a, so only a is searched: a grid, then golden section
    grid = np.logspace(-3, 3, 121)
    best = min(range(len(grid)), key=lambda i: linear(grid[i])[1])
    lo, hi, g = np.log(grid[max(0, best - 1)]), np.log(grid[min(len(grid) - 1, best + 1)]), (5**0.5 - 1) / 2
    for _ in range(80):
        m, n = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, n) if linear(np.exp(m))[1] < linear(np.exp(n))[1] else (m, hi)
    a = float(np.exp((lo + hi) / 2))
    c = linear(a)[0]
    return float(c[0]), float(c[1]), a


def ccm_matrix(df: DataFrame, E, libSizes=(), pLibSizes=(10, 20, 80, 90), sample: int = 30, Tp: int = 0, tau: int = -1, exclusionRadius: int = 0, expConverge: bool = False, seed: int = 0, noTime: bool = False, time: str | None = None, includeCCM: bool = False, validLib: str | None = None) -> DataFrame:
    """column, target, rho (at the largest library), slope (of rho over libSize / N), error[, y0, b, a][, LibSize list and rho list].

    E: one number or one per column. libSizes, or percentiles of the length. A pair that
    cannot be mapped has nulls and says why in `error`. validLib: an SQL condition for rows
    that may be in a library.
    """
    cols = value_columns(df, noTime, time)
    dims = _dimensions(E, cols)
    fixed = library_sizes(libSizes) if len(numbers(libSizes)) else None

    def kernel(x, targets, E, valid) -> dict:
        n = len(x)
        sizes = fixed or sorted({int(n * q / 100) for q in pLibSizes})
        m = len(targets)
        out = {"b": [name for name, _ in targets]}
        try:
            if min(sizes) < E + 2:
                raise ValueError(f"library sizes must be at least E + 2 = {E + 2}")
            if max(sizes) > n:
                raise ValueError(f"library sizes go beyond the {n} rows")
            spec = {"E": E, "Tp": Tp, "tau": tau, "radius": exclusionRadius}
            # samples by size, target and draw: the draws and their neighbours are the source's
            errors = kernels.ccm_targets([x], [y for _, y in targets], spec, sizes, sample, seed, valid)
        except ValueError as e:
            none = [np.nan] * m
            return out | {k: none for k in ("rho", "slope", "y0", "b_", "a_")} | {"sizes": [[]] * m, "rhos": [[]] * m, "error": [str(e)] * m}
        rel = np.array(sizes) / n
        d, rows = rel - rel.mean(), []
        for t in range(m):
            rhos = [float(np.mean([round(e["rho"], 5) for e in by_size[t]])) for by_size in errors]
            slope = float((d * np.array(rhos)).sum() / (d * d).sum()) if len(sizes) > 1 else np.nan
            rows.append((rhos[-1], slope, *(converge(rel, np.array(rhos)) if expConverge else (np.nan,) * 3), sizes, rhos, None))
        return out | dict(zip(("rho", "slope", "y0", "b_", "a_", "sizes", "rhos", "error"), map(list, zip(*rows)) if rows else [[]] * 8))

    got = block_run(df, dims, kernel, "b string, rho double, slope double, y0 double, b_ double, a_ double, sizes array<double>, rhos array<double>, error string", noTime, time, validLib)
    out = [F.col("a").alias("column"), F.col("b").alias("target"), "rho", "slope", "error"]
    out += [F.col("y0"), F.col("b_").alias("b"), F.col("a_").alias("a")] if expConverge else []
    out += [F.transform("sizes", lambda v: v.cast("long")).alias("LibSizes"), F.col("rhos")] if includeCCM else []
    return got.select(*out)
