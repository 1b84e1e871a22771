"""Simplex and S-Map projections over series and panels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indices, kernels
from ..functions.indices import names, numbers
from ..functions.solvers import solver as resolve
from ..plans.grid import Series, run
from ..sources.series import Packed, pack, quoted
from .embed import lag_name
from .neighbors import simplex_join

#: rows of one series from which its predictions are made in several tasks
SPLIT_ROWS = 3_000


@dataclass
class Request:
    """A validated call: the packed series and the specification that kernels take."""

    packed: Packed
    spec: dict
    columns: list[str]
    target: str


def request(df: DataFrame, columns, target, lib, pred, E=0, Tp=1, knn=0, tau=-1, exclusionRadius=0, embedded=False, validLib=None, noTime=False, time=None, series=None, n: int | None = None, whole_span: bool = False, extra: list[str] = ()) -> Request:
    """Check what the parameters alone allow (and the length, if n is given), and pack the series."""
    if not isinstance(df, DataFrame):
        raise ValueError("a DataFrame is needed")
    cols, targets = names(columns), names(target)
    if not cols or not targets:
        raise ValueError("columns and target are needed")
    lib, pred = numbers(lib), numbers(pred)
    if not whole_span and (not lib or not pred):
        raise ValueError("lib and pred are needed")
    if tau == 0:
        raise ValueError("tau must not be 0")
    if embedded:
        E = len(cols)
    if E < 1:
        raise ValueError("E must be at least 1")
    if lib:
        indices.check(lib, pred, E, tau, Tp, embedded, n)
    packed = pack(df, [*cols, targets[0], *extra], time, noTime, series, validLib)
    spec = {"columns": cols, "target": targets[0], "lib": lib, "pred": pred, "E": E, "Tp": Tp, "knn": knn, "tau": tau, "radius": exclusionRadius, "embedded": embedded}
    return Request(packed, spec, cols, targets[0])


def of_series(s: Series, spec: dict, finder: Callable | None = None) -> kernels.Problem:
    n = len(s.t)
    spec = spec | {k: spec[k] or [1, n] for k in ("lib", "pred")}
    p = kernels.problem([s[c] for c in spec["columns"]], s[spec["target"]], spec, s.valid)
    p.finder = finder
    return p


def simplex_kernel(s: Series, spec: dict) -> dict:
    return simplex_rows(s, of_series(s, spec))


def simplex_rows(s: Series, p: kernels.Problem) -> dict:
    own = kernels.own_rows(p)
    mu, var = kernels.simplex(p, own)
    seg, r, t, at = kernels.aligned(p, own, s.t)
    pick = lambda v: np.where(at >= 0, v[np.clip(at, 0, None)], np.nan) if len(v) else np.full(len(at), np.nan)
    return {"segment": seg, "_i": r, "t": t, "Observations": kernels.at_rows(p.y, r), "Predictions": pick(mu), "Pred_Variance": pick(var), "n_short": np.full(len(r), p.short)}


ROWS = "segment long, _i long, t double, Observations double, Predictions double, Pred_Variance double"


def shaped(packed: Packed, got: DataFrame, *more: Column | str) -> DataFrame:
    return got.select(*map(quoted, packed.keys), "segment", "_i", packed.time(F.col("t")).alias("Time"), "Observations", "Predictions", "Pred_Variance", *more)


def blocks(spec: dict, n: int | None, packed: Packed) -> list[dict]:
    """The specification for each block of prediction rows of a long series."""
    if packed.keys or n is None or n < SPLIT_ROWS:
        return [spec]
    k = min(int(packed.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // (SPLIT_ROWS // 3)))
    return [spec | {"block": [i, k]} for i in range(k)]


def simplex(df: DataFrame, columns=None, target=None, lib="", pred="", E: int = 0, Tp: int = 1, knn: int = 0, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, validLib=None, noTime: bool = False, generateSteps: int = 0, generateConcat: bool = False, ignoreNan: bool = True, returnObject: bool = False, neighbor_algorithm: str = "arrays", time: str | None = None, series=None, n: int | None = None):
    """Simplex projection: Time, Observations, Predictions, Pred_Variance per segment and row (0-based _i).

    lib and pred are 1-based inclusive (start, stop) pairs of rows. series: key columns of a
    panel; each of its series is projected alone. n: rows of a single long series, if known;
    it is checked and split over tasks. neighbor_algorithm "join" plans the same in Spark's own
    operators for a single series, "kdtree" finds neighbours by k-d trees instead of all
    distances (long series in few dimensions), with the same ties, and a function (X, pred,
    lib, k, radius) -> (rows, distances) finds them in its own way. Missing values: a row with a missing coordinate is neither
    learned from nor predicted (with ignoreNan=False such a row is an error, as neighbours of
    it are not defined); a missing target of a neighbour gives a missing prediction,
    and so does a validLib that leaves no library row.
    returnObject: a Result with neighbours.
    """
    if neighbor_algorithm == "join":
        for name, given in (("validLib", validLib is not None), ("series", bool(names(series))), ("noTime", noTime), ("generateSteps", generateSteps > 0), ("returnObject", returnObject)):
            if given:
                raise ValueError(f"neighbor_algorithm join does not take {name}")
        return simplex_join(df, columns, target, lib, pred, E, Tp, knn, tau, exclusionRadius, embedded, time, n)
    if not callable(neighbor_algorithm) and neighbor_algorithm not in kernels.FINDERS:
        raise ValueError(f"no neighbor_algorithm {neighbor_algorithm}")
    finder = neighbor_algorithm if callable(neighbor_algorithm) else kernels.FINDERS[neighbor_algorithm]
    if generateSteps > 0:
        return generate(df, columns, target, lib, E, Tp, knn, tau, exclusionRadius, embedded, validLib, noTime, generateSteps, generateConcat, time, series)
    req = request(df, columns, target, lib, pred, E, Tp, knn, tau, exclusionRadius, embedded, validLib, noTime, time, series, n)
    req.spec["whole_only"] = not ignoreNan
    got = run(req.packed, blocks(req.spec, n, req.packed), lambda s, spec: simplex_rows(s, of_series(s, spec, finder)), ROWS + ", n_short long")
    out = shaped(req.packed, got)
    if returnObject:
        return Result(out, neighbours(req, finder), req, got.groupBy().agg(F.max("n_short").alias("n_short")))
    return out


def simplex_whole(df: DataFrame, columns, target, E: int = 0, Tp: int = 1, knn: int = 0, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, noTime: bool = False, time: str | None = None, series=None) -> DataFrame:
    """Simplex projection of each series over its whole span, each row left out of its own library.

    A series that is too short for E, tau and Tp has its rows with null predictions.
    """
    req = request(df, columns, target, "", "", E, Tp, knn, tau, exclusionRadius, embedded, None, noTime, time, series, whole_span=True)

    def kernel(s: Series, spec: dict) -> dict:
        n, none = len(s.t), np.zeros(0, int)
        span = [1, n]
        try:
            indices.check(span, span, spec["E"], spec["tau"], spec["Tp"], spec["embedded"], n, False)
        except ValueError:
            rows = indices.segments(span, spec["E"], spec["tau"], spec["embedded"], n, False)[0]
            return simplex_rows(s, kernels.Problem(np.zeros((n, 0)), s[spec["target"]], none, none, [rows if len(rows) else np.arange(n)], spec["Tp"], 1))
        return simplex_rows(s, of_series(s, spec))

    return shaped(req.packed, run(req.packed, [req.spec], kernel, ROWS + ", n_short long"))


@dataclass
class Result:
    """A projection with what it was made from."""

    Projection: DataFrame
    Neighbors: DataFrame
    request: Request
    #: prediction rows for which the exclusion radius left too few neighbours, so that it was not applied
    Short: DataFrame | None = None
    Coefficients: DataFrame | None = None
    SingularValues: DataFrame | None = None


def neighbours(req: Request, finder: Callable | None = None) -> DataFrame:
    """Series keys, p, rk (from 1), l, d."""

    def kernel(s: Series, spec: dict) -> dict:
        p = of_series(s, spec, finder)
        rows, dist = kernels.neighbours(p)
        k = rows.shape[1]
        keep = rows.ravel() >= 0
        return {"p": np.repeat(p.pred, k)[keep], "rk": np.tile(np.arange(1, k + 1), len(rows))[keep], "l": rows.ravel()[keep], "d": dist.ravel()[keep]}

    return run(req.packed, [req.spec], kernel, "p long, rk long, l long, d double").drop("g")


def smap(df: DataFrame, columns=None, target=None, lib="", pred="", E: int = 0, Tp: int = 1, knn: int = 0, tau: int = -1, theta: float = 0, exclusionRadius: int = 0, solver=None, embedded: bool = False, validLib=None, noTime: bool = False, generateSteps: int = 0, generateConcat: bool = False, ignoreNan: bool = True, returnObject: bool = False, time: str | None = None, series=None, n: int | None = None):
    """Locally weighted linear maps: a dict of predictions, coefficients and singularValues.

    knn defaults to all library rows but one. solver: see functions.solvers.solver.
    Several columns need embedded=True.
    """
    cols = names(columns)
    if len(cols) > 1 and not embedded:
        raise ValueError("several columns need embedded=True")
    fit = resolve(solver)
    if generateSteps > 0:
        return generate(df, columns, target, lib, E, Tp, knn, tau, exclusionRadius, embedded, validLib, noTime, generateSteps, generateConcat, time, series, theta, fit)
    req = request(df, columns, target, lib, pred, E, Tp, knn, tau, exclusionRadius, embedded, validLib, noTime, time, series, n)
    req.spec |= {"smap": True, "theta": float(theta), "whole_only": not ignoreNan}

    def kernel(s: Series, spec: dict) -> dict:
        p = of_series(s, spec)
        own = kernels.own_rows(p)
        mu, var, coef, sing = kernels.smap(p, own, spec["theta"], fit)
        seg, r, t, at = kernels.aligned(p, own, s.t)
        pick = lambda v: np.where((at >= 0)[:, None], v[np.clip(at, 0, None)], np.nan) if len(v) else np.full((len(at), v.shape[1]), np.nan)
        both = pick(np.column_stack([mu, var]))
        return {"segment": seg, "_i": r, "t": t, "Observations": kernels.at_rows(p.y, r), "Predictions": both[:, 0], "Pred_Variance": both[:, 1], "coef": pick(coef), "sing": pick(sing)}

    got = run(req.packed, blocks(req.spec, n, req.packed), kernel, ROWS + ", coef array<double>, sing array<double>")
    all_rows = shaped(req.packed, got, "coef", "sing")
    out = parts(req, all_rows, tau, E, embedded)
    if returnObject:
        return Result(out["predictions"], neighbours(req), req, None, out["coefficients"], out["singularValues"])
    return out


def parts(req: Request, rows: DataFrame, tau: int, E: int, embedded: bool) -> dict[str, DataFrame]:
    """predictions, coefficients and singularValues from rows with arrays coef and sing."""
    coords = req.columns if embedded else [lag_name(c, tau, j) for j in range(E) for c in req.columns]
    keys = [*map(quoted, req.packed.keys), F.col("segment"), F.col("_i"), F.col("Time")]
    named = ["C0", *(f"∂{req.target}/∂{c}" for c in coords)]
    return {
        "predictions": rows.drop("coef", "sing"),
        "coefficients": rows.select(*keys, *(F.get("coef", F.lit(i)).alias(c) for i, c in enumerate(named))),
        "singularValues": rows.select(*keys, *(F.get("sing", F.lit(i)).alias(f"C{i}") for i in range(len(named)))),
    }


def generate(df, columns, target, lib, E, Tp, knn, tau, exclusionRadius, embedded, validLib, noTime, steps, concat, time=None, series=None, theta: float | None = None, fit=None):
    """Feedback forecasts (a DataFrame; with theta a dict as of smap): each prediction becomes the next row. One task per series, as steps depend on each other."""
    cols = names(columns)
    if len(cols) != 1:
        raise ValueError("generation takes one column")
    bounds = numbers(lib)
    if not bounds:
        raise ValueError("lib is needed")
    req = request(df, cols, target, bounds, [bounds[-1] - 1, bounds[-1]], E, Tp, knn, tau, exclusionRadius, embedded, validLib, noTime, time, series)
    req.spec |= {"steps": steps, "theta": theta, "smap": theta is not None}

    def kernel(s: Series, spec: dict) -> dict:
        x = s[spec["columns"][0]]
        out = kernels.generate(x, s.t, spec, spec["steps"], spec["theta"], fit, s.valid)
        rows = [(0, *x) for x in out]
        if concat:
            rows = [(0, i, t, v, np.nan, np.nan, [], []) for i, (t, v) in enumerate(zip(s.t, x))] + rows
        return dict(zip(("segment", "_i", "t", "Observations", "Predictions", "Pred_Variance", "coef", "sing"), map(list, zip(*rows))))

    got = shaped(req.packed, run(req.packed, [req.spec], kernel, ROWS + ", coef array<double>, sing array<double>"), "coef", "sing")
    return got.drop("coef", "sing") if theta is None else parts(req, got, tau, E, embedded)
