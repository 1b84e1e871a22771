"""Sweeps over one parameter: embedding dimension, forecast interval, nonlinearity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.indices import names
from ..functions.solvers import solver as resolve
from ..operators.projection import ROWS, of_series, request, shaped
from ..sources.series import quoted
from .grid import Series, run

THETAS = (0.01, 0.1, 0.3, 0.5, 0.75, 1, 1.5, 2, 3, 4, 5, 6, 7, 8, 9)


def embed_dimension(df: DataFrame, columns=None, target=None, maxE: int = 10, lib="", pred="", Tp: int = 1, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, validLib=None, noTime: bool = False, ignoreNan: bool = True, time: str | None = None, series=None, n: int | None = None) -> DataFrame:
    """E, rho of simplex projection for E = 1 to maxE; distances of all E grow from one pass over the lags."""
    req = request(df, columns, target, lib, pred, maxE, Tp, 0, tau, exclusionRadius, embedded, validLib, noTime, time, series, n)

    def kernel(s: Series, spec: dict) -> dict:
        cols, y = [s[c] for c in spec["columns"]], s[spec["target"]]
        if spec["embedded"]:
            p = of_series(s, spec)
            rho = [kernels.projected_rho(p, kernels.simplex(p, p.pred)[0], p.pred)] * maxE
        else:
            rho = kernels.e_sweep(cols, y, spec | {k: spec[k] or [1, len(y)] for k in ("lib", "pred")}, maxE, s.valid)
        return {"E": list(range(1, maxE + 1)), "rho": rho}

    got = run(req.packed, [req.spec], kernel, "E long, rho double")
    return got.select(*map(quoted, req.packed.keys), "E", "rho")


def predict_interval(df: DataFrame, columns=None, target=None, maxTp: int = 10, lib="", pred="", E: int = 1, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, validLib=None, noTime: bool = False, ignoreNan: bool = True, time: str | None = None, series=None, n: int | None = None) -> DataFrame:
    """Tp, rho of simplex projection for Tp = 1 to maxTp."""
    req = request(df, columns, target, lib, pred, E, maxTp, 0, tau, exclusionRadius, embedded, validLib, noTime, time, series, n)

    def kernel(s: Series, spec: dict) -> dict:
        p = of_series(s, spec)
        return {"Tp": [spec["Tp"]], "rho": [kernels.projected_rho(p, kernels.simplex(p, p.pred)[0], p.pred)]}

    got = run(req.packed, [req.spec | {"Tp": t} for t in range(1, maxTp + 1)], kernel, "Tp long, rho double")
    return got.select(*map(quoted, req.packed.keys), "Tp", "rho")


def predict_nonlinear(df: DataFrame, columns=None, target=None, theta=None, lib="", pred="", E: int = 1, Tp: int = 1, knn: int = 0, tau: int = -1, exclusionRadius: int = 0, solver=None, embedded: bool = False, validLib=None, noTime: bool = False, ignoreNan: bool = True, time: str | None = None, series=None, n: int | None = None) -> DataFrame:
    """theta, rho of S-Map for each theta; blocks of prediction rows find their neighbours once for all thetas."""
    thetas = [float(x) for x in (theta.split() if isinstance(theta, str) else theta or THETAS)]
    if len(names(columns)) > 1 and not embedded:
        raise ValueError("several columns need embedded=True")
    req = request(df, columns, target, lib, pred, E, Tp, knn, tau, exclusionRadius, embedded, validLib, noTime, time, series, n)
    fit = resolve(solver)

    def kernel(s: Series, spec: dict) -> dict:
        p = of_series(s, spec)
        own = kernels.own_rows(p)
        out = {"theta": [], "o": [], "p": []}
        if len(own):
            found = kernels.smap_from(p, own, *kernels.neighbours(p, own), thetas, fit) if len(p.lib) else [(np.full(len(own), np.nan),)] * len(thetas)
            for th, (mu, *_) in zip(thetas, found):
                out["theta"] += [th] * len(own)
                out["o"] += kernels.at_rows(p.y, own + p.Tp).tolist()
                out["p"] += mu.tolist()
        return {k: np.array(v) for k, v in out.items()}

    from ..functions.metrics import error_columns

    parts = 1 if req.packed.keys else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = [req.spec | {"smap": True, "block": [i, parts]} for i in range(parts)]
    got = run(req.packed, grid, kernel, "theta double, o double, p double")
    return got.groupBy(*map(quoted, req.packed.keys), "theta").agg(error_columns("o", "p")[0])


def smap_sweep(df: DataFrame, column, target, values, over: str, E: int = 2, Tp: int = 1, tau: int = -1, theta: float = 0, exclusionRadius: int = 0, lib=None, pred=None, embedded: bool = False, noTime: bool = False, knn: int = 0, validLib=None, time: str | None = None, series=None) -> DataFrame:
    """S-Map forecasts for each value of `over` ("Tp" or "theta"), named by it."""
    if not values or not target or not column:
        raise ValueError("values, target and column are needed")
    worst = max(values, key=abs) if over == "Tp" else Tp
    req = request(df, column, target, lib, pred, E, worst, knn, tau, exclusionRadius, embedded, validLib, noTime, time, series, whole_span=True)

    def kernel(s: Series, spec: dict) -> dict:
        p = of_series(s, spec)
        mu, var, *_ = kernels.smap(p, p.pred, spec["theta"])
        seg, r, t, at = kernels.aligned(p, p.pred, s.t)
        both = np.where((at >= 0)[:, None], np.column_stack([mu, var])[np.clip(at, 0, None)], np.nan) if len(mu) else np.full((len(at), 2), np.nan)
        return {"segment": seg, "_i": r, "t": t, "Observations": kernels.at_rows(p.y, r), "Predictions": both[:, 0], "Pred_Variance": both[:, 1], "value": np.full(len(r), float(spec[over]))}

    grid = [req.spec | {"smap": True, "theta": float(theta)} | {over: int(v) if over == "Tp" else float(v)} for v in values]
    got = run(req.packed, grid, kernel, ROWS + ", value double")
    value = F.col("value").cast("long") if over == "Tp" else F.col("value")
    return shaped(req.packed, got, value.alias(over))


def smap_tp(df: DataFrame, TpList, target, column, **options) -> DataFrame:
    """S-Map forecasts per Tp."""
    return smap_sweep(df, column, target, list(TpList), "Tp", **options)


def smap_theta(df: DataFrame, thetaList, target, column, **options) -> DataFrame:
    """S-Map forecasts per theta."""
    return smap_sweep(df, column, target, list(thetaList), "theta", **options)
