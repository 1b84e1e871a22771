"""Convergent cross mapping: how well one variable's states, from ever larger libraries, tell another's values.

Library samples are replayed in the tasks from one seed per direction, so no sample is
made on the driver and results do not depend on how tasks are cut: a grid row is one
direction and library size, and all samples of it share one distance matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.indices import names, numbers
from ..plans.grid import Series, run
from ..sources.series import quoted
from .projection import Request, request


def library_sizes(value) -> list[int]:
    """Sizes as given; three numbers of which the third is less than the second mean start, stop, step."""
    sizes = numbers(value)
    if not sizes:
        raise ValueError("libSizes are needed")
    if len(sizes) == 3 and sizes[2] < sizes[1]:
        start, stop, step = sizes
        if step < 1 or start > stop or start < 1:
            raise ValueError("libSizes: start, stop and step do not fit")
        return list(range(start, stop + 1, step))
    if min(sizes) < 1:
        raise ValueError("libSizes must be positive")
    return sizes


def ccm(df: DataFrame, columns=None, target=None, libSizes="", sample: int = 0, E: int = 0, Tp: int = 0, knn: int = 0, tau: int = -1, exclusionRadius: int = 0, seed=None, embedded: bool = False, validLib=None, includeData: bool = False, noTime: bool = False, ignoreNan: bool = True, returnObject: bool = False, time: str | None = None, series=None, n: int | None = None):
    """LibSize, "column:target", "target:column": mean rho over samples for each library size.

    includeData: a dict of LibMeans and PredictStats (direction, LibSize, sample and errors);
    returnObject: a CCMResult with both, and the request.
    """
    cols, targets = names(columns), names(target)
    sizes = library_sizes(libSizes)
    if sample < 1:
        raise ValueError("sample must be at least 1")
    E_real = len(cols) if embedded else E
    if E_real < 1:
        raise ValueError("E must be at least 1")
    if min(sizes) < E_real + 2:
        raise ValueError(f"libSizes must be at least E + 2 = {E_real + 2}")
    if n is not None and max(sizes) > n:
        raise ValueError(f"libSizes go beyond the {n} rows of the series")
    req = request(df, cols, targets[:1], "", "", E, Tp, knn, tau, exclusionRadius, embedded, validLib, noTime, time, series, whole_span=True, extra=targets)
    base = req.spec | {"sizes": sizes, "sample": sample, "seed": seed}
    names_of = [f"{cols[0]}:{targets[0]}", f"{targets[0]}:{cols[0]}"]
    ways = [(cols, targets[0]), (targets, cols[0])]
    grid = [base | {"columns": c, "target": t, "way": w, "only": i, "E": len(c) if embedded else E} for w, (c, t) in enumerate(ways) for i in range(len(sizes))]
    got = run(req.packed, grid, ccm_kernel, CCM_ROWS)
    keys = [*map(quoted, req.packed.keys)]
    rho = F.round("rho", 5)
    mean = got.groupBy(*keys, "LibSize").agg(*(F.avg(F.when(F.col("way") == w, rho)).alias(x) for w, x in enumerate(names_of)))
    if not includeData and not returnObject:
        return mean
    stats = got.select(*keys, F.when(F.col("way") == 0, names_of[0]).otherwise(names_of[1]).alias("direction"), "LibSize", "sample", *(F.round(c, 5).alias(c) for c in ("rho", "MAE", "mean_abs_err", "CAE", "RMSE")))
    return CCMResult(mean, stats, req) if returnObject else {"LibMeans": mean, "PredictStats": stats}


@dataclass
class CCMResult:
    """A convergent cross map with what it was made from."""

    LibMeans: DataFrame
    PredictStats: DataFrame
    request: Request


CCM_ROWS = "way long, LibSize long, sample long, rho double, MAE double, mean_abs_err double, CAE double, RMSE double"


def ccm_kernel(s: Series, spec: dict) -> dict:
    size = spec["sizes"][spec["only"]]
    errs = kernels.ccm([s[c] for c in spec["columns"]], s[spec["target"]], spec, spec["sizes"], spec["sample"], spec["seed"], spec["only"], s.valid)
    out = {k: [e[k] for e in errs] for k in ("rho", "MAE", "mean_abs_err", "CAE", "RMSE")}
    n = len(errs)
    return {"way": [spec["way"]] * n, "LibSize": [size] * n, "sample": list(range(n)), **out}
