"""Multiview: rank all state spaces of D coordinates and average the forecasts of the best."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.indices import names, numbers
from ..functions.metrics import error_columns
from ..plans.grid import Series, run
from ..sources.series import pack
from .embed import lag_name
from .projection import ROWS, of_series, shaped, simplex_kernel


def combinations_from(items: list, size: int, first: int, stop: int) -> Iterator[tuple]:
    """Combinations number first to stop - 1 in the order of itertools.combinations, without those before."""
    n, at, left, low = len(items), [], first, 0
    for k in range(size, 0, -1):
        while (more := math.comb(n - low - 1, k - 1)) <= left:
            left -= more
            low += 1
        at.append(low)
        low += 1
    for _ in range(first, stop):
        yield tuple(items[i] for i in at)
        k = next((i for i in reversed(range(size)) if at[i] < n - size + i), None)
        if k is None:
            return
        at[k:] = range(at[k] + 1, at[k] + 1 + size - k)


class _Views:
    """A series whose columns are also its lags, by name."""

    def __init__(self, s: Series, spec: dict):
        X = kernels.embed([s[c] for c in spec["of"]], spec["lags"], spec["tau"])
        self.t, self.valid, self._s = s.t, s.valid, s
        self._at = {lag_name(c, spec["tau"], j): X[:, j * len(spec["of"]) + i] for j in range(spec["lags"]) for i, c in enumerate(spec["of"])}

    def __getitem__(self, name: str):
        return self._at[name] if name in self._at else self._s[name]


def multiview(df: DataFrame, columns=None, target=None, lib="", pred="", D: int = 0, E: int = 1, Tp: int = 1, knn: int = 0, tau: int = -1, multiview: int = 0, exclusionRadius: int = 0, trainLib: bool = True, excludeTarget: bool = False, ignoreNan: bool = True, noTime: bool = False, time: str | None = None, n: int | None = None) -> dict[str, DataFrame]:
    """Predictions (averages over the best views), View (columns and errors of each) and Views (each one's forecasts).

    trainLib ranks in sample, by forecasts of the library. lib and pred default to the
    series' halves if n is not needed to be counted first.
    """
    cols, targets = names(columns), names(target)
    if not cols or not targets:
        raise ValueError("columns and target are needed")
    lib, pred = numbers(lib), numbers(pred)
    if not lib and not pred:
        if not trainLib:
            raise ValueError("trainLib=False needs lib and pred")
        n = df.count() if n is None else n
        lib, pred = [1, n // 2], [n // 2 + 1, n]
    if not lib or not pred:
        raise ValueError("lib and pred are needed")
    use = [c for c in cols if not (excludeTarget and c in targets)]
    D = D or len(cols)
    if len(use) * E < D:
        warnings.warn(f"D = {D} exceeds the {len(use) * E} coordinates and is set to that", stacklevel=2)
        D = len(use) * E
    coords = [lag_name(c, tau, j) for j in range(E) for c in use]
    count = math.comb(len(coords), D)
    most = multiview or math.isqrt(count)
    if most > count:
        warnings.warn(f"multiview = {most} exceeds the {count} combinations and is set to that", stacklevel=2)
        most = count
    packed = pack(df, [*use, targets[0]], time, noTime)
    base = {"target": targets[0], "lib": lib, "Tp": Tp, "knn": knn, "tau": tau, "E": D, "radius": exclusionRadius, "embedded": True, "of": use, "lags": E}

    def rank(s: Series, spec: dict) -> dict:
        v, rho = _Views(s, spec), []
        for c in combinations_from(coords, D, spec["first"], spec["stop"]):
            p = of_series(v, spec | {"columns": list(c)})
            rho.append(kernels.projected_rho(p, kernels.simplex(p, p.pred)[0], p.pred))
        return {"combo": list(range(spec["first"], spec["stop"])), "rho": rho}

    # spans of combinations, one grid row per task; each task makes its own
    tasks = min(count, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grid = [base | {"pred": lib if trainLib else pred, "first": count * i // tasks, "stop": count * (i + 1) // tasks} for i in range(tasks)]
    ranked = run(packed, grid, rank, "combo long, rho double")
    chosen = [r.combo for r in ranked.orderBy(F.col("rho").desc_nulls_last(), "combo").limit(most).select("combo").collect()]  # at most `multiview` numbers
    combos = {c: list(next(combinations_from(coords, D, c, c + 1))) for c in chosen}

    def forecast(s: Series, spec: dict) -> dict:
        out = simplex_kernel(_Views(s, spec), spec)
        return out | {"combo": [spec["id"]] * len(out["_i"]), "rank": [spec["rank"]] * len(out["_i"])}

    grid = [base | {"pred": pred, "columns": combos[c], "id": c, "rank": i + 1} for i, c in enumerate(chosen)]
    views = run(packed, grid, forecast, ROWS + ", combo long, rank long")
    views = shaped(packed, views, "combo", "rank")
    label = F.element_at(F.create_map(*(x for c in chosen for x in (F.lit(c), F.array(*map(F.lit, combos[c]))))), F.col("combo").cast("int"))
    averaged = views.groupBy("segment", "_i", "Time").agg(F.first("Observations").alias("Observations"), F.when(F.count("Predictions") == F.count("*"), F.avg("Predictions")).alias("Predictions"))
    stats = views.groupBy("rank", "combo").agg(*error_columns())
    return {"Predictions": averaged, "View": stats.withColumn("Columns", label).drop("combo"), "Views": views.withColumn("Columns", label).drop("combo")}
