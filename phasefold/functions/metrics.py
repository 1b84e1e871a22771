"""Errors of predictions as aggregates; safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rho(obs: Column, pred: Column) -> Column:
    """Pearson's correlation; null where a side is constant. Both sides must be null together."""
    return F.try_divide(F.covar_pop(obs, pred), F.stddev_pop(obs) * F.stddev_pop(pred))


def error_columns(obs: str = "Observations", pred: str = "Predictions") -> list[Column]:
    """rho, MAE (the largest signed error), mean_abs_err, CAE, RMSE and n_pairs; null below 5 pairs."""
    o, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    ok = o.isNotNull() & p.isNotNull() & ~F.isnan(o) & ~F.isnan(p)
    o, p = F.when(ok, o), F.when(ok, p)
    e, enough = o - p, F.count(F.when(ok, 1)) >= 5
    out = {"rho": rho(o, p), "MAE": F.max(e), "mean_abs_err": F.avg(F.abs(e)), "CAE": F.sum(F.abs(e)), "RMSE": F.sqrt(F.avg(e * e))}
    return [*(F.when(enough, c).alias(n) for n, c in out.items()), F.count(F.when(ok, 1)).alias("n_pairs")]


def compute_error(df: DataFrame, obs: str = "Observations", pred: str = "Predictions", by: list[str] | None = None, digits: int | None = 6) -> DataFrame:
    """One row of errors per group."""
    out = df.groupBy(*(by or [])).agg(*error_columns(obs, pred))
    if digits is None:
        return out
    return out.withColumns({c: F.round(c, digits) for c in ("rho", "MAE", "mean_abs_err", "CAE", "RMSE")})
