"""Delay embedding with lag and lead windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import names
from ..sources.series import clean, quoted


def lag_name(column: str, tau: int, j: int) -> str:
    return f"{column}(t{'-' if tau < 0 else '+'}{abs(tau) * j})"


def lag_columns(columns: list[str], E: int, tau: int, order: Column, series: list[str]) -> list[Column]:
    """Lag by lag: x(t-0), y(t-0), x(t-1), ..."""
    w = Window.partitionBy(*map(quoted, series)).orderBy(order)
    at = lambda c, j: F.lag(clean(quoted(c)), -tau * j).over(w) if j else clean(quoted(c))
    return [at(c, j).alias(lag_name(c, tau, j)) for j in range(E) for c in columns]


def embed(df: DataFrame, E: int = 0, tau: int = -1, columns=None, includeTime: bool = False, time: str | None = None, series=None, plusminus: bool = False) -> DataFrame:
    """The columns and their lags in the series' time order; plusminus adds the leads. Rows that lack a lag hold nulls.

    Series keys come first, then the time if includeTime.
    """
    cols, keys = names(columns), names(series)
    if E < 1:
        raise ValueError("E must be at least 1")
    if tau == 0:
        raise ValueError("tau must not be 0")
    if not cols:
        raise ValueError("columns are needed")
    if lost := [c for c in [*cols, *keys] if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(lost)}")
    at = time or next(c for c in df.columns if c not in keys)
    out = lag_columns(cols, E, tau, quoted(at), keys)
    if plusminus:
        out += lag_columns(cols, E, -tau, quoted(at), keys)[len(cols) :]
    return df.select(*map(quoted, keys), *([quoted(at)] if includeTime else []), *out)
