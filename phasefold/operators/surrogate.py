"""Surrogate series: shuffles, phase randomisation, and a smooth season with shuffled residuals.

Each surrogate is a grid row; its random numbers come from the seed and its number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indices import names
from ..plans.grid import Series, run
from ..sources.series import pack, quoted

METHODS = ("random_shuffle", "ebisuzaki", "seasonal")


def ebisuzaki(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A series with x's periodogram and random phases, scaled to its standard deviation (mean 0)."""
    n = len(x)
    a = np.abs(np.fft.rfft(x))
    a[0] = 0
    z = a * np.exp(2j * np.pi * rng.random(len(a)))
    if n % 2 == 0:
        z[-1] = np.sqrt(2) * a[-1] * np.cos(2 * np.pi * rng.random())
    out = np.fft.irfft(z, n)
    s = out.std()
    return out * (x.std() / s) if s > 0 else out


def cosines(y: np.ndarray) -> np.ndarray:
    """The orthonormal cosine transform (type II), by one FFT."""
    n = len(y)
    k = np.arange(n)
    c = (np.fft.rfft(np.concatenate([y, y[::-1]]))[:n] * np.exp(-0.5j * np.pi * k / n)).real / 2
    return c * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def of_cosines(c: np.ndarray) -> np.ndarray:
    """The series of which cosines() are c."""
    n = len(c)
    k = np.arange(n)
    z = np.concatenate([c / np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * 2 * np.exp(0.5j * np.pi * k / n), [0]])
    return np.fft.irfft(z, 2 * n)[:n]


def smooth_season(y: np.ndarray, smooth: float) -> np.ndarray:
    """A smoothing curve whose summed squared residuals come to `smooth`, by penalised second differences.

    The penalty is found by bisection; a series smoother than that gives its own line.
    """
    n = len(y)
    if n < 4:
        return y.copy()
    # eigenvectors of second differences with free ends are cosines
    c, ev = cosines(y), (2 - 2 * np.cos(np.pi * np.arange(n) / n)) ** 2
    lo, hi = -30.0, 40.0
    for _ in range(100):
        mid = (lo + hi) / 2
        left = ((c * (1 - 1 / (1 + np.exp(mid) * ev))) ** 2).sum()
        lo, hi = (mid, hi) if left < smooth else (lo, mid)
    return of_cosines(c / (1 + np.exp(lo) * ev))


def surrogate_data(df: DataFrame, column: str | None = None, method: str = "ebisuzaki", numSurrogates: int = 10, alpha: float | None = None, smooth: float = 0.8, seed: int = 0, digits: int = 8, time: str | None = None, noTime: bool = False, series=None, long: bool = False) -> DataFrame:
    """Time, column_1, ..., column_n (long: Time, surrogate, value), rounded to `digits`."""
    if not column:
        raise ValueError("column is needed")
    if method.lower() not in METHODS:
        raise ValueError(f"no method {method}")
    packed = pack(df, [column], time, noTime, series)

    def kernel(s: Series, spec: dict) -> dict:
        x, rng = s[column], np.random.default_rng([seed, spec["k"]])
        if spec["method"] == "random_shuffle":
            out = rng.permutation(x)
        elif spec["method"] == "ebisuzaki":
            out = ebisuzaki(x, rng)
        else:
            season = smooth_season(x, smooth)
            noise = np.ptp(x) / 5 if alpha is None else alpha
            out = season + rng.permutation(x - season) + rng.normal(0, noise, len(x))
        n = len(x)
        return {"_i": np.arange(n), "t": s.t, "surrogate": [spec["k"]] * n, "value": np.round(out, digits)}

    grid = [{"k": k, "method": method.lower()} for k in range(1, numSurrogates + 1)]
    got = run(packed, grid, kernel, "_i long, t double, surrogate long, value double")
    keys = [*map(quoted, names(series))]
    got = got.select(*keys, "_i", packed.time(F.col("t")).alias("Time"), "surrogate", "value")
    if long:
        return got
    return got.groupBy(*keys, "_i", "Time").agg(*(F.max(F.when(F.col("surrogate") == k, F.col("value"))).alias(f"{column}_{k}") for k in range(1, numSurrogates + 1)))
