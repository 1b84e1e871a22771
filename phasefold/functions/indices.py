"""Library and prediction rows from 1-based inclusive (start, stop) pairs."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def numbers(value) -> list[int]:
    """A list of whole numbers from "1 300", [1, 300] or one number."""
    if value is None:
        return []
    if isinstance(value, str):
        return [int(x) for x in value.replace(",", " ").split()]
    if isinstance(value, Iterable):
        return [int(x) for x in value]
    return [int(value)]


def names(value) -> list[str]:
    """A list of column names from "x y" or a list; names with spaces need the list."""
    if value is None:
        return []
    return value.split() if isinstance(value, str) else [str(x) for x in value]


def pairs(bounds: list[int], what: str, strict: bool = True) -> list[tuple[int, int]]:
    if len(bounds) % 2:
        raise ValueError(f"{what}: start and stop must come in pairs")
    out = list(zip(bounds[::2], bounds[1::2]))
    for start, stop in out:
        if strict and start >= stop:
            raise ValueError(f"{what}: start {start} is not below stop {stop}")
        if start < 1 or stop < 1:
            raise ValueError(f"{what}: rows start at 1")
    return out


def check(lib: list[int], pred: list[int], E: int, tau: int, Tp: int, embedded: bool, n: int | None, strict: bool = True) -> None:
    """Raise ValueError for ranges that the parameters or a series of n rows do not allow."""
    if E < 1 and not embedded:
        raise ValueError("E must be at least 1")
    if tau == 0 and not embedded:
        raise ValueError("tau must not be 0")
    rows = library(lib, E, tau, Tp, embedded, strict)
    shift = abs(tau) * (E - 1)
    span = abs(Tp) if embedded else max(0, -shift, Tp) - min(0, -shift, Tp) + 1
    if span > len(rows):
        raise ValueError(f"lib is too short for E = {E}, tau = {tau}, Tp = {Tp}")
    last = [stop for _, stop in pairs(pred, "pred", strict)]
    if n is not None and len(rows) and rows[-1] >= n:
        raise ValueError(f"lib reaches beyond the {n} rows of the series")
    if n is not None and last and last[-1] > n:
        raise ValueError(f"pred reaches beyond the {n} rows of the series")


def library(lib: list[int], E: int, tau: int, Tp: int, embedded: bool, strict: bool = True) -> np.ndarray:
    """0-based library rows: each pair without the rows that embedding lacks, the last one without those that Tp lacks."""
    shift, spans = abs(tau) * (E - 1), pairs(lib, "lib", strict)
    out = []
    for at, (start, stop) in enumerate(spans):
        if not embedded:
            start, stop = (start + shift, stop) if tau < 0 else (start, stop - shift)
            if Tp < 0:
                start += abs(Tp) - 1
        if Tp >= 0 and at == len(spans) - 1:
            stop -= Tp
        out.append(np.arange(start - 1, stop))
    return np.concatenate(out) if out else np.zeros(0, int)


def segments(pred: list[int], E: int, tau: int, embedded: bool, n: int, strict: bool = True) -> list[np.ndarray]:
    """0-based prediction rows of each pair, without the rows of the series' edge that embedding lacks."""
    shift = 0 if embedded else abs(tau) * (E - 1)
    lo, hi = (shift, n) if tau < 0 else (0, n - shift)
    return [np.arange(max(start - 1, lo), min(stop, hi)) for start, stop in pairs(pred, "pred", strict)]
