"""Numpy kernels on one series: embedding, neighbours, projections.

A row is a position in the series. NaN stands for a missing value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import indices

#: distances held at once
CELLS = 4_000_000


def embed(columns: list[np.ndarray], E: int, tau: int) -> np.ndarray:
    """Rows x (E * columns), lag by lag: column c at lag j is c[row + tau * j]."""
    n = len(columns[0])
    out = np.full((n, E * len(columns)), np.nan)
    for j in range(E):
        for i, c in enumerate(columns):
            s = tau * j
            if abs(s) < n:
                if s <= 0:
                    out[-s:, j * len(columns) + i] = c[: n + s]
                else:
                    out[: n - s, j * len(columns) + i] = c[s:]
    return out


@dataclass
class Problem:
    """One projection: state vectors, target, rows to learn from and to predict."""

    X: np.ndarray
    y: np.ndarray
    lib: np.ndarray
    pred: np.ndarray
    segments: list[np.ndarray]
    Tp: int
    k: int
    radius: int = 0
    overlap: bool = False
    drop_last: bool = False
    short: int = 0
    finder: Callable | None = None
    blocks: tuple[int, int] = field(default=(0, 1))


def problem(columns: list[np.ndarray], y: np.ndarray, spec: dict, valid: np.ndarray | None = None) -> Problem:
    """spec: lib, pred, E, tau, Tp, knn, radius, embedded, smap; valid marks rows that may be neighbours."""
    E, tau, Tp, embedded = spec["E"], spec["tau"], spec["Tp"], spec.get("embedded", False)
    n = len(y)
    if embedded:
        X, E = np.column_stack(columns), len(columns)
    else:
        X = embed(columns, E, tau)
    strict = spec.get("strict", True)
    indices.check(spec["lib"], spec["pred"], E, tau, Tp, embedded, n, strict)
    lib = indices.library(spec["lib"], E, tau, Tp, embedded, strict)
    parts = indices.segments(spec["pred"], E, tau, embedded, n, strict)
    pred = np.concatenate([np.arange(a - 1, b) for a, b in indices.pairs(spec["pred"], "pred", strict)])
    overlap = bool(np.intersect1d(lib, pred).size)
    whole = np.isfinite(X).all(1)
    lib = lib[(lib >= 0) & (lib < n)]
    if spec.get("whole_only") and not (whole[lib].all() and whole[np.concatenate(parts)].all()):
        raise ValueError("rows miss coordinates: ignoreNan=True leaves these out")
    lib = lib[whole[lib]]
    k = spec.get("knn", 0)
    if k < 1:
        k = max(1, len(lib) - 1) if spec.get("smap") else E + 1
    # a neighbour whose target lies outside the series is none
    lib = lib[(lib + Tp >= 0) & (lib + Tp < n)]
    drop_last = False
    if valid is not None:
        lib = lib[valid[lib]]  # may leave none: nothing is predicted then
        k, drop_last = len(lib), overlap
    return Problem(X, y, lib, pred[whole[pred]], parts, Tp, k, spec.get("radius", 0), overlap, drop_last, blocks=tuple(spec.get("block", (0, 1))))


def top_k(d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least of each row in order; equal ones by position."""
    n = d.shape[1]
    if k >= n or n <= 256:
        return np.argsort(d, 1, kind="stable")[:, :k]
    at = np.sort(np.argpartition(d, k - 1, 1)[:, :k], 1)
    own = np.take_along_axis(d, at, 1)
    edge = own.max(1, keepdims=True)
    tied = (d == edge).sum(1) > (own == edge).sum(1)
    out = np.take_along_axis(at, np.argsort(own, 1, kind="stable"), 1)
    if tied.any():
        out[tied] = np.argsort(d[tied], 1, kind="stable")[:, :k]
    return out


def masked(d2: np.ndarray, pred: np.ndarray, lib: np.ndarray, radius: int) -> np.ndarray:
    """Squared distances with a row itself, and rows within the radius, put out of reach."""
    gap = np.abs(pred[:, None] - lib)
    d2[gap <= max(radius, 0)] = np.inf
    return d2


def distances(X: np.ndarray, pred: np.ndarray, lib: np.ndarray) -> np.ndarray:
    out = np.zeros((len(pred), len(lib)))
    for j in range(X.shape[1]):
        d = X[pred, j][:, None] - X[lib, j]
        out += d * d
    return out


def chunks(n: int, width: int):
    step = max(1, CELLS // max(width, 1))
    return ((lo, min(n, lo + step)) for lo in range(0, n, step))


def neighbours(p: Problem, pred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of each prediction row's k nearest library rows; -1 and inf where there are fewer."""
    pred = p.pred if pred is None else pred
    k = min(p.k, len(p.lib))
    if p.drop_last and k:
        k -= 1
    rows, dist = np.full((len(pred), k), -1), np.full((len(pred), k), np.inf)
    if not k:
        return rows, dist
    if p.finder is not None:
        rows, dist = p.finder(p.X, pred, p.lib, k, p.radius)
        few = np.flatnonzero(~np.isfinite(dist).all(1)) if p.radius else []
        if len(few):  # too few outside the radius: it does not hold for these rows
            p.short += len(few)
            rows[few], dist[few] = p.finder(p.X, pred[few], p.lib, k, 0)
        return rows, dist
    for lo, hi in chunks(len(pred), len(p.lib)):
        q = pred[lo:hi]
        plain = distances(p.X, q, p.lib)
        d2 = masked(plain.copy() if p.radius else plain, q, p.lib, p.radius)
        if p.radius:
            few = np.isfinite(d2).sum(1) < k
            if few.any():  # too few outside the radius: it does not hold for this row
                p.short += int(few.sum())
                d2[few] = masked(plain[few], q[few], p.lib, 0)
        at = top_k(d2, k)
        d = np.sqrt(np.take_along_axis(d2, at, 1))
        rows[lo:hi] = np.where(np.isfinite(d), p.lib[at], -1)
        dist[lo:hi] = d
    return rows, dist


#: rows of a leaf
LEAF = 48


def leaves(X: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows cut in halves along their widest coordinate until no part has more than LEAF: the leaves of a k-d tree."""
    todo, out = [rows], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(np.sort(own))
            continue
        width = X[own].max(0) - X[own].min(0)
        half = len(own) // 2
        order = np.argpartition(X[own, int(width.argmax())], half)
        todo += [own[order[half:]], own[order[:half]]]
    return out


def tree_finder(X: np.ndarray, pred: np.ndarray, lib: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """neighbours() by two k-d trees: leaves of prediction rows visit leaves of library rows by the distance of their boxes, until none can hold a nearer row.

    Equal distances go to the smaller row, as in the search of all pairs.
    """
    rows, dist = np.full((len(pred), k), -1), np.full((len(pred), k), np.inf)
    if not len(pred) or not len(lib):
        return rows, dist
    own = leaves(X, lib)
    low, high = np.array([X[r].min(0) for r in own]), np.array([X[r].max(0) for r in own])
    place = np.zeros(len(X), int)
    place[pred] = np.arange(len(pred))
    for q in leaves(X, pred):
        gap = np.maximum(0, np.maximum(low - X[q].max(0), X[q].min(0) - high))
        least = (gap * gap).sum(1) * (1 - 1e-12)  # sums may round up
        order = np.argsort(least, kind="stable")
        best, who, at, step = np.full((len(q), k), np.inf), np.full((len(q), k), len(X)), 0, 2
        while at < len(order) and least[order[at]] <= best[:, -1].max():
            new = np.concatenate([own[i] for i in order[at : at + step]])
            d2 = masked(distances(X, q, new), q, new, radius)
            both, names = np.concatenate([best, d2], 1), np.concatenate([who, np.broadcast_to(new, d2.shape)], 1)
            names = np.where(np.isfinite(both), names, len(X))
            first = np.lexsort((names, both), axis=1)[:, :k]
            best, who = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)
            at, step = at + step, min(2 * step, 16)
        mine = place[q]
        dist[mine], rows[mine] = np.sqrt(best), np.where(np.isfinite(best), who, -1)
    return rows, dist


#: by name; others may be given as functions (X, pred, lib, k, radius) -> (rows, distances), rows -1 and inf where there are fewer
FINDERS = {"arrays": None, "pdist": None, "kdtree": tree_finder}


def simplex_weights(dist: np.ndarray) -> np.ndarray:
    return np.exp(-dist / np.maximum(dist[:, :1], 1e-6)) if dist.shape[1] else dist


def simplex(p: Problem, pred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and variances: neighbours' targets weighted by exp(-d / nearest d).

    Neighbours are held for a block of prediction rows at once, as all valid rows may be neighbours of each.
    """
    mu, var = np.full(len(pred), np.nan), np.full(len(pred), np.nan)
    for lo, hi in chunks(len(pred), min(p.k, len(p.lib))):
        rows, dist = neighbours(p, pred[lo:hi])
        mu[lo:hi], var[lo:hi] = weighted_mean(rows, dist, p.y, p.Tp)
    return mu, var


def weighted_mean(rows: np.ndarray, dist: np.ndarray, y: np.ndarray, Tp: int) -> tuple[np.ndarray, np.ndarray]:
    if not rows.shape[1]:
        return np.full(len(rows), np.nan), np.full(len(rows), np.nan)
    with np.errstate(invalid="ignore"):
        w = np.where(rows >= 0, simplex_weights(dist), 0.0)
    v = np.where(rows >= 0, y[np.clip(rows + Tp, 0, len(y) - 1)], 0.0)
    total = w.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (w * v).sum(1) / total
        var = (w * (v - mean[:, None]) ** 2).sum(1) / total
    return mean, var


def least_norm(A: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-norm least squares of stacked systems, and their singular values: QR, then SVD of the small factor."""
    q, r = np.linalg.qr(A)
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    cut = np.finfo(float).eps * max(A.shape[1:]) * s[:, :1]
    with np.errstate(divide="ignore"):
        inv = np.where(s > cut, 1 / s, 0.0)
    c = np.einsum("bji,bj->bi", vt, inv * np.einsum("bji,bj->bi", u, np.einsum("bki,bk->bi", q, b)))
    return c, s


def smap(p: Problem, pred: np.ndarray, theta: float, solver=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Predictions, variances, coefficients and singular values of locally weighted linear maps."""
    m = p.X.shape[1] + 1
    out = np.full(len(pred), np.nan), np.full(len(pred), np.nan), np.full((len(pred), m), np.nan), np.full((len(pred), m), np.nan)
    if not len(pred) or not len(p.lib):
        return out
    rows, dist = neighbours(p, pred)
    for (a, v, c, s), part in zip(smap_from(p, pred, rows, dist, [theta], solver), [out]):
        part[0][:], part[1][:], part[2][:], part[3][:] = a, v, c, s
    return out


def smap_from(p: Problem, pred: np.ndarray, rows: np.ndarray, dist: np.ndarray, thetas, solver=None):
    """One result as of smap() for each theta; neighbours and distances are shared."""
    m = p.X.shape[1] + 1
    real = rows >= 0
    n_real = np.maximum(real.sum(1), 1)
    mean = np.where(real, dist, 0).sum(1) / n_real
    for theta in thetas:
        mu, var = np.full(len(pred), np.nan), np.full(len(pred), np.nan)
        coef, sing = np.full((len(pred), m), np.nan), np.full((len(pred), m), np.nan)
        for lo, hi in chunks(len(pred), rows.shape[1] * m):
            r, d, ok = rows[lo:hi], dist[lo:hi], real[lo:hi].copy()
            with np.errstate(invalid="ignore", divide="ignore"):
                w = np.exp(-theta * d / mean[lo:hi, None]) if theta else np.ones(d.shape)
            b = p.y[np.clip(r + p.Tp, 0, len(p.y) - 1)]
            ok &= np.isfinite(b)
            w, b = np.where(ok, w, 0.0), np.where(ok, b, 0.0)
            Z = np.concatenate([np.ones((*r.shape, 1)), p.X[np.clip(r, 0, None)]], 2)
            if solver is None:
                k = Z.shape[1]
                A, rhs = w[:, :, None] * Z, w * b
                if k < m:  # fewer rows than unknowns
                    A = np.concatenate([A, np.zeros((len(A), m - k, m))], 1)
                    rhs = np.concatenate([rhs, np.zeros((len(rhs), m - k))], 1)
                c, s = least_norm(A, rhs)
            else:
                c, s = np.full((len(r), m), np.nan), np.full((len(r), m), np.nan)
                for i in range(len(r)):
                    o = ok[i]
                    # as the weighted rows, without the weighted ones; the solver has an intercept of its own
                    slope, intercept = solver(w[i, o, None] * Z[i, o, 1:], w[i, o] * b[i, o])
                    c[i] = np.concatenate([[intercept], slope])
            c[~ok.any(1)] = np.nan
            x = p.X[pred[lo:hi]]
            mu[lo:hi] = np.where(np.isnan(c[:, 0]) & ~np.isnan(c[:, 1:]).any(1), 0.0, c[:, 0]) + (c[:, 1:] * x).sum(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                var[lo:hi] = (w * (b - mu[lo:hi, None]) ** 2).sum(1) / w.sum(1)
            coef[lo:hi], sing[lo:hi] = c, s
        yield mu, var, coef, sing


def own_rows(p: Problem) -> np.ndarray:
    """The prediction rows of the problem's block."""
    b, n = p.blocks
    return np.array_split(p.pred, n)[b]


def aligned(p: Problem, pred: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, row, time, position in pred or -1) of the output rows that belong to the block.

    A segment of n rows has n + |Tp| output rows; a prediction from row i stands at i + Tp.
    Times beyond the series go on with its first step.
    """
    where = np.full(len(p.y) + 1, -1)
    where[pred] = np.arange(len(pred))
    b, n = p.blocks
    bounds = [c[0] if len(c) else None for c in np.array_split(p.pred, n)]
    first = -(10**18) if b == 0 else bounds[b]
    last = next((x for x in bounds[b + 1 :] if x is not None), 10**18)
    seg, out, at = [], [], []
    for s, rows in enumerate(p.segments):
        if len(rows):
            r = np.arange(rows[0] + min(p.Tp, 0), rows[-1] + max(p.Tp, 0) + 1)
            src = r - p.Tp
            inside = (src >= rows[0]) & (src <= rows[-1])
            home = np.clip(src, rows[0], rows[-1])
            mine = (home >= first) & (home < last) if first is not None else np.zeros(len(r), bool)
            seg.append(np.full(int(mine.sum()), s))
            out.append(r[mine])
            at.append(np.where(inside, where[np.clip(src, 0, len(p.y))], -1)[mine])
    if not out:
        return (np.zeros(0, int),) * 2 + (np.zeros(0), np.zeros(0, int))
    r = np.concatenate(out)
    step = t[1] - t[0] if len(t) > 1 else 1.0
    time = np.where(r < 0, t[0] + r * step, np.where(r >= len(t), t[-1] + (r - len(t) + 1) * step, t[np.clip(r, 0, len(t) - 1)]))
    return np.concatenate(seg), r, time, np.concatenate(at)


def at_rows(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.where((r >= 0) & (r < len(y)), y[np.clip(r, 0, len(y) - 1)], np.nan)


def errors(obs: np.ndarray, pred: np.ndarray) -> dict[str, float]:
    """rho (Pearson), MAE (the largest signed error, as users of this measure know it), mean_abs_err, CAE, RMSE; NaN below 5 pairs."""
    ok = np.isfinite(obs) & np.isfinite(pred)
    if ok.sum() < 5:
        return dict.fromkeys(("rho", "MAE", "mean_abs_err", "CAE", "RMSE"), np.nan)
    o, q = obs[ok], pred[ok]
    e = o - q
    so, sq = o.std(), q.std()
    rho = float(((o - o.mean()) * (q - q.mean())).mean() / (so * sq)) if so > 0 and sq > 0 else np.nan
    return {"rho": rho, "MAE": float(e.max()), "mean_abs_err": float(np.abs(e).mean()), "CAE": float(np.abs(e).sum()), "RMSE": float(np.sqrt((e * e).mean()))}


def e_sweep(columns: list[np.ndarray], y: np.ndarray, spec: dict, max_e: int, valid: np.ndarray | None = None) -> list[float]:
    """rho for E = 1 to max_e: squared distances grow by one lag at a time, so each lag is computed once."""
    probs = [problem(columns, y, spec | {"E": e, "knn": 0, "embedded": False}, valid) for e in range(1, max_e + 1)]
    X = probs[-1].X
    shapes = [(len(p.pred), max(0, min(p.k, len(p.lib)) - (1 if p.drop_last else 0))) for p in probs]
    got = [(np.full(shape, -1), np.full(shape, np.inf)) for shape in shapes]
    all_pred, all_lib = np.unique(np.concatenate([p.pred for p in probs])), np.unique(np.concatenate([p.lib for p in probs]))
    for lo, hi in chunks(len(all_pred), len(all_lib)):
        q = all_pred[lo:hi]
        d2 = np.zeros((len(q), len(all_lib)))
        for e, p in enumerate(probs):
            for i in range(len(columns)):
                d = X[q, e * len(columns) + i][:, None] - X[all_lib, e * len(columns) + i]
                d2 = d2 + d * d
            mine = np.isin(q, p.pred)
            rows = q[mine]
            if not len(rows) or not got[e][0].shape[1]:
                continue
            cols = np.searchsorted(all_lib, p.lib)
            own = d2[np.ix_(mine, cols)]
            cut = masked(own.copy(), rows, p.lib, p.radius)
            k = got[e][0].shape[1]
            few = np.isfinite(cut).sum(1) < k
            if p.radius and few.any():
                cut[few] = masked(own[few], rows[few], p.lib, 0)
            at = top_k(cut, k)
            d = np.sqrt(np.take_along_axis(cut, at, 1))
            place = np.searchsorted(p.pred, rows)
            got[e][0][place] = np.where(np.isfinite(d), p.lib[at], -1)
            got[e][1][place] = d
    out = []
    for p, (rows, dist) in zip(probs, got):
        mu, _ = weighted_mean(rows, dist, y, p.Tp)
        out.append(errors(at_rows(y, p.pred + p.Tp), mu)["rho"])
    return out


def projected_rho(p: Problem, mu: np.ndarray, pred: np.ndarray) -> float:
    return errors(at_rows(p.y, pred + p.Tp), mu)["rho"]


def ccm(columns: list[np.ndarray], y: np.ndarray, spec: dict, sizes: list[int], samples: int, seed, only: int, valid: np.ndarray | None = None) -> list[dict[str, float]]:
    """Errors of each sample for library size sizes[only]; random draws are those of a run over all sizes in order."""
    return ccm_targets(columns, [y], spec, sizes, samples, seed, valid, only)[0][0]


def ccm_targets(columns: list[np.ndarray], ys: list[np.ndarray], spec: dict, sizes: list[int], samples: int, seed, valid: np.ndarray | None = None, only: int | None = None) -> list[list[list[dict[str, float]]]]:
    """Errors by library size (all, or sizes[only]), target and sample. Distances are taken once for all, neighbours once for all targets."""
    n = len(columns[0])
    if len(ys) > 1 and len(ys) * len(sizes) * samples * n > 4 * CELLS:  # halves, so that forecasts held at once are bounded
        parts = [ccm_targets(columns, own, spec, sizes, samples, seed, valid, only) for own in (ys[: len(ys) // 2], ys[len(ys) // 2 :])]
        return [a + b for a, b in zip(*parts)]
    p = problem(columns, columns[0], spec | {"lib": [1, n], "pred": [1, n], "strict": False}, None)
    lib = p.lib if valid is None else p.lib[valid[p.lib]]
    draws, subsets = np.random.default_rng(seed), []
    for i, size in enumerate(sizes[: len(sizes) if only is None else only + 1]):
        # in row order, so that equal distances go to the smaller row here too
        own = [np.sort(draws.choice(len(lib), size=min(size, len(lib)), replace=False)) for _ in range(samples)]
        if only is None or i == only:
            subsets.append(own)
    mu = np.full((len(subsets), len(ys), samples, len(p.pred)), np.nan)
    for lo, hi in chunks(len(p.pred), len(lib)):
        d2 = masked(distances(p.X, p.pred[lo:hi], lib), p.pred[lo:hi], lib, p.radius)
        for i, own in enumerate(subsets):
            for s, sub in enumerate(own):
                at = top_k(part := d2[:, sub], min(p.k, len(sub)))
                d = np.sqrt(np.take_along_axis(part, at, 1))
                rows = np.where(np.isfinite(d), lib[sub[at]], -1)
                for t, y in enumerate(ys):
                    mu[i, t, s, lo:hi] = weighted_mean(rows, d, y, p.Tp)[0]

    def error(y: np.ndarray, m: np.ndarray) -> dict[str, float]:
        m = np.roll(m, p.Tp)
        if p.Tp > 0:
            m[: p.Tp] = np.nan
        elif p.Tp < 0:
            m[p.Tp :] = np.nan
        return errors(y[p.pred], m)

    return [[[error(y, m) for m in mu[i, t]] for t, y in enumerate(ys)] for i in range(len(subsets))]


def generate(x: np.ndarray, t: np.ndarray, spec: dict, steps: int, theta: float | None = None, solver=None, valid: np.ndarray | None = None):
    """Feedback forecasts: (row, time, observation, prediction, variance, coefficients, singular values) of each step; each prediction becomes the next row's value."""
    n, last = len(x), spec["lib"][-1]
    full, time = np.concatenate([x, np.full(steps, np.nan)]), np.concatenate([t, np.full(steps, np.nan)])
    step = t[1] - t[0] if len(t) > 1 else 1.0
    out = []
    for s in range(steps):
        now = n + s
        row = last - 1 + s  # 0-based row that is predicted from
        y = full[:now]
        at = {"pred": [row, row + 1]}
        p = problem([y], y, spec | at, None if valid is None else np.concatenate([valid, np.zeros(s, bool)]))
        pred = np.array([row]) if row in p.pred else np.zeros(0, int)
        if theta is None:
            mu, var = simplex(p, pred)
            coef = sing = np.zeros((len(pred), 0))
        else:
            mu, var, coef, sing = smap(p, pred, theta, solver)
        r = row + p.Tp
        when = time[r] if r < now else time[now - 1] + (r - now + 1) * step
        got = (float(mu[0]), float(var[0]), coef[0], sing[0]) if len(pred) else (np.nan, np.nan, np.zeros(0), np.zeros(0))
        out.append((r, when, at_rows(y, np.array([r]))[0], *got))
        full[now], time[now] = got[0], time[now - 1] + step
    return out
