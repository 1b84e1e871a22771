"""Linear solvers for locally weighted maps: fit(X, y) -> (slopes, intercept)."""

from __future__ import annotations

import numpy as np


def _centred(X, y):
    mx, my = X.mean(0), y.mean()
    return X - mx, y - my, mx, my


def linear(X: np.ndarray, y: np.ndarray):
    Xc, yc, mx, my = _centred(X, y)
    c = np.linalg.lstsq(Xc, yc, rcond=None)[0]
    return c, my - mx @ c


def ridge(alpha: float = 1.0):
    def fit(X, y):
        Xc, yc, mx, my = _centred(X, y)
        c = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
        return c, my - mx @ c

    return fit


def elastic_net(alpha: float = 1.0, l1_ratio: float = 0.5, steps: int = 1000, tol: float = 1e-8):
    """Coordinate descent on ||y - Xc||^2 / 2n + alpha * (l1_ratio |c| + (1 - l1_ratio) c^2 / 2)."""

    def fit(X, y):
        Xc, yc, mx, my = _centred(X, y)
        n, m = Xc.shape
        c, r, sq = np.zeros(m), yc.copy(), (Xc * Xc).sum(0) / n
        for _ in range(steps):
            most = 0.0
            for j in range(m):
                if sq[j] == 0:
                    continue
                z = Xc[:, j] @ r / n + sq[j] * c[j]
                new = np.sign(z) * max(abs(z) - alpha * l1_ratio, 0) / (sq[j] + alpha * (1 - l1_ratio))
                if new != c[j]:
                    r += Xc[:, j] * (c[j] - new)
                    most, c[j] = max(most, abs(new - c[j])), new
            if most < tol:
                break
        return c, my - mx @ c

    return fit


def lasso(alpha: float = 1.0, **options):
    return elastic_net(alpha, 1.0, **options)


def cross_validated(make, alphas, folds: int = 5):
    """The alpha (one of alphas, or of alphas(X)) of least squared error over contiguous folds, then fitted to all rows."""

    def fit(X, y):
        tried = alphas(X) if callable(alphas) else alphas
        if len(y) < 2:
            return make(tried[0])(X, y)
        parts = np.array_split(np.arange(len(y)), min(folds, len(y)))

        def loss(a):
            total = 0.0
            for part in parts:
                keep = np.ones(len(y), bool)
                keep[part] = False
                c, i = make(a)(X[keep], y[keep])
                total += ((y[part] - X[part] @ c - i) ** 2).sum()
            return total

        return make(min(tried, key=loss))(X, y)

    return fit


def orthogonal_matching_pursuit(n_nonzero: int | None = None):
    """Columns of the largest correlation with the residual, one by one, refitted each time."""

    def fit(X, y):
        Xc, yc, mx, my = _centred(X, y)
        norm = np.linalg.norm(Xc, axis=0)
        k, used, r = n_nonzero or max(1, X.shape[1] // 10), [], yc
        c = np.zeros(X.shape[1])
        for _ in range(min(k, X.shape[1])):
            gain = np.where(norm > 0, np.abs(Xc.T @ r) / np.where(norm > 0, norm, 1), -1)
            gain[used] = -1
            if gain.max(initial=-1) < 0:
                break
            used.append(int(gain.argmax()))
            own = np.linalg.lstsq(Xc[:, used], yc, rcond=None)[0]
            r = yc - Xc[:, used] @ own
        c[used] = own if used else 0
        return c, my - mx @ c

    return fit


def angle_path(X, y, n_nonzero: int | None = None, lasso_path: bool = False, alpha: float = 0.0):
    """Least-angle regression of centred data: (largest correlation of a unit column with the residual, slopes) at each knot."""
    n, m = X.shape
    norm = np.linalg.norm(X, axis=0)
    live = norm > 0
    Z = X / np.where(live, norm, 1)
    c, active, r, out = np.zeros(m), [], y.copy(), []
    knot = lambda: out.append((np.abs((Z.T @ r)[live]).max(initial=0), np.where(live, c / np.where(live, norm, 1), 0)))
    for _ in range(8 * m):
        knot()
        corr = Z.T @ r
        most = np.abs(corr[live]).max(initial=0)
        if most <= max(alpha * n / max(norm.max(initial=1), 1), 1e-12 * max(1, np.abs(y).max(initial=0))) or len(active) >= (n_nonzero or m):
            return out
        new = [j for j in range(m) if live[j] and j not in active and abs(abs(corr[j]) - most) < 1e-10 * max(1, most)]
        active += new[: 1 if not active else None]
        A = Z[:, active] * np.sign(corr[active])
        g = np.linalg.pinv(A.T @ A) @ np.ones(len(active))
        a = 1 / np.sqrt(g.sum())
        u = A @ (a * g)
        step = most / a
        for j in range(m):
            if live[j] and j not in active:
                p = Z[:, j] @ u
                for s in ((most - corr[j]) / (a - p) if a != p else np.inf, (most + corr[j]) / (a + p) if a != -p else np.inf):
                    if 1e-12 < s < step:
                        step = s
        move = a * g * np.sign(corr[active])
        if lasso_path:
            cross = [(-c[j] / d, j) for j, d in zip(active, move) if d and 1e-12 < -c[j] / d < step]
            step = min([step, *(s for s, _ in cross)])
        c[active] += step * move
        r = y - Z @ c
        if lasso_path:
            gone = [j for j in active if abs(c[j]) < 1e-12 and len(active) > 1]
            for j in gone:
                c[j] = 0
                active.remove(j)
    knot()
    return out


def least_angle(n_nonzero: int | None = None, lasso_path: bool = False, alpha: float = 0.0):
    """Least-angle regression; with lasso_path, coefficients that cross zero leave."""

    def fit(X, y):
        Xc, yc, mx, my = _centred(X, y)
        c = angle_path(Xc, yc, n_nonzero, lasso_path, alpha)[-1][1]
        return c, my - mx @ c

    return fit


def least_angle_cv(lasso_path: bool = False, folds: int = 5):
    """The point of the path of least squared error over contiguous folds; points are correlations over the root of the rows."""

    def path(X, y):
        Xc, yc, mx, my = _centred(X, y)
        got = angle_path(Xc, yc, None, lasso_path)
        at = np.minimum.accumulate(np.array([a for a, _ in got]) / np.sqrt(len(y)))
        C = np.array([c for _, c in got])
        # slopes are linear in the correlation between knots
        slopes = lambda q: np.column_stack([np.interp(q, at[::-1], C[::-1, j]) for j in range(X.shape[1])])
        return at, slopes, mx, my

    def fit(X, y):
        if len(y) < 2:
            return least_angle(lasso_path=lasso_path)(X, y)
        whole, slopes, mx, my = path(X, y)
        made = []
        for part in np.array_split(np.arange(len(y)), min(folds, len(y))):
            keep = np.ones(len(y), bool)
            keep[part] = False
            made.append((part, *path(X[keep], y[keep])))
        tried = np.unique(np.concatenate([whole, *(at for _, at, *_ in made)]))[::-1]
        loss = np.zeros(len(tried))
        for part, _, own, fx, fy in made:
            loss += ((y[part] - fy - own(tried) @ (X[part] - fx).T) ** 2).sum(1)
        c = slopes(tried[[loss.argmin()]])[0]
        return c, my - mx @ c

    return fit


def least_angle_ic(X, y):
    """The knot of the lasso path of least Akaike criterion, with the noise of least squares on all columns."""
    Xc, yc, mx, my = _centred(X, y)
    n, m = X.shape
    knots = [c for _, c in angle_path(Xc, yc, None, True)]
    rss = np.array([((yc - Xc @ c) ** 2).sum() for c in knots])
    df = np.array([(c != 0).sum() for c in knots])
    if n > m + 1:
        full = ((yc - Xc @ np.linalg.lstsq(Xc, yc, rcond=None)[0]) ** 2).sum()
        noise = max(full / (n - m - 1), np.finfo(float).eps * (yc @ yc) / n, np.finfo(float).tiny)
        score = rss / noise + 2 * df
    else:  # no row is left to tell the noise from
        score = n * np.log(np.maximum(rss / max(n, 1), np.finfo(float).tiny)) + 2 * df
    c = knots[int(score.argmin())]
    return c, my - mx @ c


def gradient(alpha: float = 1e-4, epochs: int = 1000, tol: float = 1e-3, eta0: float = 0.01, power: float = 0.25, seed: int = 0):
    """Stochastic gradient descent on squared loss with an L2 term and steps eta0 / t ** power."""

    def fit(X, y):
        rng, c, b, t, best, worse = np.random.default_rng(seed), np.zeros(X.shape[1]), 0.0, 0, np.inf, 0
        for _ in range(epochs):
            total = 0.0
            for i in rng.permutation(len(y)):
                t += 1
                eta, e = eta0 / t**power, X[i] @ c + b - y[i]
                total += e * e / 2
                c, b = c * (1 - eta * alpha) - eta * e * X[i], b - eta * e
            total /= max(1, len(y))
            worse = worse + 1 if total > best - tol else 0
            best = min(best, total)
            if worse >= 5:
                break
        return c, b

    return fit


_ALPHAS = tuple(10.0**k for k in range(-4, 3))
NAMED = {
    "LinearRegression": lambda: linear,
    "Ridge": ridge,
    "RidgeCV": lambda: cross_validated(ridge, (0.1, 1.0, 10.0)),
    "Lasso": lasso,
    "LassoCV": lambda: cross_validated(lasso, _ALPHAS),
    "ElasticNet": elastic_net,
    "ElasticNetCV": lambda: cross_validated(elastic_net, _ALPHAS),
    "OrthogonalMatchingPursuit": orthogonal_matching_pursuit,
    "OrthogonalMatchingPursuitCV": lambda: cross_validated(orthogonal_matching_pursuit, lambda X: range(1, X.shape[1] + 1)),
    "Lars": least_angle,
    "LarsCV": least_angle_cv,
    "LassoLars": lambda alpha=1.0: least_angle(lasso_path=True, alpha=alpha),
    "LassoLarsCV": lambda: least_angle_cv(lasso_path=True),
    "LassoLarsIC": lambda: least_angle_ic,
    "SGDRegressor": gradient,
}


def solver(which):
    """A fit(X, y) from None, "lstsq", a name of NAMED, a callable, or an object with fit(), coef_ and intercept_; None means least squares by SVD."""
    if which is None or which == "lstsq" or which is np.linalg.lstsq:
        return None
    if isinstance(which, str):
        if which not in NAMED:
            raise ValueError(f"no solver {which}")
        return NAMED[which]()
    if hasattr(which, "fit"):

        def fit(X, y):
            m = which.fit(X, y)
            return np.asarray(m.coef_), float(getattr(m, "intercept_", np.nan))

        return fit
    if callable(which):
        return which
    raise ValueError("a solver is a name, a callable or an object with fit()")
