"""Small dense numerical cores, run inside Arrow functions on the units of one estimate."""

from __future__ import annotations

import numpy as np


def quantile_regression(x: np.ndarray, y: np.ndarray, tau: float, w: np.ndarray | None = None, ridge: float = 0.0, seed: int = 0) -> np.ndarray:
    """Coefficients that minimise the weighted pinball loss, exactly (a vertex of the linear program).

    A few reweighted least-squares steps give a start; then basis rows are exchanged along
    the steepest edge, each with an exact line search (a weighted quantile of breakpoints).
    Columns that depend on others get coefficient 0. The search runs in an orthonormal basis
    of the kept columns, as their own scales and near-dependence would be squared in normal
    equations. With ridge > 0 (on all columns but the first) the reweighted steps are iterated
    to convergence instead, on the columns as they are.
    """
    n = len(y)
    w = np.ones(n) if w is None else np.asarray(w, float)
    use = w > 0
    x, y, w = x[use], y[use].astype(float), w[use]
    p = x.shape[1]
    keep = _independent(x)
    beta = np.zeros(p)
    if not len(keep) or not len(y):
        return beta
    xk = x[:, keep]
    # Ties are broken by a jitter that is far below the data's resolution.
    jitter = np.random.default_rng(seed).uniform(-1, 1, len(y)) * 1e-9 * (np.abs(y).max() + 1e-12)
    yy = y + jitter
    penalty = np.zeros(len(keep))
    if ridge > 0:
        penalty[1:] = ridge
    if ridge > 0:
        beta[keep] = _irls(xk, yy, tau, w, penalty, 200)
    else:
        q, upper = np.linalg.qr(xk)
        beta[keep] = np.linalg.solve(upper, _descend(q, yy, y, tau, w, _irls(q, yy, tau, w, penalty, 30)))
    return beta


def _independent(x: np.ndarray) -> list[int]:
    keep: list[int] = []
    q = np.zeros((x.shape[0], 0))
    for j in range(x.shape[1]):
        v = x[:, j].astype(float)
        size = np.linalg.norm(v)
        v = v - q @ (q.T @ v)
        v = v - q @ (q.T @ v)
        if size > 0 and np.linalg.norm(v) > 1e-9 * size:
            q = np.column_stack([q, v / np.linalg.norm(v)])
            keep.append(j)
    return keep


def _irls(x, y, tau, w, penalty, steps):
    b = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    scale = np.abs(y - x @ b).mean() + 1e-12
    for k in range(steps):
        r = y - x @ b
        eps = max(scale * 0.7**k, 1e-8 * scale)
        v = w * np.where(r >= 0, tau, 1 - tau) / np.maximum(np.abs(r), eps)
        try:
            new = np.linalg.solve(x.T @ (x * v[:, None]) + np.diag(2 * penalty) + 1e-12 * np.eye(x.shape[1]), x.T @ (v * y))
        except np.linalg.LinAlgError:
            if penalty.any():
                raise
            return b  # without a penalty this is only a start, and any will do
        if np.abs(new - b).max() < 1e-10 * (np.abs(b).max() + 1e-12):
            return new
        b = new
    return b


def _descend(x, yy, y, tau, w, b):
    n, p = x.shape
    basis: list[int] = []
    q = np.zeros((0, p))
    for i in np.argsort(np.abs(yy - x @ b), kind="stable"):
        v = x[i] - (q.T @ (q @ x[i]) if len(q) else 0)
        if np.linalg.norm(v) > 1e-8 * (np.linalg.norm(x[i]) + 1e-300):
            q = np.vstack([q, v / np.linalg.norm(v)])
            basis.append(int(i))
            if len(basis) == p:
                break
    h = np.array(basis)
    for _ in range(50 * (p + 1) + n):
        d = np.linalg.inv(x[h])
        b = d @ yy[h]
        r = yy - x @ b
        r[h] = 0
        a = x @ d
        slope = np.where(r > 0, tau, tau - 1) * w
        slope[h] = 0
        g = -(slope @ a)
        up = g + w[h] * (1 - tau)
        down = -g + w[h] * tau
        k = int(np.argmin(np.concatenate([up, down])))
        best = min(up.min(), down.min())
        if best >= -1e-10 * w.sum():
            break
        j, sign = (k, 1.0) if k < p else (k - p, -1.0)
        step = sign * a[:, j]
        other = np.ones(n, bool)
        other[h] = False
        moves = other & (step != 0) & (np.sign(step) == np.sign(r))
        if not moves.any():
            break
        idx = np.flatnonzero(moves)
        t = r[idx] / step[idx]
        order = np.argsort(t, kind="stable")
        gain = best + np.cumsum(w[idx][order] * np.abs(step[idx][order]))
        e = int(np.searchsorted(gain, 0.0))
        h[j] = idx[order[min(e, len(order) - 1)]]
    return np.linalg.solve(x[h], y[h])


class Ridge:
    """Weighted least squares with a ridge penalty on all but the first `free` columns.

    Weights are normalised to sum 1; the penalty is ridge * |beta|^2 over the penalised
    columns. `normal` maps responses to coefficients and is reused for many responses.
    """

    def __init__(self, x: np.ndarray, w: np.ndarray | None = None, ridge: float = 0.0, free: int = 1) -> None:
        w = np.ones(len(x)) if w is None else np.asarray(w, float)
        self.x, self.w = x, w / w.sum()
        penalty = np.zeros(x.shape[1])
        penalty[free:] = ridge
        gram = x.T @ (x * self.w[:, None]) + np.diag(penalty)
        self.normal = np.linalg.pinv(gram) @ (x * self.w[:, None]).T

    def fit(self, y: np.ndarray) -> np.ndarray:
        return self.normal @ y

    def residuals(self, y: np.ndarray, leave_one_out: bool = False, center: bool = False) -> np.ndarray:
        r = y - self.x @ self.fit(y)
        if leave_one_out:
            h = np.einsum("ij,ji->i", self.x, self.normal)
            r = r / np.maximum(1 - h, 1e-6)[(...,) + (None,) * (r.ndim - 1)]
        return r - r.mean(axis=0) if center else r


LAMBDAS = np.logspace(-3, 2, 20)


def choose_ridge(x, y, w, free: int = 1, folds: int = 5, lambdas: np.ndarray = LAMBDAS, rng: np.random.Generator | None = None) -> float:
    """The first penalty with the least weighted squared error over shuffled folds."""
    rng = rng or np.random.default_rng(0)
    order = rng.permutation(len(y))
    parts = [p for p in np.array_split(order, folds) if len(p)]
    loss = np.zeros(len(lambdas))
    for k, lam in enumerate(lambdas):
        for test in parts:
            train = np.setdiff1d(order, test)
            if not len(train):
                continue
            b = Ridge(x[train], w[train], lam, free).fit(y[train])
            loss[k] += (w[test] * (y[test] - x[test] @ b) ** 2).sum() / max(w[test].sum(), 1e-300)
    return float(lambdas[int(np.argmin(loss))])


def winsorize(v: np.ndarray, share: float = 0.05) -> np.ndarray:
    """The lowest and highest floor(share * n) values set to the nearest kept ones."""
    v = np.sort(np.asarray(v, float))
    k = int(share * len(v))
    if k:
        v[:k], v[len(v) - k :] = v[k], v[len(v) - k - 1]
    return v


def sigma_bound(v: np.ndarray, confidence: float, resamples: int = 10_000, winsor: bool = False, seed: int = 0) -> float:
    """Upper end of the basic bootstrap interval of the sample deviation: 2 s - quantile(s*, (1 - confidence) / 2)."""
    v = np.asarray(v, float)
    n = len(v)
    if n < 2:
        return float("nan")

    def deviation(a: np.ndarray) -> np.ndarray:
        if winsor:
            a = np.sort(a, axis=-1)
            k = int(0.05 * n)
            if k:
                a[..., :k], a[..., n - k :] = a[..., k : k + 1], a[..., n - k - 1 : n - k]
        return a.std(axis=-1, ddof=1)

    rng = np.random.default_rng(seed)
    drawn = np.concatenate([deviation(v[rng.integers(0, n, (min(1000, resamples - i), n))]) for i in range(0, resamples, 1000)])
    return float(2 * deviation(v.copy()) - np.quantile(drawn, (1 - confidence) / 2))
