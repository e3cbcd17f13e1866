"""Dense kernels on one block at a time (numpy); Spark decides which block goes where."""

from __future__ import annotations

import math

import numpy as np


def as_matrix(x) -> np.ndarray:
    """Fold to two dimensions; a vector becomes the diagonal of its magnitudes."""
    x = np.asarray(x, dtype=np.float64)
    if x.ndim == 1:
        return np.diag(np.abs(x))
    return x.reshape(x.shape[0], -1)


def sinkhorn(w: np.ndarray, iters: int = 8, eps: float = 1e-8, tol: float = 1e-7) -> np.ndarray:
    """Alternate row and column L2 normalisation to Frobenius norm 1; lines below the floor become zero."""
    x = np.array(w, dtype=np.float64)

    def scaled(x: np.ndarray, axis: int) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis, keepdims=True))
        floor = max(eps * norm.max(initial=0.0), np.finfo(float).tiny)
        return np.where(norm > floor, x / np.where(norm > floor, norm, 1.0), 0.0)

    for _ in range(iters):
        x = scaled(scaled(x, 1), 0)
        rows = np.sqrt((x * x).sum(1))
        live = rows[rows > 0]
        if live.size and live.max() - live.min() <= tol * live.max():
            break
    size = np.linalg.norm(x)
    return x / size if size > 0 else x


def singular_values(x: np.ndarray, k: int = 64, seed: int = 0, power: int = 2, exact: int = 384, oversample: int = 64) -> np.ndarray:
    """The k largest singular values, all if there are fewer: from the small Gram matrix, or by random projection."""
    x = as_matrix(x)
    small = min(x.shape)
    if small == 0:
        return np.zeros(0)
    if small <= exact:
        gram = x @ x.T if x.shape[0] <= x.shape[1] else x.T @ x
        s = np.sqrt(np.clip(np.linalg.eigvalsh(gram)[::-1], 0, None))
    else:
        q = np.random.default_rng(seed).standard_normal((x.shape[1], min(k + oversample, small)))
        for _ in range(power + 1):
            q, _ = np.linalg.qr(x @ q)
            q, _ = np.linalg.qr(x.T @ q)
        s = np.linalg.svd(x @ q, compute_uv=False)
    return s[:k]


def gram_spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of X'X, largest first and not negative, with their vectors."""
    values, vectors = np.linalg.eigh(x.T @ x)
    return np.clip(values[::-1], 0, None), vectors[:, ::-1]


def effective_rank(values: np.ndarray) -> float:
    total = values.sum()
    if total <= 0:
        return 0.0
    p = values[values > 0] / total
    return float(np.exp(-(p * np.log(p)).sum()))


def top_mass(values: np.ndarray, k: int) -> float:
    total = values.sum()
    return float(values[:k].sum() / total) if total > 0 else 0.0


def subspace_energy(delta: np.ndarray, basis: np.ndarray, k: int = 48) -> float:
    total = (delta * delta).sum()
    inside = delta @ basis[:, :k]
    return float((inside * inside).sum() / total) if total > 0 else 0.0


def gini(x: np.ndarray) -> float:
    x = np.sort(np.clip(x, 0, None))
    n, s = len(x), x.sum()
    return float(2 * (np.arange(1, n + 1) * x).sum() / (n * s) - (n + 1) / n) if n and s > 0 else 0.0


def profile_stats(p: np.ndarray) -> np.ndarray:
    """Eight quantiles over the mean, Gini, excess kurtosis, skewness."""
    mean, sd = p.mean(), p.std()
    quantiles = np.quantile(p, np.linspace(0.05, 0.95, 8)) / mean if mean else np.zeros(8)
    z = (p - mean) / sd if sd > 1e-12 else np.zeros_like(p)
    return np.concatenate([quantiles, [gini(p), (z**4).mean() - 3 if sd > 1e-12 else 0.0, (z**3).mean()]])


def row_shape_profile(s: np.ndarray) -> np.ndarray:
    """Inverse participation of each row: n times the sum of fourth powers over the squared sum of squares."""
    two = (s * s).sum(1)
    return np.where(two > 0, s.shape[1] * (s**4).sum(1) / np.where(two > 0, two, 1) ** 2, 0.0)


def tensor_invariants(w, k: int = 64, seed: int = 0) -> np.ndarray:
    """The 32 features of a tensor that permutation and scaling of rows and columns leave (nearly) alone."""
    w = np.nan_to_num(np.asarray(w, dtype=np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    out = np.zeros(32)
    if w.size == 0:
        return out.astype(np.float32)
    if w.ndim == 1:  # a diagonal: its values are the spectrum and the profile
        shaped = np.abs(w)
        short, whole, s = w.size, float(w @ w), np.sort(shaped)[::-1][:k]
    else:
        balanced = sinkhorn(as_matrix(w), iters=64)
        short, whole = min(balanced.shape), float((balanced * balanced).sum())
        s, shaped = singular_values(balanced, k, seed=seed), row_shape_profile(balanced)
    n, top = len(s), s[0] if s[0] > 0 else 1.0
    ranks = np.rint(np.logspace(0, math.log10(n), 16)).astype(int)
    out[:16] = np.log10(s[np.minimum(ranks, n) - 1] / top + 1e-12)
    energy = s * s
    if energy.sum() > 0:
        p = energy / energy.sum()
        out[16] = -(p[p > 0] * np.log(p[p > 0])).sum() / math.log(max(n, 2))
        out[17] = whole / (top * top) / short  # of all singular values, not of the top k only
        out[18] = 1 / (p * p).sum() / n
    out[19:30] = profile_stats(shaped)
    out[30:32] = ((s / top) ** 3).mean(), ((s / top) ** 4).mean()
    return np.clip(np.nan_to_num(out, nan=0.0, posinf=10.0, neginf=-10.0), -10, 10).astype(np.float32)


def project_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point with non-negative entries that add up to 1."""
    u = np.sort(v)[::-1]
    over = u + (1 - np.cumsum(u)) / np.arange(1, len(v) + 1) > 0
    k = int(np.flatnonzero(over)[-1]) + 1
    return np.maximum(v + (1 - u[:k].sum()) / k, 0.0)


def nnls_gram(g: np.ndarray, c: np.ndarray, iters: int = 200) -> np.ndarray:
    """Minimise w'Gw - 2c'w over w >= 0 by active sets on the Gram matrix."""
    n = len(c)
    w, free = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-12 * max(1.0, float(np.abs(c).max(initial=0.0)))
    for _ in range(iters):
        grad = c - g @ w
        grad[free] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= tol:
            break
        free[j] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(g[np.ix_(free, free)], c[free], rcond=None)[0]
            if (z[free] > 0).all():
                w = z
                break
            bad = free & (z <= 0)
            step = np.min(w[bad] / np.maximum(w[bad] - z[bad], 1e-300))
            w = w + step * (z - w)
            free &= w > 1e-15
            w[~free] = 0.0
            if not free.any():
                break
    return w


def simplex_gram(g: np.ndarray, c: np.ndarray, start: np.ndarray, iters: int = 800) -> np.ndarray:
    """Minimise w'Gw - 2c'w on the simplex by projected gradient, then exactly on the support found."""
    top = float(np.linalg.eigvalsh(g)[-1])
    w = project_simplex(start)
    value = lambda w: float(w @ g @ w - 2 * c @ w)
    if top > 0:
        for _ in range(iters):
            w = project_simplex(w - (g @ w - c) / (2 * top))
        support = w > 1e-9
        m = int(support.sum())
        kkt = np.zeros((m + 1, m + 1))
        kkt[:m, :m], kkt[:m, m], kkt[m, :m] = g[np.ix_(support, support)], 1, 1
        exact = np.zeros_like(w)
        exact[support] = np.linalg.lstsq(kkt, np.append(c[support], 1.0), rcond=None)[0][:m]
        if (exact >= -1e-12).all() and value(np.clip(exact, 0, None)) <= value(w) + 1e-15:
            w = np.clip(exact, 0, None)
            w /= w.sum()
    return w


def nnls_l1(g: np.ndarray, c: np.ndarray, yy: float, l1: float = 1e-3, sum_to_one: bool = True) -> np.ndarray:
    """Sparse non-negative weights from G = TT', c = Ty and y'y; the simplex solution is kept if it is not worse."""
    warm = nnls_gram(g + l1 * yy, c)
    if not sum_to_one:
        return warm
    start = warm / warm.sum() if warm.sum() > 0 else np.full(len(c), 1 / len(c))
    best = simplex_gram(g, c, start)
    value = lambda w: float(w @ g @ w - 2 * c @ w)
    return best if value(best) <= value(start) + 1e-12 else start


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, iters: int = 50) -> np.ndarray:
    """Logistic regression without intercept on features scaled by their spread, mirrored once, by Newton steps."""
    scale = np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    z, t = np.vstack([x / scale, -x / scale]), np.concatenate([y, 1 - y])
    w = np.zeros(x.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (t - p) - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w / scale
