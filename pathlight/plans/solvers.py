"""Solvers of b = A x + e for the delays x of links.

All but expectation maximisation need (A, b) only through a small triangle: with A = QR,
the singular values of R are those of A, and residuals differ by a constant. So a solver
takes a System - R, Q'b, the rest of b's norm and how many paths there were - whose size
depends on the number of links alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Singular values below this share of the largest, times the larger dimension, count as 0.
CUT = 1e-10


class SolveError(ValueError):
    pass


@dataclass
class System:
    """R (k x n), q = Q'b, rest = squared norm of what of b lies outside A's columns, m paths. coverage: paths by link."""

    r: np.ndarray
    q: np.ndarray
    rest: float
    m: int
    coverage: np.ndarray
    neighbors: list[tuple[int, int]] | None = None
    _svd: tuple | None = None

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, neighbors: list[tuple[int, int]] | None = None) -> System:
        a, b = np.asarray(a, float), np.asarray(b, float)
        q, r = np.linalg.qr(a)
        p = q.T @ b
        return cls(r, p, max(float(b @ b - p @ p), 0.0), len(b), (a > 0).sum(0), neighbors)

    @property
    def n(self) -> int:
        return self.r.shape[1]

    @property
    def svd(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """U'b, singular values and V', shared by all solvers of the system."""
        if self._svd is None:
            u, s, vt = np.linalg.svd(self.r, full_matrices=False)
            self._svd = (u.T @ self.q, s, vt)
        return self._svd

    def residual(self, x: np.ndarray) -> float:
        return float(np.sqrt(((self.r @ x - self.q) ** 2).sum() + self.rest))


@dataclass
class Solution:
    x: np.ndarray
    method: str
    residual: float
    metadata: dict[str, float] = field(default_factory=dict)


@dataclass
class Quality:
    """What the paths can tell about the links."""

    rank: int
    n: int
    m: int
    condition: float
    unidentifiable: list[int]
    singular: list[float]

    @property
    def identifiable_share(self) -> float:
        return (self.n - len(self.unidentifiable)) / self.n if self.n else 0.0


def audit(r: np.ndarray, m: int) -> Quality:
    """Rank, condition number and links that reach into the null space; m is the number of rows of the whole matrix."""
    n = r.shape[1]
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    top = float(s[0]) if len(s) else 0.0
    rank = int((s > top * CUT * max(m, n)).sum()) if top > 0 else 0
    if rank == 0:
        lost = list(range(n))
    elif rank >= n:
        lost = []
    else:
        lost = np.flatnonzero(np.linalg.norm(vt[rank:], axis=0) > CUT * top).tolist()
    return Quality(rank, n, m, top / float(s[rank - 1]) if rank else float("inf"), lost, s[: min(m, n)].tolist())


def _filtered(s: System, weights: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
    p, _, vt = s.svd
    return vt.T @ (weights * (p if c is None else c))


def truncated(s: System, rank: int | None = None) -> Solution:
    """Pseudo-inverse of the leading singular values."""
    _, d, _ = s.svd
    top = d[0] if len(d) else 0.0
    k = min(rank, len(d)) if rank else max(1, int((d > top * CUT * max(s.m, s.n)).sum()))
    keep = (np.arange(len(d)) < k) & (d >= max(top * CUT * max(s.m, s.n), 1e-300))
    x = _filtered(s, np.divide(1.0, d, out=np.zeros_like(d), where=keep))
    return Solution(x, "tsvd", s.residual(x), {"truncation_rank": k})


def _grid(d: np.ndarray) -> np.ndarray:
    low = d[-1] ** 2 * 1e-6
    return np.geomspace(low if low > 0 else 1e-12, d[0] ** 2 * 10, 100)


def gcv_curve(p: np.ndarray, d: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Regularisation strengths and their cross-validation scores; the part of b outside the columns does not enter."""
    lam = _grid(d)
    f = d**2 / (d**2 + lam[:, None])
    miss = (((1 - f) * p) ** 2).sum(1) / m
    room = (1 - f.sum(1) / m) ** 2
    return lam, np.where(room > 1e-15, miss / np.where(room > 1e-15, room, 1), np.inf)


def choose_gcv(p: np.ndarray, d: np.ndarray, m: int) -> float:
    lam, score = gcv_curve(p, d, m)
    return float(lam[int(score.argmin())])


def choose_lcurve(p: np.ndarray, d: np.ndarray, m: int) -> float:
    """The corner of log residual against log size; the middle of the grid where there is none."""
    lam = _grid(d)
    f = d**2 / (d**2 + lam[:, None])
    size = np.where(d > 0, f * p / np.where(d > 0, d, 1), 0)
    a = 0.5 * np.log(np.maximum((((1 - f) * p) ** 2).sum(1), 1e-30))
    b = 0.5 * np.log(np.maximum((size**2).sum(1), 1e-30))
    da, db = (a[2:] - a[:-2]) / 2, (b[2:] - b[:-2]) / 2
    dda, ddb = a[2:] - 2 * a[1:-1] + a[:-2], b[2:] - 2 * b[1:-1] + b[:-2]
    bend = (da * ddb - db * dda) / np.maximum((da**2 + db**2) ** 1.5, 1e-300)
    return float(lam[1 + int(bend.argmax())]) if np.isfinite(bend).all() and bend.max() > 0 else float(lam[50])


CHOICES: dict[str, Callable[[np.ndarray, np.ndarray, int], float]] = {"gcv": choose_gcv, "lcurve": choose_lcurve}


def _ridge(s: System, p: np.ndarray, lam: float) -> np.ndarray:
    _, d, _ = s.svd
    keep = d >= max((d[0] if len(d) else 0) * CUT, 1e-300)
    return _filtered(s, np.where(keep, d / (d**2 + lam), 0), p)


def tikhonov(s: System, lam: float = 0.0, choice: str = "gcv") -> Solution:
    """Ridge regression; a strength of 0 or less is chosen."""
    p, d, _ = s.svd
    if not len(d) or d[0] == 0:
        return Solution(np.zeros(s.n), "tikhonov", s.residual(np.zeros(s.n)), {"lambda": 0.0})
    lam = lam if lam > 0 else CHOICES[choice](p, d, s.m)
    x = _ridge(s, p, lam)
    return Solution(x, "tikhonov", s.residual(x), {"lambda": lam})


def nnls(s: System, most: int = 0) -> Solution:
    """Non-negative least squares by active sets. At full rank, where the answer is unique, it starts from the positive part of the unconstrained one."""
    x, free = np.zeros(s.n), np.zeros(s.n, bool)
    steps, most = 0, most or 3 * s.n
    tiny = 1e-15

    def settle() -> None:
        """Least squares over the free links, letting go of those that it would make negative."""
        nonlocal x, free
        while free.any():
            z = np.zeros(s.n)
            z[free] = np.linalg.lstsq(s.r[:, free], s.q, rcond=None)[0]
            low = free & (z <= tiny)
            if not low.any():
                x = z
                return
            gap = x[low] - z[low]
            x = x + np.min(np.where(gap > 0, x[low] / np.where(gap > 0, gap, 1), 0.0)) * (z - x)
            free &= x > tiny
            x[~free] = 0

    if s.n and len(s.r) >= s.n and np.linalg.matrix_rank(s.r) == s.n:
        start = np.linalg.lstsq(s.r, s.q, rcond=None)[0]
        free = start > tiny
        x = np.where(free, start, 0.0)
        settle()
    while steps < most:
        w = s.r.T @ (s.q - s.r @ x)
        w[free] = -np.inf
        j = int(w.argmax()) if s.n else 0
        if not s.n or w[j] <= tiny * max(1.0, np.abs(s.q).max(initial=0.0)):
            break
        free[j] = True
        steps += 1
        settle()
    return Solution(x, "nnls", s.residual(x), {"iterations": steps})


def shrink(v: np.ndarray, k: float | np.ndarray) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - k, 0)


def _lasso(s: System, k: np.ndarray, rho: float, rounds: int, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Alternating directions: (x, z, u, rounds taken)."""
    gram, atb = s.r.T @ s.r, s.r.T @ s.q
    inverse = np.linalg.inv(gram + rho * np.eye(s.n))
    z, u = start or (np.zeros(s.n), np.zeros(s.n))
    x, t = z, 0
    for t in range(1, rounds + 1):
        x = inverse @ (atb + rho * (z - u))
        old, z = z, shrink(x + u, k)
        u = u + x - z
        if np.linalg.norm(x - z) < 1e-6 and rho * np.linalg.norm(z - old) < 1e-6:
            break
    return x, z, u, t


def admm(s: System, lam: float = 0.0, rho: float = 1.0, rounds: int = 200) -> Solution:
    """Lasso; a strength of 0 or less is a tenth of the largest correlation. The unthresholded variable is the answer."""
    lam = lam if lam > 0 else 0.1 * float(np.abs(s.r.T @ s.q).max(initial=0.0))
    x, _, _, t = _lasso(s, np.full(s.n, lam / rho), rho, rounds)
    return Solution(x, "admm", s.residual(x), {"iterations": t, "lambda": lam, "rho": rho})


def irl1(s: System, lam: float = 0.0, rho: float = 1.0, outer: int = 5, rounds: int = 100, eps: float = 0.1) -> Solution:
    """Lasso whose weights follow the last estimate, each round from where the last one ended."""
    lam = lam if lam > 0 else 0.1 * float(np.abs(s.r.T @ s.q).max(initial=0.0))
    weight, start, x, n = np.ones(s.n), None, np.zeros(s.n), 0
    for _ in range(outer):
        x, z, u, t = _lasso(s, weight * lam / rho, rho, rounds, start)
        start, n = (z, u), n + t
        new = 1 / (np.abs(z) + eps)
        if np.abs(new - weight).max(initial=0.0) < 1e-6:
            break
        weight = new
    return Solution(x, "irl1", s.residual(x), {"iterations": n, "lambda": lam})


def gravity(s: System, prior: np.ndarray) -> Solution:
    """A ridge correction of a prior; where the sum is negative, the prior stands."""
    p, d, vt = s.svd
    rest = p - d * (vt @ prior)
    lam = choose_gcv(rest, d, s.m)
    x = prior + _ridge(s, rest, lam)
    x = np.where(x < 0, np.maximum(prior, 0), x)
    return Solution(x, "tomogravity", s.residual(x), {"lambda": lam})


def link_laplacian(n: int, neighbors: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros((n, n))
    for a, b in neighbors:
        out[a, b] = -1
    out[np.diag_indices(n)] = -out.sum(1)
    return out


def laplacian(s: System, lam: float = 0.0) -> Solution:
    """Least squares with a penalty on differences between links that share an end."""
    if s.neighbors is None:
        raise SolveError("the Laplacian solver needs to know which links share an end")
    l = link_laplacian(s.n, s.neighbors)  # noqa: E741
    if s.n > 1 and (np.diag(l) == 0).any():
        raise SolveError("a link shares no end with any other")
    if lam <= 0:
        gram, smooth, atb = s.r.T @ s.r, l.T @ l, s.r.T @ s.q
        best = (np.inf, 1.0)
        for c in 10 ** (-4 + 0.2 * np.arange(40)):
            try:
                np.linalg.cholesky(gram + c * smooth)
            except np.linalg.LinAlgError:
                continue
            x = np.linalg.solve(gram + c * smooth, atb)
            best = min(best, (s.residual(x) + c * float(np.linalg.norm(l @ x)), float(c)))
        lam = best[1]
    u, d, vt = np.linalg.svd(np.vstack([s.r, np.sqrt(lam) * l]), full_matrices=False)
    p = u.T @ np.concatenate([s.q, np.zeros(s.n)])
    keep = d > CUT * d[0]
    x = vt.T @ np.where(keep, p / np.where(keep, d, 1), 0)
    return Solution(x, "laplacian", s.residual(x), {"lambda": lam})


def em(paths: list[np.ndarray], b: np.ndarray, n: int, weights: np.ndarray | None = None, rounds: int = 500, tolerance: float = 1e-6) -> Solution:
    """Multiplicative updates over paths as lists of links; paths without links, or whose fit is 0, give nothing. weights: how many paths each one stands for, b being their mean."""
    weights = np.ones(len(paths)) if weights is None else weights
    use = [(np.unique(p), v) for p, v in zip(paths, b, strict=True) if len(p)]
    w = np.array([k for p, k in zip(paths, weights, strict=True) if len(p)], float)
    if w.sum() < 2:
        raise SolveError("expectation maximisation needs two paths with links")
    row = np.repeat(np.arange(len(use)), [len(p) for p, _ in use])
    col, y = np.concatenate([p for p, _ in use]), np.array([v for _, v in use], float)
    x, t, zero = np.ones(n), 0, 0
    for t in range(1, rounds + 1):
        fit = np.bincount(row, x[col], len(use))
        ok = fit > 0
        zero = int((~ok).sum())
        ratio = np.divide(y, fit, out=np.zeros_like(y), where=ok)
        seen = np.bincount(col, (w * ok)[row], n)
        gain = np.bincount(col, (w * ratio)[row], n)
        new = x * np.divide(gain, seen, out=np.zeros(n), where=seen > 0)
        change = np.abs(new - x)[new > 0] / new[new > 0]
        x = new
        if not len(change) or change.max() < tolerance:
            break
    fit = np.bincount(row, x[col], len(use))
    rest = sum(float(k) * float(v) ** 2 for p, v, k in zip(paths, b, weights, strict=True) if not len(p))
    return Solution(x, "vardi-em", float(np.sqrt((w * (fit - y) ** 2).sum() + rest)), {"iterations": t, "tolerance": tolerance, "skipped_empty": len(paths) - len(use), "skipped_zero_denom": zero})


SOLVERS: dict[str, Callable[[System], Solution]] = {"tsvd": truncated, "tikhonov": tikhonov, "nnls": nnls, "admm": admm, "irl1": irl1, "laplacian": laplacian}
ALIASES = {"vardi": "vardi-em", "em": "vardi-em"}
METHODS = ("tsvd", "tikhonov", "nnls", "admm", "vardi-em", "tomogravity", "irl1", "laplacian")


def solver_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in METHODS:
        raise ValueError(f"unknown method {name}; there are {', '.join(METHODS)}")
    return name
