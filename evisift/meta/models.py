"""Common-effect and random-effects models, meta-regression, multilevel and robust estimates, on NumPy arrays.

Notation: weights ``w = 1 / (v + tau2)``, design ``x`` (k by p), ``a = inv(x'wx)``, coefficients ``b``, residuals ``r``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from evisift.meta import dist

CLOSED, ITERATED = ("DL", "HE", "HS", "SJ"), ("ML", "REML", "EB")


class NoConvergence(ArithmeticError):
    """An iterative estimate did not settle."""


@dataclass
class Solved:
    b: np.ndarray
    a: np.ndarray
    r: np.ndarray
    w: np.ndarray

    @property
    def rss(self) -> float:
        return float((self.w * self.r**2).sum())


def solve(y: np.ndarray, w: np.ndarray, x: np.ndarray) -> Solved:
    a = np.linalg.inv((x.T * w) @ x)
    b = a @ (x.T @ (w * y))
    return Solved(b, a, y - x @ b, w)


def traces(w: np.ndarray, x: np.ndarray, a: np.ndarray) -> tuple[float, float]:
    """Traces of P and PP, P the residual-making weight matrix, without forming it."""
    m2, m3 = (x.T * w**2) @ x, (x.T * w**3) @ x
    am2 = a @ m2
    return float(w.sum() - np.trace(am2)), float((w**2).sum() - 2 * np.trace(a @ m3) + np.trace(am2 @ am2))


def tau2_closed(y: np.ndarray, v: np.ndarray, x: np.ndarray, how: str) -> float:
    k, p = x.shape
    if k <= p:
        return 0.0
    if how in ("DL", "HS"):
        s = solve(y, 1 / v, x)
        value = (s.rss - (k - p)) / traces(s.w, x, s.a)[0] if how == "DL" else (s.rss - k) / s.w.sum()
    elif how == "HE":
        s = solve(y, np.ones(k), x)
        h = np.einsum("ij,jk,ik->i", x, s.a, x)
        value = (s.rss - (v * (1 - h)).sum()) / (k - p)
    elif how == "SJ":
        seed = float(y.var())
        if seed == 0:
            return 0.0
        value = seed * solve(y, 1 / (v + seed), x).rss / (k - p)
    else:
        raise ValueError(how)
    return max(0.0, float(value))


def log_likelihood(y: np.ndarray, v: np.ndarray, x: np.ndarray, tau2: float, restricted: bool) -> float:
    s = solve(y, 1 / (v + tau2), x)
    k, p = x.shape
    out = -0.5 * ((k - p * restricted) * math.log(2 * math.pi) + np.log(v + tau2).sum() + s.rss)
    if restricted:
        out += 0.5 * (np.linalg.slogdet(x.T @ x)[1] + np.linalg.slogdet(s.a)[1])
    return float(out)


def tau2_iterated(y: np.ndarray, v: np.ndarray, x: np.ndarray, how: str, most: int = 200, tol: float = 1e-10) -> float:
    """Fisher scoring from the HE estimate, halving steps that would cross zero."""
    k, p = x.shape
    if k <= p:
        return 0.0
    t = tau2_closed(y, v, x, "HE")
    for _ in range(most):
        s = solve(y, 1 / (v + t), x)
        w2r2 = float(((s.w * s.r) ** 2).sum())
        if how == "ML":
            step = (w2r2 - s.w.sum()) / (s.w**2).sum()
        elif how == "REML":
            tp, tpp = traces(s.w, x, s.a)
            step = (w2r2 - tp) / tpp
        else:
            step = (s.rss * k / (k - p) - k) / s.w.sum()
        while t + step < 0 and abs(step) > tol:
            step /= 2
        new = max(0.0, t + step)
        if abs(new - t) <= tol:
            t = new
            break
        t = new
    else:
        raise NoConvergence(how)
    if how != "EB" and t > 1e-10:
        gain = log_likelihood(y, v, x, 0.0, how == "REML") - log_likelihood(y, v, x, t, how == "REML")
        if gain > np.finfo(float).eps ** 0.25:
            t = 0.0
    return 0.0 if t < 1e-9 * v.mean() else float(t)


def generalised_q(y: np.ndarray, v: np.ndarray, x: np.ndarray, tau2: float) -> float:
    return solve(y, 1 / (v + tau2), x).rss


def tau2_paule_mandel(y: np.ndarray, v: np.ndarray, x: np.ndarray) -> float:
    k, p = x.shape
    if k <= p or generalised_q(y, v, x, 0.0) < k - p:
        return 0.0
    mad = float(np.median(np.abs(y - np.median(y))))
    return dist.root(lambda t: generalised_q(y, v, x, t) - (k - p), 0.0, max(100.0, 10 * mad * mad))


def tau2(y: np.ndarray, v: np.ndarray, x: np.ndarray, how: str) -> float:
    if how == "PM":
        return tau2_paule_mandel(y, v, x)
    return tau2_iterated(y, v, x, how) if how in ITERATED else tau2_closed(y, v, x, how)


def q_profile(y: np.ndarray, v: np.ndarray, x: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """Confidence interval of tau2 by profiling Q."""
    df, half = x.shape[0] - x.shape[1], (1 - level) / 2
    low, high = dist.chi2_ppf(half, df), dist.chi2_ppf(1 - half, df)
    q = lambda t: generalised_q(y, v, x, t)
    if q(0.0) < low:
        return 0.0, 0.0
    top = 1.0
    while q(top) > low:
        top *= 2
    upper = dist.root(lambda t: q(t) - low, 0.0, top)
    return (0.0 if q(0.0) <= high else dist.root(lambda t: q(t) - high, 0.0, upper)), upper


@dataclass
class Fit:
    b: np.ndarray
    se: np.ndarray
    vb: np.ndarray
    tau2: float
    q: float
    df: int
    test: str
    crit: float
    p: np.ndarray
    k: int
    extra: dict = field(default_factory=dict)

    @property
    def lo(self) -> np.ndarray:
        return self.b - self.crit * self.se

    @property
    def hi(self) -> np.ndarray:
        return self.b + self.crit * self.se

    @property
    def i2(self) -> float:
        """In percent."""
        return max(0.0, 100 * (self.q - self.df) / self.q) if self.q > 0 else 0.0

    @property
    def h2(self) -> float:
        return self.q / self.df if self.df else float("nan")

    @property
    def q_p(self) -> float:
        return dist.chi2_sf(self.q, self.df) if self.df else 1.0


def fit(y: np.ndarray, v: np.ndarray, x: np.ndarray | None = None, how: str = "REML", test: str = "z", level: float = 0.95, truncate: bool = True) -> Fit:
    """``how``: CE or a tau2 estimator; ``test``: z or knha (Knapp-Hartung, never below the Wald variance unless ``truncate`` is off)."""
    y, v = np.asarray(y, float), np.asarray(v, float)
    x = np.ones((len(y), 1)) if x is None else x
    k, p = x.shape
    t = 0.0 if how == "CE" else tau2(y, v, x, how)
    s, vb = solve(y, 1 / (v + t), x), None
    q = generalised_q(y, v, x, 0.0)
    if test == "knha" and k > p:
        scale = s.rss / (k - p)
        scale = 0.0 if s.rss <= np.finfo(float).eps else scale
        vb = s.a * (max(1.0, scale) if truncate else scale)
        crit, tail = dist.t_ppf(1 - (1 - level) / 2, k - p), lambda z: dist.two_sided_t(z, k - p)
    else:
        test, vb = "z", s.a
        crit, tail = dist.norm_ppf(1 - (1 - level) / 2), dist.two_sided_z
    se = np.sqrt(np.diag(vb))
    return Fit(s.b, se, vb, t, q, k - p, test, crit, np.array([tail(z) for z in s.b / se]), k)


def prediction_interval(f: Fit, level: float = 0.95) -> tuple[float, float] | None:
    if f.k < 3:
        return None
    half = dist.t_ppf(1 - (1 - level) / 2, f.k - 2) * math.sqrt(f.tau2 + f.se[0] ** 2)
    return float(f.b[0] - half), float(f.b[0] + half)


def moderators(f: Fit, null_tau2: float) -> dict[str, float]:
    """Omnibus test of all coefficients but the intercept, and the share of tau2 they explain."""
    m = len(f.b) - 1
    qm = float(f.b[1:] @ np.linalg.inv(f.vb[1:, 1:]) @ f.b[1:])
    out = {"qm": qm, "m": m, "r2": 100 * max(0.0, (null_tau2 - f.tau2) / null_tau2) if null_tau2 > 0 else 0.0}
    out["p"] = dist.chi2_sf(qm, m) if f.test == "z" else dist.f_sf(qm / m, m, f.df)
    return out


def design(columns: dict[str, list], centre: bool = True, reference: dict[str, object] | None = None) -> tuple[np.ndarray, list[str]]:
    """Intercept, numbers (centred at their mean) and dummy columns against a reference level (the first in order unless given)."""
    n = len(next(iter(columns.values())))
    x, names = [np.ones(n)], ["intrcpt"]
    for name, values in columns.items():
        if all(isinstance(a, (int, float, np.number)) for a in values):
            c = np.asarray(values, float)
            x.append(c - c.mean() if centre else c)
            names.append(name)
        else:
            levels = sorted(set(values))
            base = (reference or {}).get(name, levels[0])
            for lv in levels:
                if lv != base:
                    x.append(np.array([a == lv for a in values], float))
                    names.append(f"{name}:{lv}")
    return np.stack(x, 1), names


def _clusters(ids: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(ids == c) for c in dict.fromkeys(ids.tolist())]


def che(y: np.ndarray, v: np.ndarray, x: np.ndarray, study: np.ndarray, rho: float) -> dict[str, object]:
    """Correlated and hierarchical effects: two variance components by REML.

    Minimised by a derivative-free simplex from several starts on the log scale with the bounds at zero checked apart.
    """
    groups = _clusters(study)
    sampling = [np.where(np.eye(len(g), dtype=bool), v[g][:, None], rho * np.sqrt(np.outer(v[g], v[g]))) for g in groups]

    def parts(s1: float, s2: float):
        xsx, xsy, logdet, inv = 0.0, 0.0, 0.0, []
        for g, s in zip(groups, sampling):
            m = s + s1 + np.eye(len(g)) * s2
            i = np.linalg.inv(m)
            logdet += np.linalg.slogdet(m)[1]
            xsx, xsy = xsx + x[g].T @ i @ x[g], xsy + x[g].T @ i @ y[g]
            inv.append(i)
        b = np.linalg.solve(xsx, xsy)
        q = sum(float((y[g] - x[g] @ b) @ i @ (y[g] - x[g] @ b)) for g, i in zip(groups, inv))
        return 0.5 * (logdet + np.linalg.slogdet(xsx)[1] + q), b, np.linalg.inv(xsx), inv

    def objective(z: np.ndarray) -> float:
        return parts(*np.maximum(z, 0.0) ** 2)[0]

    scale = math.sqrt(max(float(np.var(y)), 1e-8))
    best = min((nelder_mead(objective, np.array(s) * scale) for s in ((0.5, 0.5), (1, 0.1), (0.1, 1), (0.01, 0.01), (0.0, 0.0))), key=objective)
    s1, s2 = np.maximum(best, 0.0) ** 2
    value, b, vb, inv = parts(s1, s2)
    return {"b": b, "vb": vb, "sigma2_study": float(s1), "sigma2_effect": float(s2), "objective": value, "inverse": inv, "groups": groups}


def nelder_mead(f, start: np.ndarray, size: float = 0.25, most: int = 2000, tol: float = 1e-12) -> np.ndarray:
    n = len(start)
    pts = [start] + [start + size * max(1.0, abs(start).max()) * e for e in np.eye(n)]
    val = [f(p) for p in pts]
    for _ in range(most):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < tol and max(np.abs(p - pts[0]).max() for p in pts) < 1e-9:
            break
        mid = np.mean(pts[:-1], 0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < val[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def cr2(y: np.ndarray, x: np.ndarray, b: np.ndarray, groups: list[np.ndarray], weights: list[np.ndarray], working: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Bias-reduced robust standard errors with Satterthwaite degrees of freedom; weights and working covariances per cluster."""
    m = np.linalg.inv(sum(x[g].T @ w @ x[g] for g, w in zip(groups, weights)))
    adj = []
    for g, w, phi in zip(groups, weights, working):
        d = np.linalg.cholesky(phi).T
        mid = d @ (phi - x[g] @ m @ x[g].T) @ d.T
        val, vec = np.linalg.eigh((mid + mid.T) / 2)
        inv = np.where(val > 1e-12 * max(1.0, val.max()), 1 / np.sqrt(np.where(val > 0, val, 1)), 0)
        adj.append(d.T @ (vec * inv) @ vec.T @ d)
    p, se, df = x.shape[1], [], []
    for c in range(p):
        e = np.eye(p)[c]
        bj = [a.T @ w @ x[g] @ m @ e for g, w, a in zip(groups, weights, adj)]
        se.append(math.sqrt(sum(float(q @ (y[g] - x[g] @ b)) ** 2 for q, g in zip(bj, groups))))
        h = [[None] * len(groups) for _ in groups]
        for i, (qi, gi) in enumerate(zip(bj, groups)):
            for j, (qj, gj) in enumerate(zip(bj, groups)):
                cov = (working[i] if i == j else 0) - x[gi] @ m @ x[gj].T
                h[i][j] = float(qi @ cov @ qj)
        k = np.array(h)
        df.append(float(np.trace(k) ** 2 / (k * k).sum()))
    se_, df_ = np.array(se), np.array(df)
    t = b / se_
    return {"se": se_, "df": df_, "p": np.array([dist.two_sided_t(a, max(d, 1e-6)) for a, d in zip(t, df_)])}
