"""Tests for small-study effects, and what deleting studies does."""

from __future__ import annotations

import math

import numpy as np

from evisift.meta import dist
from evisift.meta.models import Fit, fit, solve


def weighted_line(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """Weighted regression with residual variance estimated; t on k - 2."""
    m = np.stack([np.ones(len(x)), x], 1)
    s = solve(y, w, m)
    df = len(y) - 2
    se = np.sqrt(np.diag(s.a) * s.rss / df)
    t = s.b / se
    return {"intercept": float(s.b[0]), "slope": float(s.b[1]), "se_intercept": float(se[0]), "se_slope": float(se[1]), "p_intercept": dist.two_sided_t(t[0], df), "p_slope": dist.two_sided_t(t[1], df), "df": df}


def egger(y: np.ndarray, v: np.ndarray) -> dict[str, float]:
    return weighted_line(y, np.sqrt(v), 1 / v)


def pet_peese(y: np.ndarray, v: np.ndarray) -> dict[str, float]:
    """PEESE if the one-tailed PET test of the effect gives p < 0.10."""
    pet, peese = egger(y, v), weighted_line(y, v, 1 / v)
    use = pet["p_intercept"] / 2 < 0.10
    return {"pet": pet["intercept"], "peese": peese["intercept"], "chosen": peese["intercept"] if use else pet["intercept"], "peese_used": float(use)}


def peters(y: np.ndarray, events: np.ndarray, nonevents: np.ndarray) -> dict[str, float]:
    n = events + nonevents
    return weighted_line(y, 1 / n, events * nonevents / n)


def harbord(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> dict[str, float]:
    """Score test on 2x2 tables (events and non-events of two arms); studies without variance are left out."""
    n, m1, m0, t = a + b + c + d, a + c, b + d, a + b
    z, v = a - t * m1 / n, t * (c + d) * m1 * m0 / (n * n * (n - 1))
    ok = v > 0
    # an unweighted line of the standardised score on its root information: its intercept measures the asymmetry
    return weighted_line(z[ok] / np.sqrt(v[ok]), np.sqrt(v[ok]), np.ones(ok.sum()))


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """Score and tau-b over all pairs."""
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    s = int((sx * sy).sum() // 2)
    nx, ny = (sx != 0).sum() / 2, (sy != 0).sum() / 2
    return s, float(s / math.sqrt(nx * ny)) if nx and ny else 0.0


def _kendall_variance(x: np.ndarray, y: np.ndarray) -> float:
    """Variance of the score under independence, with ties in either variable (Kendall 1970)."""
    n = len(x)
    t, u = (np.unique(c, return_counts=True)[1].astype(float) for c in (x, y))
    tied = sum((c * (c - 1) * (2 * c + 5)).sum() for c in (t, u))
    second = (t * (t - 1)).sum() * (u * (u - 1)).sum() / (2 * n * (n - 1))
    third = (t * (t - 1) * (t - 2)).sum() * (u * (u - 1) * (u - 2)).sum() / (9 * n * (n - 1) * (n - 2))
    return (n * (n - 1) * (2 * n + 5) - tied) / 18 + second + third


def begg(y: np.ndarray, v: np.ndarray) -> dict[str, float]:
    """Rank correlation of standardised effects with their variances."""
    w = 1 / v
    theta = (w * y).sum() / w.sum()
    left = v - 1 / w.sum()
    if (left <= 0).any():
        raise ValueError("a variance is no larger than that of the mean: effects cannot be standardised")
    z = (y - theta) / np.sqrt(left)
    s, tau = kendall(z, v)
    n = len(y)
    ties = len(set(z.tolist())) < n or len(set(v.tolist())) < n
    if not ties and n <= 200:
        p = dist.kendall_exact_p(s, n)
    else:
        p = dist.two_sided_z(s / math.sqrt(_kendall_variance(z, v)))
    return {"tau": tau, "p": p}


def trim_and_fill(y: np.ndarray, v: np.ndarray, estimator: str = "L0", how: str = "REML") -> dict[str, object]:
    """Number of missing studies and the estimate with mirrored ones."""
    # effects are turned so that the studies that may be missing lie on the left; the rightmost ones are trimmed
    turn = 1.0 if egger(y, v)["slope"] > 0 else -1.0
    order = np.argsort(turn * y, kind="stable")
    flipped, fv = (turn * y)[order], v[order]
    k, k0, seen = len(y), 0, []
    while True:
        keep = slice(0, k - k0)
        centre = float(fit(flipped[keep], fv[keep], how=how).b[0])
        dev = flipped - centre
        rank = np.empty(k)
        rank[np.argsort(np.abs(dev), kind="stable")] = np.arange(1, k + 1)
        positive = rank[dev > 0].sum()
        if estimator == "R0":
            value = k - rank[dev < 0].max(initial=0) - 1
        elif estimator == "Q0":
            value = k - 0.5 - math.sqrt(max(0.0, 2 * k * k - 4 * positive + 0.25))
        else:
            value = (4 * positive - k * (k + 1)) / (2 * k - 1)
        new = min(max(0, round(value)), k - 2)
        if new == k0 or new in seen:
            k0 = new
            break
        seen.append(new)
        k0 = new
    centre = float(fit(flipped[: k - k0], fv[: k - k0], how=how).b[0])
    mirrored = 2 * centre - flipped[k - k0 :]
    full = fit(np.concatenate([flipped, mirrored]), np.concatenate([fv, fv[k - k0 :]]), how=how)
    return {"k0": k0, "side": "left" if turn > 0 else "right", "b": turn * float(full.b[0]), "se": float(full.se[0])}


def leave_one_out(y: np.ndarray, v: np.ndarray, how: str = "REML", test: str = "z") -> list[Fit]:
    """Fits without each study; Knapp-Hartung falls back to Wald where too few are left."""
    keep = lambda i: np.arange(len(y)) != i
    return [fit(y[keep(i)], v[keep(i)], how=how, test=test if len(y) > 2 else "z") for i in range(len(y))]


def cumulative(y: np.ndarray, v: np.ndarray, how: str = "REML", test: str = "z") -> list[Fit]:
    return [fit(y[:i], v[:i], how=how if i > 1 else "CE", test=test if i > 2 else "z") for i in range(1, len(y) + 1)]


def influence(y: np.ndarray, v: np.ndarray, how: str = "REML") -> list[dict[str, float]]:
    """Studentised deleted residual, DFFITS, Cook's distance, covariance ratio, deleted tau2 and Q, leverage, weight, DFBETAS, flag."""
    whole = fit(y, v, how=how)
    w = 1 / (v + whole.tau2)
    hat = w / w.sum()
    out = []
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        f = fit(y[rest], v[rest], how=how)
        var = v[i] + f.vb[0, 0] + f.tau2
        shift = float(whole.b[0] - f.b[0])
        r = float((y[i] - f.b[0]) / math.sqrt(var))
        dffits = shift / math.sqrt(hat[i] * (f.tau2 + v[i])) if hat[i] > 0 else 0.0
        cook, cov = shift * shift / whole.vb[0, 0], f.vb[0, 0] / whole.vb[0, 0]
        # the scale is the variance that all studies would give at the tau2 found without this one
        dfb = shift * math.sqrt((1 / (v + f.tau2)).sum())
        flag = abs(r) > 1.96 or cook > 0.45 or hat[i] > 3 / len(y)
        out.append({"rstudent": r, "dffits": dffits, "cook": cook, "cov_ratio": cov, "tau2_del": f.tau2, "q_del": f.q, "hat": float(hat[i]), "weight": float(100 * hat[i]), "dfbetas": dfb, "flag": float(flag)})
    return out
