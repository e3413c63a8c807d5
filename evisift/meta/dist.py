"""Distribution functions without SciPy: regularised incomplete gamma and beta by series and continued fractions."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_N = NormalDist()
TINY = 1e-300


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def two_sided_z(z: float) -> float:
    return 2 * norm_sf(abs(z))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    # Lentz's algorithm for the upper function
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2) if x > 0 else 1.0


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > TINY else TINY)
            c = 1 + num / c
            c = c if abs(c) > TINY else TINY
            step = c * d
            h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t > 0 else 1 - tail


def two_sided_t(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def root(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-13) -> float:
    """A zero of a monotone function between two bounds, by bisection with secant steps."""
    a, b, fa, fb = lo, hi, f(lo), f(hi)
    if fa == 0:
        return a
    for k in range(300):
        m = b - fb * (b - a) / (fb - fa) if k % 2 and fb != fa else (a + b) / 2
        if not min(a, b) < m < max(a, b):
            m = (a + b) / 2
        fm = f(m)
        if fm == 0 or abs(b - a) < tol * max(1.0, abs(m)):
            return m
        if (fm < 0) == (fa < 0):
            a, fa = m, fm
        else:
            b, fb = m, fm
    return (a + b) / 2


def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    hi = 1.0
    while 1 - t_sf(hi, df) < max(p, 1 - p):
        hi *= 2
    x = root(lambda t: 1 - t_sf(t, df) - max(p, 1 - p), 0.0, hi)
    return x if p > 0.5 else -x


def chi2_ppf(p: float, df: float) -> float:
    hi = max(df, 1.0)
    while 1 - chi2_sf(hi, df) < p:
        hi *= 2
    return root(lambda x: 1 - chi2_sf(x, df) - p, 0.0, hi)


def kendall_exact_p(concordance: int, n: int) -> float:
    """Two-sided probability of an absolute score at least this large among permutations without ties."""
    counts = [1]
    for k in range(2, n + 1):
        new = [0] * (len(counts) + k - 1)
        for i, c in enumerate(counts):
            for j in range(k):
                new[i + j] += c
        counts = new
    pairs, total = n * (n - 1) // 2, math.factorial(n)
    inversions = (pairs - abs(concordance)) // 2
    return min(1.0, 2 * sum(counts[: inversions + 1]) / total)
