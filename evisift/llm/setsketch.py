"""SetSketch registers of text, vectorised over a batch, and the joint likelihood estimate of two sketches.

A set is sketched in ``REGISTERS`` registers: every element draws an exponential value per register, a register keeps
the smallest one on an exponential scale, ``K = floor(1 - log_b(h))``, truncated to one byte. Registers of a union are the
maxima of registers, so sketches merge; equal registers are as likely as the sets are alike, so values can be banded.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 32
BASE = 1.1
SHIFT = 40
GRAM = 4
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of the distinct character grams of each text's words; grams do not cross words. Rows ascend.

    texts: words of letters and digits of any script with single spaces between. A text without a gram has no element.
    """
    lines = "".join(f" {t} \n" for t in texts) + "\n\n\n"
    # code points where one byte a letter does not do; grams of ASCII letters are the same numbers in both
    buf = np.frombuffer(lines.encode("ascii"), dtype=np.uint8) if lines.isascii() else np.frombuffer(lines.encode("utf-32-le", "replace"), dtype=np.uint32)
    row = np.cumsum(buf == 10)[: -GRAM + 1]
    n = len(row)
    parts = [buf[k : n + k] for k in range(GRAM)]
    inner = np.ones(n, bool)
    for p in parts[1:-1]:
        inner &= p > 32
    inner &= (parts[0] != 10) & (parts[-1] != 10)
    gram = sum(p[inner].astype(np.uint64) << np.uint64(8 * k) for k, p in enumerate(parts))
    both = np.sort((row[inner].astype(np.uint64) << np.uint64(32)) | (gram & np.uint64(0xFFFFFFFF)))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)


def sketches(row: np.ndarray, element: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Registers (rows x REGISTERS, uint8) and set sizes. The sketch of an empty set is all zeros."""
    size = np.bincount(row, minlength=rows)
    out = np.zeros((rows, REGISTERS), np.uint8)
    has = np.flatnonzero(size)
    if len(has):
        start = np.concatenate(([0], np.cumsum(size[has])[:-1]))
        h = (mix(element + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        for j in range(REGISTERS):
            low = np.minimum.reduceat(h * _MUL[j] + _ADD[j], start)
            u = (low.astype(np.float64) + 0.5) / 2.0**32
            k = np.floor(1 - np.log(-np.log1p(-u)) / np.log(BASE)) + SHIFT
            out[has, j] = np.clip(k, 1, 255).astype(np.uint8)
    return out, size


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 32) -> np.ndarray:
    """Size of the intersection of each pair of sets, of largest joint likelihood given registers and set sizes.

    The counts of registers in which one sketch is above, below or level with the other are multinomial with
    probabilities that depend on the Jaccard similarity; it is maximised over ``steps`` values of its range.
    """
    total = np.maximum(na + nb, 1).astype(float)
    u, v = na / total, nb / total
    up, down = (a > b).sum(1), (a < b).sum(1)
    level = a.shape[1] - up - down
    top = np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-9)
    j = np.linspace(0.0, 1.0, steps)[None, :] * top[:, None]
    scale = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * scale) / np.log(BASE)

    p1, p2 = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    like = up[:, None] * np.log(p1) + down[:, None] * np.log(p2) + level[:, None] * np.log(np.maximum(1 - p1 - p2, 1e-9))
    best = j[np.arange(len(j)), like.argmax(1)] if len(j) else np.zeros(0)
    return best / (1 + best) * total
