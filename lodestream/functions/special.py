"""Tail probabilities that Spark has no function for, on numpy arrays of one number a group."""

from __future__ import annotations

import math

import numpy as np


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified method of Lentz."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Probability of |T| >= |t| for Student's T."""
    return np.array([float("nan") if x != x or n != n or n <= 0 else beta_share(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, dof, strict=True)])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(x) / math.sqrt(2)) if x == x else float("nan") for x in z])
