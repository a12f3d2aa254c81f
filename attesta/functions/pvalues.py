"""Tail probabilities of the chi-squared, Student and binomial families, and false-discovery control.

The tails are computed directly, never as one minus a distribution function, so they stay exact down to underflow.
"""

from __future__ import annotations

import math

_TINY = 1e-300
_EPS = 1e-15


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a)) if a * math.log(x) - x - math.lgamma(a) > -745 else 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > _EPS * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return scale * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return h


def beta_regularized(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(log_front) if log_front > -745 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi2_tail(statistic: float, dof: int) -> float:
    """P(chi-squared with dof degrees of freedom >= statistic)."""
    return gamma_upper(dof / 2, statistic / 2)


def spearman_tail(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation of n pairs, by Student's t with n - 2 degrees of freedom."""
    if abs(rho) >= 1:
        return 0.0
    dof = n - 2
    t2 = rho * rho * dof / ((1 + rho) * (1 - rho))
    return beta_regularized(dof / 2, 0.5, dof / (dof + t2))


def benjamini_hochberg(p_values: list[float], alpha: float) -> list[bool]:
    """Which hypotheses are rejected at false-discovery rate alpha."""
    m = len(p_values)
    order = sorted(range(m), key=lambda i: p_values[i])
    last = max((rank for rank, i in enumerate(order, 1) if p_values[i] <= alpha * rank / m), default=0)
    chosen = set(order[:last])
    return [i in chosen for i in range(m)]
