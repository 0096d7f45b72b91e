"""Special functions for the few scalars computed from small aggregates
(p-values, critical values).  numpy-vectorised so they also serve inside
pandas UDFs; no scipy in the environment."""

from __future__ import annotations

import math

import numpy as np


def _betacf(a, b, x, iters: int = 300, eps: float = 1e-15):
    """Continued fraction for the incomplete beta (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float),
                                  np.asarray(x, float))
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < eps):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float),
                                  np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    lg = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore", invalid="ignore"):
        lbt = (lg(a + b) - lg(a) - lg(b) + a * np.log(np.where(x > 0, x, 1.0)) +
               b * np.log(np.where(x < 1, 1.0 - x, 1.0)))
        bt = np.where((x == 0) | (x == 1), 0.0, np.exp(lbt))
        front = x < (a + 1.0) / (a + b + 2.0)
        cf1 = _betacf(a, b, x)
        cf2 = _betacf(b, a, 1.0 - x)
        val = np.where(front, bt * cf1 / a, 1.0 - bt * cf2 / b)
    val = np.where(x == 0, 0.0, np.where(x == 1, 1.0, val))
    out[ok] = val[ok]
    return out if out.ndim else float(out)


def t_two_sided_p(t, df):
    """Two-sided p-value of Student's t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_critical(alpha: float, df: float) -> float:
    """|t| whose two-sided p-value is ``alpha`` (bisection on the CDF)."""
    lo, hi = 0.0, 1.0
    while float(t_two_sided_p(hi, df)) > alpha:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if float(t_two_sided_p(mid, df)) > alpha:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)
