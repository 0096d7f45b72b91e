"""Exposure integral (T6 with X8).

``sev = (integral(RR(x) p(x) dx) - 1) / (rr_max - 1)`` and
``paf = 1 - 1 / (sev (rr_max - 1) + 1)`` per (row, draw).  The original
called an adaptive quadrature per draw through ctypes.  Here the integral is
taken in z = (ln x - mu) / sigma, where the density is the standard normal one
and nothing is singular at x = 0.  It is broken where the curve has a kink: at
``tmrel``, below (above) which RR is 1 and the integral is a difference of normal
distribution functions, and where the curve meets its cap.

Each smooth part starts as ``PANELS`` intervals.  An interval gets two nested
Clenshaw-Curtis rules of ``NODES`` and ``NODES`` / 2 steps, whose difference is its
error.  A work list of all intervals of a block of rows is evaluated at once in numpy;
those over their share of the tolerance are halved and go round again.  ``error`` is
the sum of a row's differences, and rows still above the tolerance after ``HALVINGS``
rounds are marked in ``converged``.  The tolerance is far below the original's
1.49e-06, so that rounded results don't depend on it.  Rows never leave their
partition (no explode, no shuffle).  The integrand itself is the X8 curve also
available as column expressions in ``functions.numeric``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = 2048            # rows per numpy block, to bound the intervals x nodes temporaries
PANELS, NODES = 4, 32    # intervals of a smooth part at first, steps of the finer rule
TOLERANCE = 1e-10        # of a row's integral, absolute below 1 and relative above
HALVINGS = 24
_Z = 12.0                # beyond this many sd the density is below 1e-32
_erfc = np.vectorize(math.erfc, otypes=[float])


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-z / math.sqrt(2.0))


def clenshaw_curtis(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in [0, 1], rising, and weights of the rule of n steps (n even)."""
    k, j = np.arange(n + 1), np.arange(1, n // 2 + 1)
    b = np.where(j == n // 2, 1.0, 2.0) / (4.0 * j * j - 1.0)
    w = 1.0 - (b * np.cos(2.0 * np.pi * np.outer(k, j) / n)).sum(axis=1)
    w *= np.where((k == 0) | (k == n), 1.0, 2.0) / n
    return (1.0 - np.cos(np.pi * k / n)) / 2, w / 2


def adaptive(f, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_rows: int, base: np.ndarray, tolerance: float,
             halvings: int) -> tuple[np.ndarray, np.ndarray]:
    """Integral and error per row of ``f(rows, points)`` over the intervals [lo, hi] of the rows named by ``row``.

    A row's tolerance is that of ``base`` plus its integral; an interval may use the share of its width.
    """
    x01, fine = clenshaw_curtis(NODES)
    _, coarse = clenshaw_curtis(NODES // 2)
    value, error = np.zeros(n_rows), np.zeros(n_rows)
    width = np.bincount(row, hi - lo, n_rows)
    allowed = None
    for turn in range(halvings + 1):
        if not len(row):
            break
        y = f(row, lo[:, None] + (hi - lo)[:, None] * x01)
        best = y @ fine * (hi - lo)
        err = np.abs(best - y[:, ::2] @ coarse * (hi - lo))
        if allowed is None:
            allowed = tolerance * np.maximum(1.0, np.abs(base + np.bincount(row, best, n_rows)))
        share = allowed[row] * (hi - lo) / width[row]
        # the rounding of the sums themselves is no reason to go on; nor is a value that isn't a number
        again = (err > share + 8 * np.finfo(float).eps * np.abs(best)) & (turn < halvings)
        value += np.bincount(row[~again], best[~again], n_rows)
        error += np.bincount(row[~again], err[~again], n_rows)
        row, lo, hi = row[again], lo[again], hi[again]
        mid = lo + (hi - lo) / 2
        row, lo, hi = np.concatenate([row, row]), np.concatenate([lo, mid]), np.concatenate([mid, hi])
    return value, error


def curve_integral(m, s, rm, cap, t, lo, hi, protective, pi_value: float = math.pi, tolerance: float = TOLERANCE,
                   halvings: int = HALVINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectorised integral of RR(x) * lognormal(x; m, s) over [lo, hi]: value, error estimate, converged."""
    out, err, done = np.empty(len(m)), np.empty(len(m)), np.empty(len(m), bool)
    for a in range(0, len(m), _BLOCK):
        b = slice(a, a + _BLOCK)
        mm, ss, r, c, tt, l, h, prot = (v[b] for v in (m, s, rm, cap, t, lo, hi, protective))
        with np.errstate(divide="ignore", invalid="ignore"):
            v = 1.0 + ss ** 2 / mm ** 2
            mu, sig = np.log(mm / np.sqrt(v)), np.sqrt(np.log(v))

            def z(x):
                return np.where(x > 0, np.clip((np.log(np.where(x > 0, x, 1.0)) - mu) / sig, -_Z, _Z), -_Z)

            # distance from tmrel at which the curve and its cap cross (none: at infinity)
            reach = np.log(c) / np.log(r)
        reach = np.where(np.isfinite(reach) & (reach > 0), reach, np.inf)
        kink = np.where(prot, tt - reach, tt + reach)
        one = np.where(prot, _normal_cdf(z(h)) - _normal_cdf(z(np.minimum(np.maximum(l, tt), h))),
                       _normal_cdf(z(np.maximum(np.minimum(h, tt), l))) - _normal_cdf(z(l)))
        near = (np.where(prot, np.maximum(l, kink), np.maximum(l, tt)), np.where(prot, np.minimum(h, tt), np.minimum(h, kink)))
        far = (np.where(prot, l, np.maximum(l, kink)), np.where(prot, np.minimum(h, kink), h))
        rows, starts, ends = [], [], []
        for x0, x1 in (near, far):
            z0, z1 = z(np.minimum(x0, x1)), z(x1)
            some = np.flatnonzero(~((x1 <= x0) | (z1 <= z0)))
            cut = np.linspace(0.0, 1.0, PANELS + 1)
            for p in range(PANELS):
                rows.append(some)
                starts.append(z0[some] + (z1 - z0)[some] * cut[p])
                ends.append(z0[some] + (z1 - z0)[some] * cut[p + 1])
        log_r, log_c = np.log(r), np.log(c)

        def density(i, zz):
            x = np.exp(mu[i, None] + sig[i, None] * zz)
            dist = np.where(prot[i, None], tt[i, None] - x, x - tt[i, None])
            return np.exp(np.minimum(dist * log_r[i, None], log_c[i, None]) - zz ** 2 / 2) / math.sqrt(2 * math.pi)

        with np.errstate(over="ignore", invalid="ignore"):
            value, error = adaptive(density, np.concatenate(rows), np.concatenate(starts), np.concatenate(ends), len(mm),
                                    one, tolerance, halvings)
        scale = math.sqrt(math.pi / pi_value)
        out[b], err[b] = (one + value) * scale, error * scale
        done[b] = error <= 2 * tolerance * np.maximum(1.0, np.abs(one + value))
    return out, err, done


def _integral_udf(pi_value: float, tolerance: float):
    @F.pandas_udf("integral double, error double, converged boolean")
    def integral(m: pd.Series, s: pd.Series, rm: pd.Series, cap: pd.Series, t: pd.Series,
                 lo: pd.Series, hi: pd.Series, flag: pd.Series) -> pd.DataFrame:
        arr = [v.to_numpy(dtype=float, na_value=np.nan) for v in (m, s, rm, cap, t, lo, hi)]
        prot = flag.to_numpy(dtype=float, na_value=0.0) == 1
        value, error, done = curve_integral(*arr, prot, pi_value, tolerance)
        return pd.DataFrame({"integral": value, "error": error, "converged": done})
    return integral


def sev_integral(df: DataFrame, pi_value: float = math.pi,
                 exp_mean: str = "exp_mean", exp_sd: str = "exp_sd",
                 rr_mean: str = "rr_mean", rr_max: str = "rr_max", tmrel: str = "tmrel",
                 lo: str = "integ_min", hi: str = "integ_max",
                 flag: str = "flag", tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``integral``, its ``error`` estimate, ``converged``, ``sev`` and ``paf`` (flag 1 = protective)."""
    f = _integral_udf(pi_value, tolerance)
    found = f(*[F.col(c).cast("double") for c in (exp_mean, exp_sd, rr_mean, rr_max, tmrel, lo, hi)], F.col(flag))
    df = df.withColumn("__i", found).select(
        *[F.col(c) for c in df.columns if c not in ("integral", "error", "converged")], "__i.*")
    den = F.col(rr_max) - F.lit(1.0)
    df = df.withColumn("sev", F.try_divide(F.col("integral") - F.lit(1.0), den))
    return df.withColumn("paf", F.lit(1.0) - F.try_divide(F.lit(1.0), F.col("sev") * den + 1))
