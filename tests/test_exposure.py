"""The integral's own error estimate, against a fine reference rule and at extreme spreads."""

import math

import numpy as np
import pytest
from numpy.polynomial import legendre

from vitalframe.plans import exposure


@pytest.mark.parametrize("n", [2, 8, 16, 32])
def test_rule_is_exact_for_polynomials(n):
    x, w = exposure.clenshaw_curtis(n)
    assert all((x ** k) @ w == pytest.approx(1 / (k + 1), rel=1e-12) for k in range(n + 1))
    assert np.allclose(exposure.clenshaw_curtis(2 * n)[0][::2], x)  # nested


def reference(m, s, rm, cap, t, lo, hi, prot):
    """Gauss-Legendre on 4,000 panels of the score axis between the kinks."""
    v = 1 + s * s / (m * m)
    mu, sig = math.log(m / math.sqrt(v)), math.sqrt(math.log(v))
    reach = math.log(cap) / math.log(rm)

    def score(x):
        return (math.log(x) - mu) / sig if x > 0 else -12.0

    cuts = sorted({min(max(score(x), -12.0), 12.0) for x in (lo, hi, t, t - reach, t + reach)} | {-12.0, 12.0})
    a, b = max(score(lo), -12.0), min(score(hi), 12.0)
    node, weight = legendre.leggauss(10)
    total = 0.0
    for u, w in zip(cuts, cuts[1:], strict=False):
        u, w = max(u, a), min(w, b)
        if w > u:
            edge = np.linspace(u, w, 1001)
            z = (edge[:-1, None] + (edge[1:] - edge[:-1])[:, None] * (node + 1) / 2).ravel()
            x = np.exp(mu + sig * z)
            dist = t - x if prot else x - t
            rr = np.where(dist > 0, np.exp(np.minimum(dist * math.log(rm), math.log(cap))), 1.0)
            y = rr * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            total += float(y @ np.tile(weight / 2, 1000) * (w - u) / 1000)
    return total


def test_extreme_spreads_meet_the_tolerance():
    rows = [(m, s, rm, cap, t, 0.0, 100.0, prot) for m in (0.5, 20.0, 60.0) for s in (0.01, 1.0, 30.0, 5000.0)
            for rm, cap in ((1.01, 1.5), (1.8, 40.0), (3.0, 1e6)) for t in (0.0, 20.0) for prot in (False, True)]
    cols = [np.array(c, float) for c in list(zip(*rows, strict=True))[:7]]
    prot = np.array([r[7] for r in rows])
    for tolerance in (exposure.TOLERANCE, 1.49e-6):
        value, error, done = exposure.curve_integral(*cols, prot, tolerance=tolerance)
        assert done.all()
        for r, v, e in zip(rows, value, error, strict=True):
            exact = reference(*r)
            assert abs(v - exact) <= max(e, 1e-9 * max(1.0, exact)) * 1.01, r
            assert abs(v - exact) <= 1.49e-6 * max(1.0, exact)


def test_rows_that_do_not_converge_are_marked():
    cols = [np.array([v]) for v in (20.0, 5.0, 1.5, 40.0, 3.0, 0.0, 100.0)]
    value, error, done = exposure.curve_integral(*cols, np.array([False]), tolerance=1e-18, halvings=1)
    assert not done[0] and error[0] > 0 and np.isfinite(value[0])
    bad = exposure.curve_integral(*[np.array([v]) for v in (20.0, np.nan, 1.5, 40.0, 3.0, 0.0, 100.0)], np.array([False]))
    assert np.isnan(bad[0][0]) and not bad[2][0]
