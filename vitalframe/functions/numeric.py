"""Numeric column expressions: transforms, rounding, densities, distances."""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def safe_ln(x) -> Column:
    """Natural log, null for x <= 0 (R gives -Inf / NaN there)."""
    c = _c(x)
    return F.when(c > 0, F.log(c))


def signif(x, digits: int = 5) -> Column:
    """Round to ``digits`` significant digits (R ``signif``); 0 -> 0."""
    c = _c(x)
    e = F.floor(F.log10(F.abs(c))) - F.lit(digits - 1)
    # divide by an exact power of ten on both branches (10^-k is inexact)
    up = F.round(c * F.pow(F.lit(10.0), -e)) / F.pow(F.lit(10.0), -e)
    down = F.round(c / F.pow(F.lit(10.0), e)) * F.pow(F.lit(10.0), e)
    return F.when(c == 0, F.lit(0.0)).when(e < 0, up).otherwise(down)


def decade(year) -> Column:
    """Floor to the decade."""
    return (F.floor(_c(year) / 10) * 10).cast("int")


def logit(p) -> Column:
    c = _c(p)
    return F.log(c / (F.lit(1.0) - c))


def ratio(num, den) -> Column:
    """``num * 1.0 / den``, null on a zero denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def poisson_pmf(lam, k) -> Column:
    """``lam^k e^-lam / k!`` in log space (exact for any k, no 20! limit)."""
    lam, k = _c(lam), _c(k)
    log_fact = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                           F.lit(0.0), lambda acc, j: acc + F.log(j))
    return F.exp(k * F.log(lam) - lam - log_fact)


EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """X7 (sphere): great-circle distance in km."""
    r = math.pi / 180.0
    p1, p2 = _c(lat1) * r, _c(lat2) * r
    dp = (_c(lat2) - _c(lat1)) * r
    dl = (_c(lng2) - _c(lng1)) * r
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


# WGS-84 ellipsoid (semi-major axis in km, flattening).
WGS84_A_KM = 6378.137
WGS84_F = 1 / 298.257223563


def vincenty_km(lat1, lng1, lat2, lng2, iterations: int = 100):
    """Vincenty's inverse formula on numpy arrays, in km.

    Steps until no row moves by more than 1e-14; a row that still moves by over
    1e-12 after ``iterations`` steps (nearly antipodal points, where the series does
    not converge) is NaN.
    """
    import numpy as np
    a, f = WGS84_A_KM, WGS84_F
    b = (1 - f) * a
    u1 = np.arctan((1 - f) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - f) * np.tan(np.radians(lat2)))
    lam0 = np.radians(lng2) - np.radians(lng1)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    def terms(lam):
        ss = np.hypot(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))
        cs = su1 * su2 + cu1 * cu2 * np.cos(lam)
        sa = np.divide(cu1 * cu2 * np.sin(lam), ss, out=np.zeros_like(ss), where=ss != 0)
        c2a = 1.0 - sa * sa
        c2m = cs - np.divide(2 * su1 * su2, c2a, out=cs.copy(), where=c2a != 0)
        return ss, cs, np.arctan2(ss, cs), sa, c2a, c2m

    lam, moved = lam0, np.full_like(lam0, np.inf)
    for _ in range(iterations):
        ss, cs, sig, sa, c2a, c2m = terms(lam)
        c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        new = lam0 + (1 - c) * f * sa * (sig + c * ss * (c2m + c * cs * (-1 + 2 * c2m * c2m)))
        moved, lam = np.abs(new - lam), new
        if not (moved > 1e-14).any():
            break
    ss, cs, sig, sa, c2a, c2m = terms(lam)
    u = c2a * (a * a - b * b) / (b * b)
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    d = big_b * ss * (c2m + big_b / 4 * (
        cs * (-1 + 2 * c2m * c2m) - big_b / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))
    return np.where(moved > 1e-12, np.nan, np.where(ss == 0, 0.0, b * big_a * (sig - d)))


@F.pandas_udf(T.DoubleType())
def _vincenty(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.Series:
    return pd.Series(vincenty_km(*(x.to_numpy(dtype=float, na_value=float("nan")) for x in (lat1, lng1, lat2, lng2))))


def add_vincenty_km(df, lat1, lng1, lat2, lng2, out: str = "distance_km"):
    """X7 (ellipsoid): Vincenty distance, null where a coordinate is null or the
    series does not converge.  The iteration is a numpy kernel over Arrow batches
    that stops on convergence (under ten steps for ordinary points); as a JVM lambda
    it would be interpreted for a fixed number of steps."""
    return df.withColumn(out, _vincenty(*[_c(x).cast("double") for x in (lat1, lng1, lat2, lng2)]))


def lognormal_params(mean, sd):
    """(mu, sigma) of a lognormal with the given arithmetic mean and sd."""
    m, s = _c(mean), _c(sd)
    v = F.lit(1.0) + F.pow(s, 2) / F.pow(m, 2)
    return F.log(m / F.sqrt(v)), F.sqrt(F.log(v))


def lognormal_pdf(x, mean, sd, pi_value: float = math.pi) -> Column:
    """Lognormal density at x; ``pi_value=3.14`` reproduces the legacy
    constant of the original C routine."""
    mu, sigma = lognormal_params(mean, sd)
    xx = _c(x)
    return (F.lit(1.0) / (xx * sigma * F.lit(math.sqrt(2 * pi_value))) *
            F.exp(-F.pow(F.log(xx) - mu, 2) / (2 * F.pow(sigma, 2))))


def relative_risk(x, rr_mean, rr_max, tmrel, protective) -> Column:
    """Log-linear RR curve capped at rr_max on the harmful side, else 1.

    ``protective`` true: harm grows as x falls below tmrel; false: as x
    rises above it.
    """
    xx, rm, cap, t = _c(x), _c(rr_mean), _c(rr_max), _c(tmrel)
    dist = F.when(_c(protective), t - xx).otherwise(xx - t)
    curve = F.pow(rm, dist)
    return F.when(dist > 0, F.when(curve < cap, curve).otherwise(cap)) \
            .otherwise(F.lit(1.0))
