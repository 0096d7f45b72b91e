"""Attributable-fraction arithmetic as column expressions.

All divisions use ``try_divide`` so a zero denominator gives null rather than
an ANSI error (the reference got ``inf`` there; null is then dropped or
filled by the caller, as the reference's ``dropna`` did).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def scalar_from_sev(sev, rrmax) -> Column:
    """``scalar = sev * (rrmax - 1) + 1``."""
    return _c(sev) * (_c(rrmax) - F.lit(1.0)) + F.lit(1.0)


def paf_from_scalar(scalar) -> Column:
    """``paf = 1 - 1 / scalar``; null when scalar is 0."""
    return F.lit(1.0) - F.try_divide(F.lit(1.0), _c(scalar))


def scalar_from_paf(paf) -> Column:
    """``scalar = 1 / (1 - paf)``; null when paf is exactly 1."""
    return F.try_divide(F.lit(1.0), F.lit(1.0) - _c(paf))


def clamp_rr_below_one(rr, replacement: float = 1.001) -> Column:
    """Relative risks below 1 become ``replacement``."""
    return F.when(_c(rr) < 1, F.lit(replacement)).otherwise(_c(rr))


def bound_zero_one(paf, one_to: float = 0.9999) -> Column:
    """P13 quirk kept on purpose: only an exact 1 is replaced."""
    return F.when(_c(paf) == 1, F.lit(one_to)).otherwise(_c(paf))


def cap_above(x, cap: float = 0.9999) -> Column:
    """Values above ``cap`` become ``cap``; null stays null."""
    return F.when(_c(x) > cap, F.lit(cap)).otherwise(_c(x))


def clip(x, lo: float, hi: float) -> Column:
    """Clamp into [lo, hi]; null stays null (``least`` would skip it)."""
    c = _c(x)
    return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)


def sev_above(sev, threshold: float = 0.99) -> Column:
    """Boolean flag ``sev > threshold`` as a native expression."""
    return _c(sev) > F.lit(threshold)
