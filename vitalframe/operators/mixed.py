"""Linear mixed models with random intercepts (M9, M10) on Spark.

Rows are reduced on the executors to per-cell sufficient statistics, a cell
being one combination of the random-effect levels (one location for M9; one
age x region pair for M10).  One factor or two crossed ones are fitted as grouped
sums over the level tables (:mod:`.mixed_levels`), for any number of levels.  Three
or more crossed factors, of few levels, are fitted per model key in
``applyInPandas`` over the cell table using Henderson's mixed-model
equations: every matrix there is (p + number of levels) square, never N.

Model: y = X b + sum_k Z_k u_k + e, u_k ~ N(0, s_k^2 I), e ~ N(0, s_e^2 I).
Criterion: REML (``reml=True``, the default of the R fits) or ML.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixed_levels import fit_levels


def cell_stats(df: DataFrame, y: str, xs, groups, by=()) -> DataFrame:
    """n, sum x, sum xx', sum y, sum xy, sum y^2 per (model key, cell);
    the intercept is the constant 1 column.  Null rows are left out."""
    d = df.where(F.col(y).isNotNull())
    for x in xs:
        d = d.where(F.col(x).isNotNull())
    terms = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
    cols = [F.count("*").alias("n"), F.sum(F.col(y)).alias("sy"),
            F.sum(F.col(y) * F.col(y)).alias("syy")]
    for i, a in enumerate(terms):
        cols.append(F.sum(a).alias(f"sx_{i}"))
        cols.append(F.sum(a * F.col(y)).alias(f"sxy_{i}"))
        for j in range(i, len(terms)):
            cols.append(F.sum(a * terms[j]).alias(f"sxx_{i}_{j}"))
    return d.groupBy(*by, *groups).agg(*cols)


def _nelder_mead(f, x0, step=1.0, iters=400, tol=1e-10):
    n = len(x0)
    pts = [np.asarray(x0, float)]
    for i in range(n):
        p = np.array(x0, float)
        p[i] += step
        pts.append(p)
    vals = [f(p) for p in pts]
    for _ in range(iters):
        order = np.argsort(vals)
        pts = [pts[i] for i in order]
        vals = [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < tol:
            break
        c = np.mean(pts[:-1], axis=0)
        xr = c + (c - pts[-1])
        fr = f(xr)
        if fr < vals[0]:
            xe = c + 2 * (c - pts[-1])
            fe = f(xe)
            pts[-1], vals[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = xr, fr
        else:
            xc = c + 0.5 * (pts[-1] - c)
            fc = f(xc)
            if fc < vals[-1]:
                pts[-1], vals[-1] = xc, fc
            else:
                for i in range(1, n + 1):
                    pts[i] = pts[0] + 0.5 * (pts[i] - pts[0])
                    vals[i] = f(pts[i])
    i = int(np.argmin(vals))
    return pts[i], vals[i]


def _golden(f, lo=-20.0, hi=12.0, iters=120):
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(np.array([c])), f(np.array([d]))
    for _ in range(iters):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(np.array([c]))
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(np.array([d]))
    x = np.array([(a + b) / 2])
    return x, f(x)


def _fit_single(pdf: pd.DataFrame, p: int, group: str, reml: bool):
    """One random intercept: closed forms per level (Woodbury), O(q p^2)
    time and O(q) memory for q levels — no (p + q)^2 matrix."""
    pdf = pdf.groupby(group, sort=True).sum(numeric_only=True).reset_index() \
        if pdf[group].duplicated().any() else pdf.sort_values(group)
    n = pdf["n"].to_numpy(float)
    N = n.sum()
    sx = np.stack([pdf[f"sx_{i}"].to_numpy(float) for i in range(p)], axis=1)
    sxy = np.stack([pdf[f"sxy_{i}"].to_numpy(float) for i in range(p)], axis=1)
    sy = pdf["sy"].to_numpy(float)
    syy = pdf["syy"].to_numpy(float).sum()
    sxx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            sxx[i, j] = sxx[j, i] = pdf[f"sxx_{i}_{j}"].sum()
    xy = sxy.sum(axis=0)

    def parts(theta):
        lam = math.exp(theta[0])
        c = lam / (1.0 + n * lam)
        A = sxx - (sx * c[:, None]).T @ sx
        b = xy - (sx * (c * sy)[:, None]).sum(axis=0)
        yvy = syy - (c * sy * sy).sum()
        try:
            beta = np.linalg.solve(A, b)
        except np.linalg.LinAlgError:
            return None
        rss = yvy - b @ beta
        return lam, c, A, beta, rss, np.log1p(n * lam).sum()

    def crit(theta):
        r = parts(theta)
        if r is None or r[4] <= 0:
            return 1e300
        _lam, _c, A, _beta, rss, logdet_v = r
        if reml:
            return ((N - p) * math.log(rss / (N - p)) + logdet_v + np.linalg.slogdet(A)[1])
        return N * math.log(rss / N) + logdet_v

    theta, val = _golden(crit)
    lam, c, A, beta, rss, _ld = parts(theta)
    s2e = rss / ((N - p) if reml else N)
    vcov = s2e * np.linalg.inv(A)
    blup = c * (sy - sx @ beta)
    blups = {group: dict(zip(pdf[group].tolist(), blup))}
    return beta, vcov, s2e, {group: s2e * lam}, blups, val


def fit_cells(pdf: pd.DataFrame, p: int, groups, reml: bool = True, dense: bool = False):
    """Fit one model from its cell statistics (pandas, one model key).

    Returns (beta, vcov_beta, sigma_e2, sigma2 per group, blups dict, crit).
    One grouping factor uses the O(q) closed form; crossed factors solve
    Henderson's equations, whose size is p + (levels of all factors).
    """
    if len(groups) == 1 and not dense:
        return _fit_single(pdf, p, groups[0], reml)
    n = pdf["n"].to_numpy(float)
    N = n.sum()
    sx = np.stack([pdf[f"sx_{i}"].to_numpy(float) for i in range(p)], axis=1)
    sxy = np.stack([pdf[f"sxy_{i}"].to_numpy(float) for i in range(p)], axis=1)
    sy = pdf["sy"].to_numpy(float)
    syy = pdf["syy"].to_numpy(float).sum()
    sxx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            sxx[i, j] = sxx[j, i] = pdf[f"sxx_{i}_{j}"].sum()
    xy = sxy.sum(axis=0)
    levels, idx = [], []
    for g in groups:
        codes, uniq = pd.factorize(pdf[g], sort=True)
        levels.append(list(uniq))
        idx.append(codes)
    q_sizes = [len(l) for l in levels]
    q = sum(q_sizes)
    offs = np.cumsum([0] + q_sizes)
    # Z'Z, X'Z, Z'y from cells (a cell belongs to one level of each factor)
    ztz = np.zeros((q, q))
    xtz = np.zeros((p, q))
    zty = np.zeros(q)
    for k, codes in enumerate(idx):
        cols_k = offs[k] + codes
        np.add.at(zty, cols_k, sy)
        np.add.at(xtz.T, cols_k, sx)
        for m, codes_m in enumerate(idx):
            cols_m = offs[m] + codes_m
            np.add.at(ztz, (cols_k, cols_m), n)
    lhs0 = np.block([[sxx, xtz], [xtz.T, ztz]])
    rhs = np.concatenate([xy, zty])

    def solve(theta):
        ratios = np.exp(theta)
        dinv = np.concatenate([np.full(s, 1.0 / r) for s, r in zip(q_sizes, ratios)])
        C = lhs0.copy()
        C[p:, p:] += np.diag(dinv)
        try:
            sol = np.linalg.solve(C, rhs)
        except np.linalg.LinAlgError:
            return None
        rss = syy - sol @ rhs
        _s, logdet_zz = np.linalg.slogdet(ztz + np.diag(dinv))
        logdet_v = np.sum(np.log(1.0 / dinv)) + logdet_zz
        _s2, logdet_c = np.linalg.slogdet(C)
        return sol, rss, logdet_v, logdet_c - logdet_zz, C

    def crit(theta):
        r = solve(theta)
        if r is None:
            return 1e300
        _sol, rss, logdet_v, logdet_xvx, _C = r
        if rss <= 0:
            return 1e300
        if reml:
            s2 = rss / (N - p)
            return (N - p) * math.log(s2) + logdet_v + logdet_xvx
        s2 = rss / N
        return N * math.log(s2) + logdet_v

    if len(groups) == 1:
        theta, val = _golden(crit)
    else:
        theta, val = _nelder_mead(crit, np.zeros(len(groups)))
        theta, val = _nelder_mead(crit, theta, step=0.25)
    sol, rss, _ld, _lx, C = solve(theta)
    s2e = rss / ((N - p) if reml else N)
    cinv = np.linalg.inv(C)
    vcov = s2e * cinv[:p, :p]
    beta = sol[:p]
    blups = {g: dict(zip(levels[k], sol[p + offs[k]:p + offs[k + 1]]))
             for k, g in enumerate(groups)}
    sig = {g: s2e * math.exp(theta[k]) for k, g in enumerate(groups)}
    return beta, vcov, s2e, sig, blups, val


def mixed_model(df: DataFrame, y: str, xs, groups, by=(), reml: bool = True) -> DataFrame:
    """Fit ``y ~ xs + (1|g) for g in groups`` per model key ``by``.

    Output (long): kind = 'fixed' (term, estimate, vcov row), 'sigma2'
    (term = group name or 'residual', estimate = variance), 'blup'
    (term = group name, level as string, estimate).
    """
    by, groups = list(by), list(groups)
    p = len(xs) + 1
    stats = cell_stats(df, y, xs, groups, by)
    if len(groups) <= 2:
        return fit_levels(df, y, list(xs), groups, by, reml, stats)
    key_fields = [f for f in stats.schema.fields if f.name in by]
    schema = T.StructType(key_fields + [
        T.StructField("kind", T.StringType()), T.StructField("term", T.StringType()),
        T.StructField("level", T.StringType()), T.StructField("estimate", T.DoubleType()),
        T.StructField("vcov", T.ArrayType(T.DoubleType()))])
    terms = ["intercept"] + list(xs)

    def run(pdf):
        beta, vcov, s2e, sig, blups, _v = fit_cells(pdf, p, groups, reml)
        keys = {b: pdf[b].iloc[0] for b in by}
        rows = []
        for i, t in enumerate(terms):
            rows.append({**keys, "kind": "fixed", "term": t, "level": None,
                         "estimate": float(beta[i]), "vcov": [float(v) for v in vcov[i]]})
        rows.append({**keys, "kind": "sigma2", "term": "residual", "level": None,
                     "estimate": float(s2e), "vcov": None})
        for g in groups:
            rows.append({**keys, "kind": "sigma2", "term": g, "level": None,
                         "estimate": float(sig[g]), "vcov": None})
            for lv, val in blups[g].items():
                rows.append({**keys, "kind": "blup", "term": g, "level": str(lv),
                             "estimate": float(val), "vcov": None})
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    if not by:
        stats = stats.withColumn("__m", F.lit(0))
        sch = T.StructType([T.StructField("__m", T.IntegerType())] + schema.fields)
        return stats.groupBy("__m").applyInPandas(
            lambda pdf: run(pdf).assign(__m=0)[[f.name for f in sch.fields]], sch).drop("__m")
    return stats.groupBy(*by).applyInPandas(run, schema)
