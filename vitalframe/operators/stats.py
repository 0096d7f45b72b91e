"""Table-level statistics (M1, M2, M3, M4, M5, M6, M14, W3 fit, X9).

Every fit is a grouped aggregation of sufficient statistics on the
executors (map-side partial sums, one row per group after the shuffle);
only the tiny per-group p x p solve runs in Python, inside
``applyInPandas`` over the statistics table, never on the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import randoms, special


def ols_simple(df: DataFrame, y: str, x: str, by=()) -> DataFrame:
    """M1: one-predictor OLS per group: slope, intercept, R^2, n."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def sufficient_stats(df: DataFrame, y: str, xs, by=()) -> DataFrame:
    """Per-group n, means, and the covariance matrix of (x..., y).

    Built from ``avg`` / ``covar_pop`` / ``var_pop``: one pass, mergeable
    partial aggregates, numerically stable (no raw sums of squares, which
    lose all precision at 10^12 rows).  Rows with a null response or
    predictor are left out of the fit.
    """
    d = df.where(F.col(y).isNotNull())
    for x in xs:
        d = d.where(F.col(x).isNotNull())
    cols = [F.count("*").alias("n"), F.avg(y).alias("m_y"), F.var_pop(y).alias("v_y")]
    for i, a in enumerate(xs):
        cols.append(F.avg(a).alias(f"m_{i}"))
        cols.append(F.covar_pop(a, y).alias(f"cy_{i}"))
        for j in range(i, len(xs)):
            cols.append(F.covar_pop(a, xs[j]).alias(f"c_{i}_{j}"))
    return d.groupBy(*by).agg(*cols)


def _solve_rows(pdf: pd.DataFrame, by, xs) -> pd.DataFrame:
    k = len(xs)
    p = k + 1
    out = []
    for _, r in pdf.iterrows():
        n = float(r["n"])
        sxx = np.empty((k, k))
        for i in range(k):
            for j in range(i, k):
                sxx[i, j] = sxx[j, i] = r[f"c_{i}_{j}"]
        sxy = np.array([r[f"cy_{i}"] for i in range(k)])
        mx = np.array([r[f"m_{i}"] for i in range(k)])
        try:
            inv = np.linalg.inv(sxx)
        except np.linalg.LinAlgError:
            inv = np.linalg.pinv(sxx)
        slope = inv @ sxy
        b0 = r["m_y"] - slope @ mx
        beta = np.concatenate([[b0], slope])
        rss = max(n * (r["v_y"] - slope @ sxy), 0.0)
        r2 = 1.0 - rss / (n * r["v_y"]) if r["v_y"] > 0 else np.nan
        dof = n - p
        sigma2 = rss / dof if dof > 0 else np.nan
        # (X'X)^-1 with the intercept, from the centred blocks
        xtx_inv = np.empty((p, p))
        xtx_inv[1:, 1:] = inv / n
        xtx_inv[0, 1:] = xtx_inv[1:, 0] = -(inv @ mx) / n
        xtx_inv[0, 0] = 1.0 / n + mx @ inv @ mx / n
        vcov = sigma2 * xtx_inv
        se = np.sqrt(np.diag(vcov))
        with np.errstate(divide="ignore", invalid="ignore"):
            tval = beta / se
        pval = special.t_two_sided_p(tval, dof) if dof > 0 else np.full(p, np.nan)
        for t_i, term in enumerate(["intercept"] + list(xs)):
            row = {b: r[b] for b in by}
            row.update(term=term, estimate=float(beta[t_i]), std_error=float(se[t_i]),
                       t_value=float(tval[t_i]), p_value=float(pval[t_i]),
                       vcov=[float(v) for v in vcov[t_i]], n=int(n), sigma2=float(sigma2),
                       r2=float(r2))
            out.append(row)
    return pd.DataFrame(out)


def ols_grouped(df: DataFrame, y: str, xs, by=()) -> DataFrame:
    """M3: OLS with several predictors per group.

    Returns one row per (group, term): estimate, std_error, t, p, the
    covariance row, n, sigma^2 and the fit's R^2.  The rows are reduced to sufficient
    statistics on the executors; each group's p x p solve runs in
    ``applyInPandas`` on its one statistics row.
    """
    by = list(by)
    stats = sufficient_stats(df, y, xs, by)
    terms = list(xs)
    key_fields = [f for f in stats.schema.fields if f.name in by]
    schema = T.StructType(key_fields + [
        T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType()),
        T.StructField("std_error", T.DoubleType()), T.StructField("t_value", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
        T.StructField("vcov", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.LongType()), T.StructField("sigma2", T.DoubleType()),
        T.StructField("r2", T.DoubleType())])
    if not by:
        stats = stats.withColumn("__g", F.lit(0))
        schema_g = T.StructType([T.StructField("__g", T.IntegerType())] + schema.fields)
        res = stats.groupBy("__g").applyInPandas(
            lambda pdf: _solve_rows(pdf, ["__g"], terms), schema_g)
        return res.drop("__g")
    return stats.groupBy(*by).applyInPandas(lambda pdf: _solve_rows(pdf, by, terms), schema)


def predict(df: DataFrame, coefs: DataFrame, y: str, xs, by=(),
            pred: str = "pred", resid: str = "resid") -> DataFrame:
    """M3: predictions and residuals for all rows (null response -> null
    residual; rows of a group without a fit stay, with null predictions) by
    joining the per-group coefficients back."""
    by = list(by)
    terms = ["intercept"] + list(xs)
    if not by:  # one fit: its p coefficients become literals (no join)
        est = {r["term"]: r["estimate"] for r in coefs.select("term", "estimate").collect()}
        j = df.withColumns({f"__b_{t}": F.lit(float(est[t])) for t in terms})
    else:
        wide = coefs.groupBy(*by).pivot("term", terms).agg(F.first("estimate"))
        wide = wide.withColumnsRenamed({t: f"__b_{t}" for t in terms})
        j = df.join(wide, by, "left")
    p = F.col("__b_intercept")
    for x in xs:
        p = p + F.col(f"__b_{x}") * F.col(x)
    j = j.withColumn(pred, p).withColumn(resid, F.col(y) - F.col(pred))
    return j.drop(*[f"__b_{t}" for t in ["intercept"] + list(xs)])


def two_sample_stats(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """M4: pooled two-sample t statistic (nulls dropped): one row with
    n1, n2, mean1, mean2, t, df."""
    return _two_sample(df, value, group, a, b).drop("pooled_sd")


def _two_sample(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """The same with the standard deviation pooled within the groups."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isin([a, b]))
    g = d.groupBy().agg(
        F.count(F.when(F.col(group) == a, 1)).alias("n1"),
        F.count(F.when(F.col(group) == b, 1)).alias("n2"),
        F.avg(F.when(F.col(group) == a, F.col(value))).alias("mean1"),
        F.avg(F.when(F.col(group) == b, F.col(value))).alias("mean2"),
        F.var_samp(F.when(F.col(group) == a, F.col(value))).alias("var1"),
        F.var_samp(F.when(F.col(group) == b, F.col(value))).alias("var2"))
    sp2 = (((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) /
           (F.col("n1") + F.col("n2") - 2))
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(sp2 * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    return g.select("n1", "n2", "mean1", "mean2", t.alias("t"),
                    (F.col("n1") + F.col("n2") - 2).alias("df"), F.sqrt(sp2).alias("pooled_sd"))


def t_test(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """M4: pooled two-sample t-test with its two-sided p-value (X9), a number
    computed from the one aggregated row."""
    s = two_sample_stats(df, value, group, a, b)
    r = s.first()
    p = None if r["t"] is None else float(special.t_two_sided_p(r["t"], float(r["df"])))
    return df.sparkSession.createDataFrame([(*r, p)], T.StructType([*s.schema.fields,
                                                                    T.StructField("p_value", T.DoubleType())]))


def bootstrap_power(n1: int, n2: int, mean1: float, mean2: float, sd: float,
                    spark, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0,
                    method: str = "literal") -> DataFrame:
    """M5: parametric bootstrap power of the pooled t-test.

    ``n_boot`` samples of two normal groups (sizes n1, n2, common sd); the
    share of samples with p < alpha.  Normals come from hashes of
    (boot, group, i), so the result does not depend on partitioning.

    ``method='literal'``: n_boot x (n1 + n2) rows generated with ``range``
    and ``explode`` (distributed), one grouped aggregate per boot.
    ``method='moments'``: per replicate, each group's sample mean is drawn as
    Normal(mu, sd^2 / n) and its sample variance as sd^2 chi2(n-1) / (n-1), which
    are their exact distributions: O(n_boot) work whatever n is (group sizes taken
    from a 100 TB table would otherwise mean 10^12 rows per replicate).  The
    method is the caller's choice and never depends on the size.
    """
    tcrit = special.t_critical(alpha, n1 + n2 - 2)
    if method == "moments":
        return _bootstrap_moments(n1, n2, mean1, mean2, sd, spark, n_boot, tcrit, seed)
    if method != "literal":
        raise ValueError(f"method must be 'literal' or 'moments', got {method!r}")
    n_max = max(n1, n2)
    rows = (spark.range(n_boot).withColumnRenamed("id", "boot")
                 .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_max - 1))))
                 .withColumn("grp", F.explode(F.array(F.lit(1), F.lit(2))))
                 .where(((F.col("grp") == 1) & (F.col("i") < n1)) |
                        ((F.col("grp") == 2) & (F.col("i") < n2))))
    z = randoms.hash_normal("boot", "grp", "i", seed=seed)
    mu = F.when(F.col("grp") == 1, F.lit(mean1)).otherwise(F.lit(mean2))
    rows = rows.withColumn("v", mu + F.lit(sd) * z)
    per = rows.groupBy("boot").agg(
        F.avg(F.when(F.col("grp") == 1, F.col("v"))).alias("m1"),
        F.avg(F.when(F.col("grp") == 2, F.col("v"))).alias("m2"),
        F.var_samp(F.when(F.col("grp") == 1, F.col("v"))).alias("v1"),
        F.var_samp(F.when(F.col("grp") == 2, F.col("v"))).alias("v2"))
    sp2 = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)
    t = (F.col("m1") - F.col("m2")) / F.sqrt(sp2 * (1.0 / n1 + 1.0 / n2))
    return per.agg(F.avg((F.abs(t) > tcrit).cast("double")).alias("power"),
                   F.count("*").alias("n_boot"))


def _bootstrap_moments(n1, n2, mean1, mean2, sd, spark, n_boot, tcrit, seed):
    b = spark.range(n_boot).withColumnRenamed("id", "boot")
    z = [randoms.hash_normal("boot", seed=seed, stream=k) for k in range(2)]
    chi = [randoms.exact_chi2(randoms.row_seed("boot", F.lit(g), seed=seed), F.lit(float(n - 1)))
           for g, n in ((1, n1), (2, n2))]
    m1 = F.lit(mean1) + F.lit(sd / n1 ** 0.5) * z[0]
    m2 = F.lit(mean2) + F.lit(sd / n2 ** 0.5) * z[1]
    v1 = F.lit(sd * sd / (n1 - 1)) * chi[0]
    v2 = F.lit(sd * sd / (n2 - 1)) * chi[1]
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    t = (m1 - m2) / F.sqrt(sp2 * (1.0 / n1 + 1.0 / n2))
    return b.agg(F.avg((F.abs(t) > tcrit).cast("double")).alias("power"),
                 F.count("*").alias("n_boot"))


def poisson_means(spark, lam_df: DataFrame, lam: str, sizes, reps: int = 1000,
                  seed: int = 0, by=(), method: str = "literal") -> DataFrame:
    """M6: sampling distribution of the mean of n Poisson(lam) draws.

    ``sizes`` are ints or names of columns of ``lam_df`` holding a per-group
    sample size.  One row per (group, n, rep) with the sample mean.
    ``method='literal'`` generates the n draws (hash Poisson by inverse CDF) and
    averages them; ``method='totals'`` draws the sample's total, which is exactly
    Poisson(n lam), in O(reps) work whatever n is.  The method is the caller's
    choice and never depends on the size.
    """
    if method not in ("literal", "totals"):
        raise ValueError(f"method must be 'literal' or 'totals', got {method!r}")
    by = list(by)
    size_cols = [s for s in sizes if isinstance(s, str)]
    base = lam_df.select(*by, F.col(lam).alias("lam"), *size_cols)
    base = base.withColumn("n", F.explode(F.array(
        *[F.col(s).cast("int") if isinstance(s, str) else F.lit(int(s)) for s in sizes])))
    base = base.drop(*size_cols)
    base = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    if method == "totals":
        total = randoms.exact_poisson(randoms.row_seed(*by, "n", "rep", seed=seed), F.col("n") * F.col("lam"))
        return base.select(*by, "lam", "n", "rep", (total / F.col("n")).alias("mean"))
    each = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    draw = randoms.hash_poisson(F.col("lam"), *by, "n", "rep", "i", seed=seed)
    return each.withColumn("x", draw).groupBy(*by, "lam", "n", "rep").agg(F.avg("x").alias("mean"))


def standardize(df: DataFrame, columns) -> DataFrame:
    """Z-scores with the population sd (pandas/numpy ``std(ddof=0)``)."""
    st = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns],
                *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns]).first()
    return df.withColumns({f"z_{c}": (F.col(c) - F.lit(st[f"__m_{c}"])) /
                           F.lit(st[f"__s_{c}"]) for c in columns})
