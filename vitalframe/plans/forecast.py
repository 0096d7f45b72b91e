"""ASFR forecast with uncertainty (T11: M9, M11, M12, M13).

Fit one random-intercept model per age group on the training years, draw
fixed effects from MVN(beta, vcov), and predict every forecast row for every
draw with its level's BLUP.  Draws of the random intercept itself, Normal(BLUP,
sigma_u), are M12, used where a model asks for them.
Fixed-effect draws are one small table per model key (p x p Cholesky
computed per key in ``applyInPandas``); predictions are joins on
(model key, draw) and (model key, level, draw) — no row data on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import randoms
from ..operators import mixed


def coefficient_draws(fit: DataFrame, by, terms, n_draws: int, seed: int = 0) -> DataFrame:
    """(model key, draw, b_<term>...) from the 'fixed' rows of a fit;
    ``terms`` in model order (intercept first)."""
    by = list(by)
    fixed = fit.where(F.col("kind") == "fixed")
    terms = list(terms)
    order = {t: i for i, t in enumerate(terms)}
    key_fields = [f for f in fit.schema.fields if f.name in by]
    schema = T.StructType(key_fields + [T.StructField("term", T.StringType()),
                                        T.StructField("mean", T.DoubleType()),
                                        T.StructField("chol", T.ArrayType(T.DoubleType()))])

    def chol(pdf):
        pdf = pdf.assign(__o=pdf["term"].map(order)).sort_values("__o")
        idx = pdf["__o"].to_numpy()
        V = np.array([np.asarray(v, float)[idx] for v in pdf["vcov"]])
        V = (V + V.T) / 2
        try:
            L = np.linalg.cholesky(V)
        except np.linalg.LinAlgError:
            w, U = np.linalg.eigh(V)
            L = U @ np.diag(np.sqrt(np.clip(w, 0, None)))
        out = pdf[by + ["term"]].copy()
        out["mean"] = pdf["estimate"].to_numpy(float)
        out["chol"] = [list(map(float, L[i])) for i in range(len(pdf))]
        return out
    ch = fixed.groupBy(*by).applyInPandas(chol, schema)
    wide = ch.groupBy(*by).pivot("term", terms).agg(F.first(F.struct("mean", "chol")))
    d = wide.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    z = [randoms.hash_normal(*by, "draw", seed=seed, stream=k) for k in range(len(terms))]
    cols = {}
    for i, t in enumerate(terms):
        e = F.col(f"`{t}`.mean")
        for k in range(i + 1):
            e = e + F.col(f"`{t}`.chol")[k] * z[k]
        cols[f"b_{t}"] = e
    return d.select(*by, "draw", *[v.alias(k) for k, v in cols.items()])


def random_effect_draws(fit: DataFrame, levels: DataFrame, by, group: str, n_draws: int,
                        seed: int = 0) -> DataFrame:
    """Normal(BLUP, sigma_u) per (model key, level, draw); a level not
    seen in training gets its prior Normal(0, sigma_u)."""
    by = list(by)
    blup = (fit.where((F.col("kind") == "blup") & (F.col("term") == group))
               .select(*by, F.col("level"), F.col("estimate").alias("__blup")))
    sig = (fit.where((F.col("kind") == "sigma2") & (F.col("term") == group))
              .select(*by, F.sqrt("estimate").alias("__sd")))
    lv = levels.select(*by, F.col(group).cast("string").alias("level")).distinct()
    d = (lv.join(blup, by + ["level"], "left").join(sig, by, "inner")
           .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))))
    re = (F.coalesce(F.col("__blup"), F.lit(0.0)) +
          F.col("__sd") * randoms.hash_normal(*by, "level", "draw", seed=seed))
    return d.select(*by, F.col("level").alias(group), "draw", re.alias("re"))


def forecast_draws(train: DataFrame, future: DataFrame, y: str, xs, group: str, by,
                   n_draws: int, seed: int = 0, reml: bool = True) -> DataFrame:
    """Per-draw predictions ``b0 + sum b_x x + BLUP_group`` for every
    future row (M13).  A ``draw`` column in ``future`` holds covariate draws:
    draw i of the covariates meets draw i of the coefficients.  Without one each
    row meets every coefficient draw.  A level not seen in training has BLUP 0."""
    by = list(by)
    from ..session import cut_lineage
    fit = cut_lineage(mixed.mixed_model(train, y, xs, [group], by, reml))  # tiny; read twice
    coefs = coefficient_draws(fit, by, ["intercept"] + list(xs), n_draws, seed)
    blup = (fit.where((F.col("kind") == "blup") & (F.col("term") == group))
               .select(*by, F.col("level").alias(group), F.col("estimate").alias("re")))
    fut = future.withColumn(group, F.col(group).cast("string"))
    keys = by + (["draw"] if "draw" in future.columns else [])
    j = fut.join(coefs, keys, "inner").join(blup, by + [group], "left")
    pred = F.col("b_intercept") + F.coalesce(F.col("re"), F.lit(0.0))
    for x in xs:
        pred = pred + F.col(f"b_{x}") * F.col(x)
    return j.withColumn("pred", pred).drop("b_intercept", *[f"b_{x}" for x in xs], "re")
