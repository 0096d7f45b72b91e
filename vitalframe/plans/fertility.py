"""Fertility features and forecasts (T7, T8, T9, P14-P16 composition)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clean, joins, windows


def cohort_lag(df: DataFrame, value: str, location: str = "location_id",
               age: str = "age_group_id", year: str = "year_id", step: int = 5,
               kind: str = "cohort", out: str | None = None) -> DataFrame:
    """Lag feature by self-join.

    ``kind='cohort'``: (age a, year t) gets the value of (a-1, t-step);
    ``kind='period'``: (a, t) gets (a, t-step).  Only rows with both values
    are returned (inner join on shifted keys: one shuffle per side, no
    window over a whole location).
    """
    out = out or f"lag_{value}"
    prev = df.select(F.col(location), (F.col(age) + (1 if kind == "cohort" else 0)).alias(age),
                     (F.col(year) + step).alias(year), F.col(value).alias(out))
    j = df.join(prev, [location, age, year], "inner")
    return j.where(F.col(value).isNotNull() & F.col(out).isNotNull())


def arc_rates(df: DataFrame, keys, value: str, start_year: int, last_year: int,
              weight_exp: float = 0.4, year: str = "year_id") -> DataFrame:
    """The weighted annual rate of change per key (see arc_forecast)."""
    keys = list(keys)
    hist = df.where((F.col(year) >= start_year) & (F.col(year) <= last_year))
    w = Window.partitionBy(*keys).orderBy(year)
    prev_year = F.lag(year).over(w)
    r = F.log(F.try_divide(F.col(value), F.lag(value).over(w)))
    rates = (hist.withColumn("__r", F.when(prev_year == F.col(year) - 1, r))
                 .withColumn("__w", F.pow(F.col(year) - start_year + 1, F.lit(weight_exp))))
    return (rates.where(F.col("__r").isNotNull())
                 .groupBy(*keys)
                 .agg((F.sum(F.col("__w") * F.col("__r")) / F.sum("__w")).alias("arc")))


def arc_scenarios(df: DataFrame, keys, across: str, value: str, start_year: int,
                  last_year: int, horizon: int, quantiles=(0.15, 0.85),
                  weight_exp: float = 0.4, year: str = "year_id") -> DataFrame:
    """T9 scenarios (our definition of the unknown quantile step): per key,
    scenario 0 uses the key's own rate; scenarios -1 and +1 use the
    ``quantiles`` of the rates across ``across`` (e.g. locations) within the
    rest of the key (e.g. age).  Forecast rows only, one per scenario."""
    from ..session import cut_lineage
    keys = list(keys)
    rest = [k for k in keys if k != across]
    # one row per key, read by the quantile step and the projection: written once
    rates = cut_lineage(arc_rates(df, keys, value, start_year, last_year, weight_exp, year),
                        "arc_rates")
    q = (rates.groupBy(*rest)
              .agg(F.percentile("arc", F.array(*[F.lit(float(x)) for x in quantiles]))
                   .alias("__q")))
    last = df.where(F.col(year) == last_year).select(*keys, F.col(value).alias("__last"))
    base = rates.join(q, rest, "inner").join(last, keys, "inner")
    sc = F.inline(F.array(
        F.struct(F.lit(-1).alias("scenario"), F.col("__q")[0].alias("__rate")),
        F.struct(F.lit(0).alias("scenario"), F.col("arc").alias("__rate")),
        F.struct(F.lit(1).alias("scenario"), F.col("__q")[1].alias("__rate"))))
    out = (base.select(*keys, "__last", sc)
               .withColumn("__h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))))
    return out.select(*keys, "scenario", (F.lit(last_year) + F.col("__h")).cast("int").alias(year),
                      (F.col("__last") * F.exp(F.col("__rate") * F.col("__h"))).alias(value))


def arc_forecast(df: DataFrame, keys, value: str, start_year: int, last_year: int,
                 horizon: int, weight_exp: float = 0.4, year: str = "year_id") -> DataFrame:
    """Weighted annual-rate-of-change forecast (our definition).

    Per key: ``r_t = ln(v_t / v_{t-1})`` for years in (start_year, last_year],
    weights ``(t - start_year + 1) ** weight_exp``, ``r = sum(w r) / sum(w)``;
    forecast ``v_{last+h} = v_last * exp(r h)`` for h = 1..horizon.
    Returns past rows and forecast rows with a ``forecast`` flag.
    The lag window is per key over its years (bounded), the rest grouped
    aggregates.
    """
    keys = list(keys)
    hist = df.where((F.col(year) >= start_year) & (F.col(year) <= last_year))
    agg = arc_rates(df, keys, value, start_year, last_year, weight_exp, year)
    last = hist.where(F.col(year) == last_year).select(*keys, F.col(value).alias("__last"))
    fc = (agg.join(last, keys, "inner")
             .withColumn("__h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
             .select(*keys, (F.lit(last_year) + F.col("__h")).cast("int").alias(year),
                     (F.col("__last") * F.exp(F.col("arc") * F.col("__h"))).alias(value),
                     F.lit(True).alias("forecast")))
    past = hist.select(*keys, F.col(year).cast("int").alias(year), value,
                       F.lit(False).alias("forecast"))
    return past.unionByName(fc)


def modelling_table(asfr: DataFrame, edu: DataFrame, met: DataFrame, locations: DataFrame,
                    forecast_edu: DataFrame | None = None, keys=("location_id", "year_id",
                                                              "age_group_id")) -> DataFrame:
    """ASFR x education x met demand, scaled logit (P14), decade (P15),
    region lookup (J7), education spline (P16), forecast rows bound (O5)."""
    keys = list(keys)
    rest = [c for c in met.columns if c not in keys]
    met = windows.dedupe_first(met, keys, rest)
    d = asfr.join(edu, keys, "inner").join(met, keys, "inner")
    d = clean.scale_logit(d, "asfr")
    d = clean.add_decade(d, "year_id", "decade", 1950, 2010)
    d = joins.lookup(d, locations, ["location_id"], "inner")  # location dimension
    names = ["asmedu_below_6", "asmedu_between_6_10", "asmedu_between_10_14", "asmedu_above_14"]
    bounds = clean.knot_bounds(d, "asmedu")
    d = clean.spline_basis(d, "asmedu", [6, 10, 14], names, bounds)
    if forecast_edu is not None:
        f = clean.spline_basis(forecast_edu, "asmedu", [6, 10, 14], names, bounds)
        f = joins.lookup(f, locations, ["location_id"], "inner")
        d = d.unionByName(f, allowMissingColumns=True)
    return d


def sequential_lag_forecast(df: DataFrame, value: str, xs, first_year: int, last_year: int,
                            step: int = 5, location: str = "location_id",
                            age: str = "age_group_id", year: str = "year_id",
                            ages=None) -> DataFrame:
    """Age/period-lag forecast (section 3.3 of the build plan; M3 + T7).

    Model per age group: ``value ~ lag + xs`` by OLS, where the lag of the
    first age is the period lag (same age, year - step) and of every later
    age the cohort lag (age - 1, year - step).  Fitted on observed years
    (< first_year) in one grouped job.  Forecasting is sequential by
    construction: the first age goes in year blocks of ``step`` (a block's
    lag is the previous block's forecast), then each later age uses the
    forecast of the age below.  That is a driver loop over
    (blocks + ages - 1) rounds; each round is one distributed join +
    prediction whose output is checkpointed (reliable checkpoint, lineage
    cut) so later rounds and retries read it instead of recomputing.
    Returns observed rows plus forecast rows (``forecast`` flag, ``pred``).
    """
    from ..operators import stats
    from ..session import cut_lineage
    xs = list(xs)
    ages = sorted(ages) if ages is not None else sorted(
        r[0] for r in df.select(age).distinct().collect())  # a handful of age groups
    a0 = ages[0]
    obs = df.where(F.col(year) < first_year)

    def with_lag(rows, source):
        src = source.select(location, F.col(age).alias("__src_age"),
                            (F.col(year) + step).alias(year), F.col(value).alias("lag"))
        want = rows.withColumn("__src_age", F.when(F.col(age) == a0, F.col(age))
                               .otherwise(F.col(age) - 1))
        # a row whose lag is missing stays, with a null lag (and so a null forecast)
        return (want.join(src, [location, "__src_age", year], "left").drop("__src_age"))

    train = with_lag(obs, obs).where(F.col(value).isNotNull() & F.col("lag").isNotNull())
    coefs = cut_lineage(stats.ols_grouped(train, value, ["lag"] + xs, [age]))
    future = df.where((F.col(year) >= first_year) & (F.col(year) <= last_year)).drop(value)

    def predict(rows, source):
        p = stats.predict(with_lag(rows, source).withColumn(value, F.lit(None).cast("double")),
                          coefs, value, ["lag"] + xs, [age])
        return p.drop("resid", value, "lag").withColumnRenamed("pred", value)

    pieces = []
    prev = obs.select(location, age, year, value)
    for start in range(first_year, last_year + 1, step):
        rows = future.where((F.col(age) == a0) & (F.col(year) >= start) &
                            (F.col(year) < start + step))
        out = cut_lineage(predict(rows, prev.where(F.col(age) == a0)))
        pieces.append(out)
        prev = prev.unionByName(out.select(location, age, year, value))
    prev_age = reduce(DataFrame.unionByName,
                      [obs.where(F.col(age) == a0).select(location, age, year, value)] +
                      [p.select(location, age, year, value) for p in pieces])
    for a in ages[1:]:
        rows = future.where(F.col(age) == a)
        src = prev_age.unionByName(obs.where(F.col(age) == a - 1)
                                   .select(location, age, year, value)).distinct()
        out = cut_lineage(predict(rows, src))
        pieces.append(out)
        prev_age = out.select(location, age, year, value)
    fc = reduce(DataFrame.unionByName, pieces).withColumn("forecast", F.lit(True))
    base = obs.withColumn("forecast", F.lit(False))
    return base.unionByName(fc, allowMissingColumns=True)
