"""Fertility plans: lags, arc forecast, sequential lag forecast vs brute force."""

import numpy as np
import pandas as pd
import pytest

from vitalframe.plans import fertility


def _panel(rng):
    rows = []
    for loc in range(4):
        for a in (8, 9, 10):
            for y in range(1990, 2006):
                x = float(rng.normal())
                rows.append((loc, a, y, x, float(0.1 * a + 0.02 * (y - 1990) + 0.3 * x +
                                                 rng.normal(0, 0.05))))
    return pd.DataFrame(rows, columns=["location_id", "age_group_id", "year_id", "x", "v"])


def test_sequential_lag_forecast_matches_loop(spark):
    pdf = _panel(np.random.default_rng(0))
    df = spark.createDataFrame(pdf)
    out = fertility.sequential_lag_forecast(df, "v", ["x"], 2000, 2005, step=2,
                                            ages=[8, 9, 10]).toPandas()
    # brute force: same model, same recursion, in pandas
    obs = pdf[pdf.year_id < 2000]
    known = {(r.location_id, r.age_group_id, r.year_id): r.v for r in obs.itertuples()}

    def lag_of(loc, a, y):
        return known.get((loc, a if a == 8 else a - 1, y - 2))
    coefs = {}
    for a in (8, 9, 10):
        d = [(lag_of(r.location_id, a, r.year_id), r.x, r.v)
             for r in obs[obs.age_group_id == a].itertuples()]
        d = np.array([t for t in d if t[0] is not None])
        X = np.column_stack([np.ones(len(d)), d[:, 0], d[:, 1]])
        coefs[a] = np.linalg.lstsq(X, d[:, 2], rcond=None)[0]
    fut = pdf[pdf.year_id >= 2000]
    for a in (8, 9, 10):
        years = sorted(fut.year_id.unique())
        blocks = [years[i:i + 2] for i in range(0, len(years), 2)] if a == 8 else [years]
        for blk in blocks:
            new = {}
            for r in fut[(fut.age_group_id == a) & fut.year_id.isin(blk)].itertuples():
                lag = lag_of(r.location_id, a, r.year_id)
                if lag is not None:
                    b = coefs[a]
                    new[(r.location_id, a, r.year_id)] = b[0] + b[1] * lag + b[2] * r.x
            known.update(new)
    fc = out[out.forecast]
    assert len(fc) == len(fut)
    for r in fc.itertuples():
        assert r.v == pytest.approx(known[(r.location_id, r.age_group_id, r.year_id)], rel=1e-9)


def test_cohort_and_period_lag(spark):
    df = spark.createDataFrame([(1, 8, 2000, 1.0), (1, 9, 2005, 2.0), (1, 8, 2005, 3.0)],
                               "location_id int, age_group_id int, year_id int, v double")
    c = fertility.cohort_lag(df, "v").collect()
    assert [(r.age_group_id, r.year_id, r.lag_v) for r in c] == [(9, 2005, 1.0)]
    p = fertility.cohort_lag(df, "v", kind="period").collect()
    assert [(r.age_group_id, r.year_id, r.lag_v) for r in p] == [(8, 2005, 1.0)]


def test_arc_forecast_constant_growth(spark):
    rows = [(1, 8, y, 0.1 * 1.05 ** (y - 1990)) for y in range(1990, 2001)]
    df = spark.createDataFrame(rows, "location_id int, age_group_id int, year_id int, v double")
    out = {r.year_id: r.v for r in fertility.arc_forecast(
        df, ["location_id", "age_group_id"], "v", 1990, 2000, 3).collect() if r.forecast}
    for h in (1, 2, 3):
        assert out[2000 + h] == pytest.approx(0.1 * 1.05 ** (10 + h), rel=1e-12)
