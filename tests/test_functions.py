"""Column expressions: randoms, numeric helpers, text helpers."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from vitalframe.functions import numeric, randoms, special, text


def test_portable_uniform_matches_sql(spark):
    df = spark.createDataFrame([(i, j) for i in range(20) for j in range(5)], "a int, b int")
    got = {(r.a, r.b): r.u for r in df.select(
        "a", "b", randoms.hash_uniform("a", "b", seed=9, portable=True).alias("u")).collect()}
    con = duckdb.connect()
    sql = (f"SELECT a, b, {randoms.sql_uniform('a', 'b', seed=9)} AS u "
           "FROM range(20) t1(a), range(5) t2(b)")
    for a, b, u in con.execute(sql).fetchall():
        assert got[(a, b)] == pytest.approx(u, abs=0, rel=0)


def test_uniform_and_normal_moments(spark):
    df = spark.range(200000)
    r = df.select(randoms.hash_uniform("id", seed=1).alias("u"),
                  randoms.hash_normal("id", seed=1).alias("z")).agg(
        F.avg("u").alias("mu"), F.var_pop("u").alias("vu"), F.min("u").alias("lo"),
        F.max("u").alias("hi"), F.avg("z").alias("mz"), F.var_pop("z").alias("vz")).first()
    se = math.sqrt(1 / 12 / 200000)
    assert abs(r.mu - 0.5) < 4 * se
    assert abs(r.vu - 1 / 12) < 0.002
    assert 0 <= r.lo and r.hi < 1
    assert abs(r.mz) < 4 / math.sqrt(200000)
    assert abs(r.vz - 1) < 0.02


def test_streams_are_independent(spark):
    df = spark.range(100000)
    c = df.select(randoms.hash_uniform("id", stream=1).alias("a"),
                  randoms.hash_uniform("id", stream=2).alias("b")).agg(F.corr("a", "b")).first()[0]
    assert abs(c) < 0.02


def test_hash_poisson_mean(spark):
    df = spark.range(50000).select(randoms.hash_poisson(4.0, "id", seed=2).alias("k"))
    r = df.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v")).first()
    assert abs(r.m - 4.0) < 4 * math.sqrt(4.0 / 50000)
    assert abs(r.v - 4.0) < 0.15


def test_poisson_pmf_beyond_20(spark):
    df = spark.createDataFrame([(10.0, 25)], "lam double, k int")
    v = df.select(numeric.poisson_pmf("lam", "k")).first()[0]
    exact = math.exp(25 * math.log(10) - 10 - math.lgamma(26))
    assert v == pytest.approx(exact, rel=1e-10)


def test_signif(spark):
    df = spark.createDataFrame([(123456.789,), (0.000123456,), (0.0,), (-98765.4321,)], "x double")
    got = [r[0] for r in df.select(numeric.signif("x", 5)).collect()]
    assert got == [123460.0, 0.00012346, 0.0, -98765.0]


def test_vincenty_close_to_haversine(spark):
    pts = [(38.8976763, -77.0387185, 40.7128, -74.006), (0.0, 0.0, 0.0, 1.0),
           (51.5, -0.12, -33.9, 151.2), (38.8976763, -77.0387185, 38.8976763, -77.0387185)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    df = numeric.add_vincenty_km(df, "a", "b", "c", "d", "v")
    rows = df.select("v", numeric.haversine_km("a", "b", "c", "d").alias("h")).collect()
    assert rows[3].v == 0.0
    for r in rows[:3]:
        assert r.v == pytest.approx(r.h, rel=0.006)
    # one degree of longitude on the equator is 111.319 km on WGS-84
    assert rows[1].v == pytest.approx(111.3195, abs=1e-3)


def test_lognormal_pdf_integrates_to_one(spark):
    df = spark.range(1, 40001).select((F.col("id") * 0.005).alias("x"))
    s = df.select(numeric.lognormal_pdf("x", F.lit(20.0), F.lit(6.0)).alias("p")) \
          .agg(F.sum("p") * 0.005).first()[0]
    assert s == pytest.approx(1.0, abs=1e-4)


def test_relative_risk_curve(spark):
    df = spark.createDataFrame([(25.0, 0), (15.0, 0), (15.0, 1), (100.0, 0)], "x double, f int")
    got = [r[0] for r in df.select(numeric.relative_risk(
        "x", F.lit(1.1), F.lit(3.0), F.lit(20.0), F.col("f") == 1)).collect()]
    assert got[0] == pytest.approx(1.1 ** 5)
    assert got[1] == 1.0
    assert got[2] == pytest.approx(1.1 ** 5)
    assert got[3] == 3.0


def test_text_numbers_and_ages(spark):
    df = spark.createDataFrame([("<1.6",), ("PENDING",), ("nan",), (" 2.5",), (None,)], "v string")
    assert [r[0] for r in df.select(text.to_number("v")).collect()] == [None, None, None, 2.5, None]
    d = spark.createDataFrame([("3/4/52 10:00", "7/1/05 08:00"), ("1/1/99 0:00", "1/1/99 1:00")],
                              "b string, o string")
    assert [r[0] for r in d.select(text.age_from_two_digit_years("b", "o")).collect()] == [53, 0]


def test_template_strict(spark):
    with pytest.raises(KeyError):
        text.render_template("Hi ${NAME} ${OTHER}", {"NAME": "n"})


def test_special_functions():
    assert special.t_two_sided_p(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-9)
    assert special.t_critical(0.05, 10) == pytest.approx(2.228138851986, rel=1e-9)
    assert special.betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248, rel=1e-9)


def test_counter_uniforms_and_bernoulli_forms(spark):
    import numpy as np
    from vitalframe.operators import draws
    u = randoms.counter_uniforms(np.arange(2000, dtype=np.int64), np.arange(100))
    assert u.shape == (2000, 100) and 0 <= u.min() and u.max() < 1
    assert abs(u.mean() - 0.5) < 0.002 and abs(u.var() - 1 / 12) < 0.001
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.05
    df = spark.range(3000).select("id", (F.col("id") % 10 / 10.0).alias("p"))
    c = draws.bernoulli_counts(df, "p", ["id"], 40, seed=1)
    lf = draws.bernoulli_draws(df, "p", ["id"], 40, seed=1).groupBy("id").agg(
        F.sum("event").alias("m"))
    assert c.join(lf, "id").where(F.col("n_events") != F.col("m")).count() == 0
    assert c.agg(F.sum("n_events")).first()[0] == pytest.approx(3000 * 0.45 * 40, rel=0.02)


def test_counter_draws_stay_in_cache_sized_blocks():
    import tracemalloc

    import numpy as np
    import pandas as pd
    from vitalframe.operators import draws
    rng = np.random.default_rng(1)
    seeds, p = rng.integers(-2 ** 63, 2 ** 63 - 1, 3000), rng.random(3000)
    p[:9] = [0.0, 1.0, -1.0, 2.0, np.nan, np.inf, -np.inf, 5e-324, 1 - 2.0 ** -53]
    count = draws._count_udf(1000).func
    tracemalloc.start()
    got = count(pd.Series(seeds), pd.Series(p))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # a block of 4,096 rows x 1,000 draws took tens of MB, far beyond a core's cache
    u = randoms.counter_uniforms(seeds, np.arange(1000))
    with np.errstate(invalid="ignore"):
        assert got.tolist() == (u < p[:, None]).sum(axis=1).tolist()
    for n in (0, 1, 20000):
        want = (randoms.counter_uniforms(seeds[:20], np.arange(n)) < p[:20, None]).sum(axis=1)
        assert randoms.counter_counts(seeds[:20], n, p[:20]).tolist() == want.tolist()
    edge = u[:, 0]  # the uniform itself is not below it, the next number is
    assert not randoms.counter_counts(seeds, 1, edge).any()
    assert randoms.counter_counts(seeds, 1, np.nextafter(edge, 2.0)).all()


def test_portable_counts_hash_blocks_not_single_draws(spark):
    import hashlib
    from vitalframe.operators import draws
    rows = [(i, str(i * 7919), (i % 11) / 10.0) for i in range(60)]
    rows += [(None, None, 0.5), (1, None, 0.5), (None, "", 0.5), (1, "\u00e9" * 40, 0.5), (1, "x" * 51, 0.5), (1, "x" * 52, 0.5),
             (2, "y" * 130, 0.5), (3, "a", None), (3, "a", float("nan")), (3, "a", -1.0), (3, "a", 2.0), (3, "a", 1e300)]
    df = spark.createDataFrame(rows, "k int, t string, p double").coalesce(1)
    got = draws.bernoulli_counts(df, "p", ["k", "t"], 120, seed=3, portable=True)
    # one lambda step and one md5 call a draw took 2.5 us a draw
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()

    def expected(k, t, p):
        keys = [str(x) for x in (k, t) if x is not None]
        u = [int(hashlib.md5("|".join([*keys, str(d), "3"]).encode()).hexdigest()[:8], 16) / 2.0 ** 32 for d in range(120)]
        return 0 if p is None else 120 if math.isnan(p) else sum(x < p for x in u)

    assert got.schema["n_events"].dataType.simpleString() == "bigint"
    assert [r.n_events for r in got.collect()] == [expected(*r) for r in rows]


def test_cluster_conf_scales_with_input():
    from vitalframe.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4, executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) >= 100 * 1024 ** 4 // (256 * 1024 ** 2)
    small = cluster_conf(1024 ** 3, executors=2, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 24


@pytest.mark.parametrize("lam", [1.0, 60.0, 100.0, 1000.0])
def test_hash_poisson_any_mean(spark, lam):
    r = spark.range(4000).select(randoms.hash_poisson(lam, "id", seed=2).alias("k")).agg(
        F.avg("k").alias("m"), F.var_samp("k").alias("v")).first()
    assert abs(r.m - lam) < 4 * (lam / 4000) ** 0.5
    assert r.v == pytest.approx(lam, rel=0.12)


def test_vincenty_marks_points_that_do_not_converge(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7), (None, 0.0, 1.0, 1.0), (10.0, 0.0, 10.0, 1.0)],
                               "a double, b double, c double, d double")
    got = [r.v for r in numeric.add_vincenty_km(df, "a", "b", "c", "d", "v").collect()]
    assert got[0] is None and got[1] is None and got[2] == pytest.approx(109.64, abs=0.05)
