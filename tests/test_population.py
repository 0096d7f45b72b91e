"""Under-one step: closed form of W2 against the literal 52-step loop."""

import pytest
from pyspark.sql import functions as F

from vitalframe.plans import population


def literal_loop(rows, steps: int = 52):
    """Reference implementation of the weekly recurrence on one cohort (plain
    Python, for tests): ``rows`` is a list of (q, start_pop) by week."""
    q = [r[0] for r in rows]
    c = [r[1] for r in rows]

    def run(newborns):
        cur = list(c)
        for _ in range(steps):
            nxt = [None] * len(cur)
            nxt[0] = (1 - q[0]) * newborns
            for k in range(1, len(cur)):
                nxt[k] = cur[k - 1] * (1 - q[k - 1])
            cur = nxt
        return cur
    return run


def _fixture(spark):
    keys = "location_id int, year_id int, sex_id int"
    pop = spark.createDataFrame(
        [(1, 2000, s, a, g, d, 100.0 * g) for s in (1, 2) for d in (0, 1)
         for a, g in (("enn", 2), ("lnn", 3), ("pnn", 4))],
        f"{keys}, age string, age_group_id int, draw int, pop double")
    qs = {"enn": 0.01, "lnn": 0.002, "pnn": 0.0005}
    nqx = spark.createDataFrame(
        [(1, 2000, s, a, d, qs[a] * (1 + d) * s) for s in (1, 2) for d in (0, 1) for a in qs],
        f"{keys}, age string, draw int, q double")
    births = spark.createDataFrame(
        [(1, 2000, s, d, b) for s in (1, 2) for d in (0, 1) for b in (500.0, 250.0)],
        f"{keys}, draw int, births double")
    return pop, nqx, births, qs


def test_closed_form_matches_loop(spark):
    pop, nqx, births, qs = _fixture(spark)
    out = population.under_one_step(pop, nqx, births)
    got = {(r.sex_id, r.draw, r.age): r.pop for r in out.collect()}
    for s in (1, 2):
        for d in (0, 1):
            weekly = ([qs["enn"]] + [qs["lnn"]] * 3 + [qs["pnn"]] * 48)
            weekly = [q * (1 + d) * s for q in weekly]
            start = [100.0 * 2] + [100.0 * 3 / 3] * 3 + [100.0 * 4 / 48] * 48
            final = literal_loop(list(zip(weekly, start)))(750.0)
            assert got[(s, d, "enn")] == pytest.approx(final[0], rel=1e-12)
            assert got[(s, d, "lnn")] == pytest.approx(sum(final[1:4]), rel=1e-12)
            assert got[(s, d, "pnn")] == pytest.approx(sum(final[4:]), rel=1e-12)


def test_legacy_draw_shift(spark):
    pop, nqx, births, _ = _fixture(spark)
    b2 = births.withColumn("births", F.col("births") * (F.col("draw") + 1))
    plain = {(r.sex_id, r.draw, r.age): r.pop for r in
             population.under_one_step(pop, nqx, b2).collect()}
    shifted = {(r.sex_id, r.draw, r.age): r.pop for r in
               population.under_one_step(pop, nqx, b2, legacy_draw_shift=True,
                                         n_draws=2).collect()}
    # with the shift, draw 1 uses draw 0's births (half of its own)
    assert shifted[(1, 1, "enn")] == pytest.approx(plain[(1, 1, "enn")] / 2)
