"""PAF -> scalar DAG identities on hand-written fixtures."""

import pytest
from pyspark.sql import functions as F

from vitalframe.functions import paf as pafx
from vitalframe.operators import aggs
from vitalframe.plans import scalars

KEYS = ["location_id", "year_id", "draw"]


def test_paf_scalar_round_trip(spark):
    df = spark.createDataFrame([(0.1, 2.0), (0.0, 3.0), (0.9, 1.5)], "sev double, rr double")
    r = df.select(pafx.paf_from_scalar(pafx.scalar_from_sev("sev", "rr")).alias("paf"),
                  pafx.scalar_from_sev("sev", "rr").alias("s"))
    for row in r.select("s", pafx.scalar_from_paf("paf").alias("s2")).collect():
        assert row.s2 == pytest.approx(row.s)


def test_zero_scalar_is_null_not_error(spark):
    df = spark.createDataFrame([(0.0,)], "s double")
    assert df.select(pafx.paf_from_scalar("s")).first()[0] is None


def _paf(spark, rows):
    return spark.createDataFrame(rows, "acause string, version string, risk string, "
                                       "location_id int, year_id int, draw int, paf double")


def test_single_risk_combine_is_identity(spark):
    p = _paf(spark, [("c", "past", "r1", 1, 2000, 0, 0.3), ("c", "past", "r1", 2, 2000, 0, 0.5)])
    out = scalars.cause_scalar(p, None, None, ["acause", "version"], KEYS)
    got = {r.location_id: r.paf for r in out.collect()}
    assert got == {1: pytest.approx(0.3), 2: pytest.approx(0.5)}


def test_all_risks_rule_and_product(spark):
    p = _paf(spark, [("c", "past", "r1", 1, 2000, 0, 0.2), ("c", "past", "r2", 1, 2000, 0, 0.5),
                     ("c", "past", "r1", 2, 2000, 0, 0.4)])       # cell 2 lacks r2
    out = scalars.cause_scalar(p, None, None, ["acause", "version"], KEYS).collect()
    assert len(out) == 1 and out[0].location_id == 1
    assert out[0].paf == pytest.approx(1 - 0.8 * 0.5)
    assert out[0].scalar == pytest.approx(1 / (0.8 * 0.5))


def test_cap_and_rescale(spark):
    p = _paf(spark, [("c", "past", "r1", 1, 2000, 0, 1.0), ("c", "past", "r1", 2, 2000, 0, 0.5),
                     ("d", "past", "r1", 1, 2000, 0, 0.5)])
    out = {(r.acause, r.location_id): r.paf for r in
           scalars.cause_scalar(p, None, None, ["acause", "version"], KEYS).collect()}
    assert out[("c", 1)] == pytest.approx(0.95)            # 0.9999 capped, then scaled to 0.95
    assert out[("c", 2)] == pytest.approx(0.5 * 0.95 / 0.9999)
    assert out[("d", 1)] == pytest.approx(0.5)              # other cause not rescaled


def test_mediation_and_set_one(spark):
    p = _paf(spark, [("c", "past", "r1", 1, 2000, 0, 0.2), ("c", "past", "r2", 1, 2000, 0, 0.5),
                     ("c", "past", "r3", 1, 2000, 0, 0.9)])
    med = spark.createDataFrame([("c", "r2", "r1", 0.5), ("c", "r2", "r1", 0.2),
                                 ("c", "zz", "r1", 0.9)],
                                "acause string, risk string, mediator string, mean double")
    one = spark.createDataFrame([("c", "r3")], "acause string, risk string")
    out = scalars.cause_scalar(p, med, one, ["acause", "version"], KEYS).first()
    m1 = (1 - 0.5) * (1 - 0.2)          # 'zz' is not a risk of the cause
    assert out.paf == pytest.approx(1 - (1 - 0.2 * m1) * (1 - 0.5))


def test_risk_cause_paf_fills_and_shared_keys(spark):
    sev = spark.createDataFrame([("r", 1, 2000, 0, 0.5), ("r", 1, 2000, 1, None)],
                                "risk string, location_id int, year_id int, draw int, sev double")
    rr = spark.createDataFrame([("c", "r", 0, 3.0), ("c", "r", 2, 2.0)],
                               "acause string, risk string, draw int, rr double")
    out = {r.draw: r.paf for r in
           scalars.risk_cause_paf(sev, rr, ["location_id", "year_id"]).collect()}
    assert out[0] == pytest.approx(1 - 1 / (0.5 * 2 + 1))
    assert out[2] == pytest.approx(0.0)   # no sev -> 0 -> scalar 1
    assert 1 not in out                   # sev without rr has no cause


def test_rrmax_clamp(spark):
    rr = spark.createDataFrame([("c", 0.5), ("c", 1.0), ("c", None)], "acause string, rr double")
    got = [r.rr for r in scalars.load_rrmax(rr).collect()]
    assert got == [1.001, 1.0, None]


def test_hierarchy_clusters(spark):
    risks = spark.createDataFrame(
        [(1, "top", "0,1", 1), (2, "mid", "0,1,2", 2), (3, "leaf", "0,1,2,3", 3),
         (4, "solo", "0,4", 1), (5, "deep", "0,1,2,3,5", 4)],
        "rei_id int, rei string, path_to_top_parent string, level int")
    pairs = spark.createDataFrame([("c", "leaf"), ("c", "solo"), ("c", "deep"), ("c", "gone")],
                                  "acause string, risk string")
    got = sorted((r.cluster, r.risk) for r in aggs.hierarchy_clusters(pairs, risks).collect())
    # 'solo' is its own only member -> skipped; 'gone' is not in the table
    assert got == [("leaf", "deep"), ("leaf", "leaf"), ("mid", "deep"), ("mid", "leaf"),
                   ("top", "deep"), ("top", "leaf")]


def test_scalars_job_with_files(spark, tmp_path):
    sev = spark.createDataFrame(
        [(r, loc, y, 0, 0.1 * (i + 1)) for i, r in enumerate(["r1", "r2"])
         for loc in (1, 2) for y in (2000, 2020)],
        "risk string, location_id int, year_id int, draw int, sev double")
    rr = spark.createDataFrame([("c", "r1", 0, 2.0), ("c", "r2", 0, 3.0)],
                               "acause string, risk string, draw int, rr double")
    ver = F.when(F.col("year_id") < 2017, F.lit("past")).otherwise(F.lit("forecast"))
    paths = scalars.scalars_job(sev, rr, None, None, str(tmp_path), ["location_id", "year_id"], ver)
    out = spark.read.parquet(paths["scalar"])
    assert out.count() == 4 and set(r.version for r in out.collect()) == {"past", "forecast"}
    p1, p2 = 1 - 1 / (0.1 * 1 + 1), 1 - 1 / (0.2 * 2 + 1)
    exp = 1 - (1 - p1) * (1 - p2)
    assert all(r.paf == pytest.approx(exp) for r in out.collect())
    # a second run without update_past keeps the stored PAF partitions as they are
    sev2 = sev.withColumn("sev", F.col("sev") * 2)
    scalars.scalars_job(sev2, rr, None, None, str(tmp_path), ["location_id", "year_id"], ver)
    again = spark.read.parquet(paths["scalar"]).collect()
    assert all(r.paf == pytest.approx(exp) for r in again)
