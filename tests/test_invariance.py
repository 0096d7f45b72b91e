"""Random and windowed operators give the same result under any partitioning
(the guard against rand() and unordered windows)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["bernoulli_draws", "under_one_population", "bootstrap_power", "dedupe_first",
         "cause_scalar", "asfr_forecast_draws", "sequential_lag_forecast", "arc_scenarios",
         "repeated_rows"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_any_partitioning(spark, name):
    results = []
    for n in (1, 2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = E.queries()[name](spark, SF)
        results.append(sorted(tuple(r) for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert results[0] == results[1] == results[2]
