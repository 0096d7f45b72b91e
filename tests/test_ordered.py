"""Positions, running sums and shifts over one global order, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import ordered

ROWS = [(i, random.Random(i).randrange(50), None if i % 17 == 0 else i * 1.5) for i in range(700)]


@pytest.fixture(scope="module", params=[1, 7])
def table(spark, request):
    return spark.createDataFrame(ROWS, "id long, grp long, v double").repartition(request.param)


def ordered_rows():
    return sorted(ROWS, key=lambda r: (r[1], -r[0]))


def test_position_and_drop(table):
    got = {r["id"]: r["position"] for r in ordered.global_position(table, ["grp", ("id", True)]).collect()}
    assert got == {r[0]: i for i, r in enumerate(ordered_rows())}
    left = {r["id"] for r in ordered.drop_global_position(table, 300, ["grp", ("id", True)]).collect()}
    assert left == {r[0] for r in ROWS} - {ordered_rows()[299][0]}


def test_running_sum(table):
    got = {r["id"]: r["running"] for r in ordered.running_sum(table, ["grp", ("id", True)], "grp").collect()}
    total, want = 0, {}
    for r in ordered_rows():
        want[r[0]] = total
        total += r[1]
    assert got == want


@pytest.mark.parametrize("offset", [1, -1, 5, -130])
def test_shift_crosses_partitions(table, offset):
    name = "prev_v" if offset > 0 else "next_v"
    got = {r["id"]: r[name] for r in
           ordered.global_shift(table, ["grp", ("id", True)], ["v"], offset).collect()}
    rows = ordered_rows()
    want = {r[0]: rows[i - offset][2] if 0 <= i - offset < len(rows) else None for i, r in enumerate(rows)}
    assert got == want


def test_ties_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None), (2, 7), (1, 3)] + [(5, 5)] * 400,
                               "a int, b int").repartition(5)
    got = ordered.global_position(df, ["a"]).collect()
    assert sorted(r["position"] for r in got) == list(range(405))
    assert sorted(r["position"] for r in got if r["a"] is None) == [403, 404]
    none = df.where(F.lit(False))
    assert ordered.global_position(none, ["a"]).collect() == []
    assert ordered.running_sum(none, ["a"], "b").collect() == []
    assert ordered.global_shift(none, ["a"], ["b"]).collect() == []


def test_no_unpartitioned_exchange(table):
    plan = ordered.global_shift(table, ["grp", "id"], ["v"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" in plan
