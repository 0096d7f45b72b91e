"""Physical-plan shape: pushdown, pruning, no row-at-a-time Python, no
Cartesian products of data, partial aggregation, top-k without a full sort."""

import pytest

import __spark_entry__ as E
from oracle_compare import physical_plan

SF = "/root/testdata/sf0.001"


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "1000")
    return physical_plan(df)


def test_filter_and_projection_reach_the_scan(spark):
    plan = plan_of(E.queries()["top5_by_price"](spark, SF))
    assert "PushedFilters: [IsNotNull(p_type), IsNotNull(p_size), EqualTo(p_type,ECONOMY), " \
           "GreaterThan(p_size,20)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_type:string,p_size:int," \
           "p_retailprice:double>" in plan
    assert "TakeOrderedAndProject" in plan          # top-k, no global sort


def test_partial_aggregation_before_shuffle(spark):
    plan = plan_of(E.queries()["group_sums"](spark, SF))
    assert "partial_sum" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double," \
           "l_returnflag:string,l_linestatus:string>" in plan


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_row_python_no_cartesian(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in plan
    if name != "sev_complete_index":    # T1: the dense index is a product of dimensions
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
