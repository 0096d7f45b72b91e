"""Relational operators on hand-written fixtures: nulls, empties, duplicates."""

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import aggs, clean, joins, reshape, windows


def test_self_join_suffixes_and_null_keys(spark):
    a = spark.createDataFrame([(1, None, 10.0), (2, "x", 20.0)], "id int, d string, v double")
    b = spark.createDataFrame([(1, None, 1.0), (2, "x", 2.0)], "id int, d string, v double")
    plain = joins.self_join(a, b, ["id", "d"]).collect()
    assert [(r.id, r.v_x, r.v_y) for r in plain] == [(2, 20.0, 2.0)]
    ns = joins.self_join(a, b, ["id", "d"], null_safe=True).orderBy("id").collect()
    assert [(r.id, r.v_x, r.v_y) for r in ns] == [(1, 10.0, 1.0), (2, 20.0, 2.0)]


def test_on_pairs_drops_right_keys(spark):
    a = spark.createDataFrame([(1, "2020-01-01", 5.0)], "ID int, ORDER_START_DATE string, v double")
    b = spark.createDataFrame([(1, "2020-01-01", 7.0)], "ID int, RAR_DT string, w double")
    out = joins.on_pairs(a, b, [("ID", "ID"), ("ORDER_START_DATE", "RAR_DT")])
    assert sorted(out.columns) == ["ID", "ORDER_START_DATE", "v", "w"]


def test_outer_on_available_refuses_cross(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,)], "y int")
    with pytest.raises(ValueError):
        joins.outer_on_available(a, b, ["z"])


def test_replicate_by_band(spark):
    df = spark.createDataFrame([("enn", 1.0), ("lnn", 2.0), ("pnn", 3.0)], "age string, pop double")
    out = joins.replicate_by_band(df, joins.week_bands(spark))
    counts = {r.age: r.n for r in out.groupBy("age").agg(F.count("*").alias("n")).collect()}
    assert counts == {"enn": 1, "lnn": 3, "pnn": 48}
    assert out.agg(F.max("age_wks")).first()[0] == 52


def test_scale_logit_bounds_and_outside_ages(spark):
    df = spark.createDataFrame([(8, 0.0), (8, 0.5), (14, 0.05), (3, 0.1)],
                               "age_group_id int, asfr double")
    got = {(r.age_group_id, r.asfr): r.scaled_asfr for r in clean.scale_logit(df).collect()}
    assert got[(8, 0.0)] == 0.001          # below the bound -> clamp
    assert got[(8, 0.5)] == 0.999          # above -> clamp
    assert got[(14, 0.05)] == pytest.approx((0.05 - 0.00001) / (0.10 - 0.00001))
    assert got[(3, 0.1)] is None           # age outside 8..14


def test_spline_reuses_training_knots(spark):
    train = spark.createDataFrame([(2.0,), (16.0,)], "asmedu double")
    fut = spark.createDataFrame([(20.0,), (None,), (8.0,)], "asmedu double")
    names = ["b6", "b6_10", "b10_14", "a14"]
    bounds = clean.knot_bounds(train, "asmedu")
    rows = {r.asmedu: (r.b6, r.b6_10, r.b10_14, r.a14) for r in
            clean.spline_basis(fut, "asmedu", [6, 10, 14], names, bounds).collect()}
    assert rows[8.0] == (4.0, 2.0, 0.0, 0.0)
    assert rows[20.0] == (4.0, 4.0, 4.0, 2.0)      # capped at the training max
    assert rows[None] == (0.0, 0.0, 0.0, 0.0)


def test_decade_bounds_and_signif_zero(spark):
    df = spark.createDataFrame([(1949,), (1955,), (2010,), (2019,)], "year_id int")
    got = [r.decade for r in clean.add_decade(df, lo=1950, hi=2010).orderBy("year_id").collect()]
    assert got == [None, 1950, 2010, 2010]


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    rows = aggs.histogram(df, "v", 10).collect()
    assert [(r.bin, r.n) for r in rows] == [(0, 2)]


def test_element_frequency_tie_break(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b", "c"],), ([],), (None,)], "w array<string>")
    got = [(r.item, r.n) for r in aggs.element_frequency(df, "w").collect()]
    assert got == [("a", 2), ("b", 2), ("c", 1)]


def test_product_default_and_zero(spark):
    df = spark.createDataFrame([("c", "r1")], "acause string, risk string")
    med = spark.createDataFrame([("c", "r2", 1.0)], "acause string, risk string, mean double")
    prods = aggs.product_of_complements(med, ["acause", "risk"])
    got = {r.risk: r.mediation for r in
           aggs.attach_product(df.unionByName(spark.createDataFrame([("c", "r2")], df.schema)),
                               prods, ["acause", "risk"]).collect()}
    assert got == {"r1": 1.0, "r2": 0.0}


def test_shift_both_directions(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0)], "g int, t int, v double")
    nxt = [r.n for r in windows.shift(df, ["g"], ["t"], "v", -1, "n").orderBy("t").collect()]
    prv = [r.p for r in windows.shift(df, ["g"], ["t"], "v", 1, "p").orderBy("t").collect()]
    assert nxt == [20.0, 30.0, None] and prv == [None, 10.0, 20.0]


def test_repeated_rows_and_string_desc_fallback(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", 2), (2, "z", 9)],
                               "k int, s string, t int")
    rep = sorted(r.t for r in windows.repeated_rows(df, ["k"], ["t"]).collect())
    assert rep == [2, 3]
    first = {r.k: r.s for r in windows.dedupe_first(df, ["k"], [("s", True)]).collect()}
    assert first == {1: "c", 2: "z"}   # strings descending use the window path


def test_nested_and_wide_to_long(spark):
    df = spark.createDataFrame([(7, [[1.0, 2.0], [3.0]])], "id int, a array<array<double>>")
    rows = sorted((r.age_group_id, r.draw, r.value) for r in reshape.nested_to_long(
        df, ["id"], "a", [("age_group_id", 8), ("draw", 0)]).collect())
    assert rows == [(8, 0, 1.0), (8, 1, 2.0), (9, 0, 3.0)]
    wide = spark.createDataFrame([(1, 0.1, 0.2)], "k int, draw_0 double, draw_1 double")
    long = sorted((r.draw, r.value) for r in reshape.wide_to_long(wide, ["k"], "draw_").collect())
    assert long == [(0, 0.1), (1, 0.2)]


def test_year_slice_rules(spark):
    df = spark.createDataFrame([(y,) for y in range(1989, 2043)], "year_id int")
    past = reshape.year_slice(df, "past", 1990, 2017, 2040)
    fc = reshape.year_slice(df, "forecast", 1990, 2017, 2040)
    assert (past.agg(F.min("year_id"), F.max("year_id")).first()[:] == (1990, 2016))
    assert (fc.agg(F.min("year_id"), F.max("year_id")).first()[:] == (2017, 2040))
    with pytest.raises(ValueError):
        reshape.year_slice(df, "future", 1990, 2017, 2040)


def test_complete_index_versions(spark):
    idx = reshape.complete_index({"location_id": [1, 2], "year_id": [2016, 2017, 2018],
                                  "sex_id": [1, 2]}, spark, version="forecast", y1=2017)
    assert idx.count() == 2 * 2 * 2


def test_outbox(spark):
    df = spark.createDataFrame([("ann", "09:30:00")], "name string, time string")
    r = clean.outbox(df, "Hi ${PERSON_NAME},", {"PERSON_NAME": "name"}, "name", "x.org", "time",
                     run_date=F.lit("2024-05-06").cast("date")).first()
    assert (r.recipient, r.body, str(r.send_at)) == ("ann@x.org", "Hi ann,", "2024-05-06 09:30:00")


def test_dedupe_puts_nulls_last_for_every_type(spark):
    for kind, vals in (("int", (None, 5, 3)), ("string", (None, "5", "3"))):
        df = spark.createDataFrame([("k", v) for v in vals], f"k string, v {kind}")
        for desc, want in ((True, 5), (False, 3)):
            assert int(windows.dedupe_first(df, ["k"], [("v", desc)]).first().v) == want


def test_key_of_max_tie_ignores_row_order(spark):
    rows = [(1, 2, 9.0), (1, 1, 9.0), (1, 3, 4.0)]
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "g int, k int, v double").coalesce(1)
        assert aggs.key_of_max(df, "k", "v", ["g"]).first().k == 2


def test_session_keeps_the_given_master(spark):
    import inspect

    from vitalframe import session
    assert session.build_session().sparkContext.master == spark.sparkContext.master
    assert "local[" not in inspect.getsource(session.build_session).split("if master is not None")[0].split('"""')[2]
