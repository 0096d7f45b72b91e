"""Registered queries over global orders and exact quantiles of continuous columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, clean, ordered, stats
from .catalog import register, rounded, tbl
from .catalog_sql import SQL, r6


@register("price_quantiles")
def q_price_quantiles(spark, sf):
    """Median and 2.5 / 97.5 percentiles of a continuous column over all lines."""
    l = tbl(spark, sf, "lineitem")
    return rounded(aggs.column_quantiles(l, "l_extendedprice", (0.025, 0.5, 0.975), names=["lo", "median", "hi"]))


SQL["price_quantiles"] = "SELECT " + ", ".join(
    f"{r6(f'quantile_cont(l_extendedprice, {p})')} AS {n}" for p, n in ((0.025, "lo"), (0.5, "median"), (0.975, "hi"))
) + " FROM lineitem"


@register("price_quantiles_by_flag")
def q_price_quantiles_by_flag(spark, sf):
    """A7 over groups that grow with the data: mean and percentiles of the price per return flag."""
    l = tbl(spark, sf, "lineitem")
    return rounded(aggs.draw_summary(l, ["l_returnflag"], "l_extendedprice", bounded=False))


SQL["price_quantiles_by_flag"] = f"""SELECT l_returnflag, {r6('avg(l_extendedprice)')} AS mean,
  {r6('quantile_cont(l_extendedprice, 0.025)')} AS lower, {r6('quantile_cont(l_extendedprice, 0.975)')} AS upper
FROM lineitem GROUP BY 1"""


@register("price_box_stats")
def q_price_box_stats(spark, sf):
    """Quartiles and whiskers of the price per ship year, three groups of which hold most rows."""
    l = tbl(spark, sf, "lineitem").select(F.year("l_shipdate").alias("ship_year"), "l_extendedprice")
    return rounded(aggs.box_stats(l, "ship_year", "l_extendedprice"))


SQL["price_box_stats"] = f"""WITH l AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_extendedprice AS x FROM lineitem),
q AS (SELECT ship_year, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
  FROM l GROUP BY 1),
w AS (SELECT ship_year, min(x) AS whisker_lo, max(x) AS whisker_hi FROM l JOIN q USING (ship_year)
  WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) GROUP BY 1)
SELECT ship_year, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
  {r6('whisker_lo')} AS whisker_lo, {r6('whisker_hi')} AS whisker_hi FROM q LEFT JOIN w USING (ship_year)"""


@register("drop_global_position")
def q_drop_global_position(spark, sf):
    """All customers but the 32nd by balance, one order over the whole table."""
    c = tbl(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(clean.drop_position(c, 32, [("c_acctbal", True), "c_custkey"]))


SQL["drop_global_position"] = f"""SELECT c_custkey, c_nationkey, {r6('c_acctbal')} AS c_acctbal FROM customer
QUALIFY row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) <> 32"""


@register("global_positions")
def q_global_positions(spark, sf):
    """Position of every line by price and key, with the quantity of all lines before it."""
    l = tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                          F.col("l_quantity").cast("long").alias("quantity"))
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "quantity"]
    placed = ordered.global_position(l, order, "position", 1)
    return rounded(ordered.running_sum(placed, ["position"], "quantity", "quantity_before"))


SQL["global_positions"] = f"""SELECT l_orderkey, l_linenumber, {r6('l_extendedprice')} AS l_extendedprice,
  CAST(l_quantity AS BIGINT) AS quantity, row_number() OVER w AS position,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    AS quantity_before
FROM lineitem WINDOW w AS (ORDER BY l_extendedprice, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT))"""


@register("global_lag")
def q_global_lag(spark, sf):
    """Each event's predecessor and the value three events later, in one order of all events."""
    e = tbl(spark, sf, "events").select("event_id", "ts", "value")
    out = ordered.global_shift(e, ["ts", "event_id"], ["event_id", "value"], 1)
    return rounded(ordered.global_shift(out, ["ts", "event_id"], ["value"], -3, "later_").drop("ts"))


SQL["global_lag"] = f"""SELECT event_id, {r6('value')} AS value, lag(event_id) OVER w AS prev_event_id,
  {r6('lag(value) OVER w')} AS prev_value, {r6('lead(value, 3) OVER w')} AS later_value
FROM events WINDOW w AS (ORDER BY ts, event_id)"""


@register("event_autocorr")
def q_event_autocorr(spark, sf):
    """Lag-1 fit of the event values' deviations from their kind's mean, over all events in order."""
    e = tbl(spark, sf, "events").where(F.col("value").isNotNull())
    mean = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    r = e.join(mean, "event_type").select("event_id", "ts", (F.col("value") - F.col("m")).alias("resid"))
    return rounded(stats.ols_simple(ordered.global_lag_pairs(r, ["ts", "event_id"], "resid"), "next_resid", "resid"))


SQL["event_autocorr"] = f"""WITH e AS (SELECT event_id, ts, value - avg(value) OVER (PARTITION BY event_type) AS resid
  FROM events WHERE value IS NOT NULL),
p AS (SELECT resid, lead(resid) OVER (ORDER BY ts, event_id) AS next_resid FROM e)
SELECT {r6('regr_slope(next_resid, resid)')} AS slope, {r6('regr_intercept(next_resid, resid)')} AS intercept,
  {r6('regr_r2(next_resid, resid)')} AS r2, CAST(regr_count(next_resid, resid) AS BIGINT) AS n
FROM p WHERE next_resid IS NOT NULL"""
