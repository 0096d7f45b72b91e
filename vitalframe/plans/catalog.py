"""Registered queries: the library's operators run on the given tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
are all aliased; doubles are rounded to 6 places at the very end (sums and
products differ in the last bits with row order).  The matching SQL is in
``catalog_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric, paf as pafx, randoms
from ..operators import aggs, clean, joins, reshape, stats, windows
from ..sources import views
from ..sources.readers import read_table
from . import scalars

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column to ``digits`` places for comparison.

    Values that are exact decimals one digit longer (x.xxxxxx5) are ties;
    engines break them differently (decimal HALF_UP vs scaled binary), so
    the value is first nudged away from zero by 10^-(digits+3), a thousandth
    of the last kept unit: ties then round away from zero everywhere, other
    values are unaffected.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name).cast("double")
            nudged = c + F.signum(c) * F.lit(10.0 ** -(digits + 3))
            cols.append(F.round(nudged, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def tbl(spark, sf, name):
    return read_table(spark, sf, name)


# ---------------------------------------------------------------- PAF / scalar

@register("paf_from_sev_rrmax")
def q_paf_from_sev_rrmax(spark, sf):
    """Minimum slice: SEV table outer-joined with RRmax on (age, sex), scalar
    and PAF (X1), incomplete rows dropped (P5), de-duplicated (O3)."""
    from ..session import cut_lineage
    d = views.demography(spark, sf, with_cause=False)
    # both inputs in one pass (GROUPING SETS), checkpointed: two consumers
    agg = cut_lineage(d.groupingSets([["location_id", "age_group_id", "sex_id"],
                                      ["age_group_id", "sex_id"]],
                                     "location_id", "age_group_id", "sex_id")
                      .agg(F.avg("sev").alias("sev"), F.max("rr").alias("rrmax"),
                           F.grouping_id().alias("__gid")))
    sev = agg.where(F.col("__gid") == 0).select("location_id", "age_group_id", "sex_id", "sev")
    rrmax = agg.where(F.col("__gid") == 4).select("age_group_id", "sex_id", "rrmax")
    j = joins.outer(sev, rrmax, ["age_group_id", "sex_id"])
    j = j.withColumn("scalar", pafx.scalar_from_sev("sev", "rrmax"))
    j = j.withColumn("paf", pafx.paf_from_scalar("scalar"))
    j = clean.drop_incomplete(j).drop("sev", "rrmax")
    return rounded(reshape.distinct_sorted(j, "location_id", "age_group_id", "sex_id"))


@register("sev_threshold_flag")
def q_sev_threshold_flag(spark, sf):
    """The sev > 0.99 flag as a native boolean; counted per flag."""
    d = views.demography(spark, sf, with_cause=False)
    return (d.withColumn("sev_above_threshold", pafx.sev_above("sev", 0.99))
             .groupBy("sev_above_threshold").agg(F.count("*").alias("n")))


@register("rrmax_load")
def q_rrmax_load(spark, sf):
    """RR per cause with rr < 1 clamped to 1.001."""
    rr = views.rr_by_cause(spark, sf)
    return rounded(scalars.load_rrmax(rr, causes=["ECONOMY", "STANDARD", "PROMO"]))


@register("sev_complete_index")
def q_sev_complete_index(spark, sf):
    """T1 + T2: SEV sliced to the past years and left-joined onto the dense
    (location, year, draw, risk) index; missing cells stay null."""
    sev = views.sev_by_risk(spark, sf)
    idx = reshape.complete_index({
        "location_id": tbl(spark, sf, "nation").select(
            F.col("n_nationkey").cast("int").alias("location_id")),
        "year_id": list(range(1995, 2002)),
        "draw": list(range(1, 8)),
        "risk": tbl(spark, sf, "orders").select(F.col("o_orderpriority").alias("risk")),
    }, spark)
    out = scalars.load_sev(sev, idx, "past", 1995, 1999, 2001,
                           ["risk", "location_id", "year_id", "draw"])
    return rounded(out)


@register("risk_cause_paf")
def q_risk_cause_paf(spark, sf):
    """T4: PAF for all (cause, risk) pairs in one job."""
    sev, rr, _med = views.paf_inputs(spark, sf)
    paf = scalars.risk_cause_paf(sev, scalars.load_rrmax(rr), ["location_id", "year_id"],
                                 skip_risks=["4-NOT SPECIFIED"])
    return rounded(paf)


def _paf_long(spark, sf, inputs=None):
    sev, rr, _med = inputs if inputs is not None else views.paf_inputs(spark, sf)
    rr = scalars.load_rrmax(rr)
    paf = scalars.risk_cause_paf(sev, rr, ["location_id", "year_id"])
    return paf.withColumn("version", F.when(F.col("year_id") < 1999, F.lit("past"))
                          .otherwise(F.lit("forecast")))


@register("mediation_product")
def q_mediation_product(spark, sf):
    """A4: prod(1 - mean) per (cause, mediator), risks limited to the cause's."""
    d = views.demography(spark, sf, with_risk=True)
    pairs = d.select("acause", "risk").distinct()
    return rounded(scalars.mediation_products(views.mediation(spark, sf, d), pairs))


@register("cause_scalar")
def q_cause_scalar(spark, sf):
    """T5: all-risks combine with mediation, cap, rescale, scalar."""
    inputs = views.paf_inputs(spark, sf)
    paf = _paf_long(spark, sf, inputs)
    set_one = (tbl(spark, sf, "part").select(F.col("p_type").alias("acause"))
               .where(F.col("acause") == "PROMO").distinct()
               .withColumn("risk", F.lit("2-HIGH")))
    pairs = inputs[1].select("acause", "risk").distinct()
    out = scalars.cause_scalar(paf, inputs[2], set_one,
                               ["acause", "version"], ["location_id", "year_id", "draw"],
                               cause_risks=pairs)
    return rounded(out)


@register("scalar_from_paf")
def q_scalar_from_paf(spark, sf):
    """X2 with the P13 bounds: paf == 1 -> 0.9999, then 1/(1-paf)."""
    paf = _paf_long(spark, sf)
    p = paf.withColumn("paf", pafx.bound_zero_one("paf"))
    return rounded(p.withColumn("scalar", pafx.scalar_from_paf("paf")))


@register("draw_summary")
def q_draw_summary(spark, sf):
    """Mean and 2.5/97.5 percentiles over draws."""
    sev = views.sev_by_risk(spark, sf)
    return rounded(aggs.draw_summary(sev, ["risk", "location_id", "year_id"], "sev"))


@register("mean_over_draws")
def q_mean_over_draws(spark, sf):
    """Mean over the draw dimension."""
    return rounded(aggs.mean_over_draws(views.sev_by_risk(spark, sf),
                                        ["risk", "location_id", "year_id"], "sev"))


@register("scenario_compare")
def q_scenario_compare(spark, sf):
    """Mean sev by (year, location) with one column per scenario."""
    d = views.demography(spark, sf, with_cause=False)
    return rounded(reshape.scenario_table(d, ["year_id", "location_id"], "sev"))


@register("past_plus_forecast")
def q_past_plus_forecast(spark, sf):
    """O4 + O9: past years [1995, 1999) of one table and forecast [1999, 2001]
    of another, concatenated by name."""
    sev = views.paf_inputs(spark, sf)[0]   # two consumers: materialised input
    fc = sev.withColumn("sev", F.col("sev") * 1.1)
    return rounded(reshape.past_plus_forecast(sev, fc, 1995, 1999, 2001))


@register("risk_clusters")
def q_risk_clusters(spark, sf):
    """Each cause risk under its level-1/2 ancestors; singleton
    self-clusters skipped."""
    pairs = views.cause_risk_pairs(spark, sf)
    return aggs.hierarchy_clusters(pairs, views.risk_hierarchy(spark, sf), levels=(1, 2, 3))


@register("related_risks")
def q_related_risks(spark, sf):
    """Risks of one cause, plus a special-case risk, minus the
    unavailable ones (nations of region 0)."""
    pairs = views.cause_risk_pairs(spark, sf)
    n = tbl(spark, sf, "nation")
    unavailable = n.where(F.col("n_regionkey") == 0).select(F.col("n_name").alias("risk"))
    return aggs.related_set(pairs, "acause", "BUILDING", "risk", unavailable,
                            extra=["NATION_0", "NATION_99"])


# ---------------------------------------------------------------- filters / clean

@register("top5_by_price")
def q_top5_by_price(spark, sf):
    """P1 + P3 + O1: AND filter, projection, ascending sort, first 5."""
    p = tbl(spark, sf, "part")
    f = clean.filter_all(p, F.col("p_type") == "ECONOMY", "p_size > 20")
    return rounded(reshape.top_k(f.select("p_partkey", "p_name", "p_type", "p_retailprice"),
                                 [F.col("p_retailprice").asc(), F.col("p_partkey").asc()], 5))


@register("customers_without_orders")
def q_customers_without_orders(spark, sf):
    """Null filter on an outer result (customers with no order in 1996)."""
    c = tbl(spark, sf, "customer").select("c_custkey", "c_name")
    o = (tbl(spark, sf, "orders").where(F.year("o_orderdate") == 1996).groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
         .withColumnRenamed("o_custkey", "c_custkey"))
    return clean.null_rows(c.join(o, "c_custkey", "left"), "n_orders")


@register("group_mean_plus")
def q_group_mean_plus(spark, sf):
    """A1 + P4: group mean renamed, plus a constant column."""
    l = tbl(spark, sf, "lineitem")
    return rounded(aggs.group_mean(l, ["l_returnflag", "l_linestatus"], "l_extendedprice",
                                   "mean_price", plus=2.0, plus_col="price_limit"))


@register("priority_recode")
def q_priority_recode(spark, sf):
    """Recode a value set to one label, then count."""
    o = tbl(spark, sf, "orders")
    r = clean.recode(o, "o_orderpriority", ["1-URGENT", "2-HIGH"], "HIGH", "priority")
    return r.groupBy("priority").agg(F.count("*").alias("n"))


@register("text_numbers")
def q_text_numbers(spark, sf):
    """Text to number; unparsable strings dropped."""
    e = tbl(spark, sf, "events").select("event_id", F.substring("props", 7, 2).alias("raw"))
    return rounded(clean.numeric_or_drop(e, "raw", "num").select("event_id", "num"))


def _two_digit_dates(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = tbl(spark, sf, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    by = (F.col("c_custkey") % 90 + 10).cast("int")
    birth = F.format_string("%d/%d/%02d 08:30", (F.col("c_custkey") % 12 + 1).cast("int"),
                            (F.col("c_custkey") % 28 + 1).cast("int"), by)
    order = F.format_string("%d/%d/%02d 10:15", F.month("o_orderdate"),
                            F.dayofmonth("o_orderdate"), F.year("o_orderdate") % 100)
    return j.select("o_orderkey", birth.alias("birth_date"), order.alias("order_date"))


@register("age_from_dates")
def q_age_from_dates(spark, sf):
    """Age from two-digit-year date strings, age < 100 kept."""
    return clean.add_age(_two_digit_dates(spark, sf), "birth_date", "order_date")


@register("log_transform")
def q_log_transform(spark, sf):
    """Ln of several columns (null for <= 0)."""
    l = tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(clean.log_columns(l, ["l_discount", "l_tax"]))


@register("clamp_bounds")
def q_clamp_bounds(spark, sf):
    """Clamp to [0.001, 0.999] and the 0.9999 cap."""
    l = tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                          (F.col("l_discount") * 10).alias("x"),
                                          (F.col("l_tax") * 12.5).alias("y"))
    out = clean.clamp_columns(l, ["x"], lo=0.001, hi=0.999)
    return rounded(out.withColumn("y", pafx.cap_above("y", 0.9999)))


def _asfr_like(spark, sf):
    """(location, year, age 8..14, asfr) from orders: share of order value."""
    o = tbl(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = tbl(spark, sf, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return (j.select(F.col("c_nationkey").cast("int").alias("location_id"),
                     F.year("o_orderdate").cast("int").alias("year_id"),
                     (F.col("o_custkey") % 7 + 8).cast("int").alias("age_group_id"),
                     (F.col("o_totalprice") / 2000000.0).alias("asfr"))
             .groupBy("location_id", "year_id", "age_group_id")
             .agg(F.avg("asfr").alias("asfr")))


@register("asfr_scale_logit")
def q_asfr_scale_logit(spark, sf):
    """Bounds-scaled, clamped logit of ASFR for ages 8..14."""
    return rounded(clean.scale_logit(_asfr_like(spark, sf)))


@register("decade_bucket")
def q_decade_bucket(spark, sf):
    """Decade of the order year, counted."""
    o = tbl(spark, sf, "orders").select(F.year("o_orderdate").alias("year_id"))
    return (clean.add_decade(o, "year_id", "decade")
            .groupBy("decade").agg(F.count("*").alias("n")))


@register("spline_basis")
def q_spline_basis(spark, sf):
    """P16 + A18: piecewise-linear basis at (min, 6, 10, 14, max)."""
    c = tbl(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 500.0).alias("asmedu"))
    names = ["asmedu_below_6", "asmedu_between_6_10", "asmedu_between_10_14", "asmedu_above_14"]
    return rounded(clean.spline_basis(c, "asmedu", [6, 10, 14], names))


@register("unit_conversion")
def q_unit_conversion(spark, sf):
    """Per-5-years to per-1000-per-year, with a constant key column."""
    a = _asfr_like(spark, sf)
    return rounded(clean.rescale(a, "asfr", 1000.0 / 5, "asfr_per_1000", sex_id=2))


@register("signif_digits")
def q_signif_digits(spark, sf):
    """5 significant digits."""
    o = tbl(spark, sf, "orders").select("o_orderkey",
                                        (F.col("o_totalprice") / 7.0).alias("v"))
    return clean.signif_columns(o, ["v"], 5)


@register("message_outbox")
def q_message_outbox(spark, sf):
    """Templated messages, recipient address and send time."""
    c = tbl(spark, sf, "customer").select(
        "c_name", F.format_string("%02d:%02d:00", (F.col("c_custkey") % 24).cast("int"),
                                  (F.col("c_custkey") % 60).cast("int")).alias("time"))
    tpl = "Hi ${PERSON_NAME},\nThis is a reminder of your visit in 5 minutes."
    out = clean.outbox(c, tpl, {"PERSON_NAME": "c_name"}, "c_name", "example.com",
                       "time", run_date=F.lit("2024-01-02").cast("date"))
    return out.withColumn("send_at", F.date_format("send_at", "yyyy-MM-dd HH:mm:ss"))


@register("parameter_grid")
def q_parameter_grid(spark, sf):
    """P20: one job over a (cutoff x day) grid instead of a shell loop:
    events per day with value above each cutoff."""
    e = tbl(spark, sf, "events").select(F.to_date("ts").alias("day"), "value")
    j = clean.with_parameter_grid(e, cutoff=(0.0, 50.0, 10.0))
    j = j.where(F.col("value") > F.col("cutoff"))
    return (j.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "cutoff")
             .agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- joins

def _asfr_mean_age(spark, sf):
    a = _asfr_like(spark, sf)
    o = tbl(spark, sf, "orders").select("o_custkey", "o_orderdate")
    c = tbl(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = (o.join(c, o.o_custkey == c.c_custkey)
          .groupBy(F.col("c_nationkey").cast("int").alias("location_id"),
                   F.year("o_orderdate").cast("int").alias("year_id"))
          .agg(F.count("*").alias("n_orders")))
    return a, n


@register("inner_multi_key")
def q_inner_multi_key(spark, sf):
    """Inner equi-join on (location, year)."""
    a, n = _asfr_mean_age(spark, sf)
    return rounded(joins.inner(a, n, ["location_id", "year_id"]))


def _daily_events(spark, sf, kind):
    e = tbl(spark, sf, "events").where(F.col("event_type") == kind)
    return (e.groupBy("user_id", F.to_date("ts").alias("day"))
             .agg(F.avg("value").alias("value")))


@register("join_renamed_keys")
def q_join_renamed_keys(spark, sf):
    """Join on differently named keys (user_id, view_day) =
    (buyer_id, buy_day); the right key columns are dropped."""
    v = _daily_events(spark, sf, "view").withColumnsRenamed(
        {"day": "view_day", "value": "view_value"})
    p = _daily_events(spark, sf, "purchase").withColumnsRenamed(
        {"user_id": "buyer_id", "day": "buy_day"})
    out = joins.on_pairs(v, p, [("user_id", "buyer_id"), ("view_day", "buy_day")])
    return rounded(out.withColumn("view_day", F.date_format("view_day", "yyyy-MM-dd")))


@register("self_join_suffix")
def q_self_join_suffix(spark, sf):
    """Two subsets of one table joined on keys; clashing columns get
    suffixes _x / _y."""
    e = tbl(spark, sf, "events")
    daily = (e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
              .agg(F.avg("value").alias("value")))
    a = daily.where(F.col("event_type") == "view")
    b = daily.where(F.col("event_type") == "click")
    return rounded(joins.self_join(a, b, ["user_id", "day"]))


@register("region_lookup")
def q_region_lookup(spark, sf):
    """Lookup joins against bounded dimensions (nation, region)."""
    c = tbl(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = tbl(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = tbl(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions
    j = joins.lookup(joins.lookup(c, n, ["c_nationkey"]), r, ["n_regionkey"])
    return j.groupBy("r_name").agg(F.sum("n").alias("n_customers"))


@register("anti_pairs")
def q_anti_pairs(spark, sf):
    """(cause, risk) pairs minus a pair list."""
    pairs = views.demography(spark, sf, with_risk=True).select("acause", "risk").distinct()
    drop = (tbl(spark, sf, "part").where(F.col("p_type").startswith("E"))
            .select(F.col("p_type").alias("acause")).distinct()
            .withColumn("risk", F.lit("1-URGENT")))
    return joins.anti(pairs, drop, ["acause", "risk"])


@register("semi_by_list")
def q_semi_by_list(spark, sf):
    """Orders of customers in one segment (semi-join), counted."""
    o = tbl(spark, sf, "orders")
    seg = (tbl(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
           .select(F.col("c_custkey").alias("o_custkey")))
    return (joins.semi(o, seg, ["o_custkey"])
            .groupBy("o_orderpriority").agg(F.count("*").alias("n")))


def _addresses(spark, sf):
    c = tbl(spark, sf, "customer")
    addr = c.select("c_custkey", F.col("c_name").alias("address"))
    gaz = (c.where(F.col("c_acctbal") > 0)
            .select(F.col("c_name").alias("address"), (F.col("c_acctbal") / 125.0).alias("lat"),
                    (F.col("c_custkey") % 360 - 180).cast("double").alias("lng")))
    return addr, gaz


# Fixed value: the anchor point of the distance job (latitude, longitude);
# the longitude sign is corrected to the western hemisphere.
ANCHOR = (38.8976763, -77.0387185)


@register("geocode_distance")
def q_geocode_distance(spark, sf):
    """J10 + X7: address -> coordinates (null when unknown), then the
    great-circle distance to the anchor in km."""
    addr, gaz = _addresses(spark, sf)
    g = joins.geocode(addr, gaz)
    d = numeric.haversine_km("lat", "lng", F.lit(ANCHOR[0]), F.lit(ANCHOR[1]))
    return rounded(g.withColumn("distance_km", d))


@register("vincenty_distance")
def q_vincenty_distance(spark, sf):
    """X7 precise mode: ellipsoid distance (Vincenty) to the anchor."""
    addr, gaz = _addresses(spark, sf)
    g = joins.geocode(addr, gaz).where(F.col("lat").isNotNull())
    return rounded(numeric.add_vincenty_km(g, "lat", "lng", F.lit(ANCHOR[0]),
                                           F.lit(ANCHOR[1])))


# ---------------------------------------------------------------- aggregates

@register("word_frequency")
def q_word_frequency(spark, sf):
    """A2: count per array element (words of whole documents), by count."""
    d = tbl(spark, sf, "documents").select(F.split("text", " ").alias("words"))
    return aggs.element_frequency(d, "words", "word")


@register("group_sums")
def q_group_sums(spark, sf):
    """A3: group sums of several value columns."""
    l = tbl(spark, sf, "lineitem")
    return rounded(aggs.group_sums(l, ["l_returnflag", "l_linestatus"],
                                   ["l_quantity", "l_extendedprice", "l_discount"]))


@register("quantity_quantiles")
def q_quantity_quantiles(spark, sf):
    """Median and 90th percentile of a bounded-domain column (exact)."""
    l = tbl(spark, sf, "lineitem")
    return rounded(aggs.column_quantiles(l, "l_quantity", (0.5, 0.9), names=["median", "p90"]))


@register("top10_price")
def q_top10_price(spark, sf):
    """The 10 largest values (tie-broken)."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(aggs.top_n(o, "o_totalprice", 10, ["o_orderkey"]))


@register("distinct_values")
def q_distinct_values(spark, sf):
    """A10: distinct values."""
    return aggs.sorted_distinct(tbl(spark, sf, "orders"), "o_orderpriority")


@register("corr_matrix")
def q_corr_matrix(spark, sf):
    """Pairwise-complete correlation matrix (long form)."""
    l = tbl(spark, sf, "lineitem")
    return rounded(aggs.correlation_matrix(l, ["l_quantity", "l_extendedprice",
                                              "l_discount", "l_tax"]))


@register("key_of_max")
def q_key_of_max(spark, sf):
    """Customer with the highest balance per segment."""
    c = tbl(spark, sf, "customer")
    return rounded(aggs.key_of_max(c, "c_custkey", "c_acctbal", ["c_mktsegment"]))


@register("price_histogram")
def q_price_histogram(spark, sf):
    """10 fixed-width bins over [min, max] per status."""
    o = tbl(spark, sf, "orders")
    return rounded(aggs.histogram(o, "o_totalprice", 10, ["o_orderstatus"]))


@register("group_share")
def q_group_share(spark, sf):
    """Value / rows in its group."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(aggs.group_share(o, ["o_orderpriority"], "o_totalprice", "share"))


@register("min_max")
def q_min_max(spark, sf):
    """Global min/max of a covariate."""
    return rounded(aggs.min_max(tbl(spark, sf, "customer"), "c_acctbal"))


@register("box_stats")
def q_box_stats(spark, sf):
    """Quartiles and whiskers per level."""
    l = tbl(spark, sf, "lineitem")
    return rounded(aggs.box_stats(l, "l_returnflag", "l_quantity"))


# ---------------------------------------------------------------- windows

@register("next_age_value")
def q_next_age_value(spark, sf):
    """Value of the next age group within a location and year (shift(-1))."""
    a = _asfr_like(spark, sf)
    return rounded(windows.shift(a, ["location_id", "year_id"], ["age_group_id"], "asfr", -1,
                                 "asfr_next"))


@register("dedupe_first")
def q_dedupe_first(spark, sf):
    """Latest order per customer, tie-broken by order key."""
    o = tbl(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    out = windows.dedupe_first(o, ["o_custkey"], [("o_orderdate", True), "o_orderkey"])
    return rounded(out.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")))


@register("repeated_rows")
def q_repeated_rows(spark, sf):
    """Rows repeating a key (all but the first)."""
    e = tbl(spark, sf, "events").select("event_id", "user_id", "event_type",
                                        F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return windows.repeated_rows(e, ["user_id", "event_type", "day"], ["event_id"])


# ---------------------------------------------------------------- reshape

@register("bind_missing_columns")
def q_bind_missing_columns(spark, sf):
    """Row-bind with missing columns filled with null."""
    a = _asfr_like(spark, sf).where(F.col("year_id") < 1996)
    b = (_asfr_like(spark, sf).where(F.col("year_id") >= 1996)
         .withColumn("forecast", F.lit(True)).drop("asfr")
         .withColumn("asfr_mean", F.lit(0.5)))
    return rounded(reshape.bind_rows(a, b))


@register("pivot_event_types")
def q_pivot_event_types(spark, sf):
    """Long -> wide mean value per event type, names cleaned."""
    e = tbl(spark, sf, "events").select("user_id", "event_type", "value")
    return rounded(reshape.long_to_wide(e, ["user_id"], "event_type", "value",
                                        values=["view", "click", "error", "signup", "purchase"],
                                        prefix="v_"))


@register("unpivot_draws")
def q_unpivot_draws(spark, sf):
    """Wide draw columns -> long (draw number parsed from the name)."""
    sev = views.sev_by_risk(spark, sf)
    wide = reshape.long_to_wide(sev, ["risk", "location_id", "year_id"], "draw", "sev",
                                values=list(range(1, 8)), prefix="draw_")
    return rounded(reshape.wide_to_long(wide, ["risk", "location_id", "year_id"], "draw_",
                                        "draw", "sev").where(F.col("sev").isNotNull()))


@register("nested_to_long")
def q_nested_to_long(spark, sf):
    """Nested array (8 x 8 blocks of an embedding) -> labelled rows."""
    e = tbl(spark, sf, "embeddings")
    nested = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)),
                      lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("blocks"))
    out = reshape.nested_to_long(nested, ["vec_id"], "blocks", [("block", 0), ("pos", 1)])
    return rounded(out.withColumn("value", F.col("value").cast("double")))


@register("array_product")
def q_array_product(spark, sf):
    """Element-wise product of two draw vectors (zip_with), summed."""
    e = tbl(spark, sf, "embeddings")
    a = F.transform("embedding", lambda x: x.cast("double"))
    prod = F.zip_with(a, F.reverse(a), lambda x, y: x * y)
    return rounded(e.select("vec_id", F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)
                            .alias("dot"), prod[0].alias("first")))


@register("ratio_filter")
def q_ratio_filter(spark, sf):
    """Ratio num * 1.0 / den kept in [0.18, 181]."""
    l = tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                          numeric.ratio("l_tax", "l_discount").alias("ratio"))
    return rounded(l.where(F.col("ratio").between(0.18, 181)))


@register("poisson_mass")
def q_poisson_mass(spark, sf):
    """Poisson mass for k = 1..20 at each event type's rate per user."""
    e = tbl(spark, sf, "events")
    lam = e.groupBy("event_type").agg(
        (F.count("*") / F.count_distinct("user_id")).alias("lam"))
    k = lam.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return rounded(k.withColumn("pmf", numeric.poisson_pmf("lam", "k")))


@register("props_json")
def q_props_json(spark, sf):
    """JSON text column parsed with a schema; counted per key value."""
    from ..sources.readers import parse_json_column
    e = tbl(spark, sf, "events").select("props")
    p = parse_json_column(e, "props", T.StructType([T.StructField("k", T.IntegerType())]))
    return p.groupBy("k").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- population

def _under_one_inputs(spark, sf):
    """Population, weekly nqx and births for every (location, year, sex,
    draw) from one aggregate of orders x customer (checkpointed: it feeds
    all three inputs)."""
    from ..session import cut_lineage
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = tbl(spark, sf, "customer").select("c_custkey", "c_nationkey")
    keys = ["location_id", "year_id", "sex_id", "draw"]
    base = cut_lineage(
        o.join(c, o.o_custkey == c.c_custkey)
         .groupBy(F.col("c_nationkey").cast("int").alias("location_id"),
                  F.year("o_orderdate").cast("int").alias("year_id"),
                  (F.col("o_orderkey") % 2 + 1).cast("int").alias("sex_id"),
                  (F.col("o_custkey") % 5).cast("int").alias("draw"))
         .agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice") / 100000.0).alias("births")))
    band = F.inline(F.array(*[F.struct(F.lit(a).alias("age"), F.lit(g).alias("age_group_id"),
                                       F.lit(hi - lo + 1).alias("weeks"))
                              for a, g, lo, hi in joins.WEEK_BANDS]))
    pop = (base.select("*", band)
           .withColumn("pop", F.col("n") * F.col("weeks"))
           .select(*keys, "age", "age_group_id", "pop"))
    # weekly death probability of the band, from the cohort's own data
    q = (F.lit(0.0005) + F.lit(0.0001) * F.col("age_group_id") +
         F.lit(0.00001) * (F.col("pop") % 10))
    nqx = pop.withColumn("q", q).select(*keys, "age", "q")
    return pop, nqx, base.select(*keys, "births")


@register("under_one_population")
def q_under_one_population(spark, sf):
    """T10 (J11, A17, W2, A3): under-one population one year ahead for every
    location, year, sex and draw at once."""
    from . import population
    pop, nqx, births = _under_one_inputs(spark, sf)
    return rounded(population.under_one_step(pop, nqx, births))


@register("replicate_weeks")
def q_replicate_weeks(spark, sf):
    """Rows replicated per band week (enn 1, lnn 3, pnn 48), counted."""
    pop, _nqx, _b = _under_one_inputs(spark, sf)
    r = joins.replicate_by_band(pop, joins.week_bands(spark).drop("age_group_id"))
    return r.groupBy("age").agg(F.count("*").alias("n_rows"),
                                F.max("age_wks").alias("last_week"))


@register("births_by_sex_draw")
def q_births_by_sex_draw(spark, sf):
    """Column sum per (sex, draw) over all rows."""
    _p, _q, births = _under_one_inputs(spark, sf)
    return rounded(aggs.group_sums(births, ["sex_id", "draw"], ["births"]))


# ---------------------------------------------------------------- exposure

def _exposure_rows(spark, sf):
    l = tbl(spark, sf, "lineitem")
    return l.select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("draw"),
                    F.col("l_quantity").alias("exp_mean"),
                    (F.col("l_quantity") * 0.3 + 1.0).alias("exp_sd"),
                    (F.lit(1.01) + F.col("l_tax")).alias("rr_mean"),
                    (F.lit(1.5) + F.col("l_discount") * 10).alias("rr_max"),
                    F.lit(20.0).alias("tmrel"), F.lit(0.0).alias("integ_min"),
                    F.lit(100.0).alias("integ_max"),
                    (F.col("l_linenumber") % 2).cast("int").alias("flag"))


@register("sev_integral")
def q_sev_integral(spark, sf):
    """T6 + X8: SEV and PAF by an integral of RR x density in normal scores."""
    from . import exposure
    out = exposure.sev_integral(_exposure_rows(spark, sf))
    return rounded(out.select("row_id", "draw", "integral", "sev", "paf"))


@register("exposure_density")
def q_exposure_density(spark, sf):
    """Lognormal density and capped RR curve at the exposure mean."""
    e = _exposure_rows(spark, sf)
    x = F.col("exp_mean") * 0.8
    return rounded(e.select("row_id", "draw",
                            numeric.lognormal_pdf(x, "exp_mean", "exp_sd").alias("density"),
                            numeric.relative_risk(x, "rr_mean", "rr_max", "tmrel",
                                                  F.col("flag") == 1).alias("rr")))


# ---------------------------------------------------------------- fertility

@register("cohort_lag")
def q_cohort_lag(spark, sf):
    """Cohort lag (age a, year t) <- (a-1, t-5), both present."""
    from . import fertility
    return rounded(fertility.cohort_lag(_asfr_like(spark, sf), "asfr"))


@register("arc_forecast")
def q_arc_forecast(spark, sf):
    """Weighted annual-rate-of-change forecast, past + 5 years."""
    from . import fertility
    a = _asfr_like(spark, sf)
    return rounded(fertility.arc_forecast(a, ["location_id", "age_group_id"], "asfr",
                                          1995, 2000, 5))


# ---------------------------------------------------------------- labs / SQL view

@register("lab_ratio_pipeline")
def q_lab_ratio_pipeline(spark, sf):
    """Two test kinds per (subject, day), duplicates averaged (O6),
    self-join (J6), ratio (X3) kept in [0.18, 181], elevated flag (M24)."""
    from . import labs
    e = tbl(spark, sf, "events")
    return rounded(labs.ratio_table(e))


@register("sql_over_view")
def q_sql_over_view(spark, sf):
    """Temp view + SQL over it."""
    l = tbl(spark, sf, "lineitem")
    mean_price = aggs.group_mean(l, ["l_returnflag", "l_linestatus"], "l_extendedprice",
                                 "mean_price", plus=2.0, plus_col="price_limit")
    name = "mean_price_view"
    mean_price.createOrReplaceTempView(name)
    return rounded(spark.sql(f"SELECT * FROM {name} WHERE price_limit > 0"))


# ---------------------------------------------------------------- statistics

@register("ols_by_panel")
def q_ols_by_panel(spark, sf):
    """M1: slope, intercept, R^2 of price on quantity per return flag."""
    l = tbl(spark, sf, "lineitem")
    return rounded(stats.ols_simple(l, "l_extendedprice", "l_quantity", ["l_returnflag"]))


@register("grouped_ols")
def q_grouped_ols(spark, sf):
    """M3: OLS with two predictors per group (sufficient statistics +
    per-group solve), coefficients only."""
    l = tbl(spark, sf, "lineitem")
    c = stats.ols_grouped(l, "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"])
    return rounded(c.select("l_returnflag", "term", "estimate"), 4)


@register("grouped_ols_predict")
def q_grouped_ols_predict(spark, sf):
    """M3: predictions and residuals for all rows from the group fits."""
    l = tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                          "l_extendedprice", "l_quantity", "l_discount")
    xs = ["l_quantity", "l_discount"]
    c = stats.ols_grouped(l, "l_extendedprice", xs, ["l_returnflag"])
    p = stats.predict(l, c, "l_extendedprice", xs, ["l_returnflag"])
    return rounded(p.select("l_orderkey", "l_linenumber", "pred", "resid"), 3)


@register("t_statistic")
def q_t_statistic(spark, sf):
    """M4: pooled two-sample t statistic of event value, view vs purchase."""
    e = tbl(spark, sf, "events")
    return rounded(stats.two_sample_stats(e, "value", "event_type", "view", "purchase"))


@register("t_test")
def q_t_test(spark, sf):
    """M4: the same test with its two-sided p-value."""
    e = tbl(spark, sf, "events")
    return rounded(stats.t_test(e, "value", "event_type", "view", "purchase"))


@register("residual_autocorr")
def q_residual_autocorr(spark, sf):
    """OLS of daily mean price on daily count, then the lag-1 fit of the
    residuals (ordered by day)."""
    o = tbl(spark, sf, "orders")
    d = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.avg("o_totalprice").alias("y"), F.count("*").cast("double").alias("x"))
    fit = stats.ols_simple(d, "y", "x").first()
    r = d.withColumn("resid", F.col("y") - (F.lit(fit["intercept"]) + F.lit(fit["slope"]) * F.col("x")))
    pairs = windows.lag_pairs(r, "day", "resid")
    return rounded(stats.ols_simple(pairs, "next_resid", "resid"), 4)


@register("standardized_ols")
def q_standardized_ols(spark, sf):
    """OLS on population-sd z-scores (slope = correlation)."""
    l = tbl(spark, sf, "lineitem")
    z = stats.standardize(l, ["l_quantity", "l_extendedprice"])
    return rounded(stats.ols_simple(z, "z_l_extendedprice", "z_l_quantity"))


def _bernoulli(spark, sf, portable):
    from ..operators import draws
    l = tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                          (F.col("l_discount") * 10).alias("p"))
    row_key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = draws.bernoulli_counts(l, "p", row_key, 100 if portable else 1000, seed=3, portable=portable)
    return rounded(out.drop("l_partkey", "l_suppkey"))


@register("bernoulli_draws")
def q_bernoulli_draws(spark, sf):
    """M8: 1000 Bernoulli draws per row from p = 10 x discount (row seed from
    xxhash64, splitmix64 draws), counted per row without exploding them."""
    return _bernoulli(spark, sf, portable=False)


@register("bernoulli_draws_portable")
def q_bernoulli_draws_portable(spark, sf):
    """M8 with the portable md5 uniforms, reproducible by any SQL engine
    (slower: one md5 of a key string per draw, in numpy blocks)."""
    return _bernoulli(spark, sf, portable=True)


@register("bootstrap_power")
def q_bootstrap_power(spark, sf):
    """M5: parametric bootstrap power of the t-test with the observed group
    sizes, means and pooled sd of view vs purchase values."""
    e = tbl(spark, sf, "events")
    r = stats._two_sample(e, "value", "event_type", "view", "purchase").first()
    return rounded(stats.bootstrap_power(int(r["n1"]), int(r["n2"]), r["mean1"], r["mean2"],
                                         r["pooled_sd"], spark, n_boot=1000, alpha=0.5, seed=11,
                                         method="moments"))


@register("poisson_sample_means")
def q_poisson_sample_means(spark, sf):
    """M6: sampling distribution of Poisson means (1000 reps) at each event
    type's daily rate per user, for n = 10, 100 and n = the type's number of
    users (so the work grows with the data), summarised per (type, n)."""
    e = tbl(spark, sf, "events")
    lam = e.groupBy("event_type").agg(
        (F.count("*") / (F.count_distinct("user_id") * 30.0)).alias("lam"),
        F.count_distinct("user_id").alias("n_users"))
    m = stats.poisson_means(spark, lam, "lam", [10, 100, "n_users"], reps=1000, seed=5,
                            by=["event_type"], method="totals")
    return rounded(m.groupBy("event_type", "lam", "n").agg(
        F.avg("mean").alias("mean_of_means"), F.var_samp("mean").alias("var_of_means"),
        F.count("*").alias("reps")), 4)


# ---------------------------------------------------------------- models

def _asfr_covariates(spark, sf, materialize: bool = True):
    """Model table (location, year, age): ASFR, log ASFR, ldi, edu.

    One pass over orders x customer aggregated to (location, year, age);
    the (location, year) covariates are a second aggregate of that small
    table.  The result has several consumers (train, future, levels), so it
    is checkpointed to the shared checkpoint folder.
    """
    from ..session import cut_lineage
    o = tbl(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = tbl(spark, sf, "customer").select("c_custkey", "c_nationkey")
    cell = (o.join(c, o.o_custkey == c.c_custkey)
             .groupBy(F.col("c_nationkey").cast("int").alias("location_id"),
                      F.year("o_orderdate").cast("int").alias("year_id"),
                      (F.col("o_custkey") % 7 + 8).cast("int").alias("age_group_id"))
             .agg((F.avg("o_totalprice") / 2000000.0).alias("asfr"),
                  F.count("*").alias("__n"), F.sum("o_totalprice").alias("__s")))
    cov = (cell.groupBy("location_id", "year_id")
               .agg((F.sum("__s") / F.sum("__n") / 100000.0).alias("ldi"),
                    F.log(F.sum("__n").cast("double")).alias("edu")))
    out = (cell.drop("__n", "__s").join(cov, ["location_id", "year_id"], "inner")
               .withColumn("log_asfr", numeric.safe_ln("asfr")))
    return cut_lineage(out) if materialize else out


@register("mixed_model_asfr")
def q_mixed_model_asfr(spark, sf):
    """M9: log ASFR ~ ldi + edu + (1 | location), one REML model per age
    group, trained on years before the 1999 holdout."""
    from ..operators import mixed
    d = _asfr_covariates(spark, sf).where(F.col("year_id") < 1999)
    fit = mixed.mixed_model(d, "log_asfr", ["ldi", "edu"], ["location_id"], ["age_group_id"])
    return rounded(fit.where(F.col("kind") != "blup").drop("vcov", "level"), 4)


@register("crossed_mixed_model")
def q_crossed_mixed_model(spark, sf):
    """Two crossed random intercepts (age group, region), ML fit."""
    from ..operators import mixed
    d = views.demography(spark, sf, with_cause=False)
    n = tbl(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("location_id"),
                                        F.col("n_regionkey").alias("region_id"))
    d = (d.join(n, "location_id")
          .select("age_group_id", "region_id", F.col("sev").alias("sdi"),
                  F.log(F.col("l_extendedprice") / 1000.0).alias("log_rate")))
    fit = mixed.mixed_model(d, "log_rate", ["sdi"], ["age_group_id", "region_id"], reml=False)
    return rounded(fit.drop("vcov"), 4)


@register("asfr_forecast_draws")
def q_asfr_forecast_draws(spark, sf):
    """T11 (M9, M11, M13): 1000 draws of log ASFR for the forecast years with
    covariate draws paired by draw, summarised per (location, year, age) as mean
    and 95% interval (A7)."""
    from . import forecast
    d = _asfr_covariates(spark, sf)
    train = d.where(F.col("year_id") < 1999)
    future = d.where(F.col("year_id") >= 1999).select("location_id", "year_id",
                                                      "age_group_id", "ldi", "edu")
    # covariate draws: 5 % noise around each location-year's value, the same for all its ages
    future = future.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(999))))
    for k, x in enumerate(("ldi", "edu")):
        z = randoms.hash_normal("location_id", "year_id", "draw", seed=29, stream=k)
        future = future.withColumn(x, F.col(x) * (1 + 0.05 * z))
    pred = forecast.forecast_draws(train, future, "log_asfr", ["ldi", "edu"], "location_id",
                                   ["age_group_id"], n_draws=1000, seed=17)
    return rounded(aggs.draw_summary(pred, ["location_id", "year_id", "age_group_id"], "pred"), 4)


@register("random_effect_draws")
def q_random_effect_draws(spark, sf):
    """1000 Normal(BLUP, sigma_u) draws per location and age model,
    summarised as mean and 95% interval (A7)."""
    from . import forecast
    from ..operators import mixed
    d = _asfr_covariates(spark, sf)
    fit = mixed.mixed_model(d.where(F.col("year_id") < 1999), "log_asfr", ["ldi", "edu"], ["location_id"],
                            ["age_group_id"])
    levels = d.select("age_group_id", "location_id").distinct()
    re = forecast.random_effect_draws(fit, levels, ["age_group_id"], "location_id", 1000, seed=18)
    return rounded(aggs.draw_summary(re, ["age_group_id", "location_id"], "re"), 4)


@register("model_comparison")
def q_model_comparison(spark, sf):
    """M2 + P18: three fits (lin-lin, log-lin, log-log) with slope,
    intercept, R^2 and p-values, 5 significant digits."""
    y, x = F.col("l_extendedprice"), F.col("l_quantity").cast("double")
    log_y, log_x = numeric.safe_ln("l_extendedprice"), numeric.safe_ln("l_quantity")
    specs = [("lm1", y, x), ("lm2", log_y, x), ("lm3", log_y, log_x)]
    # one scan: every row gives its (model, y, x) triples, which the map side reduces
    rows = (tbl(spark, sf, "lineitem")
            .select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), v.alias("y"), u.alias("x"))
                                        for m, v, u in specs])).alias("r")).select("r.*"))
    w = (stats.ols_grouped(rows, "y", ["x"], by=["model"]).groupBy("model").pivot("term", ["intercept", "x"])
         .agg(F.first("estimate").alias("est"), F.first("p_value").alias("p"), F.first("r2").alias("r2")))
    out = w.select("model", F.col("x_est").alias("slope"), F.col("intercept_est").alias("intercept"),
                   F.col("x_r2").alias("r_sq"), F.col("x_p").alias("p_slope"),
                   F.col("intercept_p").alias("p_intercept"))
    return clean.signif_columns(out, ["slope", "intercept", "r_sq", "p_slope", "p_intercept"])


def _embedding_frame(spark, sf):
    from ..operators import learn
    e = tbl(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return learn.array_features(e, "embedding")


def _two_class_frame(spark, sf):
    """All labels as two classes: odd or even."""
    return _embedding_frame(spark, sf).withColumn("label", F.col("label") % 2)


@register("logistic_formula")
def q_logistic_formula(spark, sf):
    """M7 + M8: logistic model with categorical terms, then 1000 Bernoulli
    draws per row from its probability, summarised per category."""
    from ..operators import draws, learn
    l = tbl(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
        F.year("l_shipdate").cast("string").alias("ship_year"), "l_discount", "l_tax",
        (F.col("l_returnflag") == "R").cast("double").alias("label"))
    _m, pred = learn.logistic_formula(l, "label ~ l_linestatus + ship_year + l_discount + l_tax")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    dr = draws.bernoulli_counts(pred, "p", keys, 1000, seed=23)
    return rounded(dr.groupBy("l_linestatus", "ship_year").agg(
        F.avg("p").alias("mean_p"), F.avg(F.col("n_events") / 1000.0).alias("draw_rate"),
        F.avg("label").alias("observed")), 4)


@register("lasso_fit")
def q_lasso_fit(spark, sf):
    """Lasso (alpha 0.1) of the price on four line features; every
    coefficient (0 for those it leaves out) and the intercept."""
    from ..operators import learn
    xs = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    l = tbl(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000.0).alias("y"), *xs)
    m = learn.lasso(learn.assemble(l, xs), "y", alpha=0.1)
    coefs = list(zip([*xs, "intercept"], [*map(float, m.coefficients.toArray()), float(m.intercept)]))
    return rounded(spark.createDataFrame(coefs, "feature string, coef double"), 4)


@register("classifier_accuracy")
def q_classifier_accuracy(spark, sf):
    """M17 + M18 + M23: binary subset (labels 0/1) and its two feature columns,
    hash 70/30 split, logistic / random forest / linear and radial SVM accuracies."""
    from ..operators import learn
    e = learn.binary_subset(_embedding_frame(spark, sf), "label")
    train, test = learn.hash_split(e, ["id"], 0.7, seed=1)
    preds = learn.classifiers(train, test, features="features2", seed=1,
                              models=("logistic", "forest", "svm", "rbf_svm"))
    return rounded(preds.groupBy("model").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count("*").alias("n")), 4)


@register("ensemble_vote")
def q_ensemble_vote(spark, sf):
    """Hard vote of a logistic model, a forest and a radial SVM (ties -> smallest label) on all
    labels recoded to two classes, accuracy of the vote."""
    from ..operators import learn
    e = _two_class_frame(spark, sf)
    train, test = learn.hash_split(e, ["id"], 0.7, seed=1)
    vote = learn.hard_vote(learn.classifiers(train, test, seed=1, models=("logistic", "forest", "rbf_svm")))
    return rounded(learn.accuracy(vote), 4)


@register("tree_grid_search")
def q_tree_grid_search(spark, sf):
    """3-fold cross-validated depth of a decision tree on all labels."""
    from ..operators import learn
    cv = learn.grid_search_tree(_embedding_frame(spark, sf), depths=(1, 2, 3), seed=2)
    rows = [(int(pm[list(pm)[0]]), float(m)) for pm, m in
            zip(cv.getEstimatorParamMaps(), cv.avgMetrics)]
    return rounded(spark.createDataFrame(rows, "max_depth int, cv_accuracy double"), 4)


@register("vote_grid_search")
def q_vote_grid_search(spark, sf):
    """M20 + M19: 5-fold cross-validated accuracy of the hard vote for all 18 combinations of
    2 forest sizes, 3 C of the radial SVM and 3 C of the logistic model, on all labels recoded to
    two classes."""
    from ..operators import learn
    return rounded(learn.grid_search_vote(_two_class_frame(spark, sf), seed=2, kernel="rbf"), 4)


@register("bagged_trees")
def q_bagged_trees(spark, sf):
    """M21 + M19: 1000 depth-2 trees on 100-row subsets; mean single-tree
    accuracy and the accuracy of their majority vote, on all labels recoded to two
    classes."""
    from ..operators import learn
    e = _two_class_frame(spark, sf)
    train, test = learn.hash_split(e, ["id"], 0.7, seed=4)
    got = learn.bagged_trees(train, test, 1000, 100, seed=4)
    single = F.avg(F.get("votes", F.col("label")) / 1000.0)
    vote = F.avg((learn.vote_winner() == F.col("label")).cast("double"))
    out = got.agg(single.alias("mean_single_accuracy"), vote.alias("vote_accuracy"))
    return rounded(out.unpivot([], ["mean_single_accuracy", "vote_accuracy"], "metric", "value"), 4)


@register("precision_recall")
def q_precision_recall(spark, sf):
    """Logistic classifier at threshold 0.5, all labels recoded to two
    classes: precision and recall."""
    from pyspark.ml.classification import LogisticRegression
    from ..operators import learn
    e = _two_class_frame(spark, sf)
    train, test = learn.hash_split(e, ["id"], 0.8, seed=5)
    m = LogisticRegression(threshold=0.5).fit(train)
    return rounded(learn.precision_recall(m.transform(test)), 4)


# ---------------------------------------------------------------- more clean-up / reshape

@register("prefix_columns")
def q_prefix_columns(spark, sf):
    """Keys plus the columns named draw_<n> of a wide draw table."""
    sev = views.sev_by_risk(spark, sf)
    wide = reshape.long_to_wide(sev, ["risk", "location_id", "year_id"], "draw", "sev",
                                values=list(range(1, 8)), prefix="draw_")
    wide = wide.withColumn("n_cells", F.lit(7))
    return rounded(clean.columns_by_prefix(wide, "draw_", ["risk", "location_id", "year_id"]))


@register("drop_incomplete")
def q_drop_incomplete(spark, sf):
    """P5: rows with any null dropped (addresses without coordinates)."""
    addr, gaz = _addresses(spark, sf)
    return rounded(clean.drop_incomplete(joins.geocode(addr, gaz)))


@register("outer_fill")
def q_outer_fill(spark, sf):
    """J3 + J4 + P6: outer join on risk, draw and the demography keys the RR
    side has; missing SEV -> 0 and missing RR -> 1."""
    sev, rr, _med = views.paf_inputs(spark, sf)
    rr = scalars.load_rrmax(rr)
    j = joins.outer_on_available(sev, rr, ["location_id", "year_id"], always=["risk", "draw"])
    return rounded(clean.fill_groups(j, {0.0: ["sev"], 1.0: ["rr"]}))


@register("normalize_names")
def q_normalize_names(spark, sf):
    """P10: lower-cased, regex-edited column names and a regex value edit."""
    p = tbl(spark, sf, "part").toDF("P_PartKey", "P_Name", "P_Brand", "P_Type", "P_Size",
                                    "P_RetailPrice")
    p = clean.normalize_names(p, r"^p_", "")
    return rounded(clean.replace_values(p, "brand", r"Brand#", "B-"))


@register("drop_position")
def q_drop_position(spark, sf):
    """Drop the 3rd row of an explicit order within each nation."""
    c = tbl(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(clean.drop_position(c, 3, [F.col("c_acctbal").desc(), F.col("c_custkey")],
                                       ["c_nationkey"]))


@register("sort_nulls_last")
def q_sort_nulls_last(spark, sf):
    """O2: multi-key sort (priority ascending, price descending, nulls last)."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(reshape.sort_nulls_last(o, "o_orderpriority", "o_totalprice", "o_orderkey",
                                           descending=("o_totalprice",)))


@register("modelling_table")
def q_modelling_table(spark, sf):
    """ASFR x education x met demand, scaled logit, decade, region
    lookup and the education spline in one table."""
    from . import fertility
    asfr = _asfr_like(spark, sf)
    o = tbl(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = tbl(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").cast("int").alias("location_id"),
        F.year("o_orderdate").cast("int").alias("year_id"),
        (F.col("o_custkey") % 7 + 8).cast("int").alias("age_group_id"), "c_acctbal", "o_totalprice")
    keys = ["location_id", "year_id", "age_group_id"]
    edu = j.groupBy(*keys).agg((F.avg("c_acctbal") / 500.0).alias("asmedu"))
    met = j.groupBy(*keys).agg((F.avg("o_totalprice") / 600000.0).alias("met_demand"))
    locs = tbl(spark, sf, "nation").select(
        F.col("n_nationkey").cast("int").alias("location_id"),
        F.col("n_regionkey").alias("region_id"),
        F.floor(F.col("n_regionkey") / 2).cast("int").alias("super_region_id"))
    return rounded(fertility.modelling_table(asfr, edu, met, locs))


@register("sequential_lag_forecast")
def q_sequential_lag_forecast(spark, sf):
    """Section 3.3: age/period-lag OLS forecast of log ASFR, year blocks for
    the first age then age by age (1-year steps on the 1995-2001 data)."""
    from . import fertility
    d = _asfr_covariates(spark, sf)
    out = fertility.sequential_lag_forecast(d.select("location_id", "year_id", "age_group_id",
                                                     "log_asfr", "ldi", "edu"),
                                            "log_asfr", ["ldi", "edu"], 1999, 2001, step=1,
                                            ages=list(range(8, 15)))
    return rounded(out.select("location_id", "year_id", "age_group_id", "log_asfr",
                              "forecast"), 4)


@register("elevated_subset_fit")
def q_elevated_subset_fit(spark, sf):
    """M24 (+ M1, A13): within the elevated subset of the lab ratio table
    (ratio >= 1.5), per sex group: OLS of the numerator on the denominator
    test and their correlation."""
    from . import labs
    t = labs.ratio_table(tbl(spark, sf, "events"))
    t = t.withColumn("gender", F.when(F.col("user_id") % 2 == 0, F.lit("F")).otherwise(F.lit("M")))
    sub = t.where(F.col("ratio") >= 1.5)
    fit = stats.ols_simple(sub, "purchase", "view", ["gender"])
    corr = sub.groupBy("gender").agg(F.corr("purchase", "view").alias("corr"))
    return rounded(fit.join(corr, "gender"))


@register("arc_scenarios")
def q_arc_scenarios(spark, sf):
    """T9 scenarios: forecasts at the 15th/85th percentile rates across
    locations (per age) next to each location's own rate."""
    from . import fertility
    a = _asfr_like(spark, sf)
    return rounded(fertility.arc_scenarios(a, ["location_id", "age_group_id"], "location_id",
                                           "asfr", 1995, 2000, 5))


@register("cluster_scalar")
def q_cluster_scalar(spark, sf):
    """T5 per risk cluster: A11 clusters of each cause's risks (levels 1-2 of
    the priority tree), then combine / cap / rescale per (cause, cluster,
    version)."""
    inputs = views.paf_inputs(spark, sf)
    paf = _paf_long(spark, sf, inputs)
    pairs = inputs[1].select("acause", "risk").distinct()
    clusters = aggs.hierarchy_clusters(pairs, views.priority_hierarchy(spark, sf), levels=(1, 2))
    out = scalars.cluster_scalar(paf, clusters, inputs[2], None,
                                 ["location_id", "year_id", "draw"], cause_risks=pairs)
    return rounded(out)


from . import catalog_learn, catalog_more, catalog_ordered  # noqa: E402,F401  (they register their queries)
