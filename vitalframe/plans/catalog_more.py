"""Further registered queries: files written and read back, the whole lab pipeline, draw helpers.

The file queries write a given table below the shared checkpoint folder with a
sink (K) and read it back with a reader (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import randoms
from ..operators import draws, stats
from ..session import run_folder
from ..sources import filetable, readers, sinks
from .catalog import register, rounded, tbl
from .catalog_sql import SQL, r6


def _folder(spark) -> str:
    return run_folder(spark, "io")


@register("csv_round_trip")
def q_csv_round_trip(spark, sf):
    """K3 + S1: customers written as CSV with a header and read with a fixed schema."""
    c = tbl(spark, sf, "customer")
    path = _folder(spark)
    sinks.save_csv(c, path)
    return rounded(readers.read_csv(spark, path, c.schema))


SQL["csv_round_trip"] = f"""SELECT c_custkey, c_name, c_nationkey, {r6('c_acctbal')} AS c_acctbal, c_mktsegment
FROM customer"""


@register("csv_index_column")
def q_csv_index_column(spark, sf):
    """K3 + S2: a CSV with a leading row-index column, dropped on reading."""
    s = tbl(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_index"), "s_suppkey", "s_acctbal")
    path = _folder(spark)
    sinks.save_csv(s, path)
    return rounded(readers.read_csv(spark, path, s.schema, index_col=True))


SQL["csv_index_column"] = f"SELECT s_suppkey, {r6('s_acctbal')} AS s_acctbal FROM supplier"


@register("json_lines_round_trip")
def q_json_lines_round_trip(spark, sf):
    """K1 + S3: orders as JSON lines with a nested object, its fields selected by name."""
    o = tbl(spark, sf, "orders").select("o_orderkey", F.struct("o_totalprice", "o_orderstatus").alias("body"))
    path = _folder(spark)
    sinks.save(o, path, "json")
    back = readers.read_json_lines(spark, path, o.schema)
    return rounded(back.select("o_orderkey", "body.o_orderstatus", "body.o_totalprice"))


SQL["json_lines_round_trip"] = f"SELECT o_orderkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice FROM orders"


@register("keyed_table")
def q_keyed_table(spark, sf):
    """K2 + S7: a keyed table, one item of it read by its path key."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = _folder(spark)
    sinks.save_keyed(o, path, ["o_orderstatus"], ["o_orderkey"])
    return rounded(readers.read_partitioned(spark, path, o.schema, o_orderstatus="F"))


SQL["keyed_table"] = f"""SELECT o_orderkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice FROM orders
WHERE o_orderstatus = 'F'"""


@register("file_name_keys")
def q_file_name_keys(spark, sf):
    """K1 + S6: one folder per group, the group read back from the file names."""
    s = tbl(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    path = _folder(spark)
    for k in range(5):
        sinks.save(s.where(F.col("s_nationkey") % 5 == k), f"{path}/group_{k}")
    return readers.read_keyed_files(spark, f"{path}/group_*", "group_", key_col="grp")


SQL["file_name_keys"] = "SELECT s_suppkey, s_nationkey, CAST(s_nationkey % 5 AS BIGINT) AS grp FROM supplier"


@register("incremental_write")
def q_incremental_write(spark, sf):
    """K4 + K5: even nations are written, then all that are absent (plus 1), then every third is replaced (plus 2)."""
    s = tbl(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("string").alias("nation"))
    n = F.col("nation").cast("int")
    path = _folder(spark)
    sinks.write_incremental(s.where(n % 2 == 0), path, ["nation"])
    sinks.write_incremental(s.withColumn("s_acctbal", F.col("s_acctbal") + 1), path, ["nation"])
    sinks.write_incremental(s.where(n % 3 == 0).withColumn("s_acctbal", F.col("s_acctbal") + 2), path, ["nation"],
                            overwrite=True)
    return rounded(sinks.stored(spark, path, s.schema))


SQL["incremental_write"] = f"""SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation,
  {r6('s_acctbal + CASE WHEN s_nationkey % 3 = 0 THEN 2 WHEN s_nationkey % 2 = 0 THEN 0 ELSE 1 END')} AS s_acctbal
FROM supplier"""


@register("days_split")
def q_days_split(spark, sf):
    """K7: one output per day, summed by day after reading it back."""
    e = tbl(spark, sf, "events").select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    path = _folder(spark)
    sinks.split_by_day(e, path)
    back = readers.read_partitioned(spark, path, e.schema)
    return rounded(back.groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


SQL["days_split"] = f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, {r6('sum(value)')} AS total
FROM events GROUP BY 1"""


@register("delete_where")
def q_delete_where(spark, sf):
    """K6: rows deleted by a predicate; a row whose predicate is null stays."""
    c = tbl(spark, sf, "customer").select("c_custkey", "c_mktsegment",
                                          F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return rounded(sinks.delete_where(c, (F.col("c_mktsegment") == "BUILDING") & (F.col("balance") < 5000)))


SQL["delete_where"] = f"""WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance
  FROM customer)
SELECT c_custkey, c_mktsegment, {r6('balance')} AS balance FROM c
WHERE coalesce(c_mktsegment = 'BUILDING' AND balance < 5000, false) = false"""


@register("lab_chain")
def q_lab_chain(spark, sf):
    """The whole lab pipeline over the events, results and dates as text."""
    from . import labs
    e = tbl(spark, sf, "events")
    user = F.col("user_id")
    text = F.when(F.col("event_id") % 50 == 0, F.lit("<1.6")).otherwise(F.col("value").cast("string"))
    day = F.date_format("ts", "yyyy-MM-dd")
    birth = F.format_string("%d/%d/%02d 08:30", (user % 12 + 1).cast("int"), (user % 28 + 1).cast("int"),
                            (user % 90 + 10).cast("int"))
    order = F.format_string("%d/%d/%02d 10:15", F.month("ts"), F.dayofmonth("ts"), F.year("ts") % 100)
    tests = e.select("user_id", day.alias("day"), "event_type", text.alias("result"), birth.alias("birth_date"),
                     order.alias("order_date"), F.when(user % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"))
    others = e.select(user.alias("lab_subject"), day.alias("lab_day"), "event_type", text.alias("result"),
                      F.col("event_id").alias("row_id"))
    return rounded(labs.lab_chain(tests, others))


_KINDS = ("click", "error", "purchase", "signup", "view")
SQL["lab_chain"] = f"""WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, value,
    CAST(CASE WHEN year(ts) % 100 < 25 THEN year(ts) % 100 + 100 ELSE year(ts) % 100 END - (user_id % 90 + 10) AS INTEGER) AS age,
    CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender
  FROM events WHERE event_id % 50 <> 0 AND value IS NOT NULL),
t AS (SELECT * REPLACE (CASE WHEN kind = 'click' THEN 'view' ELSE kind END AS kind) FROM e WHERE age < 100),
j AS (SELECT a.user_id, a.day, a.gender, a.age, a.value / NULLIF(b.value, 0) AS ratio FROM t a JOIN t b
  ON a.user_id = b.user_id AND a.day = b.day AND a.kind = 'purchase' AND b.kind = 'view'),
c AS (SELECT quantile_cont(ratio, 0.025) AS lo, quantile_cont(ratio, 0.975) AS hi FROM j),
k AS (SELECT j.* FROM j, c WHERE ratio BETWEEN lo AND hi),
n AS (SELECT user_id, day, sum(m - 1) AS n_repeats FROM (SELECT user_id, day, kind, count(*) AS m FROM e GROUP BY ALL) GROUP BY ALL),
m AS (SELECT k.*, n.n_repeats, e.kind, e.value FROM k JOIN e USING (user_id, day) JOIN n USING (user_id, day))
SELECT user_id, day, gender, age, {r6('ratio')} AS ratio, CAST(n_repeats AS BIGINT) AS n_repeats,
  {', '.join(r6(f"avg(value) FILTER (WHERE kind = '{x}')") + f' AS {x}' for x in _KINDS)}, ratio >= 1.5 AS elevated
FROM m GROUP BY m.user_id, m.day, m.gender, m.age, m.ratio, m.n_repeats"""


@register("truncate_draws")
def q_truncate_draws(spark, sf):
    """Draws clamped to their key's 2.5 % and 97.5 % percentiles."""
    l = tbl(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(draws.truncate_draws(l, ["l_suppkey"], "l_extendedprice"))


SQL["truncate_draws"] = f"""WITH c AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.025) AS lo,
  quantile_cont(l_extendedprice, 0.975) AS hi FROM lineitem GROUP BY 1)
SELECT l_suppkey, l_orderkey, l_linenumber, {r6('greatest(least(l_extendedprice, hi), lo)')} AS l_extendedprice
FROM lineitem JOIN c USING (l_suppkey)"""


@register("resample_draws")
def q_resample_draws(spark, sf):
    """Every order brought to 4 draws (its lines): by hash down, by repeats up."""
    l = (tbl(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("draw"))
         .agg(F.sum("l_quantity").alias("quantity")))
    return rounded(draws.resample(l, ["l_orderkey"], "draw", 4, seed=9, portable=True))


SQL["resample_draws"] = f"""WITH l AS (SELECT l_orderkey, l_linenumber AS draw, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {randoms.sql_uniform('l_orderkey', 'draw', seed=9)}, draw) AS r,
  count(*) OVER (PARTITION BY l_orderkey) AS c FROM l),
k AS (SELECT *, CASE WHEN c >= 4 THEN (CASE WHEN r <= 4 THEN 1 ELSE 0 END)
  ELSE 4 // c + CASE WHEN r <= 4 % c THEN 1 ELSE 0 END END AS copies FROM r),
x AS (SELECT *, unnest(range(copies)) AS i FROM k WHERE copies > 0)
SELECT l_orderkey, CAST(i * c + r - 1 AS INTEGER) AS draw, {r6('quantity')} AS quantity FROM x"""


@register("clustered_lookup")
def q_clustered_lookup(spark, sf):
    """K2: orders in files clustered by three keys at once, looked up by each of them."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"),
                                        "o_totalprice")
    path = _folder(spark)
    filetable.save_clustered(o, path, ["o_custkey", "o_orderdate", "o_totalprice"], 16)
    keys = {"customer": {"o_custkey": 10}, "order": {"o_orderkey": 33}}
    parts = [filetable.lookup(spark, path, o.schema, **v).withColumn("by", F.lit(k)) for k, v in keys.items()]
    day = filetable.read(spark, path, o.schema).where(F.col("o_orderdate") == "1996-01-02").withColumn("by", F.lit("day"))
    found = parts[0].unionByName(parts[1]).unionByName(day)
    return rounded(found.withColumn("o_orderdate", F.col("o_orderdate").cast("string")))


SQL["clustered_lookup"] = f"""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate,
  {r6('o_totalprice')} AS o_totalprice FROM orders)
SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM (
  SELECT *, 'customer' AS by FROM o WHERE o_custkey = 10 UNION ALL SELECT *, 'order' FROM o WHERE o_orderkey = 33
  UNION ALL SELECT *, 'day' FROM o WHERE o_orderdate = DATE '1996-01-02')"""


@register("delete_in_place")
def q_delete_in_place(spark, sf):
    """K6: two deletes on a table of files, a range of dates of one status (null totals stay) and one customer's."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderstatus",
                                        F.when(F.col("o_totalprice") > 5000, F.col("o_totalprice")).alias("total"))
    path = _folder(spark)
    filetable.save_clustered(o, path, ["o_orderdate"], 16)
    filetable.delete(spark, path, o.schema, F.col("o_orderdate").between("1996-01-01", "1996-03-31") & (F.col("o_orderstatus") == "F")
                     & (F.col("total") < 200000))
    filetable.delete(spark, path, o.schema, F.col("o_custkey") == 10)
    return rounded(filetable.read(spark, path, o.schema).withColumn("o_orderdate", F.col("o_orderdate").cast("string")))


SQL["delete_in_place"] = f"""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderstatus,
    CASE WHEN o_totalprice > 5000 THEN o_totalprice END AS total FROM orders)
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderstatus, {r6('total')} AS total FROM o
WHERE NOT coalesce(o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND o_orderstatus = 'F'
  AND total < 200000, false) AND o_custkey <> 10"""


@register("sev_integral_errors")
def q_sev_integral_errors(spark, sf):
    """Rows per flag whose integral met the original's tolerance by its own error estimate, also for spreads
    a thousand times narrower and wider than the table's."""
    from . import exposure
    from .catalog import _exposure_rows
    e = _exposure_rows(spark, sf)
    wide = e.withColumn("spread", F.explode(F.array(*[F.lit(v) for v in (0.001, 1.0, 1000.0)]))).withColumn(
        "exp_sd", F.col("exp_sd") * F.col("spread"))
    out = exposure.sev_integral(wide)
    good = F.col("converged") & (F.col("error") <= 1.49e-06 * F.greatest(F.lit(1.0), F.abs("integral")))
    return out.groupBy("flag", "spread").agg(F.count("*").alias("n"), F.count_if(good).alias("n_converged"))


SQL["sev_integral_errors"] = """SELECT CAST(l_linenumber % 2 AS INTEGER) AS flag, spread, count(*) AS n, count(*) AS n_converged
FROM lineitem, (VALUES (CAST(0.001 AS DOUBLE)), (CAST(1.0 AS DOUBLE)), (CAST(1000.0 AS DOUBLE))) t(spread) GROUP BY 1, 2"""


@register("bootstrap_power_literal")
def q_bootstrap_power_literal(spark, sf):
    """M5: bootstrap power with every sample drawn row by row: 1000 replicates of both groups at their observed
    sizes, means and pooled sd."""
    e = tbl(spark, sf, "events")
    r = stats._two_sample(e, "value", "event_type", "view", "purchase").first()
    return rounded(stats.bootstrap_power(int(r["n1"]), int(r["n2"]), r["mean1"], r["mean2"], r["pooled_sd"], spark,
                                         n_boot=1000, alpha=0.5, seed=11, method="literal"))


@register("poisson_sample_means_literal")
def q_poisson_sample_means_literal(spark, sf):
    """M6: 1000 samples of 10 and of 100 Poisson draws at each event type's daily rate per user, every draw made."""
    e = tbl(spark, sf, "events")
    lam = e.groupBy("event_type").agg((F.count("*") / (F.count_distinct("user_id") * 30.0)).alias("lam"))
    m = stats.poisson_means(spark, lam, "lam", [10, 100], reps=1000, seed=5, by=["event_type"], method="literal")
    return rounded(m.groupBy("event_type", "lam", "n").agg(
        F.avg("mean").alias("mean_of_means"), F.var_samp("mean").alias("var_of_means"), F.count("*").alias("reps")), 4)
