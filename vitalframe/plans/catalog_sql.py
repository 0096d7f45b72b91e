"""Oracle SQL (DuckDB dialect) for the registered queries.

Each string derives the same projections from the raw tables as
``sources/views.py`` and computes the same result independently of Spark.
Doubles are rounded to 6 places; ``+ 0.0`` turns a rounded -0.0 into 0.0.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions.randoms import sql_uniform


def ld(with_risk: bool = False) -> str:
    risk = ", o.o_orderpriority AS risk" if with_risk else ""
    join = " JOIN orders o ON l.l_orderkey = o.o_orderkey" if with_risk else ""
    return f"""ld AS (
  SELECT CAST(s.s_nationkey AS INTEGER) AS location_id,
         CAST(p.p_size % 20 + 2 AS INTEGER) AS age_group_id,
         CAST(l.l_linenumber % 2 + 1 AS INTEGER) AS sex_id,
         CAST(year(l.l_shipdate) AS INTEGER) AS year_id,
         CAST(l.l_orderkey % 3 - 1 AS INTEGER) AS scenario,
         CAST(l.l_linenumber AS INTEGER) AS draw,
         l.l_discount * 10 AS sev, 0.5 + l.l_tax * 50 AS rr,
         l.l_orderkey, l.l_quantity, l.l_extendedprice, l.l_returnflag,
         p.p_type AS acause{risk}
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey{join})"""


def rn(x: str, digits: int) -> str:
    """Round like ``catalog.rounded``: nudge ties away from zero, then round;
    ``+ 0.0`` turns a rounded -0.0 into 0.0."""
    eps = repr(10.0 ** -(digits + 3))
    return f"(round(({x}) + sign({x}) * {eps}, {digits}) + 0.0)"


def r6(x: str) -> str:
    return rn(x, 6)


SEV_BY_RISK = """sev AS (SELECT risk, location_id, year_id, draw, avg(sev) AS sev
  FROM ld GROUP BY risk, location_id, year_id, draw)"""
RR_BY_CAUSE = """rr0 AS (SELECT acause, risk, draw, max(rr) AS rr FROM ld GROUP BY acause, risk, draw),
rr AS (SELECT acause, risk, draw, CASE WHEN rr < 1 THEN 1.001 ELSE rr END AS rr FROM rr0)"""
MEDIATION = """med AS (SELECT acause, risk,
    CASE WHEN l_returnflag = 'A' THEN '1-URGENT' WHEN l_returnflag = 'N' THEN '3-MEDIUM'
         ELSE '5-LOW' END AS mediator, avg(sev) / 10 AS mean
  FROM ld GROUP BY ALL)"""


def paf_long(skip: str | None = None) -> str:
    cond = f"WHERE risk <> '{skip}'" if skip else ""
    return f"""sev_f AS (SELECT * FROM sev {cond}), rr_f AS (SELECT * FROM rr {cond}),
j AS (SELECT coalesce(s.risk, r.risk) AS risk, coalesce(s.draw, r.draw) AS draw,
             s.location_id, s.year_id, r.acause,
             coalesce(s.sev, 0.0) AS sev, coalesce(r.rr, 1.0) AS rr
      FROM sev_f s FULL OUTER JOIN rr_f r ON s.risk = r.risk AND s.draw = r.draw),
paf AS (SELECT acause, risk, location_id, year_id, draw,
               1 - 1.0 / NULLIF(sev * (rr - 1) + 1, 0) AS paf
        FROM j WHERE acause IS NOT NULL)"""


SQL: dict[str, str] = {}

SQL["paf_from_sev_rrmax"] = f"""WITH {ld()},
sev AS (SELECT location_id, age_group_id, sex_id, avg(sev) AS sev FROM ld GROUP BY ALL),
rrmax AS (SELECT age_group_id, sex_id, max(rr) AS rrmax FROM ld GROUP BY ALL),
j AS (SELECT coalesce(s.age_group_id, r.age_group_id) AS age_group_id,
             coalesce(s.sex_id, r.sex_id) AS sex_id, s.location_id, s.sev, r.rrmax
      FROM sev s FULL OUTER JOIN rrmax r
        ON s.age_group_id = r.age_group_id AND s.sex_id = r.sex_id),
k AS (SELECT *, sev * (rrmax - 1) + 1 AS scalar FROM j),
m AS (SELECT *, 1 - 1.0 / NULLIF(scalar, 0) AS paf FROM k)
SELECT DISTINCT age_group_id, sex_id, location_id, {r6('scalar')} AS scalar, {r6('paf')} AS paf
FROM m WHERE age_group_id IS NOT NULL AND sex_id IS NOT NULL AND location_id IS NOT NULL
  AND sev IS NOT NULL AND rrmax IS NOT NULL AND scalar IS NOT NULL AND paf IS NOT NULL"""

SQL["sev_threshold_flag"] = f"""WITH {ld()}
SELECT sev > 0.99 AS sev_above_threshold, count(*) AS n FROM ld GROUP BY 1"""

SQL["rrmax_load"] = f"""WITH {ld(True)}, {RR_BY_CAUSE}
SELECT acause, risk, draw, {r6('rr')} AS rr FROM rr
WHERE acause IN ('ECONOMY', 'STANDARD', 'PROMO')"""

SQL["sev_complete_index"] = f"""WITH {ld(True)}, {SEV_BY_RISK},
idx AS (SELECT * FROM (SELECT DISTINCT CAST(n_nationkey AS INTEGER) AS location_id FROM nation)
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS year_id FROM range(1995, 2002))
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS draw FROM range(1, 8))
        CROSS JOIN (SELECT DISTINCT o_orderpriority AS risk FROM orders)
        WHERE year_id >= 1995 AND year_id < 1999),
s AS (SELECT * FROM sev WHERE year_id >= 1995 AND year_id < 1999)
SELECT i.risk, i.location_id, i.year_id, i.draw, {r6('s.sev')} AS sev
FROM idx i LEFT JOIN s ON i.risk = s.risk AND i.location_id = s.location_id
  AND i.year_id = s.year_id AND i.draw = s.draw"""

SQL["risk_cause_paf"] = f"""WITH {ld(True)}, {SEV_BY_RISK}, {RR_BY_CAUSE},
{paf_long('4-NOT SPECIFIED')}
SELECT acause, risk, location_id, year_id, draw, {r6('paf')} AS paf FROM paf"""

PAF_VERSIONED = f"""{ld(True)}, {SEV_BY_RISK}, {RR_BY_CAUSE}, {paf_long()},
pv AS (SELECT *, CASE WHEN year_id < 1999 THEN 'past' ELSE 'forecast' END AS version FROM paf)"""

SQL["mediation_product"] = f"""WITH {ld(True)}, {MEDIATION},
pairs AS (SELECT DISTINCT acause, risk FROM ld)
SELECT m.acause, m.mediator AS risk, {r6('product(1 - m.mean)')} AS mediation
FROM med m SEMI JOIN pairs p ON m.acause = p.acause AND m.risk = p.risk
GROUP BY m.acause, m.mediator"""

SQL["cause_scalar"] = f"""WITH {PAF_VERSIONED}, {MEDIATION},
set_one AS (SELECT DISTINCT p_type AS acause, '2-HIGH' AS risk FROM part WHERE p_type = 'PROMO'),
p AS (SELECT * FROM pv WHERE paf IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM set_one o WHERE o.acause = pv.acause AND o.risk = pv.risk)),
cr AS (SELECT DISTINCT acause, risk FROM rr),
prods AS (SELECT m.acause, m.mediator AS risk, product(1 - m.mean) AS mediation
          FROM med m SEMI JOIN cr ON m.acause = cr.acause AND m.risk = cr.risk
          GROUP BY m.acause, m.mediator),
pm AS (SELECT p.*, coalesce(prods.mediation, 1.0) AS mediation FROM p
       LEFT JOIN prods ON p.acause = prods.acause AND p.risk = prods.risk),
nu AS (SELECT acause, version, count(DISTINCT risk) AS n_usable FROM pm GROUP BY ALL),
cells AS (SELECT acause, version, location_id, year_id, draw,
                 product(1 - paf * mediation) AS pr, count(DISTINCT risk) AS n
          FROM pm GROUP BY acause, version, location_id, year_id, draw),
comb AS (SELECT c.acause, c.version, c.location_id, c.year_id, c.draw,
                CASE WHEN 1 - c.pr > 0.9999 THEN 0.9999 ELSE 1 - c.pr END AS paf
         FROM cells c JOIN nu ON c.acause = nu.acause AND c.version = nu.version
         WHERE c.n = nu.n_usable),
mx AS (SELECT acause, version, max(paf) AS mx FROM comb GROUP BY ALL),
sc AS (SELECT c.acause, c.version, c.location_id, c.year_id, c.draw,
              c.paf * CASE WHEN mx.mx > 0.95 THEN 0.95 / mx.mx ELSE 1.0 END AS paf
       FROM comb c JOIN mx ON c.acause = mx.acause AND c.version = mx.version)
SELECT acause, version, location_id, year_id, draw, {r6('paf')} AS paf,
       {r6('1.0 / NULLIF(1 - paf, 0)')} AS scalar FROM sc"""

SQL["scalar_from_paf"] = f"""WITH {PAF_VERSIONED},
b AS (SELECT *, CASE WHEN paf = 1 THEN 0.9999 ELSE paf END AS paf2 FROM pv)
SELECT acause, risk, location_id, year_id, draw, {r6('paf2')} AS paf, version,
       {r6('1.0 / NULLIF(1 - paf2, 0)')} AS scalar FROM b"""

SQL["draw_summary"] = f"""WITH {ld(True)}, {SEV_BY_RISK}
SELECT risk, location_id, year_id, {r6('avg(sev)')} AS mean,
       {r6('quantile_cont(sev, 0.025)')} AS lower, {r6('quantile_cont(sev, 0.975)')} AS upper
FROM sev GROUP BY risk, location_id, year_id"""

SQL["mean_over_draws"] = f"""WITH {ld(True)}, {SEV_BY_RISK}
SELECT risk, location_id, year_id, {r6('avg(sev)')} AS sev FROM sev GROUP BY ALL"""

SQL["scenario_compare"] = f"""WITH {ld()}
SELECT year_id, location_id,
  {r6('avg(sev) FILTER (WHERE scenario = -1)')} AS sev_sm1,
  {r6('avg(sev) FILTER (WHERE scenario = 0)')} AS sev_s0,
  {r6('avg(sev) FILTER (WHERE scenario = 1)')} AS sev_s1
FROM ld GROUP BY year_id, location_id"""

SQL["past_plus_forecast"] = f"""WITH {ld(True)}, {SEV_BY_RISK}
SELECT risk, location_id, year_id, draw, {r6('sev')} AS sev FROM sev
WHERE year_id >= 1995 AND year_id < 1999
UNION ALL
SELECT risk, location_id, year_id, draw, {r6('sev * 1.1')} AS sev FROM sev
WHERE year_id >= 1999 AND year_id <= 2001"""

HIER = """pairs AS (SELECT DISTINCT c_mktsegment AS acause, n_name AS risk
          FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT r_regionkey + 100 AS rei_id, r_name AS rei,
             '0,' || CAST(r_regionkey + 100 AS VARCHAR) AS path, 1 AS level FROM region
      UNION ALL
      SELECT n_nationkey + 200, n_name, '0,' || CAST(n_regionkey + 100 AS VARCHAR) || ','
             || CAST(n_nationkey + 200 AS VARCHAR), 2 FROM nation)"""

SQL["risk_clusters"] = f"""WITH {HIER},
pos AS (SELECT p.acause, p.risk, TRY_CAST(trim(split_part(h.path, ',', lv + 1)) AS INTEGER) AS anc
        FROM pairs p JOIN h ON h.rei = p.risk
        CROSS JOIN (VALUES (1), (2), (3)) v(lv)
        WHERE lv < len(string_split(h.path, ','))),
cl AS (SELECT DISTINCT pos.acause, pos.risk, h.rei AS cluster FROM pos
       JOIN h ON h.rei_id = pos.anc AND h.level IN (1, 2, 3)),
sz AS (SELECT acause, cluster, count(*) AS n, max(risk = cluster) AS self FROM cl GROUP BY ALL)
SELECT cl.acause, cl.risk, cl.cluster FROM cl JOIN sz
  ON cl.acause = sz.acause AND cl.cluster = sz.cluster
WHERE NOT (sz.n = 1 AND sz.self)"""

SQL["related_risks"] = f"""WITH {HIER},
r AS (SELECT DISTINCT risk FROM pairs WHERE acause = 'BUILDING'
      UNION SELECT 'NATION_0' UNION SELECT 'NATION_99')
SELECT risk FROM r WHERE risk NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 0)"""

SQL["top5_by_price"] = f"""SELECT p_partkey, p_name, p_type, {r6('p_retailprice')} AS p_retailprice
FROM part WHERE p_type = 'ECONOMY' AND p_size > 20
ORDER BY p_retailprice, p_partkey LIMIT 5"""

SQL["customers_without_orders"] = """SELECT c.c_custkey, c.c_name, o.n_orders FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) o
  ON c.c_custkey = o.o_custkey WHERE o.n_orders IS NULL"""

SQL["group_mean_plus"] = f"""SELECT l_returnflag, l_linestatus, {r6('avg(l_extendedprice)')} AS mean_price,
  {r6('avg(l_extendedprice) + 2')} AS price_limit FROM lineitem GROUP BY ALL"""

SQL["priority_recode"] = """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH'
  ELSE o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY 1"""

SQL["text_numbers"] = f"""WITH e AS (SELECT event_id, TRY_CAST(trim(substring(props, 7, 2)) AS DOUBLE) AS num
  FROM events)
SELECT event_id, {r6('num')} AS num FROM e WHERE num IS NOT NULL AND NOT isnan(num)"""

TWO_DIGIT = """d AS (SELECT o.o_orderkey,
    printf('%d/%d/%02d 08:30', c.c_custkey % 12 + 1, c.c_custkey % 28 + 1, c.c_custkey % 90 + 10)
      AS birth_date,
    printf('%d/%d/%02d 10:15', month(o.o_orderdate), day(o.o_orderdate), year(o.o_orderdate) % 100)
      AS order_date
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

SQL["age_from_dates"] = f"""WITH {TWO_DIGIT},
y AS (SELECT *, TRY_CAST(split_part(split_part(birth_date, '/', 3), ' ', 1) AS INTEGER) AS b,
             TRY_CAST(split_part(split_part(order_date, '/', 3), ' ', 1) AS INTEGER) AS o FROM d)
SELECT o_orderkey, birth_date, order_date,
       CAST(CASE WHEN o < 17 THEN o + 100 ELSE o END - b AS INTEGER) AS age
FROM y WHERE CASE WHEN o < 17 THEN o + 100 ELSE o END - b < 100"""

SQL["log_transform"] = f"""SELECT l_orderkey, l_linenumber, {r6('l_discount')} AS l_discount, {r6('l_tax')} AS l_tax,
  {r6('CASE WHEN l_discount > 0 THEN ln(l_discount) END')} AS log_l_discount,
  {r6('CASE WHEN l_tax > 0 THEN ln(l_tax) END')} AS log_l_tax FROM lineitem"""

SQL["clamp_bounds"] = f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x, l_tax * 12.5 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber,
  {r6('CASE WHEN x < 0.001 THEN 0.001 WHEN x > 0.999 THEN 0.999 ELSE x END')} AS x,
  {r6('CASE WHEN y > 0.9999 THEN 0.9999 ELSE y END')} AS y FROM t"""

ASFR = """asfr AS (SELECT CAST(c.c_nationkey AS INTEGER) AS location_id,
    CAST(year(o.o_orderdate) AS INTEGER) AS year_id,
    CAST(o.o_custkey % 7 + 8 AS INTEGER) AS age_group_id,
    avg(o.o_totalprice / 2000000.0) AS asfr
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL)"""

SQL["asfr_scale_logit"] = f"""WITH {ASFR},
b(age_group_id, lb, ub) AS (VALUES (8, 0.0005::DOUBLE, 0.22::DOUBLE), (9, 0.01, 0.35),
   (10, 0.01, 0.4), (11, 0.02, 0.35), (12, 0.007, 0.3), (13, 0.0005, 0.18), (14, 0.00001, 0.10)),
s AS (SELECT a.*, (a.asfr - b.lb) / NULLIF(b.ub - b.lb, 0) AS sc FROM asfr a LEFT JOIN b
      ON a.age_group_id = b.age_group_id),
c AS (SELECT *, CASE WHEN sc < 0.001 THEN 0.001 WHEN sc > 0.999 THEN 0.999 ELSE sc END AS scaled_asfr FROM s)
SELECT age_group_id, location_id, year_id, {r6('asfr')} AS asfr, {r6('scaled_asfr')} AS scaled_asfr,
  {r6('ln(scaled_asfr / (1 - scaled_asfr))')} AS logit_asfr FROM c"""

SQL["decade_bucket"] = """SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, count(*) AS n
FROM orders GROUP BY 1"""

SQL["spline_basis"] = f"""WITH c AS (SELECT c_custkey, c_acctbal / 500.0 AS asmedu FROM customer),
k AS (SELECT min(asmedu) AS lo, max(asmedu) AS hi FROM c)
SELECT c_custkey, {r6('asmedu')} AS asmedu,
  {r6('coalesce(CASE WHEN asmedu >= lo AND asmedu < 6 THEN asmedu - lo WHEN asmedu >= 6 THEN 6 - lo END, 0)')} AS asmedu_below_6,
  {r6('coalesce(CASE WHEN asmedu >= 6 AND asmedu < 10 THEN asmedu - 6 WHEN asmedu >= 10 THEN 4.0 END, 0)')} AS asmedu_between_6_10,
  {r6('coalesce(CASE WHEN asmedu >= 10 AND asmedu < 14 THEN asmedu - 10 WHEN asmedu >= 14 THEN 4.0 END, 0)')} AS asmedu_between_10_14,
  {r6('coalesce(CASE WHEN asmedu >= 14 AND asmedu < hi THEN asmedu - 14 WHEN asmedu >= hi THEN hi - 14 END, 0)')} AS asmedu_above_14
FROM c CROSS JOIN k"""

SQL["unit_conversion"] = f"""WITH {ASFR}
SELECT location_id, year_id, age_group_id, {r6('asfr')} AS asfr,
  {r6('asfr * 200.0')} AS asfr_per_1000, 2 AS sex_id FROM asfr"""

SQL["signif_digits"] = """WITH v AS (SELECT o_orderkey, o_totalprice / 7.0 AS v FROM orders),
e AS (SELECT *, floor(log10(abs(v))) - 4 AS e FROM v)
SELECT o_orderkey, CASE WHEN v = 0 THEN 0.0 WHEN e < 0 THEN round(v * pow(10.0, -e)) / pow(10.0, -e)
  ELSE round(v / pow(10.0, e)) * pow(10.0, e) END AS v
FROM e"""

SQL["message_outbox"] = """SELECT c_name AS name, c_name || '@example.com' AS recipient,
  replace('Hi ${PERSON_NAME},
This is a reminder of your visit in 5 minutes.', '${PERSON_NAME}', coalesce(c_name, '')) AS body,
  '2024-01-02 ' || printf('%02d:%02d:00', c_custkey % 24, c_custkey % 60) AS send_at
FROM customer"""

SQL["parameter_grid"] = """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, g.cutoff, count(*) AS n
FROM events CROSS JOIN (VALUES (0.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE), (30.0::DOUBLE),
  (40.0::DOUBLE), (50.0::DOUBLE)) g(cutoff)
WHERE value > g.cutoff GROUP BY 1, 2"""

MEAN_AGE = """n AS (SELECT CAST(c.c_nationkey AS INTEGER) AS location_id,
    CAST(year(o.o_orderdate) AS INTEGER) AS year_id, count(*) AS n_orders
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL)"""

SQL["inner_multi_key"] = f"""WITH {ASFR}, {MEAN_AGE}
SELECT a.location_id, a.year_id, a.age_group_id, {r6('a.asfr')} AS asfr, n.n_orders
FROM asfr a JOIN n ON a.location_id = n.location_id AND a.year_id = n.year_id"""


def daily(kind):
    return f"""SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS value FROM events
  WHERE event_type = '{kind}' GROUP BY ALL"""


SQL["join_renamed_keys"] = f"""WITH v AS ({daily('view')}), p AS ({daily('purchase')})
SELECT v.user_id, strftime(v.day, '%Y-%m-%d') AS view_day, {r6('v.value')} AS view_value,
  {r6('p.value')} AS value
FROM v JOIN p ON v.user_id = p.user_id AND v.day = p.day"""

SQL["self_join_suffix"] = f"""WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type,
    avg(value) AS value FROM events GROUP BY ALL),
a AS (SELECT * FROM d WHERE event_type = 'view'), b AS (SELECT * FROM d WHERE event_type = 'click')
SELECT a.user_id, a.day, a.event_type AS event_type_x, {r6('a.value')} AS value_x,
  b.event_type AS event_type_y, {r6('b.value')} AS value_y
FROM a JOIN b ON a.user_id = b.user_id AND a.day = b.day"""

SQL["region_lookup"] = """SELECT r.r_name, CAST(sum(c.n) AS BIGINT) AS n_customers
FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"""

SQL["anti_pairs"] = f"""WITH {ld(True)},
pairs AS (SELECT DISTINCT acause, risk FROM ld),
d AS (SELECT DISTINCT p_type AS acause, '1-URGENT' AS risk FROM part WHERE p_type LIKE 'E%')
SELECT acause, risk FROM pairs ANTI JOIN d USING (acause, risk)"""

SQL["semi_by_list"] = """SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
GROUP BY 1"""

ADDR = """addr AS (SELECT c_custkey, c_name AS address FROM customer),
gaz AS (SELECT DISTINCT ON (address) c_name AS address, c_acctbal / 125.0 AS lat,
          CAST(c_custkey % 360 - 180 AS DOUBLE) AS lng FROM customer WHERE c_acctbal > 0),
g AS (SELECT addr.address, addr.c_custkey, gaz.lat, gaz.lng FROM addr LEFT JOIN gaz USING (address))"""

SQL["geocode_distance"] = f"""WITH {ADDR},
r AS (SELECT *, radians(lat) AS p1, radians(38.8976763) AS p2, radians(38.8976763 - lat) AS dp,
        radians(-77.0387185 - lng) AS dl FROM g)
SELECT address, c_custkey, {r6('lat')} AS lat, {r6('lng')} AS lng,
  {r6('2 * 6371.0088 * asin(sqrt(least(pow(sin(dp / 2), 2) + cos(p1) * cos(p2) * pow(sin(dl / 2), 2), 1.0)))')} AS distance_km
FROM r"""

SQL["word_frequency"] = """SELECT w AS word, count(*) AS n
FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w"""

SQL["group_sums"] = f"""SELECT l_returnflag, l_linestatus, {r6('sum(l_quantity)')} AS l_quantity,
  {r6('sum(l_extendedprice)')} AS l_extendedprice, {r6('sum(l_discount)')} AS l_discount
FROM lineitem GROUP BY ALL"""

SQL["quantity_quantiles"] = f"""SELECT {r6('quantile_cont(l_quantity, 0.5)')} AS median,
  {r6('quantile_cont(l_quantity, 0.9)')} AS p90 FROM lineitem"""

SQL["top10_price"] = f"""SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"""

SQL["distinct_values"] = "SELECT DISTINCT o_orderpriority FROM orders"

_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL["corr_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {r6(f'corr({a}, {b})')} AS corr FROM lineitem"
    for a in _CORR_COLS for b in _CORR_COLS)

SQL["key_of_max"] = f"""SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS c_custkey,
  {r6('max(c_acctbal)')} AS c_acctbal FROM customer GROUP BY 1"""

SQL["price_histogram"] = f"""WITH r AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi
  FROM orders GROUP BY 1),
b AS (SELECT o.o_orderstatus, r.lo, r.hi,
    CAST(CASE WHEN (r.hi - r.lo) / 10.0 = 0 THEN 0
         ELSE least(floor((o.o_totalprice - r.lo) / ((r.hi - r.lo) / 10.0)), 9) END AS INTEGER) AS bin
  FROM orders o JOIN r USING (o_orderstatus) WHERE o.o_totalprice IS NOT NULL)
SELECT o_orderstatus, bin, count(*) AS n, {r6('lo + bin * (hi - lo) / 10.0')} AS bin_lo
FROM b GROUP BY o_orderstatus, bin, lo, hi"""

SQL["group_share"] = f"""SELECT o_orderpriority, o_orderkey, {r6('o_totalprice')} AS o_totalprice,
  {r6('o_totalprice / count(*) OVER (PARTITION BY o_orderpriority)')} AS share FROM orders"""

SQL["min_max"] = f"""SELECT {r6('min(c_acctbal)')} AS min_c_acctbal, {r6('max(c_acctbal)')} AS max_c_acctbal
FROM customer"""

SQL["box_stats"] = f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1,
    quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3
  FROM lineitem GROUP BY 1),
w AS (SELECT l.l_returnflag, min(l.l_quantity) AS whisker_lo, max(l.l_quantity) AS whisker_hi
  FROM lineitem l JOIN q USING (l_returnflag)
  WHERE l.l_quantity >= q.q1 - 1.5 * (q.q3 - q.q1) AND l.l_quantity <= q.q3 + 1.5 * (q.q3 - q.q1)
  GROUP BY 1)
SELECT q.l_returnflag, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
  {r6('whisker_lo')} AS whisker_lo, {r6('whisker_hi')} AS whisker_hi FROM q LEFT JOIN w USING (l_returnflag)"""

SQL["next_age_value"] = f"""WITH {ASFR}
SELECT location_id, year_id, age_group_id, {r6('asfr')} AS asfr,
  {r6('lead(asfr) OVER (PARTITION BY location_id, year_id ORDER BY age_group_id)')} AS asfr_next
FROM asfr"""

SQL["dedupe_first"] = f"""SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  {r6('o_totalprice')} AS o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1"""

SQL["repeated_rows"] = """SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, strftime(ts, '%Y-%m-%d')
                           ORDER BY event_id) > 1"""

SQL["bind_missing_columns"] = f"""WITH {ASFR}
SELECT location_id, year_id, age_group_id, {r6('asfr')} AS asfr, NULL::BOOLEAN AS forecast,
  NULL::DOUBLE AS asfr_mean FROM asfr WHERE year_id < 1996
UNION ALL
SELECT location_id, year_id, age_group_id, NULL::DOUBLE, TRUE, 0.5::DOUBLE FROM asfr WHERE year_id >= 1996"""

SQL["pivot_event_types"] = f"""SELECT user_id,
  {r6("avg(value) FILTER (WHERE event_type = 'view')")} AS v_view,
  {r6("avg(value) FILTER (WHERE event_type = 'click')")} AS v_click,
  {r6("avg(value) FILTER (WHERE event_type = 'error')")} AS v_error,
  {r6("avg(value) FILTER (WHERE event_type = 'signup')")} AS v_signup,
  {r6("avg(value) FILTER (WHERE event_type = 'purchase')")} AS v_purchase
FROM events WHERE event_type IS NOT NULL GROUP BY user_id"""

SQL["unpivot_draws"] = f"""WITH {ld(True)}, {SEV_BY_RISK}
SELECT risk, location_id, year_id, draw, {r6('sev')} AS sev FROM sev
WHERE draw BETWEEN 1 AND 7 AND sev IS NOT NULL"""

SQL["nested_to_long"] = f"""SELECT vec_id, CAST(b AS INTEGER) AS block, CAST(p + 1 AS INTEGER) AS pos,
  {r6('CAST(embedding[b * 8 + p + 1] AS DOUBLE)')} AS value
FROM embeddings, range(0, 8) t1(b), range(0, 8) t2(p)
WHERE embedding IS NOT NULL AND b * 8 + p < len(embedding)"""

SQL["array_product"] = f"""SELECT vec_id,
  {r6('list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[len(embedding) + 1 - i] AS DOUBLE)))')} AS dot,
  {r6('CAST(embedding[1] AS DOUBLE) * CAST(embedding[len(embedding)] AS DOUBLE)')} AS first
FROM embeddings"""

SQL["ratio_filter"] = f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_tax / NULLIF(l_discount, 0) AS ratio FROM lineitem)
SELECT l_orderkey, l_linenumber, {r6('ratio')} AS ratio FROM r WHERE ratio BETWEEN 0.18 AND 181"""

SQL["poisson_mass"] = f"""WITH l AS (SELECT event_type, count(*) / count(DISTINCT user_id) AS lam
  FROM events GROUP BY 1)
SELECT event_type, {r6('lam')} AS lam, CAST(k AS INTEGER) AS k,
  {r6('exp(k * ln(lam) - lam - lgamma(k + 1))')} AS pmf
FROM l, range(1, 21) t(k)"""

SQL["props_json"] = """SELECT TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n
FROM events GROUP BY 1"""


UNDER_ONE = f"""base AS (SELECT CAST(c.c_nationkey AS INTEGER) AS location_id,
    CAST(year(o.o_orderdate) AS INTEGER) AS year_id, CAST(o.o_orderkey % 2 + 1 AS INTEGER) AS sex_id,
    CAST(o.o_custkey % 5 AS INTEGER) AS draw, o.o_totalprice / 100000.0 AS births
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
nb AS (SELECT location_id, year_id, sex_id, draw, sum(births) AS new_borns, count(*) AS n
  FROM base GROUP BY ALL),
bands(age, age_group_id, wk_from, wk_to) AS (VALUES ('enn', 2, 1, 1), ('lnn', 3, 2, 4), ('pnn', 4, 5, 52)),
x AS (SELECT nb.*, bands.age, bands.age_group_id,
    0.0005 + 0.0001 * bands.age_group_id + 0.00001 * ((nb.n * (wk_to - wk_from + 1)) % 10) AS q,
    unnest(range(wk_from, wk_to + 1)) AS age_wks FROM nb CROSS JOIN bands)"""

SQL["under_one_population"] = f"""WITH {UNDER_ONE},
w AS (SELECT *, new_borns * (1 - first_value(q) OVER (PARTITION BY location_id, year_id, sex_id, draw
        ORDER BY age_wks)) * coalesce(product(1 - q) OVER (PARTITION BY location_id, year_id, sex_id, draw
        ORDER BY age_wks ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS pop FROM x)
SELECT location_id, year_id, sex_id, age_group_id, age, draw, {r6('sum(pop)')} AS pop
FROM w GROUP BY ALL"""

SQL["replicate_weeks"] = f"""WITH {UNDER_ONE}
SELECT age, count(*) AS n_rows, CAST(max(age_wks) AS INTEGER) AS last_week FROM x GROUP BY age"""

SQL["births_by_sex_draw"] = f"""WITH {UNDER_ONE}
SELECT sex_id, draw, {r6('sum(births)')} AS births FROM base GROUP BY ALL"""

EXPO = """e AS (SELECT row_number() OVER () AS rid, l_orderkey AS row_id, l_linenumber AS draw, l_quantity AS m,
    l_quantity * 0.3 + 1.0 AS s, 1.01 + l_tax AS rm, 1.5 + l_discount * 10 AS cap, 20.0::DOUBLE AS t,
    0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, CAST(l_linenumber % 2 AS INTEGER) AS flag FROM lineitem),
p AS (SELECT *, ln(m / sqrt(1.0 + pow(s, 2) / pow(m, 2))) AS mu,
    sqrt(ln(1.0 + pow(s, 2) / pow(m, 2))) AS sigma, (hi - lo) / 256.0 AS h FROM e)"""

# A rule of other order and panels than the Spark side's, over all three parts.
_NODES = ", ".join(f"({x!r}, {w!r})" for x, w in zip(*(v.tolist() for v in np.polynomial.legendre.leggauss(20))))
_SCORE = "CASE WHEN {x} <= 0 THEN -12.0 ELSE greatest(-12.0, least(12.0, (ln({x}) - mu) / sigma)) END"

SQL["sev_integral"] = f"""WITH {EXPO},
k AS (SELECT *, CASE WHEN flag = 1 THEN t - ln(cap) / ln(rm) ELSE t + ln(cap) / ln(rm) END AS kink FROM p),
s AS (
  SELECT *, CASE WHEN flag = 1 THEN greatest(lo, t) ELSE lo END AS a, CASE WHEN flag = 1 THEN hi ELSE least(hi, t) END AS b FROM k
  UNION ALL SELECT *, CASE WHEN flag = 1 THEN greatest(lo, kink) ELSE greatest(lo, t) END,
                      CASE WHEN flag = 1 THEN least(hi, t) ELSE least(hi, kink) END FROM k
  UNION ALL SELECT *, CASE WHEN flag = 1 THEN lo ELSE greatest(lo, kink) END,
                      CASE WHEN flag = 1 THEN least(hi, kink) ELSE hi END FROM k),
zz AS (SELECT *, {_SCORE.format(x='a')} AS za, {_SCORE.format(x='b')} AS zb FROM s WHERE b > a),
q(node, weight) AS (VALUES {_NODES}),
v AS (SELECT rid, row_id, draw, cap, rm, t, flag, mu, sigma, weight * (zb - za) / 20.0 AS w,
    za + (zb - za) * (CAST(i AS DOUBLE) + (node + 1.0) / 2.0) / 10.0 AS z FROM zz, q, range(0, 10) r(i)),
d AS (SELECT *, CASE WHEN flag = 1 THEN t - exp(mu + sigma * z) ELSE exp(mu + sigma * z) - t END AS dist FROM v),
g AS (SELECT row_id, draw, cap, sum(w * 0.3989422804014327 * exp(-z * z / 2.0) *
    CASE WHEN dist > 0 THEN least(pow(rm, least(dist, 1e4)), cap) ELSE 1.0 END) AS integral
  FROM d GROUP BY rid, row_id, draw, cap),
y AS (SELECT *, (integral - 1.0) / NULLIF(cap - 1.0, 0) AS sev FROM g)
SELECT row_id, draw, {r6('integral')} AS integral, {r6('sev')} AS sev,
  {r6('1.0 - 1.0 / NULLIF(sev * (cap - 1.0) + 1, 0)')} AS paf FROM y"""

SQL["exposure_density"] = f"""WITH {EXPO},
c AS (SELECT *, m * 0.8 AS x FROM p),
v AS (SELECT *, CASE WHEN flag = 1 THEN t - x ELSE x - t END AS dist FROM c)
SELECT row_id, draw,
  {r6('1.0 / (x * sigma * ' + repr(math.sqrt(2 * math.pi)) + ') * exp(-pow(ln(x) - mu, 2) / (2 * pow(sigma, 2)))')} AS density,
  {r6('CASE WHEN dist > 0 THEN (CASE WHEN pow(rm, dist) < cap THEN pow(rm, dist) ELSE cap END) ELSE 1.0 END')} AS rr
FROM v"""

SQL["cohort_lag"] = f"""WITH {ASFR}
SELECT a.location_id, a.age_group_id, a.year_id, {r6('a.asfr')} AS asfr, {r6('p.asfr')} AS lag_asfr
FROM asfr a JOIN asfr p ON a.location_id = p.location_id AND a.age_group_id = p.age_group_id + 1
  AND a.year_id = p.year_id + 5
WHERE a.asfr IS NOT NULL AND p.asfr IS NOT NULL"""

SQL["arc_forecast"] = f"""WITH {ASFR},
hist AS (SELECT * FROM asfr WHERE year_id >= 1995 AND year_id <= 2000),
r AS (SELECT *, CASE WHEN lag(year_id) OVER w = year_id - 1
          THEN ln(asfr / NULLIF(lag(asfr) OVER w, 0)) END AS r,
        pow(year_id - 1995 + 1, 0.4) AS wt
      FROM hist WINDOW w AS (PARTITION BY location_id, age_group_id ORDER BY year_id)),
agg AS (SELECT location_id, age_group_id, sum(wt * r) / sum(wt) AS arc FROM r
        WHERE r IS NOT NULL GROUP BY ALL),
last AS (SELECT location_id, age_group_id, asfr AS lastv FROM hist WHERE year_id = 2000)
SELECT location_id, age_group_id, year_id, {r6('asfr')} AS asfr, FALSE AS forecast FROM hist
UNION ALL
SELECT a.location_id, a.age_group_id, CAST(2000 + h AS INTEGER), {r6('l.lastv * exp(a.arc * h)')}, TRUE
FROM agg a JOIN last l ON a.location_id = l.location_id AND a.age_group_id = l.age_group_id,
  range(1, 6) t(h)"""

SQL["lab_ratio_pipeline"] = f"""WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, value
  FROM events WHERE value IS NOT NULL AND event_type IN ('purchase', 'view')),
w AS (SELECT user_id, day, avg(value) FILTER (WHERE event_type = 'purchase') AS purchase,
        avg(value) FILTER (WHERE event_type = 'view') AS view FROM e GROUP BY ALL),
r AS (SELECT *, purchase / NULLIF(view, 0) AS ratio FROM w WHERE purchase IS NOT NULL AND view IS NOT NULL)
SELECT user_id, day, {r6('purchase')} AS purchase, {r6('view')} AS view, {r6('ratio')} AS ratio,
  ratio >= 30 AS elevated FROM r WHERE ratio BETWEEN 0.18 AND 181"""

SQL["sql_over_view"] = f"""SELECT * FROM ({SQL["group_mean_plus"]}) WHERE price_limit > 0"""

SQL["ols_by_panel"] = f"""SELECT l_returnflag, {r6('regr_slope(l_extendedprice, l_quantity)')} AS slope,
  {r6('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
  {r6('regr_r2(l_extendedprice, l_quantity)')} AS r2,
  CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1"""

OLS2 = """s AS (SELECT l_returnflag, covar_pop(l_quantity, l_extendedprice) AS c1y,
    covar_pop(l_discount, l_extendedprice) AS c2y, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2,
    covar_pop(l_quantity, l_discount) AS c12, avg(l_extendedprice) AS my, avg(l_quantity) AS m1,
    avg(l_discount) AS m2 FROM lineitem
  WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1),
b AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1,
        (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s),
coef AS (SELECT l_returnflag, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM b)"""

SQL["grouped_ols"] = f"""WITH {OLS2}
SELECT l_returnflag, 'intercept' AS term, {rn('b0', 4)} AS estimate FROM coef
UNION ALL SELECT l_returnflag, 'l_quantity', {rn('b1', 4)} FROM coef
UNION ALL SELECT l_returnflag, 'l_discount', {rn('b2', 4)} FROM coef"""

SQL["grouped_ols_predict"] = f"""WITH {OLS2},
p AS (SELECT l.l_orderkey, l.l_linenumber, c.b0 + c.b1 * l.l_quantity + c.b2 * l.l_discount AS pred,
        l.l_extendedprice FROM lineitem l JOIN coef c ON l.l_returnflag = c.l_returnflag)
SELECT l_orderkey, l_linenumber, {rn('pred', 3)} AS pred,
  {rn('l_extendedprice - pred', 3)} AS resid FROM p"""

SQL["t_statistic"] = f"""WITH g AS (SELECT
    count(value) FILTER (WHERE event_type = 'view') AS n1,
    count(value) FILTER (WHERE event_type = 'purchase') AS n2,
    avg(value) FILTER (WHERE event_type = 'view') AS mean1,
    avg(value) FILTER (WHERE event_type = 'purchase') AS mean2,
    var_samp(value) FILTER (WHERE event_type = 'view') AS var1,
    var_samp(value) FILTER (WHERE event_type = 'purchase') AS var2
  FROM events WHERE value IS NOT NULL),
t AS (SELECT *, ((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) AS sp2 FROM g)
SELECT n1, n2, {r6('mean1')} AS mean1, {r6('mean2')} AS mean2,
  {r6('(mean1 - mean2) / sqrt(sp2 * (1.0 / n1 + 1.0 / n2))')} AS t,
  CAST(n1 + n2 - 2 AS BIGINT) AS df FROM t"""



def _t_pvalue(source: str, t: str, df: str, out: str, key: str = "0") -> str:
    """CTE ``out`` (k, p): two-sided Student-t p-values of the rows of ``source``, by Simpson's rule
    on the density.  Beyond |t| = 40 they are below any digit that is kept (df over 1000 here)."""
    return f"""{out} AS (SELECT k, CASE WHEN abs(t) > 40 THEN 0.0 ELSE 1 - 2 * abs(t) / 6000
    * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi())
      * pow(1 + pow(abs(t) * i / 2000.0, 2) / df, -(df + 1) / 2.0)) END AS p
  FROM (SELECT {key} AS k, CAST({t} AS DOUBLE) AS t, CAST({df} AS DOUBLE) AS df FROM {source}), range(2001) AS s(i)
  GROUP BY k, t, df)"""


SQL["t_test"] = f"""WITH g AS (SELECT
    count(value) FILTER (WHERE event_type = 'view') AS n1,
    count(value) FILTER (WHERE event_type = 'purchase') AS n2,
    avg(value) FILTER (WHERE event_type = 'view') AS mean1,
    avg(value) FILTER (WHERE event_type = 'purchase') AS mean2,
    var_samp(value) FILTER (WHERE event_type = 'view') AS var1,
    var_samp(value) FILTER (WHERE event_type = 'purchase') AS var2
  FROM events WHERE value IS NOT NULL),
t AS (SELECT *, (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)
    * (1.0 / n1 + 1.0 / n2)) AS t, CAST(n1 + n2 - 2 AS BIGINT) AS df FROM g),
{_t_pvalue("t", "t", "df", "pv")}
SELECT n1, n2, {r6('mean1')} AS mean1, {r6('mean2')} AS mean2, {r6('t')} AS t, df, {r6('p')} AS p_value
FROM t, pv"""


def _signif(x: str, digits: int = 5) -> str:
    e = f"(floor(log10(abs({x}))) - {digits - 1})"
    return (f"CASE WHEN {x} = 0 THEN 0.0 WHEN {e} < 0 THEN round({x} * pow(10.0, -{e})) / pow(10.0, -{e}) "
            f"ELSE round({x} / pow(10.0, {e})) * pow(10.0, {e}) END")


SQL["model_comparison"] = f"""WITH l AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x,
    CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END AS ly, CASE WHEN l_quantity > 0 THEN ln(l_quantity) END AS lx
  FROM lineitem),
r AS (SELECT 'lm1' AS model, y, x FROM l UNION ALL SELECT 'lm2', ly, x FROM l UNION ALL SELECT 'lm3', ly, lx FROM l),
f AS (SELECT model, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_count(y, x) AS n,
    regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_avgx(y, x) AS mx FROM r GROUP BY model),
v AS (SELECT *, n - 2 AS df, syy * (1 - r2) / (n - 2) AS s2 FROM f),
t AS (SELECT *, b / sqrt(s2 / sxx) AS tb, a / sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS ta FROM v),
{_t_pvalue("t", "tb", "df", "pb", "model")},
{_t_pvalue("t", "ta", "df", "pa", "model")}
SELECT model, {_signif('b')} AS slope, {_signif('a')} AS intercept, {_signif('r2')} AS r_sq,
  {_signif('pb.p')} AS p_slope, {_signif('pa.p')} AS p_intercept
FROM t JOIN pb ON pb.k = model JOIN pa ON pa.k = model"""

SQL["residual_autocorr"] = f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS y,
    CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),
r AS (SELECT d.day, d.y - (f.a + f.b * d.x) AS resid FROM d, f),
p AS (SELECT resid, lead(resid) OVER (ORDER BY day) AS next_resid FROM r)
SELECT {rn('regr_slope(next_resid, resid)', 4)} AS slope,
  {rn('regr_intercept(next_resid, resid)', 4)} AS intercept,
  {rn('regr_r2(next_resid, resid)', 4)} AS r2,
  CAST(regr_count(next_resid, resid) AS BIGINT) AS n FROM p WHERE next_resid IS NOT NULL"""

SQL["standardized_ols"] = f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
    avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem),
z AS (SELECT (l_quantity - mq) / sq AS zq, (l_extendedprice - mp) / sp AS zp FROM lineitem, s)
SELECT {r6('regr_slope(zp, zq)')} AS slope, {r6('regr_intercept(zp, zq)')} AS intercept,
  {r6('regr_r2(zp, zq)')} AS r2, CAST(regr_count(zp, zq) AS BIGINT) AS n FROM z"""

SQL["bernoulli_draws_portable"] = f"""WITH l AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_discount * 10 AS p FROM lineitem)
SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber,
  {r6('any_value(p)')} AS p,
  CAST(count_if({sql_uniform('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'd', seed=3)} < p) AS BIGINT)
    AS n_events
FROM l, range(0, 100) t(d) GROUP BY rid"""

SQL["prefix_columns"] = f"""WITH {ld(True)}, {SEV_BY_RISK}
SELECT risk, location_id, year_id,
""" + ",\n".join(f"  {r6(f'avg(sev) FILTER (WHERE draw = {d})')} AS draw_{d}" for d in range(1, 8)) + """
FROM sev GROUP BY risk, location_id, year_id"""

SQL["drop_incomplete"] = f"""WITH {ADDR}
SELECT address, c_custkey, {r6('lat')} AS lat, {r6('lng')} AS lng FROM g
WHERE address IS NOT NULL AND c_custkey IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL"""

SQL["outer_fill"] = f"""WITH {ld(True)}, {SEV_BY_RISK}, {RR_BY_CAUSE}
SELECT coalesce(s.risk, r.risk) AS risk, coalesce(s.draw, r.draw) AS draw, s.location_id, s.year_id,
  r.acause, {r6('coalesce(s.sev, 0.0)')} AS sev, {r6('coalesce(r.rr, 1.0)')} AS rr
FROM sev s FULL OUTER JOIN rr r ON s.risk = r.risk AND s.draw = r.draw"""

SQL["normalize_names"] = f"""SELECT p_partkey AS partkey, p_name AS name,
  regexp_replace(p_brand, 'Brand#', 'B-', 'g') AS brand, p_type AS type, p_size AS size,
  {r6('p_retailprice')} AS retailprice FROM part"""

SQL["drop_position"] = f"""SELECT c_custkey, c_nationkey, {r6('c_acctbal')} AS c_acctbal FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <> 3"""

SQL["sort_nulls_last"] = f"""SELECT o_orderkey, o_orderpriority, {r6('o_totalprice')} AS o_totalprice FROM orders
ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey"""

SQL["modelling_table"] = f"""WITH {ASFR},
j AS (SELECT CAST(c.c_nationkey AS INTEGER) AS location_id, CAST(year(o.o_orderdate) AS INTEGER) AS year_id,
        CAST(o.o_custkey % 7 + 8 AS INTEGER) AS age_group_id, c.c_acctbal, o.o_totalprice
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
edu AS (SELECT location_id, year_id, age_group_id, avg(c_acctbal) / 500.0 AS asmedu FROM j GROUP BY ALL),
met AS (SELECT location_id, year_id, age_group_id, avg(o_totalprice) / 600000.0 AS met_demand FROM j GROUP BY ALL),
b(age_group_id, lb, ub) AS (VALUES (8, 0.0005::DOUBLE, 0.22::DOUBLE), (9, 0.01, 0.35),
   (10, 0.01, 0.4), (11, 0.02, 0.35), (12, 0.007, 0.3), (13, 0.0005, 0.18), (14, 0.00001, 0.10)),
locs AS (SELECT CAST(n_nationkey AS INTEGER) AS location_id, n_regionkey AS region_id,
          CAST(floor(n_regionkey / 2) AS INTEGER) AS super_region_id FROM nation),
d AS (SELECT a.location_id, a.year_id, a.age_group_id, a.asfr, e.asmedu, m.met_demand,
        (a.asfr - b.lb) / NULLIF(b.ub - b.lb, 0) AS sc,
        CASE WHEN CAST(floor(a.year_id / 10) * 10 AS INTEGER) BETWEEN 1950 AND 2010
             THEN CAST(floor(a.year_id / 10) * 10 AS INTEGER) END AS decade,
        l.region_id, l.super_region_id
      FROM asfr a JOIN edu e USING (location_id, year_id, age_group_id)
      JOIN met m USING (location_id, year_id, age_group_id)
      LEFT JOIN b ON a.age_group_id = b.age_group_id
      JOIN locs l ON a.location_id = l.location_id),
s AS (SELECT *, CASE WHEN sc < 0.001 THEN 0.001 WHEN sc > 0.999 THEN 0.999 ELSE sc END AS scaled_asfr FROM d),
k AS (SELECT min(asmedu) AS lo, max(asmedu) AS hi FROM s)
SELECT location_id, year_id, age_group_id, {r6('asfr')} AS asfr, {r6('asmedu')} AS asmedu,
  {r6('met_demand')} AS met_demand, {r6('scaled_asfr')} AS scaled_asfr,
  {r6('ln(scaled_asfr / (1 - scaled_asfr))')} AS logit_asfr, decade, region_id, super_region_id,
  {r6('coalesce(CASE WHEN asmedu >= lo AND asmedu < 6 THEN asmedu - lo WHEN asmedu >= 6 THEN 6 - lo END, 0)')} AS asmedu_below_6,
  {r6('coalesce(CASE WHEN asmedu >= 6 AND asmedu < 10 THEN asmedu - 6 WHEN asmedu >= 10 THEN 4.0 END, 0)')} AS asmedu_between_6_10,
  {r6('coalesce(CASE WHEN asmedu >= 10 AND asmedu < 14 THEN asmedu - 10 WHEN asmedu >= 14 THEN 4.0 END, 0)')} AS asmedu_between_10_14,
  {r6('coalesce(CASE WHEN asmedu >= 14 AND asmedu < hi THEN asmedu - 14 WHEN asmedu >= hi THEN hi - 14 END, 0)')} AS asmedu_above_14
FROM s, k"""

SQL["elevated_subset_fit"] = f"""WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, value
  FROM events WHERE value IS NOT NULL AND event_type IN ('purchase', 'view')),
w AS (SELECT user_id, day, avg(value) FILTER (WHERE event_type = 'purchase') AS purchase,
        avg(value) FILTER (WHERE event_type = 'view') AS view FROM e GROUP BY ALL),
r AS (SELECT *, purchase / NULLIF(view, 0) AS ratio FROM w WHERE purchase IS NOT NULL AND view IS NOT NULL),
s AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM r
      WHERE ratio BETWEEN 0.18 AND 181 AND ratio >= 1.5)
SELECT gender, {r6('regr_slope(purchase, view)')} AS slope, {r6('regr_intercept(purchase, view)')} AS intercept,
  {r6('regr_r2(purchase, view)')} AS r2, CAST(regr_count(purchase, view) AS BIGINT) AS n,
  {r6('corr(purchase, view)')} AS corr FROM s GROUP BY gender"""

SQL["arc_scenarios"] = f"""WITH {ASFR},
hist AS (SELECT * FROM asfr WHERE year_id >= 1995 AND year_id <= 2000),
r AS (SELECT *, CASE WHEN lag(year_id) OVER w = year_id - 1
          THEN ln(asfr / NULLIF(lag(asfr) OVER w, 0)) END AS r,
        pow(year_id - 1995 + 1, 0.4) AS wt
      FROM hist WINDOW w AS (PARTITION BY location_id, age_group_id ORDER BY year_id)),
agg AS (SELECT location_id, age_group_id, sum(wt * r) / sum(wt) AS arc FROM r
        WHERE r IS NOT NULL GROUP BY ALL),
q AS (SELECT age_group_id, quantile_cont(arc, 0.15) AS lo, quantile_cont(arc, 0.85) AS hi
      FROM agg GROUP BY age_group_id),
last AS (SELECT location_id, age_group_id, asfr AS lastv FROM asfr WHERE year_id = 2000),
b AS (SELECT a.location_id, a.age_group_id, a.arc, q.lo, q.hi, l.lastv FROM agg a
      JOIN q ON a.age_group_id = q.age_group_id
      JOIN last l ON a.location_id = l.location_id AND a.age_group_id = l.age_group_id),
s AS (SELECT location_id, age_group_id, -1 AS scenario, lo AS rate, lastv FROM b
      UNION ALL SELECT location_id, age_group_id, 0, arc, lastv FROM b
      UNION ALL SELECT location_id, age_group_id, 1, hi, lastv FROM b)
SELECT location_id, age_group_id, scenario, CAST(2000 + h AS INTEGER) AS year_id,
  {r6('lastv * exp(rate * h)')} AS asfr FROM s, range(1, 6) t(h)"""

PRIORITY_TREE = """h AS (SELECT 1 AS rei_id, 'urgent' AS rei, '0,1' AS path, 1 AS level
      UNION ALL SELECT 2, 'routine', '0,2', 1
      UNION ALL SELECT DISTINCT CAST(substring(o_orderpriority, 1, 1) AS INTEGER) + 10, o_orderpriority,
        '0,' || CASE WHEN CAST(substring(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN '1' ELSE '2' END
        || ',' || CAST(CAST(substring(o_orderpriority, 1, 1) AS INTEGER) + 10 AS VARCHAR), 2
      FROM orders)"""

SQL["cluster_scalar"] = f"""WITH {PAF_VERSIONED}, {MEDIATION}, {PRIORITY_TREE},
rrp AS (SELECT DISTINCT acause, risk FROM rr),
pos AS (SELECT p.acause, p.risk, TRY_CAST(trim(split_part(h.path, ',', lv + 1)) AS INTEGER) AS anc
        FROM rrp p JOIN h ON h.rei = p.risk CROSS JOIN (VALUES (1), (2)) v(lv)
        WHERE lv < len(string_split(h.path, ','))),
cl0 AS (SELECT DISTINCT pos.acause, pos.risk, h.rei AS cluster FROM pos
        JOIN h ON h.rei_id = pos.anc AND h.level IN (1, 2)),
sz AS (SELECT acause, cluster, count(*) AS n, max(risk = cluster) AS self FROM cl0 GROUP BY ALL),
cl AS (SELECT cl0.* FROM cl0 JOIN sz ON cl0.acause = sz.acause AND cl0.cluster = sz.cluster
       WHERE NOT (sz.n = 1 AND sz.self)),
p AS (SELECT pv.*, cl.cluster FROM pv JOIN cl ON pv.acause = cl.acause AND pv.risk = cl.risk
      WHERE pv.paf IS NOT NULL),
prods AS (SELECT m.acause, m.mediator AS risk, product(1 - m.mean) AS mediation
          FROM med m SEMI JOIN rrp ON m.acause = rrp.acause AND m.risk = rrp.risk
          GROUP BY m.acause, m.mediator),
pm AS (SELECT p.*, coalesce(prods.mediation, 1.0) AS mediation FROM p
       LEFT JOIN prods ON p.acause = prods.acause AND p.risk = prods.risk),
nu AS (SELECT acause, cluster, version, count(DISTINCT risk) AS n_usable FROM pm GROUP BY ALL),
cells AS (SELECT acause, cluster, version, location_id, year_id, draw,
                 product(1 - paf * mediation) AS pr, count(DISTINCT risk) AS n
          FROM pm GROUP BY acause, cluster, version, location_id, year_id, draw),
comb AS (SELECT c.acause, c.cluster, c.version, c.location_id, c.year_id, c.draw,
                CASE WHEN 1 - c.pr > 0.9999 THEN 0.9999 ELSE 1 - c.pr END AS paf
         FROM cells c JOIN nu ON c.acause = nu.acause AND c.cluster = nu.cluster
           AND c.version = nu.version WHERE c.n = nu.n_usable),
mx AS (SELECT acause, cluster, version, max(paf) AS mx FROM comb GROUP BY ALL),
sc AS (SELECT c.acause, c.cluster, c.version, c.location_id, c.year_id, c.draw,
              c.paf * CASE WHEN mx.mx > 0.95 THEN 0.95 / mx.mx ELSE 1.0 END AS paf
       FROM comb c JOIN mx ON c.acause = mx.acause AND c.cluster = mx.cluster
         AND c.version = mx.version)
SELECT acause, cluster, version, location_id, year_id, draw, {r6('paf')} AS paf,
       {r6('1.0 / NULLIF(1 - paf, 0)')} AS scalar FROM sc"""


def _vincenty_sql() -> str:
    """X7 precise mode in SQL: the same fixed 100 Vincenty iterations as
    ``numeric.add_vincenty_km``, as a recursive CTE."""
    a, f, b, r = 6378.137, 0.0033528106647474805, 6356.752314245179, 0.017453292519943295
    return f"""WITH RECURSIVE {ADDR},
base AS (SELECT address, c_custkey, lat, lng,
    atan((1 - {f!r}) * tan(lat * {r!r})) AS U1, atan((1 - {f!r}) * tan(38.8976763 * {r!r})) AS U2,
    (-77.0387185 - lng) * {r!r} AS L FROM g WHERE lat IS NOT NULL),
b2 AS (SELECT address, c_custkey, lat, lng, sin(U1) AS sU1, cos(U1) AS cU1, sin(U2) AS sU2,
    cos(U2) AS cU2, L FROM base),
it(address, c_custkey, lat, lng, sU1, cU1, sU2, cU2, L, lam, i) AS (
  SELECT address, c_custkey, lat, lng, sU1, cU1, sU2, cU2, L, L, 0 FROM b2
  UNION ALL
  SELECT address, c_custkey, lat, lng, sU1, cU1, sU2, cU2, L,
    L + (1 - C) * {f!r} * sa * (sig + C * sin_sig * (c2m + C * cos_sig * (-1 + 2 * c2m * c2m))), i + 1
  FROM (SELECT *, {f / 16!r} * c2a * (4 + {f!r} * (4 - 3 * c2a)) AS C FROM (
    SELECT *, CASE WHEN c2a = 0 THEN 0.0 ELSE cos_sig - 2 * sU1 * sU2 / c2a END AS c2m FROM (
      SELECT *, 1.0 - sa * sa AS c2a FROM (
        SELECT *, atan2(sin_sig, cos_sig) AS sig,
          CASE WHEN sin_sig = 0 THEN 0.0 ELSE cU1 * cU2 * sin(lam) / sin_sig END AS sa FROM (
          SELECT *, sqrt(pow(cU2 * sin(lam), 2) + pow(cU1 * sU2 - sU1 * cU2 * cos(lam), 2)) AS sin_sig,
            sU1 * sU2 + cU1 * cU2 * cos(lam) AS cos_sig FROM it WHERE i < 100) t1) t2) t3) t4) t5),
fin AS (SELECT address, c_custkey, lat, lng,
    sqrt(pow(cU2 * sin(lam), 2) + pow(cU1 * sU2 - sU1 * cU2 * cos(lam), 2)) AS ss,
    sU1 * sU2 + cU1 * cU2 * cos(lam) AS cs, sU1, sU2, cU1, cU2, lam FROM it WHERE i = 100),
fin2 AS (SELECT *, atan2(ss, cs) AS sg,
    CASE WHEN ss = 0 THEN 0.0 ELSE cU1 * cU2 * sin(lam) / ss END AS sa FROM fin),
fin3 AS (SELECT *, 1.0 - sa * sa AS c2a FROM fin2),
fin4 AS (SELECT *, CASE WHEN c2a = 0 THEN 0.0 ELSE cs - 2 * sU1 * sU2 / c2a END AS c2m,
    c2a * ({a!r} * {a!r} - {b!r} * {b!r}) / ({b!r} * {b!r}) AS u2 FROM fin3),
fin5 AS (SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS AA,
    u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS BB FROM fin4),
fin6 AS (SELECT *, BB * ss * (c2m + BB / 4 * (cs * (-1 + 2 * c2m * c2m) -
    BB / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m))) AS dsig FROM fin5)
SELECT address, c_custkey, {r6('lat')} AS lat, {r6('lng')} AS lng,
  {r6('CASE WHEN ss = 0 THEN 0.0 ELSE ' + repr(b) + ' * AA * (sg - dsig) END')} AS distance_km
FROM fin6"""


SQL["vincenty_distance"] = _vincenty_sql()
