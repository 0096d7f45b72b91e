"""Risk -> PAF -> cause-scalar DAG.

The original ran one OS process per cause and a loop per risk, passing HDF
files between two scripts.  Here all causes, risks, versions and draws are
columns of one long table, so the whole thing is one Spark DAG:

* T2  SEV load: year slice, dense index, left join.
* T3  RRmax load: cause filter, clamp rr < 1.
* T4  risk-cause PAF: outer join on the keys RR has, fills, X1, de-dup.
* T5  cause scalar: drop paf-set-one pairs, mediation products (A4), the
      all-risks product (A5), cap, group-max rescale (A6), X2.

Shuffles: T4 joins on (risk, shared keys, draw); A5 aggregates on
(group, cell, draw) with map-side partial products; A6 is a tiny grouped
max joined back.  No row data reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paf as pafx
from ..operators import aggs, joins, reshape, windows


def load_sev(sev: DataFrame, index: DataFrame | None, version: str, y0: int,
             y1: int, y2: int, keys, year: str = "year_id") -> DataFrame:
    """Slice years for ``version`` and left-join onto the complete index
    (``index`` from :func:`reshape.complete_index`, already including the
    draw and risk columns it should be dense over)."""
    s = reshape.year_slice(sev, version, y0, y1, y2, year)
    if index is None:
        return s
    idx = reshape.year_slice(index, version, y0, y1, y2, year)
    return joins.complete(idx, s, keys)


def load_rrmax(rr: DataFrame, cause_col: str = "acause", causes=None,
               drop=(), rr_col: str = "rr", floor_to: float = 1.001) -> DataFrame:
    """Keep the causes asked for, drop id columns, clamp rr < 1."""
    out = rr
    if causes is not None:
        out = out.where(F.col(cause_col).isin(list(causes)))
    out = out.drop(*drop)
    return out.withColumn(rr_col, pafx.clamp_rr_below_one(rr_col, floor_to))


def risk_cause_paf(sev: DataFrame, rr: DataFrame, keys, draw: str = "draw",
                   risk: str = "risk", cause: str = "acause",
                   skip_risks=(), sev_col: str = "sev", rr_col: str = "rr",
                   tie_break=()) -> DataFrame:
    """T4: PAF for every (cause, risk) pair in one job.

    The join keys are the demography keys the RR side actually has (J4),
    plus risk and draw (J3: outer join semantics); missing SEV -> 0, missing
    RR -> 1 (P6); then
    ``scalar = sev (rr - 1) + 1`` and ``paf = 1 - 1/scalar`` (X1); rows are
    de-duplicated per (cause, risk, keys, draw) (W4).  Risks listed in
    ``skip_risks`` (vaccines in the original) are left out.
    """
    if skip_risks:
        sev = sev.where(~F.col(risk).isin(list(skip_risks)))
        rr = rr.where(~F.col(risk).isin(list(skip_risks)))
    on = [risk, draw] + joins.shared_keys(keys, rr)
    # The full outer join of the original, minus its SEV-only rows (they have
    # no cause and are dropped): matched rows by an inner join, RR-only rows
    # by an anti-join against the distinct SEV keys.  Unlike FULL OUTER, both
    # can be broadcast when one side is small and split by AQE when a join
    # key is hot (few risks x draws is a low-cardinality key).
    both = sev.join(rr, on, "inner")
    rr_only = rr.join(sev.select(*on).distinct(), on, "left_anti")
    j = both.unionByName(rr_only, allowMissingColumns=True)
    j = j.fillna({sev_col: 0.0, rr_col: 1.0})
    scalar = pafx.scalar_from_sev(sev_col, rr_col)
    j = j.withColumn("paf", pafx.paf_from_scalar(scalar))
    out_keys = [cause, risk] + list(keys) + [draw]
    j = j.where(F.col(cause).isNotNull())
    j = j.select(*out_keys, "paf").withColumn("__paf_null", F.col("paf").isNull())
    return windows.dedupe_first(j, out_keys, ["__paf_null", "paf", *tie_break]) \
                  .drop("__paf_null")


def mediation_products(mediation: DataFrame, cause_risks: DataFrame,
                       cause: str = "acause", risk: str = "risk",
                       mediator: str = "mediator", value: str = "mean") -> DataFrame:
    """A4 + J9: per (cause, mediator=risk) ``prod(1 - mean)`` over mediation
    rows whose own risk is one of the cause's risks."""
    med = joins.semi(mediation, cause_risks.select(cause, risk).distinct(), [cause, risk])
    prod = aggs.product_of_complements(med.drop(risk).withColumnRenamed(mediator, risk),
                                       [cause, risk], value, "mediation")
    return prod


def cause_scalar(paf: DataFrame, mediation: DataFrame | None, set_one: DataFrame | None,
                 group_keys, cell_keys, cause: str = "acause", risk: str = "risk",
                 cap: float = 0.9999, threshold: float = 0.95,
                 cause_risks: DataFrame | None = None,
                 materialize: bool = True) -> DataFrame:
    """T5: aggregate PAF over risks and turn it into a cause scalar.

    ``group_keys`` must start with the cause column (e.g. acause, version
    or acause, cluster, version); ``cell_keys`` are the demography keys
    plus draw.  A group with no usable risk yields no rows.
    ``cause_risks`` is the (cause, risk) list that limits the mediation
    rows: all risks of the cause, including pairs later set aside as
    paf-set-one (as the original passed its full list); a small dimension
    table, e.g. the distinct pairs of the RR input;
    without it the pairs are taken from ``paf`` at the cost of one more
    pass over it.  With it, the PAF rows are read once.
    ``materialize`` checkpoints the per-cell aggregate (at most PAF rows /
    number of risks) before its two consumers (usable-risk set, group max),
    so the PAF lineage is evaluated once even on retries.
    """
    p = paf.where(F.col("paf").isNotNull())
    if set_one is not None:
        p = joins.anti(p, set_one, [cause, risk])
    if mediation is not None:
        if cause_risks is None:
            cause_risks = p.select(cause, risk).distinct()
        prods = mediation_products(mediation, cause_risks, cause, risk)
        p = aggs.attach_product(p, prods, [cause, risk], "mediation")
    else:
        p = p.withColumn("mediation", F.lit(1.0))
    comb = aggs.combine_risks(p, group_keys, cell_keys, risk, "paf", "mediation", "paf",
                              materialize=materialize)
    comb = comb.withColumn("paf", pafx.cap_above("paf", cap))
    comb = aggs.rescale_by_group_max(comb, group_keys, "paf", threshold)
    return comb.withColumn("scalar", pafx.scalar_from_paf("paf"))


def cluster_scalar(paf: DataFrame, clusters: DataFrame, mediation: DataFrame | None,
                   set_one: DataFrame | None, cell_keys, cause: str = "acause",
                   risk: str = "risk", version: str = "version",
                   cause_risks: DataFrame | None = None) -> DataFrame:
    """T5 per risk cluster (steps 9-11 of the scalar lifecycle): each PAF row
    joins the clusters (A11) that contain its risk, then the same combine /
    cap / rescale runs per (cause, cluster, version).  ``clusters`` has
    (cause, cluster, risk) rows, one per membership; it is a small table
    (bounded by causes x risks x levels)."""
    p = paf.join(clusters.select(cause, "cluster", risk), [cause, risk], "inner")
    return cause_scalar(p, mediation, set_one, [cause, "cluster", version], cell_keys,
                        cause, risk, cause_risks=cause_risks)


def scalars_job(sev: DataFrame, rr: DataFrame, mediation: DataFrame | None,
                set_one: DataFrame | None, out_root: str, keys, version_of,
                update_past: bool = False) -> dict:
    """The two original scripts as one Spark job with files between stages.

    1. T4 PAF for all (cause, risk) pairs, tagged with ``version_of(year)``
       (a column expression), written keyed by (version, acause, risk) under
       ``out_root/paf`` (K2).  Only partitions not yet written are added
       unless ``update_past`` (K4 / K5 dynamic overwrite).
    2. The PAF dataset is read back (S7) — the written table also cuts the
       lineage — and T5 runs per (acause, version); scalars are written keyed
       by (version, acause) under ``out_root/scalar``.
    Returns the two output paths.
    """
    import os
    from ..sources import readers, sinks
    spark = sev.sparkSession
    paf_path, sc_path = os.path.join(out_root, "paf"), os.path.join(out_root, "scalar")
    keys = list(keys)
    paf = risk_cause_paf(sev, load_rrmax(rr), keys).withColumn("version", version_of)
    sinks.write_incremental(paf, paf_path, ["version", "acause", "risk"], overwrite=update_past)
    stored = readers.read_partitioned(spark, paf_path, schema=paf.schema)
    pairs = rr.select("acause", "risk").distinct()
    out = cause_scalar(stored, mediation, set_one, ["acause", "version"], keys + ["draw"],
                       cause_risks=pairs)
    sinks.write_incremental(out, sc_path, ["version", "acause"], overwrite=True)
    return {"paf": paf_path, "scalar": sc_path}
