"""Under-one population step (T10: J11, A17, W2, A3).

The original pushed 1000 draw columns through 52 weekly steps in a Python
loop (52 x 1000 column passes per location and sex, one location at a
time).  Here draws are rows, all locations/years/sexes go at once, and the
52-step recurrence is the closed-form running product of W2 over a
52-row window per cohort key, so the only shuffles are the nqx join and the
final group sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggs, joins, windows

COHORT = ["location_id", "year_id", "sex_id"]


def weekly_births(births: DataFrame, keys=COHORT, draw: str = "draw",
                  value: str = "births", legacy_draw_shift: bool = False,
                  n_draws: int | None = None) -> DataFrame:
    """Total weekly live births per cohort key and draw.

    ``legacy_draw_shift=True`` reproduces the original indexing where draw i
    read the births of draw i-1 and the first draw read the last one; draws
    must then be numbered 0..n_draws-1 (or pass ``n_draws``).
    """
    total = aggs.group_sums(births, list(keys) + [draw], [value]).withColumnRenamed(
        value, "new_borns")
    if legacy_draw_shift:
        if n_draws is None:
            raise ValueError("legacy_draw_shift needs n_draws")
        total = total.withColumn(draw, (F.col(draw) + 1) % n_draws)
    return total


def under_one_step(pop: DataFrame, nqx: DataFrame, births: DataFrame,
                   keys=COHORT, draw: str = "draw", bands: DataFrame | None = None,
                   legacy_draw_shift: bool = False, n_draws: int | None = None) -> DataFrame:
    """Population of age groups enn/lnn/pnn one year later.

    ``pop``: keys, age (enn/lnn/pnn), age_group_id, draw, pop.
    ``nqx``: keys, age, draw, q (weekly probability of death of the band).
    ``births``: keys, draw, births (rows are summed per key and draw).
    Returns keys, age_group_id, age, draw, pop (summed over the band's weeks).
    The starting population only fixes which cohorts exist: after 52 weekly
    steps none of it is left (see :func:`windows.cohort_survivors`).
    """
    keys = list(keys)
    if bands is None:
        bands = joins.week_bands(pop.sparkSession)
    x = joins.inner(pop.select(*keys, "age", "age_group_id", draw),
                    nqx.select(*keys, "age", draw, "q"), keys + ["age", draw])
    x = joins.replicate_by_band(x, bands.select("age", "wk_from", "wk_to"), "age", "age_wks")
    nb = weekly_births(births, keys, draw, legacy_draw_shift=legacy_draw_shift,
                       n_draws=n_draws)
    x = joins.inner(x, nb, keys + [draw])
    x = windows.cohort_survivors(x, keys + [draw], "age_wks", "q", "new_borns", "pop")
    return aggs.group_sums(x, keys + ["age_group_id", "age", draw], ["pop"])
