"""Lab-test pipeline (T12): two test kinds per subject and day, their ratio,
the elevated subset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import clean, joins, quantiles, reshape, windows


def ratio_table(events: DataFrame, numerator: str = "purchase", denominator: str = "view",
                subject: str = "user_id", ts: str = "ts", kind: str = "event_type",
                value: str = "value", lo: float = 0.18, hi: float = 181.0,
                elevated_at: float = 30.0) -> DataFrame:
    """Per (subject, day): mean of each test kind (duplicates averaged by the
    pivot), ratio numerator / denominator kept in [lo, hi], ``elevated``
    flag for ratio >= ``elevated_at``.  Null values are dropped first."""
    e = (events.where(F.col(value).isNotNull() & F.col(kind).isin(numerator, denominator))
               .select(subject, F.date_format(ts, "yyyy-MM-dd").alias("day"), kind, value))
    wide = reshape.long_to_wide(e, [subject, "day"], kind, value,
                                values=[numerator, denominator])
    wide = wide.where(F.col(numerator).isNotNull() & F.col(denominator).isNotNull())
    out = wide.withColumn("ratio", numeric.ratio(numerator, denominator))
    out = out.where(F.col("ratio").between(lo, hi))
    return out.withColumn("elevated", F.col("ratio") >= elevated_at)


def lab_chain(tests: DataFrame, labs: DataFrame, kind: str = "event_type", numerator: str = "purchase",
              denominator: str = "view", same_as=("click",), subject: str = "user_id", day: str = "day",
              value: str = "result", pivot_year: int = 25, elevated_at: float = 1.5) -> DataFrame:
    """The whole lab pipeline.

    ``tests`` (subject, day, kind, result as text, birth_date, order_date, gender)
    and ``labs`` (lab_subject, lab_day, kind, result as text, row id): drop
    missing results (P2), age from two-digit years (P9), one code for equivalent
    tests (P7), text to numbers (P8), the two tests of a subject and day side by
    side (J6), their ratio (X3) within its 2.5 % and 97.5 % percentiles (A9), the
    day's lab tests joined on differently named keys (J5) with their number of
    repeats (W5), one column per lab test (O6) and the elevated flag (M24).
    """
    t = clean.null_rows(tests, value, is_null=False)
    t = clean.add_age(t, "birth_date", "order_date", pivot=pivot_year)
    t = clean.recode(t, kind, list(same_as), denominator)
    t = clean.numeric_or_drop(t, value)
    keys = [subject, day, "gender", "age"]
    sides = [t.where(F.col(kind) == k).select(*keys, value) for k in (numerator, denominator)]
    both = joins.self_join(*sides, keys, suffixes=("_num", "_den"))
    both = both.withColumn("ratio", numeric.ratio(f"{value}_num", f"{value}_den"))
    cut = quantiles.exact_quantiles(both, "ratio", (0.025, 0.975), names=["lo", "hi"]).first()
    lo, hi = cut["lo"], cut["hi"]
    both = both.where(F.col("ratio").between(F.lit(lo), F.lit(hi))).select(*keys, "ratio")
    found = clean.numeric_or_drop(labs, value)
    again = (windows.repeated_rows(found, ["lab_subject", "lab_day", kind], ["row_id"])
             .groupBy("lab_subject", "lab_day").agg(F.count("*").alias("n_repeats")))
    found = found.join(again, ["lab_subject", "lab_day"], "left").fillna({"n_repeats": 0})
    met = joins.on_pairs(both, found, [(subject, "lab_subject"), (day, "lab_day")])
    kinds = sorted(r[0] for r in labs.select(kind).distinct().collect())  # the lab codes: a column each
    wide = reshape.long_to_wide(met, [*keys, "ratio", "n_repeats"], kind, value, values=kinds)
    return wide.withColumn("elevated", F.col("ratio") >= elevated_at)
