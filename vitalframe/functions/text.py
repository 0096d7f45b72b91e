"""String column expressions: text numbers, two-digit-year dates, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def to_number(x) -> Column:
    """Text to double; unparsable ('<1.6', 'PENDING') and 'nan' -> null."""
    v = F.trim(_c(x)).try_cast("double")
    return F.when(~F.isnan(v), v)


def two_digit_year(s) -> Column:
    """The year field of 'm/d/yy hh:mm' as an int (null if malformed)."""
    third = F.get(F.split(_c(s), "/"), 2)
    return F.get(F.split(third, " "), 0).try_cast("int")


def age_from_two_digit_years(birth, order, pivot: int = 17) -> Column:
    """Order year < pivot belongs to the next century; age = order - birth."""
    b, o = two_digit_year(birth), two_digit_year(order)
    o = F.when(o < pivot, o + 100).otherwise(o)
    return o - b


_PLACEHOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def render_template(template: str, mapping: dict[str, str]) -> Column:
    """Fill ``${NAME}`` placeholders from columns.

    Strict: every placeholder must be mapped, else ``KeyError`` up front
    (before any job runs).
    """
    names = _PLACEHOLDER.findall(template)
    missing = [n for n in names if n not in mapping]
    if missing:
        raise KeyError(f"template placeholders without a column: {missing}")
    out = F.lit(template)
    for n in dict.fromkeys(names):
        out = F.replace(out, F.lit("${" + n + "}"),
                        F.coalesce(_c(mapping[n]).cast("string"), F.lit("")))
    return out
