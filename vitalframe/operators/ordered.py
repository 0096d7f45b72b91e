"""Operators over one global order: positions, running sums, shifts.

A table is range-partitioned by the order, sorted inside each partition and
written once with its partition number and the row's place there.  The driver
reads one number per partition (a count or a sum), whose prefix sums become a
literal; so a global position is prefix + place, with no unpartitioned window and
no task that holds more than one range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .windows import _specs

_PART, _PLACE = "__part", "__place"
_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id: partition above, row number in the lower 33 bits


def _ranged(df: DataFrame, order_by, name: str) -> DataFrame:
    """``df`` in range partitions of the order, with partition number and place, as a table.

    ``order_by`` items are column names or (name, descending); nulls come last.  Rows
    that tie are ordered by a hash of the whole row; rows equal in every column can
    change places freely, and a mass of them is spread by their place in the input.
    """
    tagged = df.withColumns({"__tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]),
                             "__in": F.monotonically_increasing_id()})
    keys = [*_specs(order_by), F.col("__tie"), F.col("__in")]
    rows = tagged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie", "__in")
    return cut_lineage(rows.withColumns({
        _PART: F.spark_partition_id(),
        _PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))}), name)


def _by_part(numbers: dict) -> Column:
    """The number of the row's partition, from a literal of one number per partition."""
    top = max(numbers, default=0)
    text = ",".join(str(numbers.get(i, 0)) for i in range(top + 1))
    return F.element_at(F.split(F.lit(text), ",").cast("array<bigint>"), F.col(_PART) + 1)


def _before(table: DataFrame, amount: Column) -> tuple[dict, dict]:
    """Per partition: the amounts of all partitions before it, and its own."""
    own = {r[0]: int(r[1] or 0) for r in table.groupBy(_PART).agg(amount).collect()}
    parts = range(max(own, default=-1) + 1)
    sums = accumulate((own.get(i, 0) for i in parts), initial=0)
    return dict(zip(parts, sums, strict=False)), own


def global_position(df: DataFrame, order_by, out: str = "position", first: int = 0) -> DataFrame:
    """Every row's position in one global order, counted from ``first``."""
    table = _ranged(df, order_by, "position")
    before, _ = _before(table, F.count("*"))
    return (table.withColumn(out, _by_part(before) + F.col(_PLACE) + F.lit(first))
            .select(*df.columns, out))


def drop_global_position(df: DataFrame, position: int, order_by) -> DataFrame:
    """Drop the row at 1-based ``position`` of a global order."""
    return (global_position(df, order_by, "__pos", 1)
            .where(F.col("__pos") != position).select(*df.columns))


def running_sum(df: DataFrame, order_by, value: str, out: str = "running") -> DataFrame:
    """Sum of a whole-number column over all rows before this one in a global order (null counts 0)."""
    table = _ranged(df, order_by, "running")
    amount = F.coalesce(F.col(value).cast("long"), F.lit(0))
    before, _ = _before(table, F.sum(amount))
    w = Window.partitionBy(_PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    return (table.withColumn(out, _by_part(before) + F.coalesce(F.sum(amount).over(w), F.lit(0)))
            .select(*df.columns, out))


def global_shift(df: DataFrame, order_by, columns, offset: int = 1, prefix: str | None = None) -> DataFrame:
    """W1/W3 over one global order: the columns' values ``offset`` rows earlier (later if negative).

    The shift runs inside each range; only the rows at its edge, at most ``|offset|``
    of a partition, cross to the next one (a join by position whose side is bounded
    by partitions x offset).  Names get ``prefix`` (``prev_`` or ``next_``).
    """
    columns = list(columns)
    prefix = prefix if prefix is not None else ("prev_" if offset > 0 else "next_")
    k = abs(offset)
    if k == 0:
        return df.withColumns({prefix + c: F.col(c) for c in columns})
    table = _ranged(df, order_by, "shift")
    before, own = _before(table, F.count("*"))
    size, place = _by_part(own), F.col(_PLACE)
    rows = table.withColumn("__pos", _by_part(before) + place)
    w = Window.partitionBy(_PART).orderBy(_PLACE)
    step = F.lag if offset > 0 else F.lead
    inside = rows.withColumns({f"__s_{c}": step(c, k).over(w) for c in columns})
    # rows whose value is wanted in another partition, named by the position that wants it
    edge = rows.where(size - place <= k if offset > 0 else place < k).select(
        (F.col("__pos") + offset).alias("__at"), *[F.col(c).alias(f"__e_{c}") for c in columns])
    outer = place < k if offset > 0 else size - place <= k
    joined = inside.join(F.broadcast(edge), (F.col("__pos") == F.col("__at")) & outer, "left")
    return joined.select(*df.columns, *[
        F.when(outer, F.col(f"__e_{c}")).otherwise(F.col(f"__s_{c}")).alias(prefix + c) for c in columns])


def global_lag_pairs(df: DataFrame, order_by, value: str) -> DataFrame:
    """(value_i, value_{i+1}) pairs of one series of any length, as ``value`` and ``next_value``."""
    return global_shift(df, order_by, [value], -1).where(F.col("next_" + value).isNotNull())
