"""Rows in a total order, spread over range partitions, with the place of each within its group.

The rows are split into ranges, sorted within each, and written once; what is then counted for each range and group gives
the first place of that group in that range. No task holds more than a range, and no row is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrolith.llm.common import TMP, materialize

#: The row number within a partition takes the lower bits of a monotonically increasing id.
ROW_BITS = 33


def range_sorted(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` in ranges of ``order``, written sorted: with the number of the range and the row's number in it.

    Finding the ranges reads ``df`` once more: hand over rows that are cheap to read.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{TMP}at", F.monotonically_increasing_id())
    part, row = F.shiftright(f"{TMP}at", ROW_BITS), F.col(f"{TMP}at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return materialize(ranged.withColumn(f"{TMP}part", part).withColumn(f"{TMP}row", row).drop(f"{TMP}at"), name)


def with_places(ranged: DataFrame, group: str | None = None, place: str = f"{TMP}place", size: str = f"{TMP}size") -> DataFrame:
    """``range_sorted`` rows, sorted by group first, with each row's place in its group (from 0) and the group's size.

    Offsets are one row for each range, and one more for each further group in a range: Spark broadcasts them if their
    files are small and joins by range and group otherwise.
    """
    key = F.lit(0) if group is None else F.col(group)
    spans = ranged.groupBy(f"{TMP}part", key.alias(f"{TMP}group")).agg(F.count(F.lit(1)).alias(f"{TMP}n"), F.min(f"{TMP}row").alias(f"{TMP}first"))
    whole = Window.partitionBy(f"{TMP}group")
    before = F.sum(f"{TMP}n").over(whole.orderBy(f"{TMP}part")) - F.col(f"{TMP}n")
    spans = spans.select(F.col(f"{TMP}part").alias(f"{TMP}p"), f"{TMP}group", f"{TMP}first", before.alias(f"{TMP}before"), F.sum(f"{TMP}n").over(whole).alias(size))
    spans = materialize(spans, "offsets")
    joined = ranged.join(spans, (F.col(f"{TMP}part") == F.col(f"{TMP}p")) & key.eqNullSafe(F.col(f"{TMP}group")))
    return joined.withColumn(place, F.col(f"{TMP}before") + F.col(f"{TMP}row") - F.col(f"{TMP}first")).drop(f"{TMP}p", f"{TMP}group", f"{TMP}before")
