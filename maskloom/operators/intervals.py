"""Intervals of one table that meet intervals of another in the same unit.

Positions are cut into bins of 64. What the one table covers of a bin is a mask of 64 bits, summed by or on the map side, so
however many intervals lie over each other a bin is one row, and no pair of intervals is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 64


def _masks(rows: DataFrame, keep: list[str], start: str, end: str) -> DataFrame:
    """keep, _bin, _mask: a row for each bin that an interval reaches into. Empty intervals reach into none."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    bins = F.sequence(F.floor(s / BIN), F.floor((e - 1) / BIN))
    cut = rows.filter(s < e).select(*keep, s.alias("_s"), e.alias("_e"), F.explode(bins).alias("_bin"))
    low, high = F.greatest(F.col("_s") - F.col("_bin") * BIN, F.lit(0)).cast("int"), F.least(F.col("_e") - F.col("_bin") * BIN, F.lit(BIN)).cast("int")
    below = lambda n: F.when(n >= BIN, F.lit(-1).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n)))
    mask: Column = below(high).bitwiseXOR(below(low))
    return cut.select(*keep, "_bin", mask.alias("_mask"))


def meeting(rows: DataFrame, spans: DataFrame, unit: list[str], row: str, start: str = "start", end: str = "end") -> DataFrame:
    """The values of `row` in rows (unit, row, start, end) whose interval shares a position with one of spans (unit, start, end). Touching is no overlap."""
    covered = _masks(spans, unit, start, end).groupBy(*unit, "_bin").agg(F.bit_or("_mask").alias("_covered"))
    met = _masks(rows, [*unit, row], start, end).join(covered, [*unit, "_bin"])
    return met.filter(F.col("_mask").bitwiseAND(F.col("_covered")) != 0).select(row).distinct()
