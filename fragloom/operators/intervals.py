"""Joins of numbers with ranges of numbers, and ranges less ranges, within a prefix. [D8, D9]

A range is put into cells whose width, a power of 1024, is the least that is not below its length, so it lies in two cells at most, whatever
its length. A number looks into its cell of each width that occurs. Equal cells are an equi join on (prefix, width, cell), so one prefix
with most of the rows is spread over its cells, and no range is ever written out number by number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by which a width exceeds the one before; widths.
BITS, WIDTHS = 10, 7

KEYS = ["prefix", "width", "cell"]


def _cell(n: Column, width: int) -> Column:
    return F.shiftright(n, BITS * width) if width else n


def width_of(low: Column, high: Column) -> Column:
    """The number of the width of a range."""
    width = F.lit(WIDTHS - 1)
    for w in range(WIDTHS - 2, -1, -1):
        width = F.when(high - low < (1 << (BITS * w)), F.lit(w)).otherwise(width)
    return width


def in_cells(ranges: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """ranges (prefix, low, high, ...) with width and cell: one or two rows each. Ranges that end before they begin have none."""
    rows = ranges.where(F.col(low) <= F.col(high)).withColumn("width", width_of(F.col(low), F.col(high)))
    at = lambda c: F.call_function("shiftright", F.col(c), F.col("width") * BITS)
    return rows.withColumn("cell", F.explode(F.sequence(at(low), at(high))))


def widths(cells: DataFrame) -> list[int]:
    """The widths that occur, WIDTHS at most."""
    return sorted(r["width"] for r in cells.select("width").distinct().collect())


def looking(numbers: DataFrame, n: str, some: Sequence[int]) -> DataFrame:
    """numbers (prefix, n, ...) with width and cell: a row for each of some widths."""
    if not some:
        return numbers.where(F.lit(False)).withColumns({"width": F.lit(0), "cell": F.col(n)})
    places = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), _cell(F.col(n), w).alias("cell")) for w in some)))
    return numbers.withColumn("_at", places).withColumns({"width": F.col("_at.width"), "cell": F.col("_at.cell")}).drop("_at")


def gaps(low: Column, high: Column, covered: Column) -> Column:
    """What an array of ranges (low, high) leaves of low to high: array of (low, high), in order."""
    state = F.struct(low.alias("at"), F.array().cast("array<struct<low:bigint,high:bigint>>").alias("out"))
    left = lambda a, b: F.when(a <= b, F.array(F.struct(a.alias("low"), b.alias("high")))).otherwise(F.array().cast("array<struct<low:bigint,high:bigint>>"))
    step = lambda s, r: F.struct(F.greatest(s["at"], r["high"] + 1).alias("at"), F.concat(s["out"], left(s["at"], F.least(r["low"] - 1, high))).alias("out"))
    return F.aggregate(F.array_sort(covered), state, step, lambda s: F.concat(s["out"], left(s["at"], high)))


def overlaps(wanted: DataFrame, ranges: DataFrame, some: Sequence[int], mark) -> DataFrame:
    """Rows of wanted (prefix, low, high, ...), each at least once, joined with each of ranges (prefix, low, high), of some widths, that they share a
    number with, as r_low and r_high; null without one. Either the range holds the first number wanted, or its own first number is a later
    one of those wanted: two joins of numbers with ranges, and no pair twice. mark: broadcast for ranges of a checked size."""
    have = ranges.where("low <= high").select("prefix", F.col("low").alias("r_low"), F.col("high").alias("r_high"))
    keyed = lambda df: df.withColumnsRenamed({c: f"_{c}" for c in KEYS})
    same = (F.col("prefix") == F.col("_prefix")) & (F.col("width") == F.col("_width")) & (F.col("cell") == F.col("_cell"))
    first = looking(wanted, "low", some).join(mark(keyed(in_cells(have, "r_low", "r_high"))), same & F.col("low").between(F.col("r_low"), F.col("r_high")), "left")
    later = in_cells(wanted).join(mark(keyed(looking(have, "r_low", range(WIDTHS)))), same & (F.col("r_low") > F.col("low")) & (F.col("r_low") <= F.col("high")))
    return first.unionByName(later).select(*wanted.columns, "r_low", "r_high")
