"""Ordered and grouped operators on any table: keys and columns are parameters. [E, F, G, C4]

All windows are partitioned by a key; none runs over a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fragloom.functions import codes as cd

Keys = Sequence[str]


def _before(keys: Keys, order: Sequence[Column | str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(keys: Keys, order: Sequence[Column | str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def version_rank(df: DataFrame, keys: Keys, code: str, out: str = "rank") -> DataFrame:
    """[G1] Place of each row in version order within its group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*cd.version_order(F.col(code)))))


def free_minors(df: DataFrame, keys: Keys, minor: str, out: str = "free_minor") -> DataFrame:
    """[C4] Per group, the smallest minor from 1 that is not taken: of 1 and of those that follow a taken one, the least that is not taken itself. A join on
    keys and minor, so a group with most of the rows is spread over its minors."""
    taken = df.select(*keys, F.col(minor).cast("int").alias(out)).distinct()
    maybe = taken.select(*keys, F.explode(F.array(F.lit(1), F.greatest(F.col(out) + 1, F.lit(1)))).alias(out)).distinct()
    same = F.lit(True)
    for c in (*keys, out):
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}"))
    return maybe.alias("m").join(taken.alias("t"), same, "left_anti").groupBy(*keys).agg(F.min(out).alias(out))


def neighbours(df: DataFrame, keys: Keys, order: Sequence[Column | str], skipped: Column, values: Sequence[str]) -> DataFrame:
    """prev and next: struct of values of the nearest row before and after that is not skipped, null at the ends."""
    row = F.when(~skipped, F.struct(*values))
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumns({"prev": F.last(row, True).over(_before(keys, order)), "next": F.first(row, True).over(after)})


def breaks(df: DataFrame, keys: Keys, order: Sequence[Column | str], start: Sequence[str], end: Sequence[str]) -> DataFrame:
    """Rows whose start differs from the end of the row before, as expected_<start> and the row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    expected = {f"expected_{s}": F.lag(e).over(w) for s, e in zip(start, end)}
    differs = F.lit(False)
    for s in start:
        differs = differs | (F.col(s) != F.col(f"expected_{s}"))
    return df.withColumns(expected).where(differs)


def step_faults(df: DataFrame, keys: Keys, order: Sequence[Column | str], parts: Column) -> DataFrame:
    """Rows whose number does not follow the last readable one: column fault. parts: struct(prefix, grp, first, last).

    unreadable rows are faults and nothing follows them; prefix changes; in a group the first number is the last plus one; in
    the next group it is 1; other groups and a mix of grouped and ungrouped numbers are faults."""
    rows = df.withColumn("_p", parts)
    rows = rows.withColumn("_q", F.last("_p", True).over(_before(keys, order)))
    p, q = (lambda f: F.col(f"_p.{f}")), (lambda f: F.col(f"_q.{f}"))
    grouped = p("grp").isNotNull() & q("grp").isNotNull()
    fault = (
        F.when(F.col("_p").isNull(), "unreadable")
        .when(F.col("_q").isNull(), F.lit(None))
        .when(p("prefix") != q("prefix"), "prefix")
        .when(p("grp").isNull() != q("grp").isNull(), "mixed")
        .when(grouped & (p("grp") == q("grp") + 1), F.when(p("first") != 1, F.lit("group start")))
        .when(grouped & (p("grp") != q("grp")), "group jump")
        .when(p("first") != q("last") + 1, "jump")
    )
    return rows.withColumn("fault", fault).where("fault is not null").withColumnsRenamed({"_p": "parts", "_q": "previous"})


def carry(df: DataFrame, keys: Keys, order: Sequence[Column | str], point: Column, value: Column, stop: Column, out: str) -> DataFrame:
    """value of the last point above, unless a row that stops carrying came since. A row's own point counts from the next on."""
    mark = F.when(point | stop, F.struct(point.alias("point"), value.alias("value")))
    last = F.last(mark, True).over(_upto(keys, order))
    return df.withColumn(out, F.when(last["point"], last["value"]))


def boundaries(df: DataFrame, keys: Keys, order: Sequence[Column | str], content: str, unit: str = "bytes") -> DataFrame:
    """start_line, start_char, end_line, end_char of contents that follow each other from line 1, column 0."""
    size = F.octet_length if unit == "bytes" else F.char_length
    rows = df.withColumns({"_n": F.regexp_count(F.col(content), F.lit("\n")), "_t": size(F.substring_index(content, "\n", -1)).cast("long")})
    rows = rows.withColumn("_g", F.coalesce(F.sum(F.when(F.col("_n") > 0, 1).otherwise(0)).over(_upto(keys, order)), F.lit(0)))
    inner = [*keys, "_g"]
    rows = rows.withColumns({"end_line": (1 + F.sum("_n").over(_upto(keys, order))).cast("int"), "end_char": F.sum("_t").over(_upto(inner, order)).cast("int")})
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"start_line": F.lag("end_line", 1, 1).over(w), "start_char": F.lag("end_char", 1, 0).over(w)}).drop("_n", "_t", "_g")


def ends(df: DataFrame, keys: Keys, order: Column, value: str) -> DataFrame:
    """first and last value of each group."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def first_rows(df: DataFrame, keys: Keys, order: Sequence[Column | str]) -> DataFrame:
    """[F7, G3] The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def repeated(df: DataFrame, keys: Keys, out: str = "group_size") -> DataFrame:
    """[E4] Every member of a group of two or more. Sizes are counted map-side and joined, so a hot key can be split."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) > 1)
    return df.join(many, list(keys))


def counts(df: DataFrame, keys: Keys, conditions: dict[str, Column]) -> DataFrame:
    """[E1, E2, E11, E12] Rows and rows under each condition, in one pass. Without keys: one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))


def grouped_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """[E3, E8] Per outer key, the sorted array of its inner keys with counts."""
    each = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(inner, "n"))).alias("items"), F.sum("n").alias("total"))


def joined_text(df: DataFrame, keys: Keys, order: Sequence[str], content: str, separator: str = "", out: str = "text") -> DataFrame:
    """[E10] Contents of a group, in order, as one string."""
    parts = F.array_sort(F.collect_list(F.struct(*order, content)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[content]), separator).alias(out))


def byte_loss(parts: DataFrame, wholes: DataFrame, keys: Keys, content: str, whole: str) -> DataFrame:
    """[E5] Bytes of the parts less bytes of the whole, per key: negative is loss, positive repetition."""
    held = parts.groupBy(*keys).agg(F.sum(F.octet_length(content)).cast("long").alias("part_bytes"))
    rows = wholes.select(*keys, F.octet_length(whole).cast("long").alias("whole_bytes")).join(held, list(keys), "left")
    return rows.withColumn("difference", F.coalesce("part_bytes", F.lit(0)) - F.col("whole_bytes"))

