"""Comparison of two exports. [K1, D10, E12]"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.operators.lookups import small

FIELDS = ("cst_file", "frag_idx_code", "frag_type", "cst_code", "cst_vagga", "cst_sutta", "cst_paranum")
KEYS = ["cst_file", "frag_idx_code"]


def compare(old: DataFrame, new: DataFrame, references: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows of new that old has too, with ``differs`` and ``regressed``. references: cst_code, cst_sutta, one row a code.

    A row regressed if it differs, the old title was the reference's for the old code and the new one is not: same code, the
    same title is asked for; another code, that code's title, where the references have one; no code or title never is right.
    Of repeated old keys the last counts where a row_idx tells the order."""
    order = F.col("row_idx") if "row_idx" in old.columns else F.struct(*fields)
    last = old.groupBy(*KEYS).agg(F.max_by(F.struct(*fields), order).alias("o"))
    rows = new.select(*fields).join(last, KEYS)
    ref = references.select(F.col("cst_code").alias("_c"), F.col("cst_sutta").alias("_s"))
    for name, code in (("old", F.col("o.cst_code")), ("new", F.col("cst_code"))):
        rows = rows.join(small(ref.withColumnsRenamed({"_c": f"_{name}", "_s": f"{name}_expected"})), code == F.col(f"_{name}"), "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"o.{f}"))
    was_right = F.coalesce(F.col("o.cst_sutta") == F.col("old_expected"), F.lit(False))
    is_right = F.when(F.col("cst_code").isNull() | F.col("cst_sutta").isNull(), False).when(F.col("cst_code") == F.col("o.cst_code"), F.col("cst_sutta") == F.col("old_expected")).otherwise(F.coalesce(F.col("cst_sutta") == F.col("new_expected"), F.lit(True)))
    return rows.select(*KEYS, F.col("o.cst_code").alias("cst_code"), F.col("cst_sutta").alias("actual_cst_sutta"), F.col("old_expected").alias("expected_cst_sutta"), (~same).alias("differs"), (~same & was_right & ~is_right).alias("regressed"))


def regressions(compared: DataFrame) -> DataFrame:
    return compared.where("regressed").drop("differs", "regressed")


def summary(new: DataFrame, compared: DataFrame) -> DataFrame:
    """[E12] One row: total_rows of new, differing_rows, errors."""
    total = new.agg(F.count(F.lit(1)).alias("n")).select(F.col("n").alias("total_rows"), F.lit(0).cast("long").alias("differing_rows"), F.lit(0).cast("long").alias("errors"))
    found = compared.agg(F.count_if("differs").alias("d"), F.count_if("regressed").alias("e")).select(F.lit(0).cast("long").alias("total_rows"), F.col("d").alias("differing_rows"), F.col("e").alias("errors"))
    return total.unionByName(found).agg(*(F.sum(c).alias(c) for c in ("total_rows", "differing_rows", "errors")))
