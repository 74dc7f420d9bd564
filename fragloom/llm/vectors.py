"""What the operators on vectors have in common: rows that take part, and classes of equal vectors.

A class holds the first rows of a vector, by id: as many as any result can take. So a group of copies costs one vector, and no result
is lost. Ids that are null come after all others and are given back as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for a null id inside tasks.
NO_ID = np.iinfo(np.int64).max


def whole(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def padded(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with x ended by zeros to the length of the longest, and that length, at least 1."""
    dim = max(1, rows.agg(F.max(F.size("x"))).first()[0] or 1)
    zero = F.lit(0).cast(rows.schema["x"].dataType.elementType)
    return rows.withColumn("x", F.concat("x", F.array_repeat(zero, F.lit(dim) - F.size("x")))), dim


def classes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """One row per value of keys and x: hash, keys, x, and ids and rids of its first ``most`` rows by (vec_id, _rid).

    The limit holds before the shuffle too, so of a vector that many rows share each task sends ``most`` rows."""
    by = ["hash", *keys, "x"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("vec_id").asc_nulls_last(), "_rid"))
    some = rows.withColumn("hash", F.xxhash64("x")).withColumn("_n", first).where(F.col("_n") <= most)
    packed = F.array_sort(F.collect_list(F.struct("_n", F.coalesce("vec_id", F.lit(int(NO_ID))).alias("id"), "_rid")))
    part = lambda c: F.transform("_p", lambda s: s[c])
    return some.groupBy(*by).agg(packed.alias("_p")).select(*by, part("id").alias("ids"), part("_rid").alias("rids"))


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type | None = None) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return out.astype(dtype, copy=False) if dtype else out


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as (values, offsets)."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def null_ids(column: str) -> Column:
    return F.when(F.col(column) != int(NO_ID), F.col(column))


def blocks_of(queries: DataFrame, size: int) -> int:
    """Blocks of about ``size`` queries."""
    return max(1, -(-queries.count() // size))

