"""What the operators of this subpackage have in common: work tables in the shared folder, size-checked
semi joins and a few column expressions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key rows up to which a semi or anti join may broadcast its key side (8 to 16 bytes a row). Beyond it the join shuffles.
BROADCAST_KEYS = 400_000
#: A key is heavy if more than one in HEAVY of the rows have it, and more than LIGHT rows. So fewer than HEAVY keys are.
HEAVY, LIGHT = 16384, 500
#: Bitmaps of 4 KiB that may be broadcast at once: 64 MiB.
BITMAPS = 16384

#: The six white-space characters of the word rule [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where it is unset and Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_fragloom_work", None)
        if not base:
            base = spark._fragloom_work = "file://" + tempfile.mkdtemp(prefix="fragloom-")
    return base.rstrip("/")


def table(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    The file system deletes it when the driver ends."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/fragloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def drop_tables(*tables: DataFrame | None) -> None:
    """Deletes the files of table()s, once what was made of them is written too. Other DataFrames and None are left alone."""
    for df in tables:
        if path := vars(df).get("_work_path") if df is not None else None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def match(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """left_semi or left_anti of df against a written table of keys: broadcast up to BROADCAST_KEYS rows, shuffled beyond."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles at every size, so that AQE can split a hot key and growth is alike at all sizes."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def facts_join(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with written facts, one row for each value of the columns on: broadcast up to BROADCAST_KEYS rows; beyond, a
    join that AQE can split at a hot key."""
    return rows.join(F.broadcast(facts), on) if facts.count() <= BROADCAST_KEYS else merge_join(rows, facts, on)


def heavy_limit(total: int) -> int:
    return max(LIGHT, total // HEAVY)


def heavy_keys(rows: DataFrame, cols: list[str]) -> DataFrame | None:
    """The values of cols that more than heavy_limit() of the rows have, fewer than HEAVY, written; None without any.

    rows is scanned twice: once to count 65536 ranges of hashes, once to count the keys in the ranges that are too full."""
    spark, part = rows.sparkSession, F.shiftrightunsigned(F.xxhash64(*cols), 48)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # at most 65536 rows
    limit = heavy_limit(sum(r["_n"] for r in counts))
    full = [(r["_part"],) for r in counts if r["_n"] > limit]
    if not full:
        return None
    found = rows.withColumn("_part", part).join(F.broadcast(spark.createDataFrame(full, "_part long")), "_part", "left_semi")
    keys = table(found.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*cols), "heavy")
    return None if keys.isEmpty() else keys


def join_heavy(rows: DataFrame, facts: DataFrame, on: list[str], heavy: DataFrame | None) -> DataFrame:
    """Inner join of rows with facts, which has one row for each value of the columns on. Facts of heavy keys (fewer than
    HEAVY of them) are broadcast, so that no task gets all rows of such a key; the others are shuffled."""
    if heavy is None:
        return merge_join(rows, facts, on)
    keys = F.broadcast(heavy.select(*on))
    split = merge_join(rows.join(keys, on, "left_anti"), facts.join(keys, on, "left_anti"), on)
    return split.unionByName(rows.join(F.broadcast(facts.join(keys, on, "left_semi")), on))


def _scan_only(docs: DataFrame) -> bool:
    """Whether docs is one scan of files whose rows have a place there, with nothing above it but columns and filters."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        return docs.select("_metadata.row_index").schema[0].dataType.typeName() == "long"
    except AnalysisException:  # no Parquet
        return False


def stored(docs: DataFrame) -> DataFrame:
    """docs, written as table() unless it is a plain scan of Parquet files: what with_row_id() numbers alike every time."""
    return docs if _scan_only(docs) else table(docs, "rows")


def with_row_id(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """Numbers the rows of stored() docs by file and place in the file, so alike every time, however the scan is split."""
    if not _scan_only(docs):
        raise ValueError("with_row_id() numbers what stored() gives")
    plain = lambda path: re.sub("^[A-Za-z0-9+.-]+:/+", "/", path)
    at = free_name(docs, "_at")
    files = docs.sparkSession.createDataFrame(list(enumerate(sorted(map(plain, docs.inputFiles())))), f"_file long, {at} string")
    rows = docs.withColumns({name: F.col("_metadata.row_index"), at: F.regexp_replace("_metadata.file_path", "^[A-Za-z0-9+.-]+:/+", "/")})
    file = F.coalesce(files["_file"], F.raise_error(F.lit("a row of an unlisted file")).cast("long"))
    return rows.join(F.broadcast(files), at, "left").select(*(rows[c] for c in docs.columns), (F.shiftleft(file, 40) + rows[name]).alias(name))


def free_name(df: DataFrame, base: str = "_rid") -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """stored() docs, all columns, less the rows whose number (with_row_id of the same docs) is in gone (_rid). Up to BROADCAST_KEYS numbers are
    broadcast; more, as bitmaps of 32768 rows, up to BITMAPS of these; beyond that docs are shuffled."""
    name = free_name(docs)
    rows, gone = with_row_id(docs, name), table(gone.select(F.col("_rid").alias(name)), "gone")
    if gone.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(gone), name, "left_anti").drop(name)
    bucket, bits = free_name(docs, "_bucket"), free_name(docs, "_bits")
    low = lambda c: F.bitwise_not(F.lit(-32768).cast("long")).bitwiseAND(F.col(c))
    maps = table(gone.groupBy(F.shiftright(name, 15).alias(bucket)).agg(F.bitmap_construct_agg(low(name)).alias(bits)), "gonebits")
    if maps.count() > BITMAPS:
        return rows.join(gone, name, "left_anti").drop(name)
    byte = F.conv(F.hex(F.substring(F.col(bits), (low(name) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_gone = F.call_function("shiftright", byte, (low(name) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    found = rows.withColumn(bucket, F.shiftright(name, 15)).join(F.broadcast(maps), bucket, "left")
    return found.where(F.col(bits).isNull() | ~is_gone).drop(name, bucket, bits)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
