"""Readers and writers of files: XML in any encoding, code mapping, fragment TSV, titles. [A1-A6, A11-A15, A20]"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom import log, schema
from fragloom.functions import codes as cd
from fragloom.functions import text as tx


def read_xml(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """[A1, A2] (cst_file, content, encoding, marked): whole files, decoded."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(paths)
    return raw.select(
        F.element_at(F.split("path", "/"), -1).alias("cst_file"), tx.decoded(F.col("content")).alias("content"), tx.encoding(F.col("content")).alias("encoding"), tx.has_mark(F.col("content")).alias("marked")
    )


def listed_paths(spark: SparkSession, list_file: str) -> list[str]:
    """[A3, A20] Paths of a list file: trimmed, quotes and a trailing comma off, without blank lines and comments. A list that a
    person wrote: it comes to the driver."""
    lines = spark.read.text(list_file).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    return [r["v"].rstrip(",").strip("\"' ") for r in lines.collect()]


def select_inputs(spark: SparkSession, file: str | None = None, folder: str | None = None, list_file: str | None = None, base: str | None = None) -> DataFrame:
    """[A3, A4] Exactly one of a file, a folder (its *.xml, not below) or a list file, whose names may be under a base folder."""
    if sum(x is not None for x in (file, folder, list_file)) != 1:
        raise ValueError("give exactly one of file, folder and list_file")
    if folder is not None:
        return read_xml(spark, folder, "*.xml")
    names = [file] if file is not None else listed_paths(spark, list_file)
    return read_xml(spark, [f"{base.rstrip('/')}/{n}" if base else n for n in names])


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return rows.withColumn("row_idx", F.monotonically_increasing_id())


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """[A5] The seven columns of the code mapping, with row_idx for `last row wins`."""
    names = [c.split()[0] for c in schema.MAPPING.split(", ")]
    return _tsv(spark, path).select(*names, "row_idx").withColumn("cst_file", cd.strip_folders(F.col("cst_file")))


def read_fragments_tsv(spark: SparkSession, path: str) -> DataFrame:
    """[A6] The columns that the diff compares; blank optional ones are null."""
    from fragloom.operators.diff import FIELDS

    rows = _tsv(spark, path)
    blank = lambda c: F.when(F.trim(c) != "", F.col(c)).alias(c)
    return rows.select(*(F.col(c) if c in ("cst_file", "frag_idx_code", "frag_type") else blank(c) for c in FIELDS), "row_idx")


def tsv_rows(fragments: DataFrame) -> DataFrame:
    """[A11, C27, C30, E7] The 16 columns, in file and version order."""
    raw = fragments.withColumn("group_levels", tx.levels_json(F.col("group_levels")))
    escaped = raw.withColumns({c: tx.escape_tsv(F.col(c)) for c in ("cst_file", "frag_type", "nikaya", "group_levels")})
    text = escaped.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in schema.TSV_COLUMNS))
    return text.orderBy("cst_file", *cd.version_order(F.col("frag_idx_code")))


def write_tsv(fragments: DataFrame, folder: str) -> None:
    """[A11] One sorted file with a header: what people read and compare. For large stores, export a part."""
    rows = tsv_rows(fragments)
    lines = rows.select(F.concat_ws("\t", *schema.TSV_COLUMNS).alias("value"), F.lit(1).alias("o"), "cst_file", *(p.alias(f"p{i}") for i, p in enumerate(cd.version_order(F.col("frag_idx_code")))))
    head = fragments.sparkSession.createDataFrame([("\t".join(schema.TSV_COLUMNS), 0, "", 0, 0)], lines.schema)
    head.unionByName(lines).orderBy("o", "cst_file", "p0", "p1").coalesce(1).select("value").write.mode("overwrite").text(folder)


def _write_batches(folder: str):
    """A task's part of write_texts: each text goes to a name of its own, then takes its place, so a task that runs again or
    twice leaves whole files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = pa_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, text in zip(batch["cst_file"], batch["text"]):
                path = f"{at.rstrip('/')}/{name}"
                part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write((text or "").encode())
                system.move(part, path)
            yield batch[["cst_file"]]

    return run


def write_texts(texts: DataFrame, folder: str) -> int:
    """[A12-A14] Each (cst_file, text) as a file of that name, byte for byte; returns their number. Spark's text sink ends
    every file with a line break, so the tasks write, to a path or the URI of a file system that pyarrow knows. A row without
    a name is left out, a null text gives an empty file; of rows with one name, one is kept."""
    uri = folder if "://" in folder else Path(folder).absolute().as_uri()
    system, at = pa_fs.FileSystem.from_uri(uri)
    system.create_dir(at, recursive=True)
    rows = texts.where("cst_file is not null").select("cst_file", "text")
    return rows.mapInPandas(_write_batches(uri), "cst_file string").distinct().count()


def convert_to_utf8(spark: SparkSession, paths: str | list[str], folder: str) -> int:
    """[A13, A14] Returns the number of files written, in one job; a path that is not there is logged and the others go on."""
    hadoop, found = spark._jsc.hadoopConfiguration(), []
    for path in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(hadoop).exists(at):
            found.append(path)
        else:
            log.warn("%s: no such file", path)
    if not found:
        return 0
    return write_texts(read_xml(spark, found).select("cst_file", F.col("content").alias("text")), folder)


def root_titles(documents: DataFrame) -> DataFrame:
    """[A15] (uid, name) of root documents that have both."""
    return documents.where("is_root and uid is not null and name is not null").select("uid", "name")


def line_numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of texts with their place, the parts that reconstruction puts together again."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))

