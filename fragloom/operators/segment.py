"""Segmentation as a DataFrame operator: one row a file in, one row a fragment out. [B6, B13-B17]

Files are independent rows, so the scan needs no shuffle of contents: corrections, if any, are grouped per file and joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragloom import schema
from fragloom.functions import text as tx
from fragloom.operators import scan
from fragloom.operators.xmltokens import Lines, tokens

#: A fragment, or the error of a file: status ok, error or critical.
OUT = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.FRAGMENT), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
_TOKENS = "cst_file string, seq long, kind string, tag string, attrs map<string,string>, text string, byte_start long, byte_end long, line int, col int"
#: Characters of files, or rows, from which what was made of them is handed on. Files are taken out of their batch one by one, so a task holds the
#: batch, one file and this.
HELD, HELD_ROWS = 1 << 21, 1 << 14

_LEVEL = pa.struct([(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in schema.LEVEL])
_ARROW = pa.schema([(f.name, pa.list_(_LEVEL) if f.name == "group_levels" else pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in OUT])
_ARROW_TOKENS = pa.schema(
    [("cst_file", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]
    + [("byte_start", pa.int64()), ("byte_end", pa.int64()), ("line", pa.int32()), ("col", pa.int32())]
)


def _rows(file: str, content: str | None, nikaya: str | None, fixes: list, inserted: list) -> list[dict]:
    failed = lambda status, e: [dict.fromkeys(OUT.names) | {"cst_file": file, "status": status, "error": str(e)}]
    if content is None or nikaya is None:
        return failed("error", "its collection is not named or not known")
    try:
        rows = scan.segment(content, nikaya, file, {r["frag_idx_code"]: r for r in fixes}, inserted)
    except scan.CriticalError as e:
        return failed("critical", e)
    except ValueError as e:
        return failed("error", e)
    return [r | {"status": "ok", "error": None} for r in rows]


def _handed(batches: Iterator[pa.RecordBatch], made: Callable[..., Iterable[dict]], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows that made() makes of each file (cst_file, content, ...), in batches of about HELD characters or HELD_ROWS rows."""
    rows, held = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            file = [c[k].as_py() for c in batch.columns]
            held += len(file[1] or "")
            for row in made(*file):
                rows.append(row)
                if len(rows) >= HELD_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, out)
                    rows, held = [], 0
            if held >= HELD:
                yield pa.RecordBatch.from_pylist(rows, out)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _handed(batches, lambda file, content, nikaya, fixes, inserted: _rows(file, content, nikaya, fixes or [], inserted or []), _ARROW)


def _per_file(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    return rows.groupBy("cst_file").agg(F.collect_list(F.struct(*columns)).alias(name))


def segment(files: DataFrame, overrides: DataFrame | None = None, inserted: DataFrame | None = None) -> DataFrame:
    """files (cst_file, content) to generated fragments with status and error; inserted rows only move boundaries here."""
    rows = files.select("cst_file", "content", tx.collection(F.col("content")).alias("nikaya"))
    places = ["start_line", "start_char", "end_line", "end_char"]
    none = lambda more: F.lit(None).cast(f"array<struct<frag_idx_code:string,{more}start_line:int,start_char:int,end_line:int,end_char:int>>")
    if overrides is None:
        rows = rows.withColumn("fixes", none("collapse:boolean,"))
    else:
        rows = rows.join(_per_file(overrides, ["frag_idx_code", "collapse", *places], "fixes"), "cst_file", "left")
    if inserted is None:
        rows = rows.withColumn("inserted", none(""))
    else:
        rows = rows.join(_per_file(inserted, ["frag_idx_code", *places], "inserted"), "cst_file", "left")
    return rows.select("cst_file", "content", "nikaya", "fixes", "inserted").mapInArrow(_scan, OUT)


def fragments(scanned: DataFrame) -> DataFrame:
    """The fragments of segment(), without what failed."""
    return scanned.where("status = 'ok'").select(*schema.COLUMNS)


def failures(scanned: DataFrame) -> DataFrame:
    return scanned.where("status <> 'ok'").select("cst_file", "status", "error")


def token_table(files: DataFrame) -> DataFrame:
    """[B7] The events of each file with bytes, lines and columns, in order."""

    def events(file: str, content: str | None) -> Iterator[dict]:
        raw = (content or "").encode()
        lines = Lines(raw)
        for k, t in enumerate(tokens(raw, strict=False)):
            line, col = lines.at(t.start)
            yield {"cst_file": file, "seq": k, "kind": t.kind, "tag": t.name, "attrs": list(t.attrs.items()), "text": t.text, "byte_start": t.start, "byte_end": t.end, "line": line, "col": col}

    return files.select("cst_file", "content").mapInArrow(lambda batches: _handed(batches, events, _ARROW_TOKENS), _TOKENS)
