"""Edits of many files at once: a log of edits, ordered by sequence and folded per file in the JVM. [H6-H11]

log: cst_file, seq, action (move, merge, delete, insert, nudge, create), frag_idx_code, direction (prev, next) and, for nudges, nudge (line_up, line_down,
char_left, char_right). The rows of an edited file are an array in version order; aggregate() takes one edit after another, each seeing what the ones
before have left. What an edit may not do leaves the rows alone and gives a row of (cst_file, seq, reason). The rules are those of edits.py, which
changes one file. Files without edits are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragloom import schema
from fragloom.functions import codes as cd

LOG = "cst_file string, seq bigint, action string, frag_idx_code string, direction string, nudge string"
ACTIONS = ("move", "merge", "delete", "insert", "nudge", "create")

_TYPE = T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in schema.FRAGMENT])).simpleString()
_ROW = _TYPE.removeprefix("array<").removesuffix(">")
_STATE = f"struct<rows:{_TYPE},rejected:array<struct<seq:bigint,reason:string>>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with(row: Column, **changes: Column) -> Column:
    return F.struct(*((changes[c] if c in changes else row[c]).alias(c) for c in schema.COLUMNS)).cast(_ROW)


def _part(row: Column, k: int) -> Column:
    return F.split(row["frag_idx_code"], r"\.")[k].cast("int")


def _place(row: Column) -> Column:
    """A number that sorts as indexes do."""
    return F.shiftleft(_part(row, 0).cast("bigint"), 32) + _part(row, 1)


def _merged(row: Column, other: Column, prev: Column, separator: str) -> Column:
    first, second = (lambda c: F.when(prev, other[c]).otherwise(row[c])), (lambda c: F.when(prev, row[c]).otherwise(other[c]))
    places = {c: first(c) for c in ("start_line", "start_char")} | {c: second(c) for c in ("end_line", "end_char")}
    return _with(other, content_xml=F.concat(first("content_xml"), F.lit(separator), second("content_xml")), **places)


def _put(rows: Column, at: Column, row: Column) -> Column:
    """rows with the at-th replaced; a null place replaces none."""
    return F.transform(rows, lambda x, k: F.when((k + 1).eqNullSafe(at), row).otherwise(x))


def _without(rows: Column, at: Column) -> Column:
    return F.concat(F.slice(rows, F.lit(1), at - 1), F.slice(rows, at + 1, F.size(rows)))


def _in_order(rows: Column, new: Column) -> Column:
    return _let(new, lambda n: F.concat(F.filter(rows, lambda x: _place(x) < _place(n)), F.array(n), F.filter(rows, lambda x: _place(x) > _place(n))))


def _checked(row: Column) -> Column:
    return F.coalesce(row["frag_review"], F.lit("checked"))


def _nudged(rows: Column, e: Column, i: Column, j: Column, row: Column, other: Column) -> Column:
    prev = e["direction"] == "prev"
    pair = F.when(prev, F.struct(other.alias("a"), row.alias("b"))).otherwise(F.struct(row.alias("a"), other.alias("b")))

    def cut(p: Column) -> Column:
        a, b = p["a"]["content_xml"], p["b"]["content_xml"]
        size = F.char_length(a)
        up = F.when(a.contains("\n"), size - F.char_length(F.substring_index(a, "\n", -1)) - 1).otherwise(size)
        left = size - F.when((size > 0) & (p["a"]["end_char"] > 0), 1).otherwise(0)
        at = F.when(e["nudge"] == "line_up", up).when(e["nudge"] == "line_down", size + F.instr(b, "\n")).when(e["nudge"] == "char_left", left).otherwise(size + F.when(F.char_length(b) > 0, 1).otherwise(0))
        whole = F.concat(a, b)
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), F.substring(whole, F.lit(1), at).alias("x"), F.substring(whole, at + 1, F.char_length(whole)).alias("y"))

    def placed(c: Column) -> Column:
        breaks = F.regexp_count(c["x"], F.lit("\n"))
        line = c["a"]["start_line"] + breaks
        column = F.octet_length(F.substring_index(c["x"], "\n", -1)) + F.when(breaks > 0, 0).otherwise(c["a"]["start_char"])
        first = _with(c["a"], content_xml=c["x"], end_line=line, end_char=column, frag_review=_checked(c["a"]))
        second = _with(c["b"], content_xml=c["y"], start_line=line, start_char=column, frag_review=_checked(c["b"]))
        return _put(_put(rows, F.when(prev, j).otherwise(i), first), F.when(prev, i).otherwise(j), second)

    return _let(_let(pair, cut), placed)


def _inserted(rows: Column, e: Column, i: Column, j: Column, row: Column, other: Column) -> Column:
    prev = e["direction"] == "prev"
    major = F.when(prev, F.coalesce(_part(other, 0), _part(row, 0) - 1)).otherwise(_part(row, 0))
    free = _let(major, lambda m: cd.next_minor(F.transform(F.filter(rows, lambda x: _part(x, 0) == m), lambda x: _part(x, 1))))
    line, column = (F.when(prev, row[f"start_{c}"]).otherwise(row[f"end_{c}"]) for c in ("line", "char"))
    source = F.when(prev & other.isNotNull(), other).otherwise(row)
    new = _let(source, lambda s: _with(s, frag_idx_code=cd.format_index(major, free), frag_review=F.lit("checked"), content_xml=F.lit(""), start_line=line, start_char=column, end_line=line, end_char=column))
    review = F.when(F.coalesce(other["frag_review"], F.lit("")) != "", other["frag_review"]).otherwise(F.lit("checked"))
    kept = _put(rows, F.when(~prev, j), _with(other, start_line=line, start_char=column, frag_review=review))
    return _let(kept, lambda k: _in_order(k, new))


def _created(rows: Column, e: Column, row: Column) -> Column:
    """[H11] The row gives up half of its lines; rows from it on, or after it, move up by one."""
    prev = e["direction"] == "prev"
    middle = ((row["start_line"] + row["end_line"]) / 2).cast("int")
    fresh = {"frag_type": F.lit("Sutta"), "frag_review": F.lit(None).cast("string"), "cst_paranum": F.lit(None).cast("string"), "content_xml": F.lit("<!-- New fragment content -->")}
    zero = F.lit(0)
    before = _with(row, **fresh, end_line=middle, end_char=zero)
    after = _with(row, **fresh, frag_idx_code=cd.format_index(_part(row, 0) + 1, zero), start_line=middle, start_char=zero)
    own = F.when(prev, _with(row, frag_idx_code=cd.format_index(_part(row, 0) + 1, _part(row, 1)), start_line=middle, start_char=zero)).otherwise(_with(row, end_line=middle, end_char=zero))
    moved = lambda x: F.when(_place(x) > _place(row), _with(x, frag_idx_code=cd.format_index(_part(x, 0) + 1, _part(x, 1)))).when(_place(x) == _place(row), own).otherwise(x)
    new = F.when(prev, before).otherwise(after)
    return _let(F.transform(rows, moved), lambda k: F.concat(F.filter(k, lambda x: _place(x) < _place(new)), F.array(new), F.filter(k, lambda x: _place(x) >= _place(new))))


def _step(separator: str):
    def step(state: Column, e: Column) -> Column:
        rows = state["rows"]
        reject = lambda reason: F.struct(rows.alias("rows"), F.concat(state["rejected"], F.array(F.struct(e["seq"].alias("seq"), reason.alias("reason")))).alias("rejected")).cast(_STATE)
        accept = lambda new: F.struct(new.alias("rows"), state["rejected"].alias("rejected")).cast(_STATE)
        codes = F.transform(rows, lambda x: x["frag_idx_code"])
        standing = F.filter(F.transform(rows, lambda x, k: F.when(~x["frag_review"].eqNullSafe("moved"), k + 1)), lambda k: k.isNotNull())

        def found(i: Column) -> Column:
            prev, follows = F.array_max(F.filter(standing, lambda k: k < i)), F.array_min(F.filter(standing, lambda k: k > i))
            aimed = F.when(e["action"] == "delete", F.coalesce(prev, follows)).when(e["direction"] == "prev", prev).otherwise(follows)
            both = F.struct(i.cast("int").alias("i"), aimed.cast("int").alias("j"))
            return _let(both, lambda p: _let(F.struct(p["i"].alias("i"), p["j"].alias("j"), F.get(rows, p["i"] - 1).alias("row"), F.when(p["j"].isNotNull(), F.get(rows, p["j"] - 1)).alias("other")), done))

        def done(p: Column) -> Column:
            i, j, row, other = (p[c] for c in ("i", "j", "row", "other"))
            prev = F.when(e["action"] == "delete", j < i).otherwise(e["direction"] == "prev")
            merged = _merged(row, other, prev, separator)
            none = F.lit(None).cast("string")
            emptied = _with(row, content_xml=F.lit(""), frag_review=F.lit("moved"), **dict.fromkeys(schema.CODES, none), **dict.fromkeys(("start_line", "start_char", "end_line", "end_char"), F.lit(0)))
            lonely = F.concat(F.lit("no "), e["direction"], F.lit(" fragment"))
            action = e["action"]
            return (
                F.when(action.isin("move", "merge", "nudge") & other.isNull(), reject(lonely))
                .when((action == "merge") & (_part(row, 1) == 0), reject(F.lit("a generated fragment cannot be merged away")))
                .when((action == "insert") & row["frag_review"].eqNullSafe("moved"), reject(F.lit("nothing can be inserted next to a moved fragment")))
                .when((action == "insert") & prev & other.isNull() & (_part(row, 0) < 1), reject(F.lit("nothing can be inserted before the first fragment")))
                .when(action == "move", accept(_put(_put(rows, j, merged), i, emptied)))
                .when((action == "merge") | (action == "delete"), accept(_without(F.when(j.isNotNull(), _put(rows, j, merged)).otherwise(rows), i)))
                .when(action == "insert", accept(_inserted(rows, e, i, j, row, other)))
                .when(action == "create", accept(_created(rows, e, row)))
                .otherwise(accept(_nudged(rows, e, i, j, row, other)))
            )

        known = e["action"].isin(*ACTIONS) & (e["direction"].isin("prev", "next") | (e["action"] == "delete")) & ((e["action"] != "nudge") | e["nudge"].isin("line_up", "line_down", "char_left", "char_right"))
        at = F.array_position(codes, e["frag_idx_code"])
        return F.when(~F.coalesce(known, F.lit(False)), reject(F.lit("no such edit"))).when(F.coalesce(at, F.lit(0)) == 0, reject(F.concat(F.lit("no fragment "), F.coalesce(e["frag_idx_code"], F.lit(""))))).otherwise(_let(at, found))

    return step


def folded(fragments: DataFrame, log: DataFrame, compat: bool = False) -> DataFrame:
    """(cst_file, rows, rejected) of the files that log has edits of. compat: a line break between merged contents, as in edits.py. Write it before
    fragments_of() and rejected() take their parts, or both fold."""
    edits = log.groupBy("cst_file").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "frag_idx_code", "direction", "nudge"))).alias("edits"))
    own = fragments.select(*schema.COLUMNS).join(edits.select("cst_file"), "cst_file", "left_semi")
    whole = F.struct(*schema.COLUMNS)
    files = own.groupBy("cst_file").agg(F.transform(F.array_sort(F.collect_list(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(cd.version_order(F.col("frag_idx_code")))), whole.alias("r")))), lambda x: x["r"]).alias("rows"))
    files = edits.join(files, "cst_file", "left").withColumn("rows", F.coalesce("rows", F.array()).cast(_TYPE))
    start = F.struct(F.col("rows"), F.array().cast("array<struct<seq:bigint,reason:string>>").alias("rejected")).cast(_STATE)
    return files.select("cst_file", F.aggregate("edits", start, _step("\n" if compat else "")).alias("s")).select("cst_file", "s.rows", "s.rejected")


def fragments_of(fragments: DataFrame, done: DataFrame) -> DataFrame:
    """The whole store after the edits of folded()."""
    others = fragments.select(*schema.COLUMNS).join(done.select("cst_file"), "cst_file", "left_anti")
    return others.unionByName(done.select(F.explode("rows").alias("r")).select("r.*"))


def rejected(done: DataFrame) -> DataFrame:
    """(cst_file, seq, reason) of the edits that were not done."""
    return done.select("cst_file", F.explode("rejected").alias("x")).select("cst_file", "x.seq", "x.reason")
