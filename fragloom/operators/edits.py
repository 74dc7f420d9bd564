"""Edits of one file's fragments. Each takes the rows of a file and returns all its rows after the edit, for the store to
rewrite that one partition. [H]

compat: put a line break between merged contents, as stores made with other tools have it; by default no byte is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from fragloom import schema
from fragloom.functions import codes as cd
from fragloom.operators import ordered
from fragloom.operators.checks import blank, reviewed
from fragloom.operators.scan import parse_index

ACTIONS = ("line_up", "line_down", "char_left", "char_right")


class EditError(ValueError):
    pass


def _around(rows: DataFrame, code: str, direction: str) -> tuple[dict, dict | None]:
    """The row and its nearest neighbour that is not moved: two rows come to the driver."""
    if direction not in ("prev", "next"):
        raise EditError(f"no such direction: {direction}")
    near = ordered.neighbours(rows, ["cst_file"], cd.version_order(F.col("frag_idx_code")), F.col("frag_review").eqNullSafe("moved"), schema.COLUMNS)
    found = near.where(F.col("frag_idx_code") == code).limit(1).collect()
    if not found:
        raise EditError(f"no fragment {code}")
    row: Row = found[0]
    other = row[direction]
    plain = lambda r: {c: r[c] for c in schema.COLUMNS}
    return plain(row), plain(other) if other is not None else None


def _changed(rows: DataFrame, changed: list[dict], removed: list[str] = ()) -> DataFrame:
    codes = [r["frag_idx_code"] for r in changed] + list(removed)
    stays = rows.select(*schema.COLUMNS).where(~F.col("frag_idx_code").isin(codes))
    new = rows.sparkSession.createDataFrame([tuple(r[c] for c in schema.COLUMNS) for r in changed], schema.FRAGMENT) if changed else None
    return stays.unionByName(new) if new is not None else stays


def _merged(row: dict, other: dict, direction: str, compat: bool) -> dict:
    """other with row's content before or after its own."""
    first, second = (other, row) if direction == "prev" else (row, other)
    return other | {
        "content_xml": first["content_xml"] + ("\n" if compat else "") + second["content_xml"],
        "start_line": first["start_line"], "start_char": first["start_char"], "end_line": second["end_line"], "end_char": second["end_char"],
    }


def move_content(rows: DataFrame, code: str, direction: str, compat: bool = False) -> DataFrame:
    """[H6] The content goes to the neighbour; the row stays, empty, without codes, as moved."""
    row, other = _around(rows, code, direction)
    if other is None:
        raise EditError(f"nothing to move to: no {direction} fragment")
    emptied = row | dict.fromkeys(schema.CODES) | {"content_xml": "", "frag_review": "moved", "start_line": 0, "start_char": 0, "end_line": 0, "end_char": 0}
    return _changed(rows, [_merged(row, other, direction, compat), emptied])


def merge_delete(rows: DataFrame, code: str, direction: str, compat: bool = False) -> DataFrame:
    """[H7] An inserted row is merged into the neighbour and removed."""
    if parse_index(code)[1] == 0:
        raise EditError("a generated fragment cannot be merged away")
    row, other = _around(rows, code, direction)
    if other is None:
        raise EditError(f"nothing to merge into: no {direction} fragment")
    return _changed(rows, [_merged(row, other, direction, compat)], [code])


def delete(rows: DataFrame, code: str, compat: bool = False) -> DataFrame:
    """[H8] Merged into the previous row, else the next, and removed."""
    direction = "prev"
    row, other = _around(rows, code, direction)
    if other is None:
        direction = "next"
        row, other = _around(rows, code, direction)
    return _changed(rows, [_merged(row, other, direction, compat)] if other else [], [code])


def insert(rows: DataFrame, code: str, direction: str, past_moved: bool = True) -> DataFrame:
    """[H9, C4] A new empty, checked row beside a row, with its free index; a following row then starts there. past_moved: also one behind moved rows, which
    have given their places up; in a store whose moved rows keep theirs (False), it starts behind them and stays as it is."""
    row, other = _around(rows, code, direction)
    if row["frag_review"] == "moved":
        raise EditError("nothing can be inserted next to a moved fragment")
    major = parse_index(row["frag_idx_code"])[0]
    if direction == "prev":
        major = parse_index(other["frag_idx_code"])[0] if other else major - 1
        if major < 0:
            raise EditError("nothing can be inserted before the first fragment")
    parts = rows.select(cd.index_parts(F.col("frag_idx_code")).alias("p")).where(F.col("p.major") == major).groupBy().agg(cd.next_minor(F.collect_set("p.minor")).alias("free"))
    free = parts.first()["free"]
    side = "start" if direction == "prev" else "end"
    line, column = row[f"{side}_line"], row[f"{side}_char"]
    source = (other or row) if direction == "prev" else row
    new = source | {"frag_idx_code": f"{major}.{free}", "frag_review": "checked", "content_xml": "", "start_line": line, "start_char": column, "end_line": line, "end_char": column}
    changed = [new]
    if direction == "next" and other and not past_moved:
        p, place = cd.index_parts(F.col("frag_idx_code")), lambda c: F.struct(*(F.lit(k).alias(n) for n, k in zip(("major", "minor"), parse_index(c))))
        if not rows.where((p > place(code)) & (p < place(other["frag_idx_code"]))).isEmpty():
            other = None
    if direction == "next" and other:
        changed.append(other | {"start_line": line, "start_char": column, "frag_review": other["frag_review"] or "checked"})
    return _changed(rows, changed)


def nudge(rows: DataFrame, code: str, direction: str, action: str) -> DataFrame:
    """[H10] Moves the boundary with a neighbour by a line or a character. Columns are bytes, so a character moves it by its
    bytes; positions follow from what the first of the two then holds."""
    if action not in ACTIONS:
        raise EditError(f"no such action: {action}")
    row, other = _around(rows, code, direction)
    if other is None:
        raise EditError(f"no {direction} fragment")
    first, second = (other, row) if direction == "prev" else (row, other)
    a, b = first["content_xml"], second["content_xml"]
    if action == "line_up":
        at = a.rfind("\n")
        cut = len(a) if at < 0 else at
    elif action == "line_down":
        cut = len(a) + b.find("\n") + 1
    elif action == "char_left":
        cut = len(a) - (1 if a and first["end_char"] > 0 else 0)
    else:
        cut = len(a) + (1 if b else 0)
    whole = a + b
    a, b = whole[:cut], whole[cut:]
    breaks = a.count("\n")
    line = first["start_line"] + breaks
    column = len(a.rpartition("\n")[2].encode()) + (0 if breaks else first["start_char"])
    checked = lambda r: r["frag_review"] if r["frag_review"] is not None else "checked"
    return _changed(
        rows,
        [
            first | {"content_xml": a, "end_line": line, "end_char": column, "frag_review": checked(first)},
            second | {"content_xml": b, "start_line": line, "start_char": column, "frag_review": checked(second)},
        ],
    )


def create(rows: DataFrame, code: str, direction: str) -> DataFrame:
    """[H11] Legacy: a placeholder row before or after a row, which gives up half of its lines; later rows move up by one,
    in version order."""
    row, _ = _around(rows, code, direction)
    major, minor = parse_index(code)
    middle = (row["start_line"] + row["end_line"]) // 2
    before = direction == "prev"
    p = cd.index_parts(F.col("frag_idx_code"))
    later = (p["major"] > major) | ((p["major"] == major) & ((p["minor"] >= minor) if before else (p["minor"] > minor)))
    moved = rows.select(*schema.COLUMNS).withColumn("frag_idx_code", F.when(later, cd.format_index(p["major"] + 1, p["minor"])).otherwise(F.col("frag_idx_code")))
    new = row | {"frag_type": "Sutta", "frag_review": None, "cst_paranum": None, "content_xml": "<!-- New fragment content -->"}
    if before:
        new |= {"frag_idx_code": code, "end_line": middle, "end_char": 0}
        own = row | {"frag_idx_code": f"{major + 1}.{minor}", "start_line": middle, "start_char": 0}
    else:
        new |= {"frag_idx_code": f"{major + 1}.0", "start_line": middle, "start_char": 0}
        own = row | {"end_line": middle, "end_char": 0}
    kept = moved.where(F.col("frag_idx_code") != own["frag_idx_code"])
    return kept.unionByName(rows.sparkSession.createDataFrame([tuple(r[c] for c in schema.COLUMNS) for r in (new, own)], schema.FRAGMENT))


def patch(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """[H5] patches: frag_idx_code, frag_review and codes; null leaves a field, '' is stored. A row without a status becomes
    checked unless the patch gives one."""
    fields = [*schema.CODES, "frag_review"]
    p = patches.select(F.col("frag_idx_code").alias("_k"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in fields))
    out = rows.join(p, F.col("frag_idx_code") == F.col("_k"), "left")
    status = F.when(F.col("_hit") & F.col("frag_review").isNull() & blank(F.col("_frag_review")), F.lit("checked")).otherwise(F.coalesce("_frag_review", "frag_review"))
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in schema.CODES} | {"frag_review": status}).select(*schema.COLUMNS)


def apply_titles(fragments: DataFrame, fixes: DataFrame) -> DataFrame:
    """[H12] fixes: cst_file, frag_idx_code, suggested_value."""
    f = fixes.select("cst_file", "frag_idx_code", F.col("suggested_value").alias("_v"))
    return fragments.join(f, ["cst_file", "frag_idx_code"], "left").withColumn("sc_sutta", F.coalesce("_v", "sc_sutta")).select(*schema.COLUMNS)


def restore_reviews(fragments: DataFrame, reviews: DataFrame) -> DataFrame:
    """[H4] reviews: cst_file, frag_idx_code, frag_review; a row without one keeps its own."""
    r = reviews.select("cst_file", "frag_idx_code", F.col("frag_review").alias("_r"))
    return fragments.join(r, ["cst_file", "frag_idx_code"], "left").withColumn("frag_review", F.coalesce("_r", "frag_review")).select(*schema.COLUMNS)


def recalculated(rows: DataFrame, unit: str = "bytes") -> DataFrame:
    """[H15, F5] Boundaries from the contents."""
    places = ["start_line", "start_char", "end_line", "end_char"]
    return ordered.boundaries(rows.drop(*places), ["cst_file"], cd.version_order(F.col("frag_idx_code")), "content_xml", unit).select(*schema.COLUMNS)


def corrections(fragments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """[H2, H3] (overrides, inserted rows, review states) of reviewed rows; of one file or of all, as given."""
    rows = fragments.where(reviewed(F.col("frag_review"))).withColumn("_minor", cd.index_parts(F.col("frag_idx_code"))["minor"])
    rows = rows.withColumn("frag_type", F.when(F.col("frag_type").isin("Header", "Sutta"), F.col("frag_type")).otherwise("Sutta"))
    moved = F.col("frag_review") == "moved"
    unless = lambda c: F.when(~moved, F.col(c)).alias(c)
    overrides = rows.where("_minor = 0").select("cst_file", "frag_idx_code", moved.alias("collapse"), *map(unless, ["start_line", "start_char", "end_line", "end_char", *schema.CODES]), "frag_review", "frag_type")
    return overrides, rows.where("_minor > 0").select(*schema.COLUMNS), rows.select("cst_file", "frag_idx_code", "frag_review")


def inject(fragments: DataFrame, inserted: DataFrame) -> DataFrame:
    """[H1] Generated and inserted rows of the files that were scanned; their order is that of their indexes."""
    known = inserted.join(fragments.select("cst_file").distinct(), "cst_file", "left_semi")
    return fragments.select(*schema.COLUMNS).unionByName(known.select(*schema.COLUMNS))
