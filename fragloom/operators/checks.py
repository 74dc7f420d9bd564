"""Data-quality checks. Each returns findings (check_id, cst_file, frag_idx_code, message, frag_review). [J, P, E4, F2, F3, F6]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.functions import codes as cd
from fragloom.functions import text as tx
from fragloom.operators import lookups, ordered

NAMES = {
    "missing_sc_code": "Sections without an sc_code",
    "missing_sc_sutta": "Rows with an sc_code but no title",
    "sutta_review_status": "Sections that need attention",
    "xml_reconstruction": "Files that cannot be put together again",
    "sc_code_sequence": "Codes that do not rise in steps of one within a file",
    "code_uniqueness": "Codes that stand twice in a file",
    "cst_sc_range_consistency": "Range cst_codes with a single sc_code",
    "sc_code_not_in_titles": "Codes that the titles do not have",
}
KEYS = ["cst_file", "frag_idx_code"]


# -- predicates


def not_moved(review: Column) -> Column:
    """[P1]"""
    return ~review.eqNullSafe("moved")


def not_checked(review: Column, include_checked: bool = False) -> Column:
    """[P2]"""
    return F.lit(True) if include_checked else ~review.eqNullSafe("checked")


def blank(c: Column) -> Column:
    """[P3]"""
    return F.coalesce(c, F.lit("")) == ""


def reviewed(review: Column) -> Column:
    """[P4]"""
    return ~blank(review) & (review != "unchecked")


def needs_attention(review: Column) -> Column:
    """[P5] Any status but moved and checked, so unchecked too."""
    return ~blank(review) & ~review.isin("moved", "checked")


def is_section(kind: Column) -> Column:
    """[P7] Exactly; not_header() also holds for unknown kinds."""
    return kind == "Sutta"


def not_header(kind: Column) -> Column:
    """[P7]"""
    return kind != "Header"


def known_kind(kind: Column) -> Column:
    """[P10]"""
    return kind.isin("Header", "Sutta")


def of_file(fragments: DataFrame, cst_file: str, codes: list[str] | None = None) -> DataFrame:
    """[P6, P8] Rows of a file, of some indexes if given; prunes partitions."""
    rows = fragments.where(F.col("cst_file") == cst_file)
    return rows.where(F.col("frag_idx_code").isin(codes)) if codes is not None else rows


def from_index(code: Column, least: str) -> Column:
    """[P9] At or after an index, in version order."""
    major, minor = map(int, least.split("."))
    p = cd.index_parts(code)
    return (p["major"] > major) | ((p["major"] == major) & (p["minor"] >= minor))


# -- checks


def _findings(rows: DataFrame, check: str, message: Column, review: Column | None = None) -> DataFrame:
    return rows.select(F.lit(check).alias("check_id"), *KEYS, message.alias("message"), (F.col("frag_review") if review is None else review).cast("string").alias("frag_review"))


def missing_sc_code(fragments: DataFrame, include_checked: bool = False) -> DataFrame:
    """[J1]"""
    r = F.col("frag_review")
    rows = fragments.where(is_section(F.col("frag_type")) & not_moved(r) & not_checked(r, include_checked) & blank(F.col("sc_code")))
    return _findings(rows, "missing_sc_code", F.lit("Sutta fragment is missing sc_code"))


def untitled(fragments: DataFrame, include_checked: bool = False) -> DataFrame:
    r = F.col("frag_review")
    return fragments.where(not_moved(r) & not_checked(r, include_checked) & ~blank(F.col("sc_code")) & blank(F.col("sc_sutta")))


def missing_sc_sutta(fragments: DataFrame, include_checked: bool = False) -> DataFrame:
    """[J2] The fixes that titles offer: auto_fixes()."""
    return _findings(untitled(fragments, include_checked), "missing_sc_sutta", F.format_string("Fragment with sc_code '%s' is missing sc_sutta title", "sc_code"))


def auto_fixes(fragments: DataFrame, titles: DataFrame, include_checked: bool = False) -> DataFrame:
    """[J2, D11]"""
    return lookups.suggestions(untitled(fragments, include_checked), titles)


def review_status(fragments: DataFrame) -> DataFrame:
    """[J3]"""
    rows = fragments.where(is_section(F.col("frag_type")) & needs_attention(F.col("frag_review")))
    return _findings(rows, "sutta_review_status", F.format_string("Sutta fragment needs attention (status: '%s')", "frag_review"))


def reconstruction(fragments: DataFrame) -> DataFrame:
    """[J4] Files without content of a known kind, told at their first row."""
    held = fragments.groupBy("cst_file").agg(F.count_if(known_kind(F.col("frag_type")) & F.col("content_xml").isNotNull()).alias("n")).where("n = 0")
    firsts = ordered.first_rows(fragments, ["cst_file"], cd.version_order(F.col("frag_idx_code")))
    return _findings(firsts.join(held.select("cst_file"), "cst_file", "left_semi"), "xml_reconstruction", F.lit("XML reconstruction failed: no fragments with content"))


def code_sequence(fragments: DataFrame, include_checked: bool = False) -> DataFrame:
    """[J5, F3] Checked rows take part in the walk and are left out of the findings only."""
    rows = fragments.where(is_section(F.col("frag_type")) & not_moved(F.col("frag_review")) & ~blank(F.col("sc_code")))
    rows = ordered.step_faults(rows.select(*KEYS, "sc_code", "frag_review"), ["cst_file"], cd.version_order(F.col("frag_idx_code")), cd.check_parts(F.col("sc_code")))
    p, q, s = (lambda f: F.col(f"parts.{f}")), (lambda f: F.col(f"previous.{f}")), (lambda f: F.col(f).cast("string"))
    full = lambda x: F.concat(x("prefix"), F.coalesce(F.concat(x("grp").cast("string"), F.lit(".")), F.lit("")), cd.range_text(x("first"), x("last")))
    message = (
        F.when(F.col("fault") == "unreadable", F.format_string("Cannot parse sc_code '%s' format", "sc_code"))
        .when(F.col("fault") == "prefix", F.format_string("Nikaya changed from '%s' to '%s' - expected same nikaya within file", q("prefix"), p("prefix")))
        .when(F.col("fault") == "mixed", "Inconsistent sc_code format: mixing grouped and non-grouped formats")
        .when(F.col("fault") == "group start", F.format_string("Group changed from %s to %s but sutta starts at %s instead of 1", s("previous.grp"), s("parts.grp"), s("parts.first")))
        .when(F.col("fault") == "group jump", F.format_string("Group jump from %s to %s - expected step of 1", s("previous.grp"), s("parts.grp")))
        .otherwise(F.format_string("Sutta number jump from %s to %s - expected step of 1", full(q), full(p)))
    )
    out = _findings(rows, "sc_code_sequence", message, F.when(F.col("fault") != "prefix", F.col("frag_review")))
    return out.where(not_checked(F.col("frag_review"), include_checked))


def code_uniqueness(fragments: DataFrame) -> DataFrame:
    """[J6, E4]"""
    rows = fragments.where(is_section(F.col("frag_type")) & not_moved(F.col("frag_review")))
    out = []
    for code in ("cst_code", "sc_code"):
        many = ordered.repeated(rows.where(~blank(F.col(code))).select(*KEYS, code, "frag_review"), ["cst_file", code])
        out.append(_findings(many, "code_uniqueness", F.format_string(f"Duplicate {code} '%s' found (appears %d times in this file)", code, "group_size")))
    return out[0].unionByName(out[1])


def range_consistency(fragments: DataFrame, include_checked: bool = False) -> DataFrame:
    """[J7] One way only: a range cst_code needs a range sc_code."""
    r, cst, sc = map(F.col, ("frag_review", "cst_code", "sc_code"))
    rows = fragments.where(is_section(F.col("frag_type")) & not_moved(r) & not_checked(r, include_checked) & ~blank(cst) & ~blank(sc))
    rows = rows.where(cd.cst_range(cst).isNotNull() & ~cd.is_sc_range(sc))
    return _findings(rows, "cst_sc_range_consistency", F.format_string("cst_code '%s' is a range but sc_code '%s' is not a range", "cst_code", "sc_code"))


def not_in_titles(fragments: DataFrame, titles: DataFrame | None, include_checked: bool = False) -> DataFrame:
    """[J8, D9] Without titles (None, not: no titles) nothing is found."""
    r = F.col("frag_review")
    rows = fragments.where(not_header(F.col("frag_type")) & not_moved(r) & not_checked(r, include_checked) & ~blank(F.col("sc_code")))
    if titles is None:
        return _findings(rows.where(F.lit(False)), "sc_code_not_in_titles", F.lit(""))
    gone = lookups.missing_codes(rows.select(*KEYS, "sc_code", "frag_review"), titles, "sc_code", [*KEYS, "frag_review"])
    first = F.get("missing", F.lit(0))
    many = F.format_string("sc_code '%s' not found in titles (expanded from '%s', missing: %s)", first, "base", F.array_join("missing", ", "))
    return _findings(gone, "sc_code_not_in_titles", F.when(F.size("missing") == 1, F.format_string("sc_code '%s' not found in titles", first)).otherwise(many))


def run_all(fragments: DataFrame, titles: DataFrame | None = None, include_checked: bool = False) -> DataFrame:
    """The eight review checks as one set of findings; E9: count them by file and check. Read fragments from a stored table."""
    found = missing_sc_code(fragments, include_checked)
    for more in (
        missing_sc_sutta(fragments, include_checked), review_status(fragments), reconstruction(fragments), code_sequence(fragments, include_checked),
        code_uniqueness(fragments), range_consistency(fragments, include_checked), not_in_titles(fragments, titles, include_checked),
    ):
        found = found.unionByName(more)
    return found


def findings_by_file(findings: DataFrame) -> DataFrame:
    """[E9]"""
    return findings.groupBy("cst_file", "check_id").agg(F.count(F.lit(1)).alias("n"))


def files_of(findings: DataFrame) -> DataFrame:
    """[G5] The files that findings tell of, each once, sorted."""
    return findings.select("cst_file").distinct().orderBy("cst_file")


def in_order(findings: DataFrame) -> DataFrame:
    """[G4] By file, then version."""
    return findings.orderBy("cst_file", *cd.version_order(F.col("frag_idx_code")))


# -- guards of a run


def header_ends(fragments: DataFrame) -> DataFrame:
    """[J9, F6] Files whose first or last row is no Header: cst_file, first, last."""
    p = cd.index_parts(F.col("frag_idx_code"))
    return ordered.ends(fragments, ["cst_file"], p, "frag_type").where("first <> 'Header' or last <> 'Header'")


def row_counts(fragments: DataFrame, reference: DataFrame) -> DataFrame:
    """[J10] Files with another number of rows than the reference has, where an absent file has none: cst_file, n, expected."""
    n = fragments.groupBy("cst_file").agg(F.count(F.lit(1)).alias("n"))
    expected = reference.groupBy("cst_file").agg(F.count(F.lit(1)).alias("expected"))
    return n.join(expected, "cst_file", "left").withColumn("expected", F.coalesce("expected", F.lit(0))).where("n <> expected")


def reconstruct(fragments: DataFrame) -> DataFrame:
    """[E10, F9] (cst_file, text): contents in order of place; of empty ones at the same place, in version order."""
    rows = fragments.where(known_kind(F.col("frag_type")) & not_moved(F.col("frag_review"))).withColumn("p", cd.index_parts(F.col("frag_idx_code")))
    return ordered.joined_text(rows, ["cst_file"], ["start_line", "start_char", "p"], "content_xml")


#: Bytes that are compared at once.
CHUNK = 4096


def differences(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """[J11] Files that their fragments do not give back: cst_file, lengths and the first character that differs. Chunks of bytes are compared, then the
    bytes of the first unlike one."""
    both = files.select("cst_file", "content").join(reconstruct(fragments), "cst_file", "left").withColumn("text", F.coalesce("text", F.lit(""))).where("content <> text")
    return both.select("cst_file", F.char_length("content").alias("expected_chars"), F.char_length("text").alias("found_chars"), first_difference(F.col("content"), F.col("text")).alias("first_difference"))


def first_difference(content: Column, text: Column) -> Column:
    """Place from 1 of the first character in which two unlike texts differ. Each step is bound once, so that no bytes are copied again."""
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    part = lambda raw, start, n: F.substring(raw, start + 1, n)
    first = lambda n, like: F.array_position(F.transform(F.sequence(F.lit(0), n), like), False).cast("int") - 1
    size, one = F.lit(CHUNK), F.lit(1)

    def chunk(p: Column) -> Column:
        last = (F.greatest(F.octet_length(p["a"]), F.octet_length(p["b"])) / CHUNK).cast("int")
        return let(F.struct(p["a"].alias("a"), p["b"].alias("b"), (first(last, lambda k: part(p["a"], k * size, size) == part(p["b"], k * size, size)) * CHUNK).alias("c")), byte)

    def byte(p: Column) -> Column:
        x, y = part(p["a"], p["c"], size), part(p["b"], p["c"], size)
        return let(F.struct(p["a"].alias("a"), p["c"].alias("c"), x.alias("x"), y.alias("y")), lambda q: let(F.struct(*(q[n].alias(n) for n in "acxy"), first(size - 1, lambda k: part(q["x"], k, one) == part(q["y"], k, one)).alias("at")), character))

    def character(p: Column) -> Column:
        # A byte that goes on a character belongs to the one that began before it.
        own = F.hex(F.when(p["at"] < F.octet_length(p["x"]), part(p["x"], p["at"], one)).otherwise(part(p["y"], p["at"], one)))
        before = F.char_length(F.substring(p["a"], one, p["c"] + p["at"]).cast("string"))
        return (before + F.when(own.between("80", "BF"), 0).otherwise(1)).cast("long")

    return let(F.struct(content.cast("binary").alias("a"), text.cast("binary").alias("b")), chunk)


def content_integrity(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """[J12, E5] Files whose fragments lose (negative) or repeat (positive) bytes."""
    rows = fragments.where(not_moved(F.col("frag_review")))
    return ordered.byte_loss(rows, files, ["cst_file"], "content_xml", "content").where("difference <> 0")


def chain(fragments: DataFrame) -> DataFrame:
    """[J13, F2] Rows that do not start where the row before ends, moved rows aside."""
    rows = fragments.where(not_moved(F.col("frag_review")))
    return ordered.breaks(rows, ["cst_file"], cd.version_order(F.col("frag_idx_code")), ["start_line", "start_char"], ["end_line", "end_char"])


def store_stats(fragments: DataFrame) -> DataFrame:
    """[E1] One row: sections in all, without cst_code, without sc_code."""
    return ordered.counts(fragments.where(is_section(F.col("frag_type"))), [], {"empty_cst_code": blank(F.col("cst_code")), "empty_sc_code": blank(F.col("sc_code"))})


def files_by_collection(fragments: DataFrame) -> DataFrame:
    """[E3, E6, C31] Collections in display order with their files and counts."""
    rows = ordered.grouped_counts(fragments, "nikaya", "cst_file").withColumn("display", tx.display_name(F.col("nikaya")))
    return rows.orderBy(tx.display_order(F.col("nikaya")), "nikaya")
