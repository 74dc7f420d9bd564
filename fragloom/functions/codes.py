
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX = r"^\d+\.\d+$"


def _int(c: Column) -> Column:
    return c.try_cast("int")


# -- fragment indexes


def index_parts(code: Column) -> Column:
    """[C1] struct(major, minor) of `21.3`; fails the query on anything else, keeps null."""
    bad = F.raise_error(F.concat(F.lit("not a fragment index: "), code))
    part = lambda k: F.when(code.rlike(INDEX), F.split(code, r"\.")[k].cast("int")).when(code.isNotNull(), bad.cast("int"))
    return F.struct(part(0).alias("major"), part(1).alias("minor"))


def format_index(major: Column, minor: Column) -> Column:
    """[C2]"""
    return F.concat_ws(".", major.cast("string"), minor.cast("string"))


def version_order(code: Column) -> list[Column]:
    """[C3, G1] Sort keys: 21.9 before 21.10."""
    return [index_parts(code)["major"], index_parts(code)["minor"]]


def next_minor(minors: Column) -> Column:
    """[C4] Smallest minor from 1 that an array of minors leaves free."""
    return F.array_min(F.array_except(F.sequence(F.lit(1), F.size(minors) + 1), minors))


def next_index(code: Column) -> Column:
    """[C5] The next major, minor 0."""
    return F.concat(index_parts(code)["major"] + 1, F.lit(".0"))


def legacy_index(number: Column) -> Column:
    """[A17] 21 to 21.0."""
    return F.concat(number.cast("string"), F.lit(".0"))


def legacy_number(code: Column) -> Column:
    """[A18] 21.0 to 21, null for inserted fragments: lossy."""
    return F.when(F.substring_index(code, ".", -1) == "0", _int(F.substring_index(code, ".", 1)))


# -- titles


def leading_number(title: Column) -> Column:
    """[C11] `5-7` of `5-7. Title` or `5-7.Title`; null without the full stop."""
    spaced = F.regexp_extract(title, r"^\s*(\p{N}+(?:-\p{N}+)*)\.(?:\s|$)", 1)
    tight = F.regexp_extract(title, r"^([0-9]+(?:-[0-9]+)*)\.", 1)
    return F.when(spaced != "", spaced).when(tight != "", tight)


def is_number_or_range(text: Column) -> Column:
    """[C12]"""
    return text.rlike(r"^\p{N}+(-\p{N}+)*$")


# -- codes of the external numbering (sc) and of the sources (cst)

_SC = r"^([a-z]{2})(\d+)(?:\.(\d+))?$"


def sc_parts(code: Column) -> Column:
    """[C13] struct(prefix, samyutta, nipata, sutta) of a single code; null for ranges and anything else."""
    prefix, first, second = (F.regexp_extract(code, _SC, k) for k in (1, 2, 3))
    number = F.when(prefix.isin("sn", "an"), _int(second)).otherwise(_int(first))
    found = F.struct(prefix.alias("prefix"), F.when(prefix == "sn", _int(first)).alias("samyutta"), F.when(prefix == "an", _int(first)).alias("nipata"), number.alias("sutta"))
    return F.when(code.rlike(_SC), found)


def sc_range_parts(code: Column) -> Column:
    """[C14] sc_parts() of `sn12.93-103`, with the end of the range as sutta."""
    halves = F.split(code, "-")
    return F.when(F.size(halves) == 2, F.when(_int(halves[1]).isNotNull(), sc_parts(halves[0]).withField("sutta", _int(halves[1]))))


def format_sc(parts: Column) -> Column:
    """[C15]"""
    group = F.coalesce(parts["samyutta"], parts["nipata"]).cast("string")
    number = parts["sutta"].cast("string")
    grouped = F.when(group.isNull(), parts["prefix"]).when(number.isNull(), F.concat(parts["prefix"], group)).otherwise(F.concat(parts["prefix"], group, F.lit("."), number))
    return F.when(parts["prefix"].isin("sn", "an"), grouped).otherwise(F.concat(parts["prefix"], F.coalesce(number, F.lit(""))))


_RANGE = r"^(.*(?:^|\.)[0-9]+)-([0-9]+)$"


def cst_range(code: Column) -> Column:
    """[C18] struct(base, end) of `sn3.2.3.1-11`; null if it is no range."""
    base, end = F.regexp_extract(code, _RANGE, 1), _int(F.regexp_extract(code, _RANGE, 2))
    return F.when(code.rlike(_RANGE) & end.isNotNull(), F.struct(base.alias("base"), end.alias("end")))


def widen(sc: Column, cst: Column) -> Column:
    """[C19] A code as a range as long as that of the cst code; itself where that is no range of more than one."""
    span = cst_range(cst)
    first = _int(F.substring_index(span["base"], ".", -1))
    base = F.substring_index(sc, "-", 1)
    start = F.coalesce(_int(F.substring_index(base, ".", -1)), F.lit(1))
    wide = F.concat(F.regexp_extract(base, r"^(.*\.)", 1), start.cast("string"), F.lit("-"), (start + span["end"] - F.coalesce(first, F.lit(1))).cast("string"))
    return F.when(span.isNotNull() & span["base"].contains(".") & base.contains(".") & (span["end"] > F.coalesce(first, F.lit(1))), wide).otherwise(sc)


def non_range_base(code: Column) -> Column:
    """[C20] `sn30.3` of `sn30.3-12`, else null."""
    base = F.regexp_extract(code, r"^(.*(?:^|\.)[0-9]*)-[^-]*$", 1)
    return F.when(base != "", base)


def sc_from_context(cst: Column, prefix: Column, samyutta: Column, nipata: Column) -> Column:
    """[C16] The sc code of a cst code, given the prefix and group that a correction set."""
    span = cst_range(cst)
    parts = F.split(F.coalesce(span["base"], cst), r"\.")
    at = lambda k: _int(F.get(parts, F.lit(k)))
    group = F.when(prefix == "sn", samyutta).when(prefix == "an", nipata)
    end = F.when(span.isNotNull(), F.concat(F.lit("-"), span["end"].cast("string"))).otherwise(F.lit(""))
    grouped = F.concat(prefix, group.cast("string"), F.lit("."), at(3).cast("string"), end)
    return F.when(prefix.isin("sn", "an"), grouped).when(prefix.isin("dn", "mn"), F.concat(prefix, at(1).cast("string")))


# -- the second, looser reading of codes that the checks use

_LOOSE = r"^([^0-9]+)(?:(\d+)\.)?(\d+)(?:-(\d+))?$"


def check_parts(code: Column) -> Column:
    """[C21] struct(prefix, grp, first, last); drops what follows a colon, takes any prefix and ranges; null if unreadable."""
    base = F.substring_index(code, ":", 1)
    part = lambda k: F.regexp_extract(base, _LOOSE, k)
    first = part(3).try_cast("long")
    return F.when(
        base.rlike(_LOOSE),
        F.struct(part(1).alias("prefix"), part(2).try_cast("long").alias("grp"), first.alias("first"), F.coalesce(part(4).try_cast("long"), first).alias("last")),
    )


def range_text(first: Column, last: Column) -> Column:
    """[C22] `55` or `55-57`."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def is_sc_range(code: Column) -> Column:
    """[C23] The last dotted part has a hyphen."""
    return F.substring_index(F.substring_index(code, ":", 1), ".", -1).contains("-")


def code_range(code: Column) -> Column:
    """[C24] struct(prefix, low, high) of `sn1.55-57`; null for undotted ranges, numbers of more than 18 digits and anything else."""
    base = F.substring_index(code, ":", 1)
    head, first, last = (F.regexp_extract(base, r"^([^-]*\.)(\d{1,18})-(\d{1,18})$", k) for k in (1, 2, 3))
    return F.when(head != "", F.struct(head.alias("prefix"), first.try_cast("bigint").alias("low"), last.try_cast("bigint").alias("high")))


def expand(code: Column) -> Column:
    """[C24] Array of the codes in `sn1.55-57`; what is no code_range(), alone. For ranges known to be short: missing codes are found
    without it."""
    span = code_range(code)
    numbers = F.when(span["low"] <= span["high"], F.sequence(span["low"], span["high"])).otherwise(F.array().cast("array<bigint>"))
    return F.when(span.isNotNull(), F.transform(numbers, lambda n: F.concat(span["prefix"], n.cast("string")))).otherwise(F.array(code))


def strip_folders(path: Column) -> Column:
    """[C32] Drops the leading folders of mapping file names."""
    return F.regexp_replace(path, r"^(romn/|mula/)+", "")
