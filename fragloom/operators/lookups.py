"""Lookup joins against small dimensions: code mapping and titles. [D, C24]

A dimension is broadcast only after its rows and bytes were counted and are at most BROADCAST_ROWS and BROADCAST_BYTES; beyond
that the same join shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom import schema
from fragloom.functions import codes as cd
from fragloom.functions import text as tx
from fragloom.operators import intervals, ordered

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small(dimension: DataFrame) -> DataFrame:
    """The dimension, marked for broadcast if its rows, and the bytes of their texts, allow."""
    text = F.sum(F.octet_length(F.concat_ws("", *(F.col(c).cast("string") for c in dimension.columns))))
    n, size = dimension.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), text).first()
    return F.broadcast(dimension) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else dimension


def last_wins(df: DataFrame, key: str, values: Sequence[str], order: Column | str) -> DataFrame:
    """[D4, D13] One row a key, that of the largest order."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v"))
    return best.select(key, *(F.col(f"v.{c}").alias(c) for c in values))


def code_map(mapping: DataFrame, order: str = "row_idx") -> DataFrame:
    """[D4] cst_code to sc_code, sc_sutta: mapping rows with both codes; of repeated codes the last row."""
    rows = mapping.where("coalesce(cst_code, '') <> '' and coalesce(code, '') <> ''")
    return last_wins(rows.select("cst_code", F.col("code").alias("sc_code"), F.coalesce("sutta", F.lit("")).alias("sc_sutta"), order), "cst_code", ["sc_code", "sc_sutta"], order)


def title_map(mapping: DataFrame, order: str = "row_idx") -> DataFrame:
    """[D13] cst_code to cst_sutta, the last row wins."""
    return last_wins(mapping.where("coalesce(cst_code, '') <> ''"), "cst_code", ["cst_sutta"], order)


def overwrite(df: DataFrame, dimension: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """[D1, H12] Values of the dimension where the key is in it, else the row's own."""
    d = dimension.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *(F.col(v).alias(f"_{v}") for v in values))
    out = df.join(small(d), F.col(key) == F.col("_k"), "left")
    return out.withColumns({v: F.when(F.col("_hit"), F.col(f"_{v}")).otherwise(F.col(v)) for v in values}).drop("_k", "_hit", *(f"_{v}" for v in values))


def fill(df: DataFrame, dimension: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """[H4] The row's own values; where null, those of the dimension."""
    d = dimension.select(F.col(key).alias("_k"), *(F.col(v).alias(f"_{v}") for v in values))
    out = df.join(small(d), F.col(key) == F.col("_k"), "left")
    return out.withColumns({v: F.coalesce(v, f"_{v}") for v in values}).drop("_k", *(f"_{v}" for v in values))


def fill_sc(fragments: DataFrame, codes: DataFrame) -> DataFrame:
    """[D2, D3] sc_code and sc_sutta where sc_code is null: the mapping of cst_code, widened if that is a range; else of
    `p.a-b` the codes of p.a and p.b together, with the title of p.a."""
    codes = small(codes.select("cst_code", "sc_code", "sc_sutta"))
    named = lambda n: codes.select(F.col("cst_code").alias(f"_{n}"), F.col("sc_code").alias(f"_{n}_sc"), F.col("sc_sutta").alias(f"_{n}_title"))
    head, first, last = (F.regexp_extract("cst_code", r"^(.*)\.(\d+)-(\d+)$", k) for k in (1, 2, 3))
    end = lambda n: F.when(head != "", F.concat(head, F.lit("."), n.try_cast("int").cast("string")))
    out = fragments.withColumns({"_from": end(first), "_to": end(last)})
    out = out.join(named("x"), F.col("cst_code") == F.col("_x"), "left").join(named("a"), F.col("_from") == F.col("_a"), "left").join(named("b"), F.col("_to") == F.col("_b"), "left")
    tail = lambda c: F.regexp_extract(c, r"^.*\.([^.]*)$", 1)
    dotted = F.col("_a_sc").contains(".") & F.col("_b_sc").contains(".")
    span = F.concat(F.regexp_extract("_a_sc", r"^(.*)\.", 1), F.lit("."), tail(F.col("_a_sc")).try_cast("int").cast("string"), F.lit("-"), tail(F.col("_b_sc")).try_cast("int").cast("string"))
    pair = F.when(F.col("_b_sc").isNotNull(), F.when(dotted, span).otherwise(F.col("_a_sc")))
    found = cd.widen(F.coalesce("_x_sc", pair), F.col("cst_code"))
    title = F.when(F.col("_x_sc").isNotNull(), F.col("_x_title")).when(pair.isNotNull(), F.col("_a_title"))
    empty = F.col("sc_code").isNull() & found.isNotNull()
    out = out.withColumns({"_code": F.when(empty, found), "_title": F.when(empty, title)})
    return out.withColumns({"sc_code": F.coalesce("sc_code", "_code"), "sc_sutta": F.coalesce("_title", "sc_sutta")}).select(*fragments.columns)


# -- titles


#: Missing codes of one gap up to which they are given one by one; a longer gap is given as a range.
SPELLED = 100

_NUMBER, _RANGE = r"^(.*\.)(\d{1,18})$", r"^(.*\.)(\d{1,18})-(\d{1,18})$"


def title_ranges(titles: DataFrame) -> DataFrame:
    """Titles of ranges as (prefix, low, high, uid, name), `sn12.` 93 103; the base is prefix and low."""
    head, low, high = (F.regexp_extract("uid", _RANGE, k) for k in (1, 2, 3))
    rows = titles.select(head.alias("prefix"), low.try_cast("bigint").alias("low"), high.try_cast("bigint").alias("high"), "uid", "name")
    return rows.where("prefix <> '' and low is not null and high is not null")


class TitleIndex:
    """Titles as codes and as ranges in cells, measured once: mark is broadcast for titles of a checked size, else nothing."""

    def __init__(self, titles: DataFrame):
        self.titles, self.ranges = titles, title_ranges(titles).select("prefix", "low", "high")
        size = F.sum(F.octet_length(F.concat_ws("", "uid", "name")))
        low, high = (F.regexp_extract("uid", _RANGE, k).try_cast("bigint") for k in (2, 3))
        width = F.when(low <= high, intervals.width_of(low, high))
        n, size, widths = titles.agg(F.count(F.lit(1)), size, F.collect_set(width)).first()
        self.widths = sorted(widths)
        self.mark = F.broadcast if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else lambda df: df
        self.exact = self.mark(titles.select(F.col("uid").alias("_uid")).distinct())

    def covered(self) -> DataFrame:
        """(prefix, low, high) of all numbers that titles cover, single ones as they are written without leading zeros."""
        own = F.regexp_extract("uid", _NUMBER, 2)
        number = own.try_cast("bigint")
        single = self.titles.where((F.regexp_extract("uid", _NUMBER, 1) != "") & (number.cast("string") == own))
        return single.select(F.regexp_extract("uid", _NUMBER, 1).alias("prefix"), number.alias("low"), number.alias("high")).unionByName(self.ranges)


def in_titles(df: DataFrame, titles: DataFrame | TitleIndex, code: str, anti: bool = False) -> DataFrame:
    """[D8] Rows whose code is a title's, or lies in the range of one; anti: the others. Ranges are joined by cells, one join a width."""
    index = titles if isinstance(titles, TitleIndex) else TitleIndex(titles)
    numbered = df.withColumns({"_prefix": F.regexp_extract(code, _NUMBER, 1), "_n": F.regexp_extract(code, _NUMBER, 2).try_cast("bigint")})
    rest, known = numbered.join(index.exact, F.col(code) == F.col("_uid"), "left_anti"), df.join(index.exact, F.col(code) == F.col("_uid"), "left_semi")
    cells = intervals.in_cells(index.ranges).select(F.col("prefix").alias("_p"), "low", "high", "width", F.col("cell").alias("_c"))
    for w in index.widths:
        own = index.mark(cells.where(F.col("width") == w))
        inside = (F.col("_prefix") == F.col("_p")) & (F.shiftright("_n", intervals.BITS * w) == F.col("_c")) & F.col("_n").between(F.col("low"), F.col("high"))
        known = known.unionByName(rest.join(own, inside, "left_semi").select(*df.columns))
        rest = rest.join(own, inside, "left_anti")
    return rest.select(*df.columns) if anti else known


def missing_codes(df: DataFrame, titles: DataFrame, code: str, keys: Sequence[str]) -> DataFrame:
    """[D9, C24] Per key whose code, or part of its range, is not in titles: base code and the array of missing codes, in order. The ranges that titles
    cover are cut out of the code's range; what is left is given code by code, a gap of more than SPELLED codes as a range."""
    index = TitleIndex(titles)
    rows = df.where(f"coalesce({code}, '') <> ''").withColumn("base", F.substring_index(code, ":", 1))
    rows = in_titles(rows.select(*keys, "base"), index, "base", anti=True)
    span = cd.code_range(F.col("base"))
    wanted = rows.select(*keys, "base", span["prefix"].alias("prefix"), span["low"].alias("low"), span["high"].alias("high"))
    found = intervals.overlaps(wanted, index.covered(), sorted({0, *index.widths}), index.mark)
    covering = F.collect_set(F.when(F.col("r_low").isNotNull(), F.struct(F.col("r_low").alias("low"), F.col("r_high").alias("high"))))
    left = found.groupBy(*keys, "base", "prefix", "low", "high").agg(covering.alias("r")).withColumn("gap", intervals.gaps(F.col("low"), F.col("high"), F.col("r")))
    text = lambda n: F.concat("prefix", n.cast("string"))
    spelled = lambda g: F.when(g["high"] - g["low"] < SPELLED, F.transform(F.sequence(g["low"], F.least(g["high"], g["low"] + SPELLED)), text)).otherwise(F.array(F.concat(text(g["low"]), F.lit("-"), g["high"].cast("string"))))
    missing = F.when(F.col("prefix").isNull(), F.array("base")).otherwise(F.flatten(F.transform("gap", spelled)))
    return left.select(*keys, "base", missing.alias("missing")).where(F.size("missing") > 0)


def resolve(df: DataFrame, titles: DataFrame, code: str) -> DataFrame:
    """[D5] found_code and found_title of a derived code: the title itself, else one of a range that begins with it, else the
    same for the code without its own range. Of several ranges, the least."""
    exact = small(titles.groupBy(F.col("uid").alias("_k")).agg(F.min(F.struct("uid", "name")).alias("_t")))
    ranged = small(titles.where("instr(uid, '-') > 0").groupBy(F.substring_index("uid", "-", 1).alias("_k")).agg(F.min(F.struct("uid", "name")).alias("_t")))
    out = df.withColumn("_base", cd.non_range_base(F.col(code)))
    for n, (dimension, key) in enumerate(((exact, code), (ranged, code), (exact, "_base"), (ranged, "_base"))):
        out = out.join(dimension.select(F.col("_k").alias(f"_k{n}"), F.col("_t").alias(f"_t{n}")), F.col(key) == F.col(f"_k{n}"), "left")
    best = F.coalesce("_t0", "_t1", "_t2", "_t3")
    return out.withColumns({"found_code": best["uid"], "found_title": best["name"]}).select(*df.columns, "found_code", "found_title")


def suggestions(fragments: DataFrame, titles: DataFrame) -> DataFrame:
    """[D11, D14] (cst_file, frag_idx_code, sc_code, suggested_value): titles for codes, what follows a colon aside."""
    t = small(titles.groupBy(F.col("uid").alias("_k")).agg(F.max("name").alias("suggested_value")))
    return fragments.join(t, F.substring_index("sc_code", ":", 1) == F.col("_k")).select("cst_file", "frag_idx_code", "sc_code", "suggested_value")


# -- codes of corrections


def apply_overrides(fragments: DataFrame, overrides: DataFrame, titles: DataFrame | None) -> DataFrame:
    """[D6, F4] Fields of corrections, then the group of a corrected sc_code for the rows below it that have none, until one
    has. With titles, only codes that resolve() finds are taken, with their title; without, codes as derived."""
    fields = [*schema.CODES, "frag_review", "frag_type"]
    fixes = overrides.select("cst_file", "frag_idx_code", F.lit(True).alias("_fix"), *(F.col(c).alias(f"_{c}") for c in fields))
    rows = fragments.join(small(fixes), ["cst_file", "frag_idx_code"], "left")
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    point = F.col("_fix").eqNullSafe(True) & F.col("_sc_code").isNotNull() & cd.sc_parts(F.col("_sc_code")).isNotNull()
    order = cd.version_order(F.col("frag_idx_code"))
    rows = ordered.carry(rows, ["cst_file"], order, point, cd.sc_parts(F.col("_sc_code")), F.col("sc_code").isNotNull(), "_context")
    context = F.col("_context")
    derived = cd.widen(cd.sc_from_context(F.col("cst_code"), context["prefix"], context["samyutta"], context["nipata"]), F.col("cst_code"))
    rows = rows.withColumn("_derived", F.when(F.col("sc_code").isNull() & F.col("cst_code").isNotNull(), derived))
    if titles is None:
        return rows.withColumn("sc_code", F.coalesce("sc_code", "_derived")).select(*fragments.columns)
    rows = resolve(rows, titles, "_derived")
    return rows.withColumns({"sc_sutta": F.when(F.col("sc_code").isNull(), F.coalesce("found_title", "sc_sutta")).otherwise(F.col("sc_sutta")), "sc_code": F.coalesce("sc_code", "found_code")}).select(*fragments.columns)


# -- a title in the mapping


def _keys(title: Column) -> Column:
    """Spellings under which a title may stand: itself, without its number, and, of a commentary, the name it comments."""
    plain = F.trim(F.lower(title))
    bare = F.regexp_replace(plain, r"^[\p{N}-]+\.\s*", "")
    return F.array_distinct(F.array(plain, bare, F.regexp_replace(bare, r"vaṇṇanā$", "ṃ"), F.regexp_replace(bare, r"suttavaṇṇanā$", "suttaṃ")))


def find_codes(sections: DataFrame, mapping: DataFrame) -> DataFrame:
    """[D12] For (cst_file, seq, cst_vagga, cst_sutta): the mapping's code of that title, in the same file and vagga if there is
    such a row, in the same file else. Each code is given once, in order of seq: the k-th section of a title gets its k-th code."""
    stem = lambda c: F.regexp_replace(cd.strip_folders(c), r"\.(att|tik)\.xml$", ".mul.xml")
    same_stem = lambda c: F.regexp_replace(stem(c), r"[at]\.mul\.xml$", "m.mul.xml")
    m = mapping.where("coalesce(code, '') <> ''").select(same_stem(F.col("cst_file")).alias("f"), F.explode(_keys(F.col("cst_sutta"))).alias("k"), F.lower(F.trim("cst_vagga")).alias("v"), "code", "row_idx")
    s = sections.select("cst_file", "seq", same_stem(F.col("cst_file")).alias("f"), F.explode(_keys(F.col("cst_sutta"))).alias("k"), F.lower(F.trim("cst_vagga")).alias("sv"))
    hits = s.join(small(m), ["f", "k"]).withColumn("p", F.when(F.col("v").eqNullSafe(F.col("sv")), 0).otherwise(1))
    best = hits.groupBy("cst_file", "seq", "code").agg(F.min("p").alias("p"), F.min("row_idx").alias("row_idx"))
    ranked = best.groupBy("cst_file", "seq").agg(F.array_sort(F.collect_list(F.struct("p", "row_idx", "code"))).alias("all"))
    w = Window.partitionBy("cst_file", F.get("all", F.lit(0))["code"]).orderBy("seq")
    turn = F.row_number().over(w) - 1
    return ranked.withColumn("_turn", turn).select("cst_file", "seq", F.coalesce(F.get("all", F.col("_turn"))["code"], F.element_at("all", -1)["code"]).alias("code"))


def html_column(fragments: DataFrame) -> DataFrame:
    """content_html of sections, null for headers; computed when it is asked for, so it is never stale."""
    return fragments.withColumn("content_html", F.when(F.col("frag_type") == "Sutta", tx.to_html(F.col("content_xml"))))
