"""Codes that follow the row above: a fold over the rows of a run, in the JVM. [D7, C17]

A row without an sc_code takes the one that follows the code of the row above, which may itself just have been filled, if titles know it.
Nothing is handed on past a row that stays without a code, so rows fall into runs: a row with a code and the rows without one below it. A run is
an array, folded by aggregate(); what a step needs of the cst codes are columns. Titles come to a file by a join on the letters and the
first number that its codes may begin with, as maps that the fold looks into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom.functions import codes as cd

#: A code, or a range of codes, of which the end counts.
_LAST = r"^([a-z]{2})(\d+)(?:\.(\d+))?(?:-(\d+))?$"
_STEM = r"^([a-z]{2}\d+)"


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def parsed(code: Column) -> Column:
    """struct(letters, grp, number) of what a code or range ends with; letters null if it is neither."""
    part = lambda k: F.regexp_extract(code, _LAST, k)
    grouped = part(1).isin("sn", "an")
    own = F.when(grouped, _long(part(3))).otherwise(_long(part(2)))
    number = F.when(part(4) != "", _long(part(4))).otherwise(own)
    return F.struct(F.when(part(1) != "", part(1)).alias("letters"), F.when(grouped, _long(part(2))).alias("grp"), number.alias("number"))


def cst_facts(cst: Column) -> Column:
    """struct(grp, first, last, size): second and fourth number of a cst code of four parts or more, the end of its range, and by how much the range goes on."""
    span = cd.cst_range(cst)
    parts = F.split(F.coalesce(span["base"], cst), r"\.")
    at = lambda k: F.when(F.size(parts) > 3, _long(F.get(parts, F.lit(k))))
    end = F.when(span.isNotNull(), span["end"].cast("bigint"))
    return F.struct(at(1).alias("grp"), at(3).alias("first"), end.alias("last"), (end - _long(F.substring_index(span["base"], ".", -1))).alias("size"))


def following(last: Column, cst: Column, above: Column) -> Column:
    """[C17] The code that follows last (letters, grp, number) for the facts of a cst code and, where it has one, the group of the cst code above."""
    text = lambda g, start, stop: F.concat(last["letters"], g.cast("string"), F.lit("."), start.cast("string"), F.coalesce(F.concat(F.lit("-"), stop.cast("string")), F.lit("")))
    first, number, end = cst["first"], last["number"], cst["last"]
    opened = text(last["grp"] + 1, F.lit(1), end)
    same = text(last["grp"], number + 1, F.when(end.isNotNull(), number + 1 + end - first))
    by_above = F.when(above == cst["grp"], same).otherwise(opened)
    by_number = F.when(((first == 1) & (number != 0)) | (first < number), opened).when(first == number + 1, text(last["grp"], first, end))
    grouped = F.when((last["letters"] == "sn") & above.isNotNull(), by_above).otherwise(by_number)
    plain = F.when(first == number + 1, F.concat(last["letters"], first.cast("string")))
    known = cst["grp"].isNotNull() & first.isNotNull() & number.isNotNull()
    return F.when(known, F.when(last["letters"].isin("dn", "mn"), plain).when(last["letters"].isin("sn", "an") & last["grp"].isNotNull(), grouped))


def _titled(new: Column, cst: Column, names: Column, ranges: Column) -> Column:
    """struct(code, title) by which titles know a new code, title null if they do not."""
    base = F.substring_index(new, "-", 1)
    start = F.coalesce(_long(F.substring_index(base, ".", -1)), F.lit(1).cast("bigint"))
    longer = F.concat(F.substring_index(base, ".", 1), F.lit("."), start.cast("string"), F.lit("-"), (start + cst["size"]).cast("string"))
    wide = F.when((cst["size"] > 0) & base.contains("."), longer).otherwise(new)
    name = lambda code: F.try_element_at(names, code)
    uid = F.when(name(new).isNotNull(), new).otherwise(F.try_element_at(ranges, new))
    spanned = F.struct(wide.alias("code"), F.coalesce(name(wide), name(F.substring_index(wide, "-", 1))).alias("title"))
    return F.when(cst["last"].isNotNull(), spanned).otherwise(F.struct(uid.alias("code"), name(uid).alias("title")))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_STATE = "struct<last:struct<letters:string,grp:bigint,number:bigint>,above:bigint,out:array<struct<frag_idx_code:string,code:string,title:string>>>"


def _step(names: Column, ranges: Column):
    def step(state: Column, row: Column) -> Column:
        new = following(state["last"], row["cst"], state["above"])
        ended = F.struct(F.lit(None).cast("struct<letters:string,grp:bigint,number:bigint>").alias("last"), F.lit(None).cast("bigint").alias("above"), state["out"].alias("out"))
        filled = lambda f: F.when(f["title"].isNull(), ended).otherwise(F.struct(parsed(f["code"]).alias("last"), row["cst"]["grp"].alias("above"), F.concat(state["out"], F.array(F.struct(row["frag_idx_code"].alias("frag_idx_code"), f["code"].alias("code"), f["title"].alias("title")))).alias("out")))
        return F.when(state["last"]["letters"].isNull(), ended).otherwise(_let(_titled(new, row["cst"], names, ranges), filled)).cast(_STATE)

    return step


def propagate(fragments: DataFrame, titles: DataFrame | None, mark=lambda df: df) -> DataFrame:
    """[D7] sc_code and sc_sutta where null, from the row above. A code is kept only if titles know it: as one of theirs, as the first of one of their
    ranges (the least), or, for a range, by its first code. Without titles nothing is filled. mark: broadcast for titles of a checked size."""
    if titles is None:
        return fragments
    order = Window.partitionBy("cst_file").orderBy(*cd.version_order(F.col("frag_idx_code")))
    slim = fragments.select("cst_file", "frag_idx_code", "sc_code", "cst_code")
    # A row without codes at all ends a run, as one with a code begins one.
    slim = slim.withColumn("run", F.sum((F.col("sc_code").isNotNull() | F.col("cst_code").isNull()).cast("long")).over(order)).withColumn("place", F.row_number().over(order))
    row = F.struct("place", "frag_idx_code", "sc_code", cst_facts(F.col("cst_code")).alias("cst"))
    runs = slim.groupBy("cst_file", "run").agg(F.array_sort(F.collect_list(row)).alias("rows")).where(F.size("rows") > 1)
    runs = runs.select("cst_file", "run", F.get("rows", F.lit(0)).alias("head"), F.slice("rows", 2, F.size("rows") - 1).alias("rest")).where("head.sc_code is not null")
    runs = runs.withColumn("last", parsed(F.col("head.sc_code"))).where("last.letters is not null and last.number is not null")
    # Groups rise by one a row at most; numbers of ungrouped codes are those of the cst codes.
    stem = lambda n: F.concat("last.letters", n.cast("string"))
    rising = F.transform(F.sequence(F.col("last.grp"), F.col("last.grp") + F.size("rest")), stem)
    numbered = F.transform(F.filter("rest", lambda r: r["cst"]["first"].isNotNull()), lambda r: stem(r["cst"]["first"]))
    stems = F.explode(F.array_distinct(F.when(F.col("last.grp").isNotNull(), rising).otherwise(numbered)))
    named = titles.where("uid is not null and name is not null").groupBy("uid").agg(F.max("name").alias("name")).withColumn("stem", F.regexp_extract("uid", _STEM, 1)).where("stem <> ''")
    own = runs.select("cst_file", stems.alias("stem")).distinct().join(mark(named), "stem")
    first = F.when(F.col("uid").contains("-"), F.substring_index("uid", "-", 1))
    by_first = own.where(first.isNotNull()).groupBy("cst_file", first.alias("code")).agg(F.min("uid").alias("uid"))
    entries = own.select("cst_file", F.struct("uid", "name").alias("n"), F.lit(None).cast("struct<code:string,uid:string>").alias("r")).unionByName(by_first.select("cst_file", F.lit(None).cast("struct<uid:string,name:string>").alias("n"), F.struct("code", "uid").alias("r")))
    maps = entries.groupBy("cst_file").agg(F.map_from_entries(F.collect_list("n")).alias("names"), F.map_from_entries(F.collect_list("r")).alias("ranges"))
    start = F.struct(F.col("last"), F.col("head.cst.grp").alias("above"), F.array().cast("array<struct<frag_idx_code:string,code:string,title:string>>").alias("out")).cast(_STATE)
    folded = runs.join(maps, "cst_file").select("cst_file", F.explode(F.aggregate("rest", start, _step(F.col("names"), F.col("ranges")), lambda s: s["out"])).alias("f"))
    new = folded.select("cst_file", F.col("f.frag_idx_code").alias("frag_idx_code"), F.col("f.code").alias("_code"), F.col("f.title").alias("_title"))
    out = fragments.join(new, ["cst_file", "frag_idx_code"], "left")
    return out.withColumns({"sc_sutta": F.when(F.col("_code").isNotNull(), F.col("_title")).otherwise(F.col("sc_sutta")), "sc_code": F.coalesce("sc_code", "_code")}).select(*fragments.columns)
