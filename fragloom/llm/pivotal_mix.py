r"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; its documents start with the same number of copies, target / source size, at most
MAX_COPIES. The whole part is certain. The fractional part is settled by pivotal steps that keep the sum of
size * copies: of two fractional documents, one gives probability mass to the other until one of them is integral, in
either direction, at random with odds that keep each document's expectation. A group of about GROUP documents, dealt by
a hash, settles all but one fractional document and its RESERVE smallest; these residuals go up a reduction tree of
fan-in FAN_IN until one group per source is left. There the largest fractional document is settled against all smaller
ones at once, so the words that cannot be matched in the end are fewer than the smallest documents of the source.

The random draws are hashes of doc_id, size, level and group, and groups depend on the rows alone, so reruns and
other partitionings agree; rows of equal doc_id, source and size are told apart by a rank among them, so they are dealt to
groups like any others. Pivotal steps keep each document's expectation. The last one of a source does where both directions
can be paid for by the smaller documents left; where only one can, it is taken, which moves the expectations of those at most
(RESERVE + 1) * FAN_IN documents, by less than one copy each.

Scale: texts are read once and never move; (id, size, source) is shuffled, in groups of about GROUP rows however large a source
is, and however many rows are alike. Facts of heavy sources are broadcast, fewer than HEAVY, those of others joined;
a few sums come to the driver, whatever the number of sources.

Defined cases: null text has size 0. A source of null is a source, the last. Documents of size 0 take 0 words and, with
any copies, no part. Repeated rows are rows of their own. If all sizes are 0 all targets are 0. Other columns of the
input, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm._shared import drop_tables, free_name, heavy_keys, heavy_limit, join_heavy, merge_join, stored, table, with_row_id, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
GROUP, RESERVE, FAN_IN = 4096, 64, 16
#: Runs that the ranks of very many equal rows are counted in.
SLICES = 1024
_NEAR = 1e-9

_ROWS = "_rid long, doc_id long, twin long, src long, size long, grp long, whole long, part double, open boolean"


def _draw(*what: object) -> float:
    """A number in [0, 1) from what it is drawn for. The hash must not be linear, as a CRC is: then the draws of one run hang together,
    and documents are taken more or less often than their part."""
    return (int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=6).digest()) + 0.5) / 2**48


def pair(x: float, s: float, y: float, t: float, u: float) -> tuple[float, float]:
    """One pivotal step on parts x and y of documents of sizes s and t: s*x + t*y stays, one part becomes 0 or 1, and over u
    uniform in [0, 1) both keep their expectation."""
    up = min(s * (1 - x), t * y)  # words that x can take from y
    down = min(s * x, t * (1 - y))
    if u * (up + down) < down:
        x, y = x + up / s, y - up / t
    else:
        x, y = x - down / s, y + down / t
    snap = lambda p: 0.0 if p < _NEAR else 1.0 if p > 1 - _NEAR else p
    return snap(x), snap(y)


def settle(sizes: list[int], parts: list[float], ids: list[object], reserve: int, key: object) -> list[float]:
    """Pivotal steps, largest first, over documents sorted by falling size; the last `reserve` ones stay as they are."""
    parts, carry = list(parts), None
    for i in range(len(parts) - reserve):
        if not 0 < parts[i] < 1:
            continue
        if carry is None:
            carry = i
            continue
        parts[carry], parts[i] = pair(parts[carry], sizes[carry], parts[i], sizes[i], _draw(key, ids[carry], ids[i]))
        if 0 < parts[i] < 1:
            carry = i
        elif not 0 < parts[carry] < 1:
            carry = None
    return parts


def finish(sizes: list[int], parts: list[float], ids: list[object], key: object) -> list[float]:
    """Settles all: the largest open document against all smaller ones together, which share the words it gives or takes."""
    parts = list(parts)
    for i in range(len(parts)):
        rest = [j for j in range(i + 1, len(parts)) if 0 < parts[j] < 1]
        x, s = parts[i], sizes[i]
        if not 0 < x < 1:
            continue
        rise = sum(sizes[j] * (1 - parts[j]) for j in rest)
        fall = sum(sizes[j] * parts[j] for j in rest)
        up, down = s * (1 - x) <= fall, s * x <= rise
        to_one = _draw(key, ids[i], "last") < x if up == down else up
        words = s * (1 - x) if to_one else -s * x  # what the rest gives
        for j in rest:
            if to_one:
                parts[j] *= max(0.0, 1 - words / fall) if fall else 1
            else:
                parts[j] += (1 - parts[j]) * min(1.0, -words / rise) if rise else 0
            parts[j] = 0.0 if parts[j] < _NEAR else 1.0 if parts[j] > 1 - _NEAR else parts[j]
        parts[i] = 1.0 if to_one else 0.0
    return parts


def _level(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "twin"], ascending=[False, True, True], kind="stable", na_position="last")
        key = (level, int(rows["src"].iloc[0]), int(rows["grp"].iloc[0]))
        ids = [f"{d}/{s}/{t}" for d, s, t in zip(rows["doc_id"].astype("Int64").astype(str), rows["size"], rows["twin"])]
        args = rows["size"].tolist(), rows["part"].tolist(), ids
        parts = settle(*args, RESERVE, key)
        if last:
            parts = finish(args[0], parts, ids, key)
        rows["open"] = [0 < p < 1 for p in parts]
        rows["whole"] = rows["whole"] + [int(p == 1.0) for p in parts]
        rows["part"] = [p if 0 < p < 1 else 0.0 for p in parts]
        return rows

    return run


def with_twins(rows: DataFrame) -> DataFrame:
    """rows (_rid, doc_id, source, size) plus ``twin``, which tells rows of equal doc_id, source and size apart: 1 up to their
    number, whatever the file layout; with gaps, from SLICES runs, where they are heavy (see _shared)."""
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "source", "size"))
    heavy = heavy_keys(rows.select("_key"), ["_key"])
    piece = F.lit(0).cast("long")
    if heavy is not None:
        rows = rows.join(F.broadcast(heavy.withColumn("_many", F.lit(True))), "_key", "left")
        piece = F.when(F.col("_many"), F.pmod(F.xxhash64("_rid"), F.lit(SLICES))).otherwise(piece)
    rows = rows.withColumn("_piece", piece)
    rank = F.row_number().over(Window.partitionBy("_key", "_piece").orderBy("_rid"))
    return rows.withColumn("twin", F.col("_piece") * F.lit(1 << 40) + rank).select("_rid", "doc_id", "source", "size", "twin")


def source_facts(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """A row for each source, written: source, src (from 0, by code point, null last), source_size, n, target. The level to which
    sources fill up, the same for all but for their weights, is found with sums over sources; no list of them is collected."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = table(sources.orderBy(F.asc_nulls_last("source")), "sources")
    placed = table(with_row_id(sources), "placed")
    files = {r["f"]: r["c"] for r in placed.groupBy(F.shiftright("_rid", 40).alias("f")).agg(F.count(F.lit(1)).alias("c")).collect()}  # one a file
    before, at = [], 0
    for file in sorted(files):
        before.append((file, at))
        at += files[file]
    before = rows.sparkSession.createDataFrame(before, "f long, before long")
    number = (F.col("before") + F.col("_rid").bitwiseAND(F.lit((1 << 40) - 1))).cast("long")
    placed = placed.withColumn("f", F.shiftright("_rid", 40)).join(F.broadcast(before), "f")
    w = F.get(F.array(*map(F.lit, weights)), (number % len(weights)).cast("int"))
    placed = table(placed.select("source", number.alias("src"), "source_size", "n", w.alias("w")), "weighed")
    whole = placed.agg(F.sum("source_size"), F.sum("w")).first()
    total, weight = float(whole[0] or 0), float(whole[1] or 0)
    left, free, full = share * total, weight, None
    while free > 0:
        over = F.lit(left) * F.col("w") / F.lit(free) > most * F.col("source_size")
        now = placed.where(over).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("w")).first()
        if now[0] == full or now[0] == 0:
            break
        full, left, free = now[0], share * total - most * now[1], weight - now[2]
    most_words = (most * F.col("source_size")).cast("double")
    target = F.least(most_words, F.lit(left) * F.col("w") / F.lit(free)) if free > 0 else most_words
    facts = table(placed.select("source", "src", "source_size", "n", target.alias("target")), "facts")
    drop_tables(sources, placed)
    return facts


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """Per row of docs: _rid, doc_id, size, source_size, target, taken, copies."""
    rows = with_row_id(stored(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    rows = table(rows, "sizes")
    facts = source_facts(rows, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + _NEAR).cast("long")
    facts = facts.select("source", "src", "source_size", "target", "n", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("part"), F.greatest(F.lit(1), F.floor(F.col("n") / GROUP)).cast("long").alias("groups"))
    # A null source has a key of its own.
    keyed = lambda df: df.withColumns({"_name": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}).drop("source")
    facts = table(keyed(facts), "keyed")
    heavy = facts.where(F.col("n") > heavy_limit(rows.count())).select("_name", "_null")
    rows = join_heavy(keyed(with_twins(rows)), facts.drop("n"), ["_name", "_null"], heavy)
    rows = rows.withColumn("part", F.when((F.col("size") > 0) & (F.col("part") >= _NEAR), F.col("part")).otherwise(0.0)).withColumn("open", F.col("part") > 0)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size", "twin"), "groups"))
    names = [x.split()[0] for x in _ROWS.split(", ")]
    base = table(rows.select(*names, "source_size", "target"), "parts")
    most_groups = facts.agg(F.max("groups")).first()[0] or 1
    done, now, level = base.where("not open").select("_rid", "whole"), base.where("open").select(*names), 0
    while True:
        last = most_groups == 1
        now = table(now.groupBy("src", "grp").applyInPandas(_level(level, last), _ROWS), f"pivot{level}")
        done = done.unionByName(now.where("not open").select("_rid", "whole"))
        if last:
            break
        now, most_groups, level = now.where("open").withColumn("grp", F.floor(F.col("grp") / FAN_IN)), -(-most_groups // FAN_IN), level + 1
    return merge_join(base.drop("whole"), done, "_rid").select("_rid", "doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole")).alias("taken"), F.col("whole").alias("copies"))


def repeat_rows(docs: DataFrame, **options: object) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it."""
    docs = stored(docs)
    rid = free_name(docs, "_rid")
    wide = with_row_id(docs, rid)
    many = free_name(wide, "_copies")
    copies = mix(docs, **options).select(F.col("_rid").alias(rid), F.col("copies").cast("int").alias(many))
    rows = wide.join(copies.where(F.col(many) > 0), rid)
    return rows.withColumn(many, F.explode(F.sequence(F.lit(1), F.col(many)))).drop(rid, many).select(*docs.columns)
