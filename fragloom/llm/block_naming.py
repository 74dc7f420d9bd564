r"""Exact dedup by deterministic block naming.

A text (UTF-8, null as empty) is cut into blocks of BLOCK bytes. Equal blocks get equal integer names: the blocks are
dealt to buckets by a hash, each bucket is sorted, and the rank of a block in its bucket is its name there, so names
compare whole blocks and two different blocks never share one. Adjacent names are then paired and the pairs named the
same way, level by level, until each document has one name; (levels, name) is its identity, without collisions.

Scale: the text moves once, as blocks. Before that a task collapses equal blocks of an Arrow batch to one row; its occurrences
find the name through a key of their own (``lid``), which never repeats. Of a heavy block (see _shared) each task gives one row, and one of
all goes on to the naming; its name comes back by a broadcast of the heavy blocks, fewer than HEAVY of BLOCK bytes. Pairs are made distinct with map-side aggregation before
they are named; the names of heavy pairs, and what is known of heavy groups of copies, are broadcast, fewer than HEAVY rows,
the others are joined back. Levels: log2 of the blocks of the longest text. Each level is a written table, deleted when it
has been used.

Defined cases: null text counts as empty; all empty texts are equal. Repeated rows, also of one doc_id, count one each
in group_size and exactly one row of a group is kept: the largest doc_id, null below all, the later row on ties.
Other columns of the input, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm._shared import drop_tables, heavy_keys, heavy_limit, join_heavy, merge_join, stored, table, with_row_id, without_rows

BLOCK = 4096
#: Rows of a naming bucket, about.
BUCKET_ROWS = 2000

_SPLIT = "_rid long, doc_id long, sha binary, n int, pos int, lid long, block binary"


def _splitter(block: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lid = TaskContext.get().partitionId() << 36
        for batch in batches:
            local: dict[bytes, int] = {}
            out: list[list] = [[], [], [], [], [], [], []]
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                n = max(1, -(-len(raw) // block))
                for pos in range(n):
                    part = raw[pos * block : (pos + 1) * block]
                    known = local.get(part)
                    if known is None:
                        known = local[part] = lid
                        lid += 1
                        out[6].append(part)
                    else:
                        out[6].append(None)
                    out[0].append(rid)
                    out[1].append(doc if pos == 0 else None)
                    out[2].append(hashlib.sha256(raw).digest() if pos == 0 else None)
                    out[3].append(n)
                    out[4].append(pos)
                    out[5].append(known)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                names=["_rid", "doc_id", "sha", "n", "pos", "lid", "block"],
            )

    return split


def sorted_names(rows: DataFrame, cols: list[str], count: int) -> DataFrame:
    """rows plus ``name``: equal values of cols get equal integers and others different ones, by sorting each bucket."""
    buckets = max(64, count // BUCKET_ROWS)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("_b").orderBy(*cols))
    return rows.withColumn("name", rank.cast("long") * F.lit(buckets) + F.col("_b")).drop("_b")


def block_names(parts: DataFrame) -> DataFrame:
    """(lid, name), written, of all blocks of parts (lid, block, bh)."""
    blocks = parts.where("block is not null").select("lid", "bh", "block")
    heavy = heavy_keys(blocks, ["bh"])
    if heavy is None:
        return table(sorted_names(blocks, ["block"], blocks.count()).select("lid", "name"), "names")
    # Of a heavy block, one row, rep, goes on to the naming: the least of each task, then of all. Whole blocks are compared.
    many = blocks.join(F.broadcast(heavy), "bh", "left_semi")
    reps = table(many.groupBy("bh", "block").agg(F.min("lid").alias("rep")), "reps")
    few = blocks.join(F.broadcast(heavy), "bh", "left_anti").select("lid", "block").unionByName(reps.select(F.col("rep").alias("lid"), "block"))
    few = table(sorted_names(few, ["block"], blocks.count()).select("lid", "name"), "names")
    named = table(reps.join(few.join(F.broadcast(reps.select(F.col("rep").alias("lid"))), "lid").withColumnRenamed("lid", "rep"), "rep").select("bh", "block", "name"), "repnames")
    light = few.join(F.broadcast(reps.select(F.col("rep").alias("lid"))), "lid", "left_anti")
    names = table(light.unionByName(many.join(F.broadcast(named), ["bh", "block"]).select("lid", "name")), "allnames")
    drop_tables(heavy, reps, few, named)
    return names


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs, written: _rid, doc_id, sha (SHA-256 of the text), level, ident. Equal (level, ident): equal texts."""
    numbered = with_row_id(stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))))
    parts = table(numbered.select("_rid", "doc_id", "text").mapInArrow(_splitter(block), _SPLIT).withColumn("bh", F.xxhash64("block")), "blocks")
    names = block_names(parts)
    current = table(merge_join(parts.select("_rid", "n", "pos", "lid"), names, "lid").drop("lid"), "level0")
    firsts = table(parts.where("pos = 0").select("_rid", "doc_id", "sha"), "firsts")
    longest = parts.agg(F.max("n")).first()[0] or 1
    drop_tables(names, parts)
    done, level = [], 0
    while True:
        done.append(table(current.where("n = 1").select("_rid", F.lit(level).alias("level"), F.col("name").alias("ident")), "named"))
        if longest <= 1:
            break
        pairs = (
            current.where("n > 1")
            .groupBy("_rid", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = table(pairs, "pairs")
        total = pairs.count()
        named = table(sorted_names(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")), ["a", "b"], total), "pairnames")
        heavy = named.where(F.col("c") > heavy_limit(total)).select("a", "b")
        last, current, longest, level = current, join_heavy(pairs, named.drop("c"), ["a", "b"], heavy).select("_rid", "n", "pos", "name"), -(-longest // 2), level + 1
        current = table(current, f"level{level}")
        drop_tables(last, pairs, named)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    ids = table(merge_join(firsts, found, "_rid"), "identities")
    drop_tables(current, firsts, *done)
    return ids


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row of docs: _rid, doc_id, keep_id, group_size, kept, text_sha256."""
    ids = identities(docs, id_col, text_col, block)
    groups = ids.groupBy("level", "ident").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid"))).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = table(groups, "groups")
    heavy = groups.where(F.col("group_size") > heavy_limit(ids.count())).select("level", "ident")
    return join_heavy(ids, groups, ["level", "ident"], heavy).select(
        "_rid", "doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts."""
    docs = stored(docs)
    return without_rows(docs, exact_duplicates(docs, id_col, text_col, block).where(~F.col("kept")))
