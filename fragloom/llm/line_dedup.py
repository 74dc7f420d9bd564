r"""Line dedup with range-partitioned hashes, built of DataFrame functions alone.

A line's key is the line without [\x20\x09-\x0D] at both ends and with A-Z in lower case. Keys of min_chars code points
or more are hashed to 128 bits and written as rows (hash, document, position). These are range-partitioned by hash and
slice and sorted by document and position within it; the slice is 0, but of a heavy key (see heavy_keys() in _shared) it is
the document, so that such a key spreads over neighbouring partitions. A window streams over each partition as it is: it marks
the first occurrence of a key in each document and carries the number of documents and the largest one along the run. Runs
of heavy keys, which cross partitions, are merged from their first occurrences, one row a key and task; these
facts, fewer than HEAVY, are broadcast. What is returned per document is a compressed bitmap (64 lines a word, only words
in which a line is dropped, in order), not text.

Scale: rows of some 20 bytes a line are written and shuffled once, texts never: bitmaps are broadcast up to BITMAP_BYTES, and
only beyond that the texts are shuffled to them, once.

Defined cases: null or empty text is one empty line. Rows with the same doc_id are one document in the count; each keeps
its lines as a row of that doc_id does. A null doc_id is one document, below every other. Equal keys within the largest
doc_id all stay. Other columns of the input, whatever their names, are ignored. An empty table gives no rows.
Two different keys would have to agree on two 64-bit hashes to be confused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm._shared import SPACES, ascii_lower, drop_tables, heavy_keys, merge_join, table

MIN_CHARS, MIN_DOCS = 20, 3
#: Measured size up to which bitmaps are broadcast: 24 bytes a document and 16 a word.
BITMAP_BYTES = 64 << 20
#: Stands for a null doc_id.
_NONE = -(2**63)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc, dkey, pos) of each line whose key is long enough. dkey: hash of the text, tells rows of one doc_id apart."""
    lines = docs.select("doc", F.xxhash64("text").alias("dkey"), F.posexplode(_lines(ascii_lower(F.col("text")))).alias("pos", "line"))
    key = F.trim(F.col("line"), F.lit(SPACES))
    return lines.select("doc", "dkey", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "dkey", "pos")


def runs(rows: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """rows, range-partitioned and sorted, with what a stream over the run of a key sees: first (in its document), n (documents)
    and last (largest document) of the run, which is the whole key unless heavy."""
    run = ["h1", "h2"]
    if heavy is None:
        rows = rows.withColumn("heavy", F.lit(False))
    else:
        rows = rows.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), run, "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
        rows = rows.withColumn("slice", F.when(F.col("heavy"), F.col("doc")).otherwise(F.lit(0).cast("long")))
        run = [*run, "slice"]
    rows = rows.repartitionByRange(*run).sortWithinPartitions(*run, "doc", "pos")
    before = F.lag("doc").over(Window.partitionBy(*run).orderBy("doc", "pos"))
    rows = rows.withColumn("first", before.isNull() | (before != F.col("doc")))
    whole = Window.partitionBy(*run)
    return rows.withColumns({"n": F.count_if("first").over(whole), "last": F.max("doc").over(whole)})


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, dkey, pos), written, of the lines that go."""
    rows = table(line_rows(docs, min_chars), "lines")
    heavy = heavy_keys(rows, ["h1", "h2"])
    seen = runs(rows, heavy).where(f"heavy or (n >= {min_docs} and doc < last)")
    seen = table(seen.select("h1", "h2", "heavy", "first", "doc", "dkey", "pos"), "seen")
    drop_tables(rows)
    if heavy is None:
        return seen.select("doc", "dkey", "pos")
    merged = seen.where("heavy and first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
    gone = seen.join(F.broadcast(merged), ["h1", "h2"], "left").where(f"not heavy or (n >= {min_docs} and doc < last)")
    gone = table(gone.select("doc", "dkey", "pos"), "gone")
    drop_tables(seen, heavy)
    return gone


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, dkey, dropped: array of (word, bits) by word, bit p % 64 of word p / 64 set if line p goes, words without a bit left
    out. Written; documents that keep all their lines have no row."""
    gone = dropped_lines(docs, min_chars, min_docs)
    words = gone.groupBy("doc", "dkey", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    bitmaps = table(words.groupBy("doc", "dkey").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped")), "bitmaps")
    drop_tables(gone)
    return bitmaps


def _unpacked(dropped: Column) -> Column:
    """The words of a bitmap in place, zeros between them: linear in the last word's number."""
    before = F.concat(F.array(F.lit(-1)), F.transform(dropped, lambda w: w["word"]))
    gaps = F.zip_with(F.slice(before, 1, F.size(dropped)), dropped, lambda b, w: F.concat(F.array_repeat(F.lit(0).cast("long"), w["word"] - b - 1), F.array(w["bits"])))
    return F.flatten(gaps)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc, lines (all), kept (the lines that stay)."""
    size = bitmaps.agg(F.sum(24 + 16 * F.size("dropped"))).first()[0] or 0
    out = docs.withColumn("dkey", F.xxhash64("text"))
    out = out.join(F.broadcast(bitmaps), ["doc", "dkey"], "left") if size <= BITMAP_BYTES else merge_join(out, bitmaps, ["doc", "dkey"], "left")
    gone = lambda p: F.call_function("shiftrightunsigned", F.coalesce(F.get("words", F.shiftright(p, 6)), F.lit(0).cast("long")), p % 64) % 2 != 0
    lines = out.select("doc", "text", F.when(F.col("dropped").isNotNull(), _unpacked(F.col("dropped"))).alias("words"), _lines(F.col("text")).alias("lines"))
    return lines.select("doc", "text", "lines", F.when(F.col("words").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, p: ~gone(p))).alias("kept"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_text."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    return done.select(
        F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text")
    )
