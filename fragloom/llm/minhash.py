r"""MinHash near-dedup with tensored banding.

A document's set is its distinct shingles of five words (see shingles.py). Equal sets are one class first, so groups of
copies cost one row. Each class computes 2 * GROUPS * WIDTH minhashes: two small collections A and B of GROUPS values,
each made of WIDTH minhashes. A table key combines a value of A with a value of B, so GROUPS ** 2 tables of 2 * WIDTH
minhashes each come from about the square root of the minhashes they would need alone. A pair of similarity s meets in
some table with probability (1 - (1 - s ** WIDTH) ** GROUPS) ** 2: 0.9988 at 0.75, 0.99998 at 0.85 and above.
Rows meet on their A value first, and only those that meet anyone are combined with B.

Candidates are verified on full sets (intersection and union of all shingle hashes, whole numbers). No group is expanded
into all its pairs. First each member of a bucket is compared with one head, the member that meets most others anywhere,
which tends to be the text that near copies were made from. Only members that this leaves outside the head's component are
compared with all documents of other components that share a value of A with them, whatever their number. Pairs are verified
only if they agree in size (an exact bound) and in a sketch (a 4-bit fingerprint of the least hash in each of BINS ranges; at
the threshold or above, the number of differing ones has a known mean and variance, and SLACK standard deviations are
allowed: a link is lost with a probability of a few in a million). In a group of m texts that share a value of A and yet are
unlike, the sketches of all their pairs are compared, in a join that AQE splits, as no link may be lost; nothing is
written for a pair that fails.

Scale: texts are read three times and never shuffled unless more than BROADCAST_KEYS documents are candidates; what moves is
the minhashes that two or more share, the sketches of documents that meet any, and the sets of candidates. Joins shuffle
at every size; facts about heavy classes and components (see _shared) are broadcast. Every stage is a written table, deleted
when it has been used.

Defined cases: null or empty text, or white space alone: no shingles, linked with nothing. Fewer than five words: one
shingle. Repeated rows are equal sets; a component's id is its least doc_id, nulls aside, and kept compares null-safely, so
rows that share this id are kept alike; drop_near_duplicates() leaves one row.
Other columns of the input, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.llm._shared import BROADCAST_KEYS, drop_tables, heavy_limit, join_heavy, match, merge_join, stored, table, with_row_id, without_rows
from fragloom.llm.components import components
from fragloom.llm.shingles import SIZE, mix, shingle_sets

GROUPS, WIDTH = 9, 2
PERCENT = 75
BINS = 512
#: Standard deviations by which a pair at the threshold may differ in more sketch bins than expected.
SLACK = 4.5

_U = np.uint64
#: The words of a sketch: columns of their own, so that comparing two of them compiles to short code.
_Z = [f"z{k}" for k in range(BINS // 16)]
_SKETCH = "_rid long, doc_id long, n long, cls binary, a array<long>, b array<long>, " + ", ".join(f"{z} long" for z in _Z)


def _collections(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed (documents, 2 * GROUPS): the values of A, then those of B. All documents have shingles."""
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, 2 * GROUPS * WIDTH + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
        out = np.empty((len(offsets) - 1, 2 * GROUPS), _U)
        for g in range(2 * GROUPS):
            value = np.full(len(offsets) - 1, g + 1, _U)
            for k in range(WIDTH):
                least = np.minimum.reduceat(sets * seeds[g * WIDTH + k], offsets[:-1])
                value = mix(value * _U(0xE7037ED1A0B428DB) + least)
            out[:, g] = value
    return out.view(np.int64)


def _fingerprints(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed (documents, BINS / 16): of each of BINS ranges of hashes, 1 to 15 by the least hash of the document, 0 without;
    the first bits of all ranges in BINS / 64 words, then the second ones and so on."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = doc * BINS + (sets >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    marks = np.zeros((len(offsets) - 1, BINS), np.uint8)
    with np.errstate(over="ignore"):
        marks.ravel()[place[first]] = _U(1) + (mix(sets[first]) >> _U(32)) % _U(15)
    return np.concatenate([np.packbits(marks >> bit & 1, axis=1) for bit in range(4)], axis=1).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets, offsets in shingle_sets(batch.column(2)):
            counts = np.diff(offsets)
            some = np.flatnonzero(counts)
            starts = np.append(offsets[:-1][some], offsets[-1])
            z, keys = np.zeros((len(counts), BINS // 16), np.int64), np.zeros((len(counts), 2 * GROUPS), np.int64)
            if len(some):
                z[some], keys[some] = _fingerprints(sets, starts), _collections(sets, starts)
            cls = [hashlib.blake2b(sets[p:q].tobytes(), digest_size=16).digest() if q > p else None for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            lists = [pa.ListArray.from_arrays(np.arange(0, part.size + 1, GROUPS, dtype=np.int32), np.ascontiguousarray(part).ravel()) for part in (keys[:, :GROUPS], keys[:, GROUPS:])]
            rows = batch.slice(first, len(counts))
            words = [pa.array(np.ascontiguousarray(word)) for word in z.T]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(cls, pa.binary()), *lists, *words], names=["_rid", "doc_id", "n", "cls", "a", "b", *_Z])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets, offsets in shingle_sets(batch.column(0)):
            keys = batch.slice(first, len(offsets) - 1).columns[1:]
            yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(offsets.astype(np.int32), sets.view(np.int64))], names=["_rid", "as_u", "as_v", "s"])


def _most(percent: int) -> Column:
    """Ranges in which the sketch of a set of n may differ from that of a set of n that is alike by percent, apart from SLACK.
    It is concave in n: for two sizes the mean of both is less than one below what their mean allows, which the 1 covers."""
    union = F.col("n") * (200 / (100 + percent))
    q = 1 - percent / 100
    used = BINS * (1 - F.exp(-union / BINS))
    # The least hashes are a sample without replacement of the union; one in 15 that differ has the same mark; used is random.
    sampled = used * (q * (1 - q)) * F.greatest(union - used, F.lit(0.0)) / F.greatest(union - 1, F.lit(1.0))
    same = q * used * (14 / 225)
    spread = q * q * BINS * F.exp(-union / BINS) * (1 - (1 + union / BINS) * F.exp(-union / BINS))
    return F.floor(q * used * (14 / 15) + SLACK * F.sqrt(sampled + same + spread) + 1).cast("int")


def _alike(x: str, y: str, percent: int) -> Column:
    """Sizes and sketches that a pair at percent or above has. Short on purpose: the JVM compiles no method over 8000 bytes."""
    # A range differs if any of its four bits does.
    bit = lambda z: F.col(f"{x}{z}").bitwiseXOR(F.col(f"{y}{z}"))
    differ = F.lit(0)
    for k in range(BINS // 64):
        one, two, three, four = (bit(_Z[k + BINS // 64 * plane]) for plane in range(4))
        differ = differ + F.bit_count(one.bitwiseOR(two).bitwiseOR(three.bitwiseOR(four)))
    sizes = 100 * F.least(f"{x}n", f"{y}n") >= percent * F.greatest(f"{x}n", f"{y}n")
    return sizes & (2 * differ <= F.col(f"{x}most") + F.col(f"{y}most"))


def _verified(numbered: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v), written, whose full sets are similar enough. The texts are read once more for the documents in
    pairs; their sets move once as u, once with the pair and once as v."""
    sides = pairs.select(F.col("u").alias("_rid"), F.lit(True).alias("as_u"), F.lit(False).alias("as_v")).unionByName(pairs.select(F.col("v").alias("_rid"), F.lit(False).alias("as_u"), F.lit(True).alias("as_v")))
    ids = table(sides.groupBy("_rid").agg(F.max("as_u").alias("as_u"), F.max("as_v").alias("as_v")), "ids")
    texts = numbered.select("_rid", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "_rid")
    sets = table(texts.select("text", "_rid", "as_u", "as_v").mapInArrow(_sets, "_rid long, as_u boolean, as_v boolean, s array<long>"), "sets")
    both = merge_join(pairs, sets.where("as_u").select(F.col("_rid").alias("u"), F.col("s").alias("su")), "u")
    both = merge_join(both, sets.where("as_v").select(F.col("_rid").alias("v"), F.col("s").alias("sv")), "v")
    both = both.withColumn("c", F.size(F.array_intersect("su", "sv")))
    found = table(both.where(100 * F.col("c") >= percent * (F.size("su") + F.size("sv") - F.col("c"))).select("u", "v"), "verified")
    drop_tables(ids, sets)
    return found


def links(numbered: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links (u, v) between class representatives, enough to connect all that verified links connect."""
    by_a = classes.select("_rid", F.explode("a").alias("ka"))
    met = table(by_a.groupBy("ka").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "met")
    meets = table(merge_join(by_a, met, "ka").select("_rid", "ka", "c"), "meets")
    per_row = meets.groupBy("_rid").agg(F.collect_list("ka").alias("a"), F.sum(F.floor(1000 * F.log2("c"))).alias("d"))  # GROUPS values at most
    rows = merge_join(classes.select("_rid", "b"), per_row, "_rid").select("_rid", "b", "d", F.explode("a").alias("ka"))
    rows = table(rows.select("_rid", "d", "ka", F.explode("b").alias("kb")).select("_rid", "d", F.xxhash64("ka", "kb").alias("key")), "keys")
    # Most meetings first, then the least number.
    best = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("d", (-F.col("_rid")).alias("r"))).alias("h")).where("c > 1")
    heads = table(best.select("key", (-F.col("h.r")).alias("head")), "heads")
    headed = table(merge_join(rows, heads, "key").select("_rid", "head").distinct(), "headed")
    drop_tables(met, rows, heads)
    sketches = match(classes.select("_rid", "n", _most(percent).alias("most"), "a", *_Z), table(headed.select("_rid").distinct(), "ids"), "_rid", "left_semi")
    sketches = table(sketches, "sketches")

    side = lambda x: sketches.select(F.col("_rid").alias(x), *(F.col(c).alias(f"{x}{c}") for c in ("n", "most", *_Z)))
    alike = lambda pairs: merge_join(merge_join(pairs, side("u"), "u"), side("v"), "v").where(_alike("u", "v", percent))
    pairs = table(alike(headed.where("_rid <> head").select(F.col("_rid").alias("u"), F.col("head").alias("v"))).select("u", "v"), "pairs")
    stars = _verified(numbered, pairs, percent)
    drop_tables(pairs)

    # Whoever is outside a head's component meets all that are not in the own one.
    root = components(stars)
    places = _places(headed, meets, root)
    some = table(merge_join(places, sketches, "_rid"), "open")
    opened = some
    left = some.where("out").select("ka", *(F.col(c).alias(f"l{c}") for c in ("_rid", "root", "n", "most", "a", *_Z)))
    once = F.array_min(F.array_intersect("la", "a")) == F.col("ka")  # at one of the values that both have
    meet = (F.col("lroot") != F.col("root")) & (~F.col("out") | (F.col("l_rid") < F.col("_rid"))) & _alike("l", "", percent) & once
    some = some.withColumnRenamed("ka", "rka")
    pairs = left.hint("merge").join(some.hint("merge"), (F.col("ka") == F.col("rka")) & meet).select(F.col("l_rid").alias("u"), F.col("_rid").alias("v"))
    pairs = table(pairs, "pairs")
    drop_tables(meets, headed, sketches, root, places, opened)
    found = _verified(numbered, pairs, percent)
    drop_tables(pairs)
    return stars.unionByName(found)


def _places(headed: DataFrame, meets: DataFrame, root: DataFrame) -> DataFrame:
    """(ka, _rid, root, out), written: the documents of heads that someone is outside of, with all values of A that others
    have too, their root, and whether they are outside a head's component themselves."""
    rows = merge_join(headed, root.withColumnRenamed("node", "_rid"), "_rid", "left").select("_rid", "head", F.coalesce("root", "_rid").alias("root"))
    rows = merge_join(rows, root.select(F.col("node").alias("head"), F.col("root").alias("hroot")), "head", "left").withColumn("out", F.col("root") != F.coalesce("hroot", "head"))
    rows = table(rows, "rooted")
    heads = table(rows.where("out").select("head").distinct(), "openheads")
    some = table(merge_join(rows, heads, "head", "left_semi").groupBy("_rid", "root").agg(F.max("out").alias("out")), "some")
    places = table(merge_join(some, meets.select("_rid", "ka"), "_rid").select("ka", "_rid", "root", "out"), "places")
    drop_tables(rows, heads, some)
    return places


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of docs: _rid, doc_id, n_shingles, component_id, kept, and stays: exactly one row of a component does, of those with the least doc_id
    (null above all) the first."""
    numbered = with_row_id(stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    sketch = table(numbered.select("_rid", "doc_id", "text").mapInArrow(_sketch, _SKETCH), "sketch")
    first = table(sketch.where("n > 0").groupBy("cls").agg(F.min("_rid").alias("head"), F.count(F.lit(1)).alias("size")), "first")
    rows = table(sketch.select("_rid", "doc_id", "n", "cls"), "rows")
    classes = table(match(sketch.drop("doc_id", "cls"), first.select(F.col("head").alias("_rid")), "_rid", "left_semi"), "classes")
    drop_tables(sketch)
    pairs = links(numbered, classes, percent)
    root = components(pairs)
    drop_tables(classes)

    total = rows.count()
    grouped = lambda facts, key: table(facts.where(F.col("size") > heavy_limit(total)).select(key), "heavy")
    roots = merge_join(first, root.withColumnRenamed("node", "head"), "head", "left").select("cls", "size", F.coalesce("root", "head").alias("root"))
    roots = table(roots, "roots")
    members = join_heavy(rows.where("n > 0"), roots.drop("size"), ["cls"], grouped(roots, "cls")).select("_rid", "doc_id", "n", "root")
    members = table(members.unionByName(rows.where("n = 0").select("_rid", "doc_id", "n", F.col("_rid").alias("root"))), "members")
    drop_tables(rows, first, root, roots)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("first")
    ids = members.groupBy("root").agg(first, F.count(F.lit(1)).alias("size")).select("root", F.col("first.doc_id").alias("component_id"), F.col("first._rid").alias("stays"), "size")
    ids = table(ids, "ids")
    named = join_heavy(members, ids.drop("size"), ["root"], grouped(ids, "root"))
    return named.select("_rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("_rid") == F.col("stays")).alias("stays"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component, whatever the ids of its rows are."""
    docs = stored(docs)
    return without_rows(docs, near_duplicates(docs, id_col, text_col, percent).where(~F.col("stays")))


__all__ = ["SIZE", "drop_near_duplicates", "links", "near_duplicates"]
