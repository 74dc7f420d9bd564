r"""Source divergence audit: how far the word use of each source is from that of every other source of its language, and which
terms set it apart from its language, by two-dimensional group-block tiling.

Terms are the runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps its V terms that at least MIN_DOCS of its
documents have. A group is a (lang, source) that occurs, with or without terms, or a whole language; with N occurrences of kept
terms, a term of count c has the smoothed share p = 1 + floor(1e9 * (c + 2) / (N + 2 * V)) in it. Two groups differ by
f = floor((p - q)^2 / (p + q)) in a term. All in whole numbers.

The kept terms of a language are dealt to vocabulary chunks of about CHUNK, its sources to blocks of about BLOCK, both by
hash, so none grows with the input. The counts of a block in a chunk are one packed vector. A tile is a pair of blocks; each vector is
replicated to the tiles of its block, and a task computes the submatrix of its tile over SPAN successive chunks, densely, one chunk at
a time. Sums of spans are added afterwards. f is symmetric: a tile below the diagonal is the one above it, turned.

Scale: texts are counted where they are read, in dictionaries of at most HELD terms, and never move; what is shuffled is one row per
task, group and term. No task holds more than 2 * SPAN vectors. Facts of languages and groups are broadcast only after they were
counted. The ten best terms of a group are taken in two steps, so no task gets all terms of one. The number of pairs, the
square of a language's sources, is the result itself.

Defined cases: null text, lang and source are ''. Rows are documents, so repeated rows count each. A language without kept terms
gives its pairs with value 0; a language of one source gives none. Very long texts are cut between terms into pieces of PIECE bytes
while they are counted. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm._shared import drop_tables, facts_join, merge_join, table

MIN_DOCS = 10
#: Ranks of the term part.
TOP_TERMS = 10
#: Parts of one, and what is added to each count.
SHARE, PRIOR = 1_000_000_000, 2
#: Terms of a vocabulary chunk and sources of a block, about; successive chunks of a task.
CHUNK, BLOCK, SPAN = 2048, 32, 16
#: Terms that a task holds before it hands them on.
HELD = 200_000
PIECE = 1 << 20

_COUNTS = "lang string, source string, term string, n long, docs long"
#: Bytes of terms, A-Z lower-cased; all others become spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw, cut between terms."""
    start = 0
    while len(raw) - start > PIECE:
        end = raw.rfind(b" ", start, start + PIECE) + 1 or raw.find(b" ", start) + 1 or len(raw)
        yield raw[start:end]
        start = end
    yield raw[start:]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to counts of terms and of documents that have them, added up over up to HELD terms. Each group gives a row
    without a term too."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1), [None, *(t.decode() for t in terms)], [0, *n.values()], [0, *(docs[t] for t in terms)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for piece in _pieces(text.as_buffer().to_pybytes().translate(_BYTES)):
                terms = piece.split()
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(n) - before
            if size >= HELD:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p, by long division in steps of a thousand: exact for totals up to 9e15."""
    whole = total + F.lit(PRIOR) * kept
    digits, rest = F.lit(0).cast("long"), count + F.lit(PRIOR)
    for step in (1, 1000, 1000, 1000):
        rest = rest * F.lit(step)
        digits, rest = digits * F.lit(step) + F.call_function("div", rest, whole), rest % whole
    return digits + 1


def _differs(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """p of counts (groups, terms), whole: N + 2 * V of each group."""
    whole = np.maximum(whole, 1)[:, None]
    digits, rest = np.zeros_like(counts), counts + PRIOR
    for step in (1, SHARE) if whole.max() < (1 << 62) // SHARE else (1, 1000, 1000, 1000):
        rest = rest * step
        digits = digits * step + rest // whole
        rest %= whole
    return digits + 1


def submatrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of f over the terms of a chunk, for each group of p against each of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    for i, one in enumerate(p):
        d = q - one
        out[i] = (d * d // (q + one)).sum(axis=1)
    return out


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """One tile over successive chunks: (lang, i, j, x, y, value), value summed over these chunks, for members x of block i and y of block j."""
    lang, i, j = (key[k].as_py() for k in range(3))
    rows = rows.sort_by([("chunk", "ascending"), ("block", "ascending")])
    chunk, block, size = (rows[c].to_pylist() for c in ("chunk", "block", "size"))
    vectors = {c: rows[c].combine_chunks() for c in ("whole", "idx", "pos", "n")}

    def dense(k: int) -> np.ndarray:
        whole, idx, pos, n = (vectors[c][k].values.to_numpy() for c in ("whole", "idx", "pos", "n"))
        counts = np.zeros((len(whole), size[k]), np.int64)
        counts[idx, pos] = n
        return shares(counts, whole)

    at = [k for k in range(rows.num_rows) if block[k] == i]
    other = {chunk[k]: k for k in range(rows.num_rows) if block[k] == j}
    total: np.ndarray | int = 0
    for k in at:
        p = dense(k)
        total = total + submatrix(p, p if i == j else dense(other[chunk[k]]))
    x, y = (a.ravel() for a in np.indices(total.shape))
    keep = x < y if i == j else x >= 0
    x, y, value = x[keep], y[keep], total.ravel()[keep]
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "i": np.full(len(x), i, np.int64), "j": np.full(len(x), j, np.int64), "x": x.astype(np.int64), "y": y.astype(np.int64), "value": value})


def _vocabulary(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, vocabulary, languages), written: the counts of kept terms with their chunk, place there and count in the language; the
    kept terms; kept terms, sources and sums of each language."""
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= MIN_DOCS).select("lang", "term", "in_lang")
    terms = table(terms, "terms")
    facts = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_n"))
    sources = counts.where("term is null").groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    zero = F.lit(0).cast("long")
    parts = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("long")
    languages = merge_join(sources, facts, "lang", "left").select("lang", "s", F.coalesce("v", zero).alias("v"), F.coalesce("lang_n", zero).alias("lang_n"))
    languages = table(languages.withColumns({"chunks": parts("v", CHUNK), "blocks": parts("s", BLOCK)}), "languages")
    placed = facts_join(terms, languages.select("lang", "chunks"), ["lang"]).withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    vocabulary = table(placed.select("lang", "term", "in_lang", "chunk", place.alias("pos")), "vocabulary")
    kept = table(merge_join(counts.where("term is not null").select("lang", "source", "term", "n"), vocabulary, ["lang", "term"]), "kept")
    drop_tables(terms)
    return kept, vocabulary, languages


def _groups(counts: DataFrame, kept: DataFrame, languages: DataFrame) -> DataFrame:
    """Written: each group's sum, its block and place there, and what is known of its language."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    rows = merge_join(counts.where("term is null").select("lang", "source"), sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    rows = facts_join(rows, languages, ["lang"]).withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    return table(rows.withColumn("idx", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1), "groups")


def _pairs(kept: DataFrame, vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, x, j, y, value), each pair of a language's sources once."""
    whole = (F.col("total") + F.lit(PRIOR) * F.col("v")).alias("whole")
    packed = lambda c: F.transform("packed", lambda x: x[c]).alias(c)
    blocks = groups.groupBy("lang", "block", "blocks", "chunks").agg(F.array_sort(F.collect_list(F.struct("idx", whole))).alias("packed"))
    grid = blocks.select("lang", "block", "blocks", packed("whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    held = facts_join(kept.select("lang", "source", "chunk", "pos", "n"), groups.select("lang", "source", "block", "idx"), ["lang", "source"])
    held = held.groupBy("lang", "block", "chunk").agg(F.collect_list(F.struct("idx", "pos", "n")).alias("packed"))
    held = held.select("lang", "block", "chunk", *map(packed, ("idx", "pos", "n")))
    sizes = vocabulary.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("size"))
    rows = merge_join(merge_join(grid, held, ["lang", "block", "chunk"], "left"), sizes, ["lang", "chunk"], "left")
    some = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    rows = rows.select("lang", "block", "blocks", "chunk", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "whole", some("idx", "int"), some("pos", "int"), some("n", "long"))
    vectors = table(rows, "vectors")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = vectors.select("lang", "block", "chunk", "size", "whole", "idx", "pos", "n", other)
    tiles = tiles.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.floor(F.col("chunk") / SPAN).alias("span"), *(c for c in tiles.columns if c != "other"))
    part = tiles.groupBy("lang", "i", "j", "span").applyInArrow(_tile, "lang string, i long, j long, x long, y long, value long")
    return table(part.groupBy("lang", "i", "x", "j", "y").agg(F.sum("value").alias("value")), "pairs")


def _pair_part(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select("lang", F.col("j").alias("i"), F.col("y").alias("x"), F.col("i").alias("j"), F.col("x").alias("y"), "value"))
    name = lambda block, idx, source: groups.select("lang", F.col("block").alias(block), F.col("idx").cast("long").alias(idx), F.col("source").alias(source))
    rows = facts_join(both, name("i", "x", "source"), ["lang", "i", "x"])
    return facts_join(rows, name("j", "y", "item"), ["lang", "j", "y"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def _term_part(kept: DataFrame, groups: DataFrame) -> DataFrame:
    rows = facts_join(kept.select("lang", "source", "term", "n", "in_lang"), groups.select("lang", "source", "total", "v", "lang_n"), ["lang", "source"])
    rows = rows.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("v")), "q": _share(F.col("in_lang"), F.col("lang_n"), F.col("v"))}).where("n > 0 and p > q")
    return rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differs(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: of each source all other sources of its language (part ``pair``), the farthest first, and the
    top_terms terms that it has more of than the language (part ``term``)."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    counts = table(rows.mapInArrow(count_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept, vocabulary, languages = _vocabulary(counts)
    groups = _groups(counts, kept, languages)
    pairs = _pairs(kept, vocabulary, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    terms = _term_part(kept, groups).select("*", rank).where(F.col("rank") <= top_terms)
    drop_tables(counts)
    return _pair_part(pairs, groups).select("*", rank).unionByName(terms)
