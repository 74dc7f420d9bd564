r"""Quality rules with risk-controlled thresholds.

Every whole text gives counts (one pass over Arrow batches, nothing but the counts leaves it). Fixed base rules fail a
document outright. Four graded rules (RULES) then reject what exceeds a cutoff, and the cutoffs come from labelled
holdouts: within each stratum (language) the labelled good documents that a cutoff would reject are counted, and a
cutoff is certified only if the exact binomial test refutes "it rejects more than alpha of the good documents", i.e.
the Clopper-Pearson upper bound lies at alpha or below. Cutoffs are tested from loose to strict and the walk ends at
the first that fails (fixed sequence, no correction needed along it); over strata and rules delta is divided by their
number (Bonferroni). So with confidence 1 - delta no stratum loses more than RULES * alpha of its good documents.
Where labels are too few to certify any cutoff, the rule rejects nothing there.

Scale: labels meet the counts, never the texts. Counts of a stratum are taken map-side and certified on the executors,
so there may be any number of strata.

Defined cases: null or empty text has zero counts and fails the base rules. Null strata are a stratum of their own.
Labels repeated for a document count once, as good only if all are; a label without a document, or null, counts nothing.
Repeated rows are judged one by one. Other columns of the input, whatever their names, are kept out. Empty tables give
no rows; without labels nothing but the base rules rejects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.llm._shared import BROADCAST_KEYS, drop_tables, free_name, merge_join, stored, table, with_row_id, without_rows

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Rules as (name, numerator, denominator), all larger for worse texts, and the cutoffs tried, loose to strict, in percent.
RULES = (
    ("symbols", "n_symbols", "n_words"),
    ("upper", "n_upper", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
)
CUTOFFS = tuple(range(95, 4, -5))
ALPHA, DELTA = 0.01, 0.05

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_NOT_SYMBOLS = bytes(i for i in range(256) if i not in SYMBOLS)
_NOT_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_counts(raw: bytes) -> tuple[int, ...]:
    """_COUNTS of one UTF-8 text. bytes.split() cuts at exactly the six white-space characters of the word rule."""
    words = raw.split()
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(distinct := set(windows)) < len(windows):
        once: set[tuple] = set()
        again = {w for w in windows if w in once or once.add(w)}
        end = 0
        for i, w in enumerate(windows):
            if w in again:
                repeated += i + 3 - max(i, end)
                end = i + 3
    del distinct
    return (
        len(words), len(joined.translate(None, _CONTINUATION)), len(raw.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)),
        repeated, len(lines), len(raw.translate(None, _NOT_UPPER)),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_counts(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(0)]
        columns = zip(*found) if found else [[]] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names[1:], *_COUNTS])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", row_col: str | None = None) -> DataFrame:
    """Per row: doc_id, stratum, (row_col,) the counts and base_failed."""
    extra = [row_col] if row_col else []
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), *extra)
    schema = ", ".join(["doc_id long", "stratum string", *(f"{c} long" for c in extra), *(f"{c} long" for c in _COUNTS)])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(_count, schema).withColumn("base_failed", failed)


def _exceeds(rule: tuple[str, str, str], cutoff: int | Column) -> Column:
    """In whole numbers: 100 * numerator > cutoff * denominator."""
    return 100 * F.col(rule[1]) > cutoff * F.col(rule[2])


def refuted(k: int, n: int, alpha: float, level: float) -> bool:
    """True if k rejections or fewer of n have probability <= level at a rejection rate of alpha: rate <= alpha is certified."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha)
    if k >= n * alpha:  # the median of the distribution lies near n * alpha: the probability is not small
        return False
    top, total = log(k), 0.0
    for i in range(k, -1, -1):
        term = math.exp(log(i) - top)
        total += term
        if term < 1e-17 * total:
            break
    return top + math.log(total) <= math.log(level)


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Per stratum with good documents, written: stratum and, for each rule, the strictest certified cutoff, null without one."""
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("g")).where("g = 1").select("doc_id")
    tried = [F.count_if(_exceeds(r, c)).alias(f"{r[0]}_{c}") for r in RULES for c in CUTOFFS]
    counts = table(measured.where("not base_failed").join(good, "doc_id", "left_semi").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *tried), "strata")
    level = delta / max(1, counts.count() * len(RULES))

    def certify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = {"stratum": rows["stratum"]}
            for rule in RULES:
                found = []
                for row in rows.to_dict("records"):
                    strictest = None
                    for cutoff in CUTOFFS:
                        if not refuted(row[f"{rule[0]}_{cutoff}"], row["n"], alpha, level):
                            break
                        strictest = cutoff
                    found.append(strictest)
                out[rule[0]] = pd.array(found, "Int64")
            yield pd.DataFrame(out)

    cutoffs = table(counts.mapInPandas(certify, "stratum string, " + ", ".join(f"{r[0]} long" for r in RULES)), "cutoffs")
    drop_tables(counts)
    return cutoffs


def with_verdict(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured plus kept: false for rows that failed the base rules or exceed a certified cutoff of their stratum. Cutoffs are
    broadcast up to BROADCAST_KEYS strata; beyond it the join shuffles and AQE splits a hot stratum."""
    names = [free_name(measured, f"_{rule[0]}") for rule in RULES]
    key, null = F.coalesce("stratum", F.lit("")), F.col("stratum").isNull()
    cutoffs = cutoffs.select(key.alias("_key"), null.alias("_null"), *(F.col(rule[0]).alias(name) for rule, name in zip(RULES, names)))
    rows = measured.withColumns({"_key": key, "_null": null})
    rows = rows.join(F.broadcast(cutoffs), ["_key", "_null"], "left") if cutoffs.count() <= BROADCAST_KEYS else merge_join(rows, cutoffs, ["_key", "_null"], "left")
    rejected = F.col("base_failed")
    for rule, name in zip(RULES, names):
        rejected = rejected | F.coalesce(_exceeds(rule, F.col(name)), F.lit(False))
    return rows.withColumn("kept", ~rejected).select(*measured.columns, "kept")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, row_col: str | None = None) -> DataFrame:
    """measures() plus kept."""
    measured = table(measures(docs, row_col=row_col), "measures")
    return with_verdict(measured, certified_cutoffs(measured, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rejected rows."""
    docs = stored(docs)
    judged = judge(with_row_id(docs.select("doc_id", "text", "lang")), labels, row_col="_rid")
    return without_rows(docs, judged.where(~F.col("kept")))
