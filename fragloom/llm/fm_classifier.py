r"""Quality classifier: a factorisation machine.

A document's features are its words, hashed into WORDS buckets (square roots of their shares of the document, so the
part has length one), its structure statistics and its number of characters, each in a one-hot bin. A score is the
logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs are never formed, as their sum is half of
(sum v_i x_i)^2 - sum v_i^2 x_i^2, so scoring is linear in the features that a document has.

Training: a sample of at most TRAIN_ROWS labelled documents outside the held-out fold, those of the least hashes, is
turned into features on the executors, and the machine is fitted on the driver by AdaGrad, in the order of doc_id, so the
fit does not depend on the files' layout. The model has (WORDS + bins) * (FACTORS + 1) numbers and goes to the executors
with the task.

Scale: texts are read once to train (sampled rows only) and once to score; no shuffle but the join of the labels' ids.

Defined cases: null or empty text has no words and the bins of zero; it is scored like any other. Labels repeated for a
document count once, as low if any is; labels without a document, or null, count nothing. Without labels, or with one
class only, all scores are the smoothed share of high labels. A null doc_id is not held out. Repeated rows score alike.
Other columns of the input, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.llm._shared import table
from fragloom.llm.shingles import documents_words

WORDS = 4096
FACTORS = 8
TRAIN_ROWS = 6000
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.1, 1e-4
SEED = 11

#: Structure statistics and the upper ends of their bins. Characters are bytes, shares are of bytes or as named.
STATS: dict[str, tuple[float, ...]] = {
    "symbols per word": (0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    "upper share": (0, 0.01, 0.03, 0.06, 0.12, 0.3, 0.6),
    "bars per word": (0, 0.05, 0.2, 0.5),
    "exclamations per word": (0, 0.02, 0.1, 0.5),
    "digit share": (0, 0.01, 0.03, 0.1),
    "non-ascii share": (0, 0.02, 0.05, 0.1),
    "stops per word": (0, 0.02, 0.05, 0.1, 0.2),
    "mean word bytes": (0, 3, 4, 5, 6, 7, 9, 12),
    "distinct words share": (0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeated lines share": (0, 0.05, 0.15, 0.3, 0.5),
    "log2 words": (0, 2, 4, 5, 6, 7, 8, 9, 10, 12),
    "log2 characters": (0, 3, 5, 6, 7, 8, 9, 10, 11, 12, 14),
}
_BINS = np.cumsum([WORDS, *(len(b) + 1 for b in STATS.values())])
SIZE = int(_BINS[-1])
_EDGES = [np.array(b, float) for b in STATS.values()]
_SETS = {k: bytes(i for i in range(256) if i not in v) for k, v in {"symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "bars": b"|", "marks": b"!", "digits": b"0123456789", "high": bytes(range(128, 256)), "stops": b".?"}.items()}


def _stats(raw: bytes, words: int, word_bytes: int, distinct: int, chars: float) -> list[float]:
    n = {k: len(raw.translate(None, other)) for k, other in _SETS.items()}
    lines = [x for x in raw.split(b"\n") if x]
    size, some = max(1, len(raw)), max(1, words)
    return [
        n["symbols"] / some, n["upper"] / size, n["bars"] / some, n["marks"] / some, n["digits"] / size, n["high"] / size, n["stops"] / some,
        word_bytes / some, distinct / some, (len(lines) - len(set(lines))) / max(1, len(lines)), np.log2(words + 1), np.log2(chars + 1),
    ]


def features(texts: pa.Array, chars: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, feature numbers, values, offsets of documents) of runs of documents."""
    for first, words, bounds in documents_words(texts):
        count = len(bounds) - 1
        doc = np.repeat(np.arange(count), np.diff(bounds))
        keys, counts = np.unique(doc * WORDS + (words >> np.uint64(40)).astype(np.int64) % WORDS, return_counts=True)
        owner = keys // WORDS
        totals = np.diff(bounds)
        values = np.sqrt(counts / totals[owner])
        stats = np.empty((count, len(STATS)))
        distinct = np.bincount(owner, minlength=count)
        for i in range(count):
            text = texts[first + i]
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            stats[i] = _stats(raw, int(totals[i]), len(b"".join(raw.split())), int(distinct[i]), chars[first + i])
        bins = np.stack([_BINS[k] + np.searchsorted(_EDGES[k], stats[:, k]) for k in range(len(STATS))], axis=1)
        numbers = np.concatenate([keys % WORDS, bins.ravel()])
        owner = np.concatenate([owner, np.repeat(np.arange(count), len(STATS))])
        order = np.argsort(owner, kind="stable")
        yield first, numbers[order], np.concatenate([values, np.ones(bins.size)])[order], np.append(0, np.cumsum(distinct + len(STATS)))


class Machine:
    """w0, w (SIZE) and v (SIZE, FACTORS)."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, numbers: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of documents that all have features; linear in these."""
        terms = self.v[numbers] * values[:, None]
        at = offsets[:-1]
        sums, squares = np.add.reduceat(terms, at), np.add.reduceat(terms * terms, at)
        z = self.w0 + np.add.reduceat(self.w[numbers] * values, at) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """From (feature numbers, values, label) of the sampled documents."""
    y = np.array([r[2] for r in rows], np.float32)
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    rng = np.random.default_rng(SEED)
    w, v, w0 = np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32), np.log(rate / (1 - rate))
    if not 0 < y.sum() < len(y):
        return Machine(w0, w, np.zeros_like(v))
    x = np.zeros((len(rows), SIZE), np.float32)
    for i, (numbers, values, _) in enumerate(rows):
        x[i, numbers] = values
    gw, gv, g0 = np.full(SIZE, 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = order[at : at + BATCH]
            xb, x2 = x[part], x[part] ** 2
            s = xb @ v
            z = w0 + xb @ w + 0.5 * (s * s - x2 @ (v * v)).sum(axis=1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)).astype(np.float32)
            dw, dv, d0 = xb.T @ g + DECAY * w, xb.T @ (g[:, None] * s) - v * (x2.T @ g)[:, None] + DECAY * v, float(g.sum())
            gw, gv, g0 = gw + dw * dw, gv + dv * dv, g0 + d0 * d0
            w, v, w0 = w - RATE * dw / np.sqrt(gw), v - RATE * dv / np.sqrt(gv), w0 - RATE * d0 / np.sqrt(g0)
    return Machine(float(w0), w, v)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, numbers, values, offsets in features(batch.column(3), batch.column(4).to_pylist()):
            at = offsets.astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, numbers.astype(np.int32)), pa.ListArray.from_arrays(at, values.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*batch.slice(first, len(at) - 1).columns[:3], *lists], names=["doc_id", "mark", "label", "numbers", "vals"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """docs: doc_id, text, chars. Only labels outside the held-out fold are read; of a doc_id's rows, the one with the least hash
    of its text is taken."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = table(known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels")
    found = docs.join(F.broadcast(sample), "doc_id").select("doc_id", F.xxhash64("text").alias("mark"), "label", "text", "chars")
    found = found.mapInArrow(_featured, "doc_id long, mark long, label int, numbers array<int>, vals array<float>")
    # The order of the rows, which the fit depends on, is that of their numbers, however the files are split.
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("label", "numbers", "vals"), "mark").alias("x")).select("doc_id", "x.*")
    return fit([(np.array(r["numbers"]), np.array(r["vals"]), r["label"]) for r in sorted(one.collect(), key=lambda r: r["doc_id"])])  # at most `rows`


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("chars"))
    machine = train(docs, labels, "doc_id" if id_col == "doc_id" else id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, numbers, values, offsets in features(batch.column(1), batch.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), pa.array(machine.score(numbers, values, offsets).astype(float))], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
