"""Hard-negative mining: for each anchor and each of its nearest rows of the same label, the best rows of other labels whose score lies just
below, by vantage-point trees over norm-augmented vectors (see vp_tree.py).

Components are scaled by SCALE and rounded down; a score is the inner product with the anchor, a whole number. Higher scores come first, ties
by the smaller vec_id. An anchor's positives are its first POSITIVES other rows of the same label. A negative of a positive has another label and
at least LEAST / 100 of the positive's score, and at most all of it: a ring of distances, from which the trees give the rows nearest first until
there are NEGATIVES.

Rows of equal vector and label are one class, with as many of its first rows as a result can take. A tree over at most SAMPLE classes, chosen by
hash, deals all classes to cells; a cell of more than SHARD classes is dealt to shards by hash, and each shard has a tree of its own. So no shard grows
with the input, whatever the vectors. An anchor asks the shards of the cell that is nearest first; what it finds there bounds the cells that it
has to ask afterwards. For negatives it asks those cells alone that the rings of its positives meet. Anchors go in blocks of BLOCK.
Results are exact: the sample decides where rows lie, never what is found. In many dimensions without clusters few cells can be left out, and then
every anchor is compared with every class, in matrix products.

Scale: classes move once to be found and once to their shards; trees are written. A task holds one shard and one block. What goes to all tasks
is the tree of cells: at most CELLS vectors.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part. Where vec_id is divisible by RELABEL the label
becomes (label + 1) % 10. Vectors of unequal length are compared as if the shorter ended in zeros. Repeated rows are rows of
their own; an anchor is never its own positive. Null vec_ids are no anchors and come last among ties. Components beyond what products in the
long type allow raise an error. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm import vp_tree
from fragloom.llm._shared import drop_tables, stored, table, with_row_id
from fragloom.llm.vectors import blocks_of, classes, matrix, null_ids, padded, ragged, whole

ANCHORS, RELABEL, SCALE = 100, 7, 256
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
SAMPLE, CELLS, SHARD, BLOCK = 4096, 64, 8192, 1024

_TREE = "cell long, sub long, labels array<long>, x array<long>, id_ends array<long>, ids array<long>, rids array<long>, vantage array<double>, lift array<double>, kids array<long>, bounds array<double>, starts array<long>"
_FOUND = "rid long, anchor_id long, positive int, id long, cand long, score long"


def prepared(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """_rid, vec_id, label, x (scaled, whole) of the rows that take part."""
    numbered = with_row_id(stored(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))))
    own = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    some = numbered.where(F.col("label").isNotNull() & whole(F.col("x")))
    return some.select("_rid", "vec_id", own.alias("label"), F.transform("x", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))


class Shard:
    """One written tree with its classes, as a task reads it."""

    def __init__(self, row: dict, dim: int, kind: type):
        part = lambda c, dtype=np.int64: row[c].values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
        self.x, self.labels = part("x", kind).reshape(-1, dim), part("labels")
        self.ends, self.ids, self.rids = part("id_ends"), part("ids"), part("rids")
        self.tree = vp_tree.Tree(part("vantage", np.float64).reshape(-1, dim), part("lift", np.float64), part("kids").reshape(-1, 2), part("bounds", np.float64).reshape(-1, 2, 2), np.arange(len(self.labels)), part("starts"))

    def best(self, query: vp_tree.Query, scores: dict[int, np.ndarray], a: np.ndarray, rid: int, label: int, same: bool, low: int | None, high: int | None, k: int) -> list[tuple[int, int, int]]:
        """(-score, id, rid) of the first k rows of the same or of other labels with a score of low to high. scores: of leaves, kept."""
        inner, outer = query.radius(high) if high is not None else 0.0, query.radius(low) if low is not None else np.inf
        found: list[tuple[int, int, int]] = []
        starts = self.tree.starts
        for bound, leaf in query.nearest_first(max(inner - query.slack, 0.0), outer + query.slack):
            if len(found) == k and bound > query.radius(-found[-1][0]) + query.slack:
                break
            p, q = starts[leaf], starts[leaf + 1]
            if leaf not in scores:
                scores[leaf] = (self.x[p:q] @ a).astype(np.int64)
            s = scores[leaf]
            fits = (self.labels[p:q] == label) == same
            if low is not None:
                fits &= (s >= low) & (s <= high)
            if len(found) == k:
                fits &= s >= -found[-1][0]
            at = np.flatnonzero(fits)
            if len(at) > k:  # of classes with a smaller score than the k-th none is among the first k
                at = at[s[at] >= np.partition(s[at], -k - 1)[-k - 1]]
            for i in at:
                first = self.ends[p + i - 1] if p + i else 0
                found += [(-int(s[i]), int(self.ids[j]), int(self.rids[j])) for j in range(first, self.ends[p + i]) if self.rids[j] != rid]
            found = sorted(found)[:k]
        return found


def _answers(dim: int, kind: type, m2: int, same: bool, k: int):
    """(trees of one shard, a block of anchors) to found rows: per anchor, or per window of it."""

    def search(shards: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if shards.num_rows and queries.num_rows:
            vectors, windows = matrix(queries["x"], kind), queries["scores"].to_pylist()
            for shard in (Shard({c: shards[c][i] for c in shards.column_names}, dim, kind) for i in range(shards.num_rows)):
                for rid, own, label, a, scores in zip(queries["rid"].to_pylist(), queries["anchor_id"].to_pylist(), queries["label"].to_pylist(), vectors, windows):
                    query, held = vp_tree.Query(shard.tree, a, m2), {}
                    for n, high in enumerate(scores):
                        low = None if same else -(-LEAST * high // 100)
                        if not same and low > high:
                            continue
                        for score, i, cand in shard.best(query, held, a, rid, label, same, low, None if same else high, k):
                            for column, value in zip(out, (rid, own, n, i, cand, -score)):
                                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["rid", "anchor_id", "positive", "id", "cand", "score"])

    return search


class Index:
    """Written trees of all classes of rows (_rid, vec_id, label, x), with the tree of cells."""

    def __init__(self, rows: DataFrame, most: int):
        rows, self.dim = padded(rows)
        self.rows = table(rows, "vectors")
        squares = F.aggregate("x", F.lit(0).cast("double"), lambda s, c: s + c.cast("double") * c.cast("double"))
        largest, m2 = self.rows.agg(F.max(F.array_max(F.transform("x", F.abs))), F.max(squares)).first()
        self.kind = vp_tree.exact_type(int(largest or 0), self.dim)
        self.m2 = int((m2 or 0) * (1 + 1e-12)) + 1  # a bound, however the sum was rounded
        found = table(classes(self.rows, ["label"], most), "classes")
        sample = found.orderBy("hash", "x", "label").limit(SAMPLE).select("x").collect()
        picked = np.array([r["x"] for r in sample], np.float64).reshape(-1, self.dim)
        self.cells = vp_tree.build(picked, self.m2, max(1, -(-len(picked) // CELLS)), open_ended=True)
        placed = table(found.mapInArrow(self._placer(), "hash long, label long, x array<long>, ids array<long>, rids array<long>, cell long"), "placed")
        self.shards = {r["cell"]: max(1, -(-r["n"] // SHARD)) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 * CELLS rows
        many = F.create_map(*(F.lit(v) for pair in self.shards.items() for v in pair)) if self.shards else F.create_map(F.lit(0), F.lit(1))
        sub = F.pmod(F.xxhash64("hash", "label"), many[F.col("cell")].cast("long"))
        self.trees = table(placed.withColumn("sub", sub).groupBy("cell", "sub").applyInArrow(self._builder(), _TREE), "trees")
        drop_tables(found, placed)

    def _placer(self):
        tree, m2 = self.cells, self.m2

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = vp_tree.place(tree, matrix(batch.column("x"), np.float64), m2)
                kept = ["hash", "label", "x", "ids", "rids"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cells, pa.int64())], names=[*kept, "cell"])

        return place

    def _builder(self):
        m2, dim = self.m2, self.dim

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("hash", "ascending"), ("label", "ascending")])
            tree = vp_tree.build(matrix(rows["x"], np.float64).reshape(-1, dim), m2)
            rows = rows.take(tree.order)
            ids, ends = ragged(rows["ids"])
            one = lambda values: [values.ravel()]
            columns = {"cell": [key[0].as_py()], "sub": [key[1].as_py()], "labels": one(rows["label"].to_numpy()), "x": one(matrix(rows["x"])), "id_ends": one(ends[1:]), "ids": one(ids), "rids": one(ragged(rows["rids"])[0])}
            columns |= {"vantage": one(tree.vantage), "lift": one(tree.lift), "kids": one(tree.kids), "bounds": one(tree.bounds), "starts": one(tree.starts)}
            kinds = {"cell": pa.int64(), "sub": pa.int64()} | dict.fromkeys(("vantage", "lift", "bounds"), pa.list_(pa.float64()))
            return pa.table({c: pa.array(v, kinds.get(c, pa.list_(pa.int64()))) for c, v in columns.items()})

        return build

    def _router(self, nearest: bool):
        """Queries to (cell, sub): with nearest, of the one cell that is nearest; else of all others that their ring meets."""
        cells, m2, shards, kind = self.cells, self.m2, self.shards, self.kind

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                take, to, subs, vectors = [], [], [], matrix(batch.column("x"), kind)
                for i, (a, inner, outer, done) in enumerate(zip(vectors, batch.column("high").to_pylist(), batch.column("low").to_pylist(), batch.column("done").to_pylist())):
                    query = vp_tree.Query(cells, a, m2)
                    ring = (max(query.radius(inner) - query.slack, 0.0) if inner is not None else 0.0, query.radius(outer) + query.slack if outer is not None else np.inf)
                    for _, cell in query.nearest_first(*ring):
                        if cell in shards and cell != done:
                            take += [i] * shards[cell]
                            to += [cell] * shards[cell]
                            subs += range(shards[cell])
                            if nearest:
                                break
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(take, pa.int64())).columns, pa.array(to, pa.int64()), pa.array(subs, pa.int64())], names=[*batch.schema.names, "cell", "sub"])

        return route

    def ask(self, queries: DataFrame, blocks: int, same: bool, k: int, nearest: bool = False) -> DataFrame:
        """queries (rid, anchor_id, label, x, scores, low, high, done) to _FOUND and the cell, written."""
        kept = "rid long, anchor_id long, label long, x array<long>, scores array<long>, low long, high long, done long, cell long, sub long"
        routed = queries.mapInArrow(self._router(nearest), kept).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks).cast("long")))
        if nearest:
            routed = table(routed, "routed")
        each = self.trees.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        by = ["cell", "sub", "block"]
        out = table(each.groupBy(*by).cogroup(routed.groupBy(*by)).applyInArrow(_answers(self.dim, self.kind, self.m2, same, k), _FOUND), "found")
        if not nearest:
            return out
        return out, table(routed.groupBy("rid").agg(F.min("cell").alias("done")), "asked")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "cand"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    index = Index(prepared(rows, id_col, vec_col, label_col), max(POSITIVES, NEGATIVES) + 1)
    none = F.lit(None).cast("long")
    anchors = table(index.rows.where(F.col("vec_id") % ANCHORS == 0).select(F.col("_rid").alias("rid"), F.col("vec_id").alias("anchor_id"), "label", "x"), "anchors")
    blocks = blocks_of(anchors, BLOCK)

    def queries(facts: DataFrame, scores, low, high, done) -> DataFrame:
        return facts.select("rid", "anchor_id", "label", "x", scores.alias("scores"), low.alias("low"), high.alias("high"), done.alias("done"))

    near, asked = index.ask(queries(anchors, F.array(F.lit(0).cast("long")), none, none, none), blocks, True, POSITIVES, nearest=True)
    # With all POSITIVES found, only rows of at least the last one's score can be among the first ones.
    last = _first(near, ["rid"], POSITIVES).groupBy("rid").agg(F.when(F.count(F.lit(1)) == POSITIVES, F.min("score")).alias("last"))
    again = anchors.join(last.hint("merge"), "rid", "left").join(asked.hint("merge"), "rid", "left")
    more = index.ask(queries(again, F.array(F.lit(0).cast("long")), F.col("last"), none, F.col("done")), blocks, True, POSITIVES)
    positives = table(_first(near.unionByName(more), ["rid"], POSITIVES).select("rid", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    drop_tables(near, more)

    rings = positives.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))  # POSITIVES at most
    rings = anchors.join(rings.hint("merge"), "rid").where(F.array_max("scores") >= 0)
    least = F.array_min(F.transform(F.filter("scores", lambda s: s >= 0), lambda s: F.ceil(s * LEAST / 100 - 1e-6)))
    found = index.ask(queries(rings, F.col("scores"), least - 1, F.array_max("scores"), none), blocks, False, NEGATIVES)
    first = _first(found, ["rid", "positive"], NEGATIVES)
    out = first.withColumn("nth", F.col("positive") + 1).join(positives.hint("merge"), ["rid", "nth"])
    return out.select("anchor_id", null_ids("positive_id").alias("positive_id"), "rank", null_ids("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
