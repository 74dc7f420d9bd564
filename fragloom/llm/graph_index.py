"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors are one class, with as many of its first rows as a result can take. Classes are dealt by hash to shards of about SHARD, and each
shard gets a graph: vectors are inserted in rounds that double, up to ROUND; a greedy search with a beam of BUILD_BEAM proposes
the nodes it opened as neighbours; robust pruning takes the nearest of them and drops those to which it is nearer, by the factor RELAX,
than the new node is, until DEGREE are left. Edges go back as well, and nodes with too many are pruned alike. A beam search of
BEAM then answers queries, all of a block in step; every shard is asked, and the best of all are merged. Searches start from ENTRIES nodes far
from each other, so a dense group of near copies has one of them at most and cannot fill the beam from the start.

Distances are Euclidean, in double precision; those returned are computed from differences of the original components. What is approximate is
the beam: recall against brute force is in the README and the tests.

Scale: vectors move once to be made distinct and once to their shards; the index is a written table, one row a shard. Queries go in blocks of
BLOCK, so a task holds one shard and one block; results are cut to k before and after they are moved.

Defined cases: vectors that are null or zero, or hold null or non-finite components, take no part. Vectors of unequal length are compared as if
the shorter ended in zeros. Repeated rows are rows of their own; a query never finds its own row. Ties go to the smaller vec_id, null
last. Fewer than k candidates: all of them. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm._shared import drop_tables, stored, table, with_row_id
from fragloom.llm.vectors import blocks_of, classes, matrix, null_ids, padded, ragged, whole

K = 10
SHARD, BLOCK, ROUND = 8192, 4096, 1024
DEGREE, BUILD_BEAM, BEAM, RELAX, ENTRIES = 32, 64, 192, 1.2, 32
#: Bytes that a step of a search or of pruning may take at once, about.
ROOM = 64 << 20

_INDEX = "shard long, entries array<long>, x array<double>, edges array<long>, id_ends array<long>, ids array<long>, rids array<long>"
_FOUND = "rid long, query_id long, id long, cand long, score double"


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, trail: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, squared distances) of the nodes that each query ends with, -1 where there are fewer, and, with trail, the nodes that
    each step opened, -1 for queries that had ended. All queries take a step at once: each opens the nearest node of its beam that is not open."""
    many, norms, entries = len(queries), (x * x).sum(axis=1), entries[:beam]
    own = (queries * queries).sum(axis=1)
    ids, d, opened = np.full((many, beam), -1, np.int64), np.full((many, beam), np.inf), np.ones((many, beam), bool)
    first = slice(0, len(entries))
    ids[:, first], d[:, first], opened[:, first] = entries, own[:, None] + norms[entries] - 2 * (queries @ x[entries].T), False
    seen = np.zeros((many, len(x)), bool)
    seen[:, entries] = True
    path = []
    while True:
        waiting = np.where(opened, np.inf, d)
        nearest = waiting.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(waiting[np.arange(many), nearest]))
        if not len(live):
            return ids, d, path
        at = nearest[live]
        node = ids[live, at]
        opened[live, at] = True
        if trail:
            step = np.full(many, -1, np.int64)
            step[live] = node
            path.append(step)
        near = edges[node]
        new = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(new, near, node[:, None])] = True
        dist = own[live, None] + norms[near] - 2 * np.einsum("qd,qrd->qr", queries[live], x[near])
        dist = np.where(new, dist, np.inf)
        all_d, all_ids, all_open = np.hstack((d[live], dist)), np.hstack((ids[live], np.where(new, near, -1))), np.hstack((opened[live], ~new))
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        d[live], ids[live], opened[live] = (np.take_along_axis(a, best, axis=1) for a in (all_d, all_ids, all_open))


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """(nodes, degree) neighbours, -1 where there are fewer: of candidates (nodes, any; -1: none), the nearest, less those that one already taken
    is nearer to, by relax, than the node is."""
    out = np.full((len(nodes), degree), -1, np.int64)
    if not candidates.shape[1]:
        return out
    room = max(1, ROOM // (8 * candidates.shape[1] * (candidates.shape[1] + 2 * x.shape[1])))
    for start in range(0, len(nodes), room):
        node, some = nodes[start : start + room], np.sort(candidates[start : start + room], axis=1)
        live = (some >= 0) & (some != node[:, None])
        live[:, 1:] &= some[:, 1:] != some[:, :-1]
        y = x[some]
        d = ((y - x[node][:, None]) ** 2).sum(axis=2)
        norms = (y * y).sum(axis=2)
        between = norms[:, :, None] + norms[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
        row = np.arange(len(node))
        for k in range(degree):
            pick = np.where(live, d, np.inf).argmin(axis=1)
            has = live[row, pick]
            if not has.any():
                break
            out[start + row[has], k] = some[row[has], pick[has]]
            live &= (relax * relax * between[row, pick] > d) | ~has[:, None]
            live[row, pick] = False
    return out


def _grouped(nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes and, a row each, their values, -1 where there are fewer."""
    order = np.argsort(nodes, kind="stable")
    some, first, counts = np.unique(nodes[order], return_index=True, return_counts=True)
    out = np.full((len(some), counts.max() if len(counts) else 0), -1, np.int64)
    out[np.repeat(np.arange(len(some)), counts), np.arange(len(order)) - np.repeat(first, counts)] = values[order]
    return some, out


def search_blocks(x: np.ndarray, beam: int) -> int:
    """Queries that may search at once."""
    return max(1, ROOM // (len(x) + 8 * (DEGREE + beam) * x.shape[1]))


def spread(x: np.ndarray, many: int) -> np.ndarray:
    """The vector nearest the mean, then, again and again, the one farthest from all that are taken."""
    out = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    d = ((x - x[out[0]]) ** 2).sum(axis=1)
    while len(out) < many and d.max() > 0:
        out.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[out[-1]]) ** 2).sum(axis=1))
    return np.array(out)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries): up to degree neighbours of each vector, -1 where there are fewer, and the nodes that searches start from."""
    entries = spread(x, ENTRIES)
    edges = np.full((len(x), degree), -1, np.int64)
    rest = np.setdiff1d(np.arange(len(x)), entries)
    start, size = 0, len(entries)
    while start < len(rest):
        nodes = rest[start : start + size]
        start, size = start + size, min(2 * size, ROUND)
        proposed, at_once = [], search_blocks(x, beam)
        for first in range(0, len(nodes), at_once):
            path = beam_search(x, edges, entries, x[nodes[first : first + at_once]], beam, trail=True)[2]
            proposed.append(np.array(path).T)
        width = max(p.shape[1] for p in proposed)
        proposed = np.vstack([np.pad(p, ((0, 0), (0, width - p.shape[1])), constant_values=-1) for p in proposed])
        edges[nodes] = robust_prune(x, nodes, proposed, degree, relax)
        back = edges[nodes]
        ends, new = _grouped(back[back >= 0], np.repeat(nodes, (back >= 0).sum(axis=1)))
        both = np.hstack((edges[ends], new))
        full = (both >= 0).sum(axis=1) > degree
        edges[ends[~full]] = -np.sort(-both[~full], axis=1)[:, :degree]
        edges[ends[full]] = robust_prune(x, ends[full], both[full], degree, relax)
    return edges, entries


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("hash")
    x = matrix(rows["x"], np.float64)
    edges, entries = build_graph(x)
    ids, ends = ragged(rows["ids"])
    columns = {"x": x, "edges": edges, "id_ends": ends[1:], "ids": ids, "rids": ragged(rows["rids"])[0]}
    kinds = {"x": pa.list_(pa.float64())}
    return pa.table({"shard": [key[0].as_py()], "entries": [entries]} | {c: pa.array([v.ravel()], kinds.get(c, pa.list_(pa.int64()))) for c, v in columns.items()})


def _answer(dim: int, k: int, beam: int):
    def search(shards: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        if shards.num_rows and queries.num_rows:
            asked, own = matrix(queries["x"], np.float64).reshape(-1, dim), queries["rid"].to_numpy()
            for n in range(shards.num_rows):
                entries, x, edges, ends, ids, rids = (shards[c][n].values.to_numpy(zero_copy_only=False) for c in ("entries", "x", "edges", "id_ends", "ids", "rids"))
                x, starts = x.reshape(-1, dim), np.concatenate(([0], ends))
                edges, at_once = edges.reshape(len(x), -1), search_blocks(x, beam)
                for first in range(0, len(asked), at_once):
                    some = slice(first, first + at_once)
                    found = beam_search(x, edges, entries, asked[some], beam)[0]
                    query, place = np.nonzero(found >= 0)
                    node = found[query, place]
                    score = np.sqrt(((x[node] - asked[some][query]) ** 2).sum(axis=1))
                    sizes = starts[node + 1] - starts[node]
                    query, score = np.repeat(query, sizes), np.repeat(score, sizes)
                    at = np.repeat(starts[node + 1] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
                    rid = own[some][query]
                    other = rids[at] != rid
                    query, score, at, rid = query[other], score[other], at[other], rid[other]
                    order = np.lexsort((rids[at], ids[at], score, query))
                    query, score, at, rid = query[order], score[order], at[order], rid[order]
                    rank = np.arange(len(query)) - np.searchsorted(query, query)
                    query, score, at, rid = (a[rank < k] for a in (query, score, at, rid))
                    names = queries["query_id"].combine_chunks().slice(first, at_once).take(pa.array(query))
                    parts.append(pa.table({"rid": rid, "query_id": names, "id": ids[at], "cand": rids[at], "score": score}))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], t) for c, t in (("rid", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("cand", pa.int64()), ("score", pa.float64()))})

    return search


class Index:
    """Written graphs of all vectors of rows that take part; results of up to k rows."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K):
        numbered = with_row_id(stored(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))))
        some = numbered.where(whole(F.col("x"))).where(F.exists("x", lambda c: c != 0))
        some, self.dim = padded(some.withColumn("x", F.transform("x", lambda c: c + F.lit(0.0))))  # -0.0 is 0.0
        self.rows, self.k = table(some, "vectors"), k
        found = table(classes(self.rows, [], k + 1), "classes")
        shards = max(1, -(-found.count() // SHARD))
        self.graphs = table(found.withColumn("shard", F.pmod("hash", F.lit(shards).cast("long"))).groupBy("shard").applyInArrow(_build, _INDEX), "graphs")
        self.shards = shards
        drop_tables(found)

    def search(self, queries: Column, beam: int = BEAM) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found of each of the index's rows that the condition on vec_id picks."""
        asked = table(self.rows.where(queries).select(F.col("_rid").alias("rid"), F.col("vec_id").alias("query_id"), "x"), "queries")
        blocks = blocks_of(asked, BLOCK)
        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        each = self.graphs.select("*", numbers(blocks).alias("block")).groupBy("shard", "block")
        asked = asked.select("*", F.pmod(F.xxhash64("rid"), F.lit(blocks).cast("long")).alias("block"), numbers(self.shards).alias("shard")).groupBy("shard", "block")
        found = table(each.cogroup(asked).applyInArrow(_answer(self.dim, self.k, max(beam, self.k + 1)), _FOUND), "found")
        rank = F.row_number().over(Window.partitionBy("rid").orderBy("score", "id", "cand"))
        return found.withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", "rank", null_ids("id").alias("vec_id"), "score")
