"""The operators on vectors against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.llm import graph_index as gi
from fragloom.llm import hard_negatives as hn
from fragloom.llm import queries, vp_tree

SCHEMA = "vec_id long, embedding array<float>, label int, score string, _rid string"


def brute_negatives(rows):
    """Of (vec_id, vector, label)."""
    some = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        if i is not None and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        some.append((n, i, label, [math.floor(256 * float(np.float32(c))) for c in v]))
    dim = max((len(r[3]) for r in some), default=0)
    x = np.array([r[3] + [0] * (dim - len(r[3])) for r in some], dtype=np.int64).reshape(len(some), dim)
    last = lambda i: math.inf if i is None else i
    out = []
    for a, (n, i, label, _) in enumerate(some):
        if i is None or i % 100:
            continue
        s = (x @ x[a]).tolist()
        order = sorted((k for k in range(len(some)) if k != a), key=lambda k: (-s[k], last(some[k][1]), some[k][0]))
        for p in [k for k in order if some[k][2] == label][:5]:
            fits = [k for k in order if some[k][2] != label and 80 * s[p] <= 100 * s[k] <= 100 * s[p]]
            out += [(i, some[p][1], rank, some[k][1], s[p], s[k]) for rank, k in enumerate(fits[:5], 1)]
    return out


def mined(rows):
    found = hn.mine(rows).collect()
    return sorted((tuple(r) for r in found), key=str)


def made(rng, n, dim=8, groups=6, spread=0.4):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    out = []
    for i in range(n):
        k = rng.randrange(groups)
        v = [float(np.float32(c + rng.gauss(0, spread))) for c in centres[k]]
        out.append((i, v, k if rng.random() < 0.8 else rng.randrange(groups)))
    return out


@pytest.fixture
def small_shards(monkeypatch):
    for name, value in (("SAMPLE", 64), ("CELLS", 4), ("SHARD", 40), ("BLOCK", 3)):
        monkeypatch.setattr(hn, name, value)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_negatives_against_brute_force(spark, small_shards):
    rng = random.Random(5)
    rows = made(rng, 700)
    rows += [(700 + i, rows[3][1], rng.randrange(3)) for i in range(250)]  # a third are copies of one vector
    rows += [(1000, None, 1), (1100, [1.0, None] + [0.0] * 6, 1), (1200, [math.nan] * 8, 1), (1300, [math.inf] * 8, 2), (1400, [0.5] * 8, None), (None, [0.5] * 8, 1), (1500, [], 1), (1600, [1.0, 2.0], 3), (1700, [0.0] * 8, 2)]
    rows += [rows[100], rows[100]]
    expected = brute_negatives(rows)
    assert len(expected) > 100 and mined(frame(spark, rows)) == sorted(expected, key=str)


def test_negatives_of_large_components(spark, small_shards):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(c * 40_000)) for c in v], label) for i, v, label in made(rng, 300)]
    assert vp_tree.exact_type(256 * 40_000 * 4, 8) is np.int64
    assert mined(frame(spark, rows)) == sorted(brute_negatives(rows), key=str)


def test_negatives_of_few_rows(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(100, [1.0, 0.0], 1)])) == []
    rows = [(100, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.45, 0.0], 2), (3, [0.45, 0.0], 3), (4, [0.5, 9.0], 4)]
    assert mined(frame(spark, rows)) == sorted(brute_negatives(rows), key=str) != []


def test_trees_bound_what_they_hold():
    rng = np.random.default_rng(7)
    x = rng.integers(-200, 200, (3000, 6))
    m2 = int((x * x).sum(axis=1).max())
    tree = vp_tree.build(x, m2, 20)
    assert sorted(tree.order.tolist()) == list(range(3000)) and np.diff(tree.starts).max() <= 20
    opened = 0
    for a in x[:20]:
        query, s = vp_tree.Query(tree, a, m2), x @ a
        d = np.sqrt(query.c - 2 * s)
        inner, outer = np.quantile(d, [0.02, 0.05])
        met = list(query.nearest_first(inner, outer))
        assert [b for b, _ in met] == sorted(b for b, _ in met)
        held = {i for _, leaf in met for i in tree.order[tree.starts[leaf] : tree.starts[leaf + 1]].tolist()}
        assert held >= set(np.flatnonzero((d >= inner) & (d <= outer)).tolist())
        for bound, leaf in met:
            assert np.maximum(d[tree.order[tree.starts[leaf] : tree.starts[leaf + 1]]], inner).min() >= bound
        opened += len(met)
    assert opened < 20 * (len(tree.starts) - 1)  # some leaves are left out


def test_cells_take_vectors_that_the_sample_lacks():
    rng = np.random.default_rng(8)
    x = rng.integers(-50, 50, (2000, 3))
    m2 = int((x * x).sum(axis=1).max())
    tree = vp_tree.build(x[:200], m2, 10, open_ended=True)
    cells = vp_tree.place(tree, x, m2)
    for a in x[:10]:
        query = vp_tree.Query(tree, a, m2)
        d = np.sqrt(np.maximum(query.c - 2 * (x @ a), 0))
        for bound, cell in query.nearest_first(0.0, np.inf):
            assert (d[cells == cell] >= bound).all()


def brute_nearest(rows, k=10, every=100):
    some = []
    for n, (i, v, _) in enumerate(rows):
        if v is None or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        some.append((n, i, [float(np.float32(c)) for c in v]))
    dim = max((len(r[2]) for r in some), default=0)
    x = np.array([r[2] + [0.0] * (dim - len(r[2])) for r in some]).reshape(len(some), dim)
    out = {}
    for a, (n, i, _) in enumerate(some):
        if i is not None and i % every == 0:
            d = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
            order = sorted((b for b in range(len(some)) if b != a), key=lambda b: (d[b], math.inf if some[b][1] is None else some[b][1]))[:k]
            out.setdefault(i, []).append([(some[b][1], d[b]) for b in order])
    return out


def nearest(rows):
    out = {}
    for r in gi.Index(rows).search(F.col("vec_id") % 100 == 0).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(v) for i, v in out.items()}


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(gi, "SHARD", 300)
    monkeypatch.setattr(gi, "BLOCK", 4)
    rng = random.Random(9)
    rows = made(rng, 1200, dim=12)
    rows += [(1200 + i, rows[3][1], 1) for i in range(500)]  # copies of one vector, queries among them
    rows += [(3000, None, 1), (3100, [1.0, None] + [0.0] * 10, 1), (3200, [math.nan] * 12, 1), (3300, [0.0] * 12, 2), (3400, [-0.0] * 12, 2), (None, [0.5] * 12, 1), (3500, [], 1), (3600, [1.0, 2.0], None)]
    expected, found = brute_nearest(rows), nearest(frame(spark, rows))
    assert set(found) == set(expected) and len(found) == 18
    hits = [x[1] in [i for i, _ in expected[q][0]] for q in found for x in found[q]]
    assert sum(hits) / len(hits) >= 0.98
    for q, got in found.items():
        assert [r for r, _, _ in got] == list(range(1, 11)) and [s for _, _, s in got] == sorted(s for _, _, s in got)
        if expected[q][0][-1][1] == 0:  # a copy: the least ids of its group
            assert [(i, s) for _, i, s in got] == expected[q][0]
        assert all(abs(s - d) < 1e-9 for (_, i, s), (j, d) in zip(got, expected[q][0]) if i == j)


def test_neighbours_of_few_rows(spark):
    assert nearest(frame(spark, [])) == {}
    assert nearest(frame(spark, [(100, [1.0, 0.0], 1)])) == {}
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (2, [0.0, 0.0], 1), (4, [3.0, 0.0], 1)]
    assert nearest(frame(spark, rows)) == {100: [(1, 100, 0.0)] * 2 + [(2, None, 1.0)] * 2 + [(3, 4, 2.0)] * 2}


def test_recall_on_a_driver_table(spark):
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found, expected = {}, brute_nearest(rows)
    for r in queries.op13_nearest_neighbours(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == set(expected)
    assert sum(len(found[q] & {i for i, _ in expected[q][0]}) for q in found) >= 0.95 * 10 * len(found)


def test_pruned_edges_are_relaxed_neighbours():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 5))
    edges = gi.robust_prune(x, np.arange(300), np.tile(np.arange(300), (300, 1)), 8, 1.2)
    for node in range(0, 300, 30):
        d = ((x - x[node]) ** 2).sum(axis=1)
        taken = []
        for c in sorted((c for c in range(300) if c != node), key=lambda c: d[c]):
            if all(1.44 * ((x[c] - x[t]) ** 2).sum() > d[c] for t in taken):
                taken.append(c)
        assert edges[node][edges[node] >= 0].tolist() == taken[:8]
