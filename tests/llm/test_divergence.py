"""The divergence audit against brute force in Python's whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fragloom.llm import divergence as dv

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    """Of (text, lang, source)."""
    have, groups, rows = defaultdict(Counter), defaultdict(Counter), [(t or "", a or "", s or "") for t, a, s in docs]
    counted = [(a, s, Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(LOWER)))) for t, a, s in rows]
    for a, s, c in counted:
        have[a].update(c.keys())
        groups[a, s].update(c)
    out = []
    for lang in {a for a, _ in groups}:
        kept = [t for t, n in have[lang].items() if n >= 10]
        sources = sorted((s for a, s in groups if a == lang), key=lambda s: s.encode())
        count = {s: [groups[lang, s][t] for t in kept] for s in sources}
        count[None] = [sum(x) for x in zip(*(count[s] for s in sources))]
        p = {s: [1 + 10**9 * (c + 2) // (sum(n) + 2 * len(kept)) for c in n] for s, n in count.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            terms = [(f(x, q), t) for x, q, t, n in zip(p[s], p[None], kept, count[s]) if n and x > q]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= 10]
    return sorted(out)


def made(rng):
    words = ["".join(rng.choices("abcdeé中", k=rng.randrange(1, 4))) for _ in range(120)]
    docs = []
    for i in range(700):
        lang = rng.choice(["en", "en", "de", None, "fr"])
        source = rng.choice(["hot"] * 6 + [f"s{k}" for k in range(14)] + [None, "S", "é", "😀", ""])
        start = sum(map(ord, source or "")) % 60 if source != "hot" else 0
        text = " ".join(rng.choices(words[start:] if rng.random() < 0.7 else words, k=rng.randrange(40)))
        docs.append((rng.choice([text, text.upper(), text.replace(" ", "7_"), None, ""]) if rng.random() < 0.2 else text, lang, source))
    return docs + [("a " * 30, "xx", "only"), ("rare words here", "yy", "a"), ("other words", "yy", "b"), (None, "yy", "c")]


def audited(spark, docs, **names):
    rows = spark.createDataFrame([(t, a, s, 1, "x") for t, a, s in docs], "text string, lang string, source string, n int, term string")
    return sorted(tuple(r) for r in dv.audit(rows).collect())


@pytest.mark.parametrize("sizes", [(7, 3, 2), (dv.CHUNK, dv.BLOCK, dv.SPAN)])
def test_audit_against_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("CHUNK", "BLOCK", "SPAN"), sizes):
        monkeypatch.setattr(dv, name, value)
    docs = made(random.Random(4))
    expected = brute(docs)
    assert len({r[:2] for r in expected}) > 60 and audited(spark, docs) == expected


def test_audit_of_nothing(spark, empty):
    assert dv.audit(empty).collect() == []
    assert audited(spark, [(None, None, None), ("", "", "a")]) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_shares_are_exact_for_large_counts():
    counts = np.array([[0, 1, 123_456_789_012, 7 * 10**14]], np.int64)
    whole = np.array([8 * 10**14 + 7], np.int64)
    assert dv.shares(counts, whole).tolist() == [[1 + 10**9 * (c + 2) // int(whole[0]) for c in counts[0].tolist()]]
    p, q = dv.shares(counts, whole), dv.shares(counts[:, ::-1].copy(), whole)
    assert dv.submatrix(p, q).tolist() == [[sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p[0], q[0]))]]


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(dv, "PIECE", 50)
    monkeypatch.setattr(dv, "HELD", 5)
    text = "Alpha beta,gamma " * 400 + "z" * 300 + " tail"
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["a", "b"]), pa.array([text, "beta"])], names=["lang", "source", "text"])
    total, docs = Counter(), Counter()
    for out in dv.count_terms(iter([batch])):
        for r in out.to_pylist():
            total[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert {k: v for k, v in total.items() if k[1]} == {("a", "alpha"): 400, ("a", "beta"): 400, ("a", "gamma"): 400, ("a", "z" * 300): 1, ("a", "tail"): 1, ("b", "beta"): 1}
    assert docs["a", "alpha"] == 1 and docs["b", "beta"] == 1 and total["a", None] == 0
