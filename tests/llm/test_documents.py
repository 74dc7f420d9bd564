"""The operators on documents against brute force, on odd rows and on empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fragloom.llm import _shared, block_naming, fm_classifier, line_dedup, minhash, packing, pivotal_mix, quality_rules
from fragloom.llm._shared import stored, with_row_id
from fragloom.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_counts_against_brute_force(odd_rows):
    rng = random.Random(1)
    texts = [r[1] or "" for r in odd_rows if len(r[1] or "") < 100_000] + ["".join(rng.choices("ab \n#é!A", k=rng.randrange(80))) for _ in range(300)]
    for text in texts:
        w = WORD.findall(text)
        found = dict(zip(quality_rules._COUNTS, quality_rules.text_counts(text.encode())))
        many = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if many[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert found == {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)),
        }


def test_binomial_bound():
    assert not quality_rules.refuted(0, 100, 0.01, 0.05)  # 0.99 ** 100 = 0.37
    assert quality_rules.refuted(0, 299, 0.01, 0.05) and not quality_rules.refuted(0, 298, 0.01, 0.05)
    assert quality_rules.refuted(30, 5000, 0.01, 0.01) and not quality_rules.refuted(50, 5000, 0.01, 0.01)
    assert quality_rules.refuted(100_000, 100_000_000, 0.01, 1e-9)


def test_quality_judges_and_keeps(spark, odd, empty, no_labels):
    rows = quality_rules.judge(odd, no_labels).collect()
    assert len(rows) == odd.count() and all(r["kept"] == (not r["base_failed"]) for r in rows)
    good = quality_rules.keep_good(odd, no_labels)
    assert good.columns == odd.columns and good.count() == sum(r["kept"] for r in rows)
    assert quality_rules.judge(empty, no_labels).collect() == []


def test_certified_cutoffs_hold_per_stratum(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        n = 100
        rows.append((i, "en", n, 400, rng.randrange(60, 90) if bad else rng.randrange(0, 12), 0, 0, 5, 10, False))
        labels += [(i, 0 if bad else 1)] * (1 + i % 2)
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, base_failed boolean")
    cutoffs = quality_rules.certified_cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = {r["stratum"]: r.asDict() for r in cutoffs.collect()}
    assert 12 <= found["en"]["symbols"] + 5 and found["en"]["symbols"] <= 15
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.with_verdict(measured, cutoffs).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in kept)


def test_cutoffs_against_brute_force(spark):
    """Strata of null, '' and languages, some too small; every verdict by plain Python."""
    rng = random.Random(12)
    rows, labels = [], {}
    for i in range(9000):
        stratum = rng.choice(["en", "en", "en", "de", "de", None, "", "xx" if i % 40 == 0 else "en"])
        shift = {"en": 0, "de": 30, None: 10, "": 50}.get(stratum, 0)
        n = 100
        rows.append((i, stratum, n, 400, min(99, shift + int(rng.expovariate(0.2))), rng.randrange(3), rng.randrange(30), 10, rng.randrange(60), rng.random() < 0.1))
        if rng.random() < 0.8:
            labels[i] = int(rng.random() < 0.9)
    schema = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, base_failed boolean"
    measured, marks = spark.createDataFrame(rows, schema), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    names = [c.split()[0] for c in schema.split(", ")]
    found = quality_rules.with_verdict(measured, quality_rules.certified_cutoffs(measured, marks, alpha=0.02)).collect()

    def at_most(k, n, p):  # exact, by fractions of whole numbers
        from fractions import Fraction

        q = Fraction(p).limit_denominator(100)
        return sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))

    every = [dict(zip(names, r)) for r in rows]
    good = defaultdict(list)
    for r in every:
        if not r["base_failed"] and labels.get(r["doc_id"]) == 1:
            good[r["stratum"]].append(r)
    cut = {}
    for stratum, some in good.items():
        for name, num, den in quality_rules.RULES:
            for c in quality_rules.CUTOFFS:
                k = sum(100 * r[num] > c * r[den] for r in some)
                if k > 0.02 * len(some) or at_most(k, len(some), 0.02) > 0.05 / (len(good) * len(quality_rules.RULES)):
                    break
                cut[stratum, name] = c
    assert len(good) == 5 and ("xx", "symbols") not in cut and cut["en", "symbols"] < cut["de", "symbols"] < cut["", "symbols"] and cut["en", "symbols"] < cut[None, "symbols"]
    want = {r["doc_id"]: not (r["base_failed"] or any(100 * r[num] > cut.get((r["stratum"], name), 10**9) * r[den] for name, num, den in quality_rules.RULES)) for r in every}
    assert {r["doc_id"]: r["kept"] for r in found} == want and 100 < sum(not x for x in want.values()) < 9000


@pytest.mark.parametrize("block, light", [(4096, 500), (3, 500), (40, 2)])
def test_exact_duplicates(odd, odd_rows, empty, block, light, monkeypatch):
    """light: rows up to which a block, pair or text is not heavy."""
    monkeypatch.setattr(_shared, "LIGHT", light)
    docs, rows = odd, odd_rows
    if block < 4096:
        docs, rows = odd.where("length(coalesce(text, '')) < 3000"), [r for r in odd_rows if len(r[1] or "") < 3000]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    found = block_naming.exact_duplicates(docs, block=block).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for f in found:
        by[f["text_sha256"]].append(f)
    for text, ids in groups.items():
        mine = by[sha(text)]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(f["doc_id"]) for f in mine)
        assert all(f["group_size"] == len(ids) and f["keep_id"] == best for f in mine)
        assert [f["doc_id"] for f in mine if f["kept"]] == [best]
    if block == 4096:
        left = block_naming.drop_exact_duplicates(docs)
        assert left.columns == docs.columns and left.count() == len(groups)
        assert block_naming.exact_duplicates(empty).collect() == []


def near_truth(rows):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    parts = defaultdict(list)
    for i in range(len(rows)):
        parts[find(i)].append(i)
    return sets, list(parts.values())


def near_found(docs):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(docs).collect())


def near_expected(rows):
    sets, parts = near_truth(rows)
    out = []
    for part in parts:
        least = min((rows[i][0] for i in part if rows[i][0] is not None), default=None)
        out += [(str(rows[i][0]), len(sets[i]), str(least), rows[i][0] == least) for i in part]
    return sorted(out)


def test_near_duplicates_on_a_driver_table(spark):
    """All classes of a table of the driver, by comparing all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert near_found(docs) == near_expected(rows)


@pytest.mark.parametrize("light", [500, 1])
def test_near_duplicates(odd, odd_rows, empty, light, monkeypatch):
    monkeypatch.setattr(_shared, "LIGHT", light)
    assert near_found(odd) == near_expected(odd_rows)
    assert minhash.near_duplicates(empty).collect() == []


def test_near_copies_of_copies_link_without_their_first(spark, tmp_path):
    """Copies that differ from each other too much but are linked through others, in one large group."""
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(0, 300, 12), 7):
            w[k] = f"w{i}x{k}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000 + i, " ".join(base[:100] + ["".join(rng.choices("klmnop", k=5)) for _ in range(250)])) for i in range(60)]
    rows.append((9999, " ".join(base)))
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    assert near_found(spark.read.parquet(path)) == near_expected(rows)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_of_stars_need_no_rounds(spark, monkeypatch):
    """Nothing is joined where each node is linked with one node that is the least of all it reaches; a chain still is."""
    from fragloom.llm import components as module

    def refused(_):
        raise AssertionError("a round")

    monkeypatch.setattr(module, "_least", refused)
    stars = [(v, 0) for v in range(1, 50)] + [(60, v) for v in range(61, 70)][:1] + [(0, 3), (100, 100)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert found == {v: 0 for v in range(1, 50)} | {61: 60}
    for open_links in ([(1, 2), (2, 3)], [(5, 1), (5, 2)], [(3, 2), (3, 1), (2, 1)]):
        with pytest.raises(AssertionError, match="a round"):
            components(spark.createDataFrame(open_links, "u long, v long"))


def targets(sizes, weights=(3, 1, 2)):
    """By lowering the level of those that are full, one round after the other."""
    left, out = 1.5 * sum(sizes), [0.0] * len(sizes)
    w = [weights[i % 3] for i in range(len(sizes))]
    free = set(range(len(sizes)))
    while free:
        total = sum(w[i] for i in free)
        full = {i for i in free if left * w[i] / total > 2 * sizes[i]}
        for i in full or free:
            out[i] = 2.0 * sizes[i] if full else left * w[i] / total
        left -= sum(out[i] for i in full)
        free = free - full if full else set()
    return out


def test_targets(spark):
    assert targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3]) and targets([10, 1000]) == [20.0, 1495.0]
    rng = random.Random(14)
    for sizes in ([100, 100, 100], [10, 1000], [0, 0], [], [rng.randrange(500) for _ in range(40)], [1, 1, 10**6, 5, 0, 70]):
        names = sorted({f"{rng.choice('aZ€😀')}{i}" for i in range(len(sizes) - 1)}) + [None] * bool(sizes)
        order = list(zip(names, sizes))
        rows = [(i, s, n) for i, (s, n) in enumerate(rng.sample(order, len(order)))]
        found = pivotal_mix.source_facts(spark.createDataFrame(rows, "_rid long, source string, size long"), (3, 1, 2), 1.5, 2).orderBy("src").collect()
        assert [(r["source"], r["source_size"], r["src"]) for r in found] == [(s, n, i) for i, (s, n) in enumerate(order)]
        assert [r["target"] for r in found] == pytest.approx(targets(sizes))


def test_pivotal_steps_keep_mass_and_expectation():
    rng = random.Random(7)
    for _ in range(200):
        x, y, s, t = rng.random(), rng.random(), rng.randrange(1, 50), rng.randrange(1, 50)
        mean = [0.0, 0.0]
        n = 400
        for k in range(n):
            a, b = pivotal_mix.pair(x, s, y, t, (k + 0.5) / n)
            assert abs(s * a + t * b - s * x - t * y) < 1e-6 and (a in (0, 1) or b in (0, 1)) and 0 <= a <= 1 and 0 <= b <= 1
            mean[0] += a / n
            mean[1] += b / n
        assert abs(mean[0] - x) < 0.01 and abs(mean[1] - y) < 0.01


def test_mix(odd, odd_rows, empty):
    found = pivotal_mix.mix(odd).collect()
    assert len(found) == len(odd_rows)
    by, size = defaultdict(list), lambda t: len(WORD.findall(t or ""))
    for f in found:
        by[(f["source_size"], f["target"])].append(f)
        assert f["taken"] in (0, f["size"], 2 * f["size"])
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([sizes[s] for s in order])))
    assert sorted(by) == sorted((sizes[s], goal[s]) for s in order)
    again = sorted(map(str, pivotal_mix.mix(odd.repartition(5)).drop("_rid").collect()))
    assert again == sorted(str(f) for f in pivotal_mix.mix(odd).drop("_rid").collect())
    copies = pivotal_mix.repeat_rows(odd)
    assert copies.columns == odd.columns and copies.count() == sum(f["copies"] for f in found)
    assert pivotal_mix.mix(empty).collect() == [] and pivotal_mix.repeat_rows(empty).collect() == []


def plain_mix(rows):
    """doc_id to words taken, of (doc_id, size, source): one group a source, the query's draws, step by step."""
    draw = lambda *what: (int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=6).digest()) + 0.5) / 2**48
    snap = lambda p: min((q for q in (0.0, 1.0) if abs(p - q) < 1e-9), default=p)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    whole = [sum(r[1] for r in rows if r[2] == name) for name in names]
    taken = {}
    for src, (name, have, goal) in enumerate(zip(names, whole, targets(whole))):
        docs = sorted((-r[1], r[0]) for r in rows if r[2] == name)
        rate = goal / have if have else 0.0
        sure = int(rate + 1e-9)
        taken |= {d: -s * sure for s, d in docs}
        left = [[-s, rate - sure, d, f"{d}/{-s}/1"] for s, d in docs] if rate - sure >= 1e-9 else []
        left = [x for x in left if x[0]]
        key, a = (0, src, 0), None
        for b in left[: max(0, len(left) - pivotal_mix.RESERVE)]:
            if a is not None:
                up, down = min(a[0] * (1 - a[1]), b[0] * b[1]), min(a[0] * a[1], b[0] * (1 - b[1]))
                move = up if draw(key, a[3], b[3]) * (up + down) < down else -down
                a[1], b[1] = snap(a[1] + move / a[0]), snap(b[1] - move / b[0])
            a = next((x for x in (b, a) if x and 0 < x[1] < 1), None)
        for i, x in enumerate(left):
            if not 0 < x[1] < 1:
                continue
            rest = [y for y in left[i + 1 :] if 0 < y[1] < 1]
            room, stock = sum(y[0] * (1 - y[1]) for y in rest), sum(y[0] * y[1] for y in rest)
            more, less = x[0] * (1 - x[1]), x[0] * x[1]
            rise = draw(key, x[3], "last") < x[1] if (more <= stock) == (less <= room) else more <= stock
            for y in rest:
                y[1] = snap(y[1] * max(0.0, 1 - more / stock) if rise else y[1] + (1 - y[1]) * min(1.0, less / room))
            x[1] = float(rise)
        for size, part, d, _ in left:
            taken[d] += size * int(part)
    return taken


def test_mix_against_a_plain_one(spark):
    rng = random.Random(31)
    for n, most in ((400, 60), (150, 3), (5, 900)):
        rows = [(i, rng.randrange(most) if i % 9 else 0, rng.choice(["a", "b", "€", None])) for i in rng.sample(range(10_000), n)]
        docs = spark.createDataFrame([(i, "w " * size, source) for i, size, source in rows], "doc_id long, text string, source string")
        assert {r["doc_id"]: r["taken"] for r in pivotal_mix.mix(docs).collect()} == plain_mix(rows)


def test_rounding_keeps_sums_and_expectations():
    rng = random.Random(32)
    sizes = sorted((rng.randrange(1, 200) for _ in range(80)), reverse=True)
    parts, ids, runs, reserve = [rng.uniform(0.1, 0.9) for _ in sizes], list(range(80)), 1500, 12
    want, mean = sum(s * p for s, p in zip(sizes, parts)), [0.0] * 80
    for key in range(runs):
        out = pivotal_mix.finish(sizes, pivotal_mix.settle(sizes, parts, ids, reserve, key), ids, key)
        assert set(out) <= {0.0, 1.0} and abs(sum(s * p for s, p in zip(sizes, out)) - want) <= sizes[-reserve]
        mean = [m + p / runs for m, p in zip(mean, out)]
    # Five standard deviations; the last documents, which share what is left, are moved by less than a copy.
    assert all(abs(m - p) < 0.065 for m, p in zip(mean[: -reserve - 1], parts))


def test_mix_comes_near_in_many_groups(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, "w " * rng.randrange(1, 40), f"s{min(i % 9, 5)}") for i in range(12_000)], "doc_id long, text string, source string")
    found = pivotal_mix.mix(rows).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 40 for r in found)


def test_equal_rows_are_dealt_evenly(spark, monkeypatch):
    """Rows of one id, source and size, however many, spread over groups; their ranks do not repeat, nor do reruns differ."""
    monkeypatch.setattr(_shared, "LIGHT", 100)
    rows = [(None, "w w w", "a")] * 5000 + [(3, "w w", "a")] * 50 + [(i, "w " * (i % 7), "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = with_row_id(stored(docs)).selectExpr("_rid", "doc_id", "source", "cast(length(text) as long) AS size")
    twins = pivotal_mix.with_twins(sized).collect()
    assert len(twins) == len(rows) == len({(r["doc_id"], r["source"], r["size"], r["twin"]) for r in twins})
    monkeypatch.setattr(pivotal_mix, "GROUP", 500)
    found = pivotal_mix.mix(docs).collect()
    of = defaultdict(int)
    for r in found:
        of[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 10 for (_, target), taken in of.items())


def test_encoder_is_the_library():
    import public_tokenizers as P

    encode = packing.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    rng = random.Random(9)
    letters = [*" \n\t\r  ab'sé1.,!²½ñ　中😀\x85\xa0\0\1_<|>", "'re", "<|endoftext|>", "the ", "  "]
    texts = ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(4000)]
    texts += [" ".join(rng.choice(["the", "é1", "a,", "b.", "c.\nD", "x²"]) for _ in range(rng.randrange(6))) for _ in range(2000)]
    for text, whole in zip(texts, encode.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == np.array(whole.ids, "<u4").tobytes(), repr(text)


def test_plan_covers_and_fits():
    rng = random.Random(10)
    for limit in (8, 30, 100):
        for _ in range(60):
            counts = np.zeros(limit + 1, np.int64)
            for _ in range(rng.randrange(1, 200)):
                counts[rng.randrange(1, limit + 1)] += rng.randrange(1, 9)
            used = np.zeros_like(counts)
            sequences = 0
            for pattern, times in packing.plan(counts, limit):
                assert sum(pattern) <= limit and times > 0
                sequences += times
                for x in pattern:
                    used[x] += times
            assert (used == counts).all()
            weight = int((counts * np.arange(limit + 1)).sum())
            assert sequences <= 1.25 * max(-(-weight // limit), int(counts[limit // 2 + 1 :].sum())) + 1


def test_sums_against_brute_force():
    """A gap is filled if, and only if, one to three lengths that are left sum to it."""
    rng = random.Random(13)
    for _ in range(150):
        limit = rng.randrange(6, 24)
        index = packing.SumIndex(np.array([0] + [rng.choice([0, 0, 1, 2, 3]) for _ in range(limit)]))
        for _ in range(12):
            gap = rng.randrange(1, limit + 1)
            can = any(sum(x) == gap and all(index.counts[v] >= x.count(v) for v in x) for k in (1, 2, 3) for x in itertools.combinations_with_replacement(range(1, limit + 1), k))
            found = index.fill(gap)
            assert (found is not None) == can
            for v in found or [int(x) for x in np.flatnonzero(index.counts)[:1]]:
                index.counts[v] -= 1
            if found:
                assert sum(found) == gap
            assert (index.counts >= 0).all()


def test_pack(odd, odd_rows, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = [(900, "x <|endoftext|> y"), (901, "<|endoftext|>"), (902, "plain<|endoftext|>prose, it is.")]
    assert 50256 in tokenizer.encode(special[0][1], add_special_tokens=False).ids
    docs = odd.where("coalesce(doc_id, 0) <> 11").select("doc_id", "text")
    docs = docs.unionByName(docs.sparkSession.createDataFrame(special, "doc_id long, text string"))
    expected = Counter()
    for r in [*odd_rows, *special]:
        if r[0] != 11:
            ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
            start, end, piece = 0, len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048, 0
            while start < len(ids):
                expected[(r[0], piece, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
                start, end, piece = end, end + 2048, piece + 1
    found = packing.pack(docs).collect()
    assert Counter((f["doc_id"], f["piece"], f["start"], f["length"], f["ids_crc32"]) for f in found) == expected
    by = defaultdict(list)
    for f in found:
        by[f["sequence_id"]].append((f["offset"], f["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(f["length"] for f in found) // 2048) + 2
    assert packing.pack(empty).collect() == []


@pytest.mark.parametrize("light", [10**6, 2])
def test_line_dedup(spark, empty, tmp_path, monkeypatch, light):
    """light: rows up to which a key is not heavy."""
    monkeypatch.setattr(_shared, "LIGHT", light)
    rng = random.Random(11)
    shared = [f"  This line number {i} is Shared by many\t" for i in range(6)]
    rows = [(i, "\n".join(rng.choice([*shared, "short", f"own line of document {i} here", shared[0].upper()]) for _ in range(rng.randrange(1, 140)))) for i in range(40)]
    rows += [(7, rows[7][1]), (None, "\n".join(shared)), (50, None), (51, ""), (52, "\n\n"), (53, shared[1] + "\n" + shared[1])]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and d != max((h for h in holders[key(x)] if h is not None)))]
        out.append((str(d), len(lines), len(lines) - len(stay), "\n".join(stay)))
    found = [(str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(spark.read.parquet(path)).collect()]
    assert sorted(found) == sorted(out)
    assert line_dedup.line_dedup(empty).collect() == []


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_bitmaps_are_sparse_and_exact(spark, monkeypatch, most):
    """Long texts with few lines to drop; bitmaps broadcast and joined."""
    monkeypatch.setattr(line_dedup, "BITMAP_BYTES", most)
    common = "a line that is in all of the documents"
    texts = [[f"own line {i} of the document {d}" for i in range(9000)] for d in range(4)]
    for d in range(4):
        for place in (0, 63, 64, 4000, 8999)[: d + 2]:
            texts[d][place] = common
    docs = spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(texts)], "doc_id long, text string")
    bitmaps = {r["doc"]: r["dropped"] for r in line_dedup.keep_bitmaps(docs.withColumnRenamed("doc_id", "doc")).collect()}
    assert {d: [w["word"] for w in b] for d, b in bitmaps.items()} == {0: [0], 1: [0, 1], 2: [0, 1, 62]}
    for r in line_dedup.line_dedup(docs).collect():
        want = texts[r["doc_id"]] if r["doc_id"] == 3 else [x for x in texts[r["doc_id"]] if x != common]
        assert r["kept_text"] == "\n".join(want) and r["n_lines"] == 9000


def test_line_dedup_takes_odd_rows(odd, odd_rows):
    assert line_dedup.line_dedup(odd).count() == len(odd_rows)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=fm_classifier.SIZE), rng.normal(size=(fm_classifier.SIZE, 3))
    numbers, values = np.array([1, 5, 9, 2]), np.array([0.5, 1.0, 2.0, 0.1])
    z = 0.3 + (w[numbers] * values).sum() + sum(v[a] @ v[b] * x * y for i, (a, x) in enumerate(zip(numbers, values)) for b, y in zip(numbers[i + 1 :], values[i + 1 :]))
    got = fm_classifier.Machine(0.3, w, v).score(numbers, values, np.array([0, 4]))
    assert abs(got[0] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_classifier_takes_odd_rows(odd, odd_rows, empty, no_labels):
    rows = fm_classifier.classify(odd, no_labels).collect()
    assert len(rows) == len(odd_rows) and {r["score"] for r in rows} == {0.5}
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert fm_classifier.classify(empty, no_labels).collect() == []


def test_fit_does_not_follow_the_files(spark, tmp_path):
    """Scores are the same whatever the number of files; repeated rows of a document count once."""
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choices(["good", "text", "fine"] if i % 3 else ["spam", "buy", "$$$"], k=30)) + f" {i}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    seen = []
    for n, repeat in ((1, 1), (5, 1), (3, 4)):
        docs = spark.createDataFrame(rng.sample(rows * repeat, len(rows) * repeat), "doc_id long, text string").repartition(n)
        docs.write.parquet(f"{tmp_path}/{n}")
        seen.append({r["doc_id"]: r["score"] for r in fm_classifier.classify(spark.read.parquet(f"{tmp_path}/{n}"), labels).collect()})
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) > 100


def test_fit_against_plain_loops(monkeypatch):
    """The same steps with the pairs written out and no matrices."""
    monkeypatch.setattr(fm_classifier, "SIZE", 7)
    monkeypatch.setattr(fm_classifier, "FACTORS", 2)
    monkeypatch.setattr(fm_classifier, "EPOCHS", 3)
    monkeypatch.setattr(fm_classifier, "BATCH", 4)
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(7, 3, replace=False)), rng.random(3), int(rng.random() < 0.5)) for _ in range(10)]
    got = fm_classifier.fit(rows)
    ys = [r[2] for r in rows]
    rate = (sum(ys) + 0.5) / (len(ys) + 1)
    draw = np.random.default_rng(fm_classifier.SEED)
    w, v, w0 = [0.0] * 7, draw.normal(0, 0.02, (7, 2)).astype(np.float32).tolist(), math.log(rate / (1 - rate))
    gw, gv, g0 = [1e-2] * 7, [[1e-2] * 2 for _ in range(7)], 1e-2
    for _ in range(3):
        order = draw.permutation(10)
        for at in range(0, 10, 4):
            part = [rows[i] for i in order[at : at + 4]]
            dw, dv, d0 = [fm_classifier.DECAY * x for x in w], [[fm_classifier.DECAY * x for x in row] for row in v], 0.0
            for numbers, values, y in part:
                x = dict(zip(map(int, numbers), map(float, values)))
                z = w0 + sum(w[i] * a for i, a in x.items()) + sum(sum(v[i][f] * v[j][f] for f in range(2)) * x[i] * x[j] for i in x for j in x if i < j)
                g = (1 / (1 + math.exp(-z)) - y) / len(part)
                d0 += g
                for i, a in x.items():
                    dw[i] += g * a
                    for f in range(2):
                        dv[i][f] += g * a * sum(v[j][f] * x[j] for j in x if j != i)
            g0 += d0 * d0
            w0 -= fm_classifier.RATE * d0 / math.sqrt(g0)
            for i in range(7):
                gw[i] += dw[i] ** 2
                w[i] -= fm_classifier.RATE * dw[i] / math.sqrt(gw[i])
                for f in range(2):
                    gv[i][f] += dv[i][f] ** 2
                    v[i][f] -= fm_classifier.RATE * dv[i][f] / math.sqrt(gv[i][f])
    assert got.w0 == pytest.approx(w0, abs=1e-3) and got.w == pytest.approx(w, abs=1e-3) and got.v == pytest.approx(np.array(v), abs=1e-3)


def test_classifier_on_held_out_rows(spark):
    """Accuracy on the fold that training does not read."""
    folder = "/root/testdata/sf0.01"
    scored = fm_classifier.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = scored.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9


def test_one_row_of_a_component_stays(spark):
    """Whatever the ids are: null, equal or different."""
    base = [f"word{i}" for i in range(200)]
    near = lambda k: " ".join(base[:k] + ["changed"] + base[k + 1 :])
    rows = [(None, near(3)), (None, near(50)), (None, near(150)), (5, near(90)), (5, near(120)), (6, "other text of its own"), (6, "other text of its own"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in minhash.drop_near_duplicates(docs).collect()]
    assert sorted(i for i, t in left if t and "word1" in t) == [5] and sum(t == rows[5][1] for _, t in left) == 1 and len(left) == 4
    assert minhash.drop_near_duplicates(spark.createDataFrame(rows[:3], "doc_id long, text string")).count() == 1


def test_heavy_blocks_spread_over_tasks(spark, monkeypatch):
    """A block that most rows have: names are right and no task of the naming gets its rows."""
    monkeypatch.setattr(_shared, "LIGHT", 10)
    monkeypatch.setattr(_shared, "HEAVY", 50)
    monkeypatch.setattr(block_naming, "heavy_limit", _shared.heavy_limit)
    texts = ["hot block"] * 3000 + [f"text {i % 40}" for i in range(400)] + ["hot block and more"] * 700
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    sizes = Counter(texts)
    for r in block_naming.exact_duplicates(docs, block=4).collect():
        text = texts[r["doc_id"]]
        assert r["group_size"] == sizes[text] and r["keep_id"] == max(i for i, t in enumerate(texts) if t == text) if r["doc_id"] % 50 == 0 else r["group_size"] == sizes[text]
